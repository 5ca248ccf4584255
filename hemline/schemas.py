"""Declared schemas, so that no read needs an inference pass."""

from pyspark.sql import types as T

_TYPES = {
    "boolean": T.BooleanType(), "string": T.StringType(), "int": T.IntegerType(),
    "bigint": T.LongType(), "double": T.DoubleType(),
}


def _schema(text: str) -> T.StructType:
    fields = [field.split() for field in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


# Forum comments, 23 fields.
FORUM_COMMENTS = _schema(
    "archived boolean, author string, author_flair_css_class string, author_flair_text string, "
    "body string, controversiality bigint, created_utc string, distinguished string, downs bigint, "
    "edited string, gilded bigint, id string, link_id string, name string, parent_id string, "
    "retrieved_on bigint, score bigint, score_hidden boolean, subreddit string, "
    "subreddit_id string, ups bigint, year int, month int"
)

# Forum submissions, 39 fields.
FORUM_SUBMISSIONS = _schema(
    "archived boolean, author string, author_flair_css_class string, author_flair_text string, "
    "created bigint, created_utc string, distinguished string, domain string, downs bigint, "
    "edited boolean, from string, from_id string, from_kind string, gilded bigint, "
    "hide_score boolean, id string, is_self boolean, link_flair_css_class string, "
    "link_flair_text string, media string, name string, num_comments bigint, over_18 boolean, "
    "permalink string, quarantine boolean, retrieved_on bigint, saved boolean, score bigint, "
    "secure_media string, selftext string, stickied boolean, subreddit string, "
    "subreddit_id string, thumbnail string, title string, ups bigint, url string, "
    "year int, month int"
)

CLEANED_PRODUCT = _schema(
    "url string, name string, sku string, price double, materials string, brand string"
)

NORMALIZED_PRODUCT = _schema(
    "source_file string, brand string, title string, description string, materials string, "
    "review_text string, product_id string, price double"
)

# The eight fields of the semicolon listing.
SEMICOLON_LISTING = _schema(
    "url string, name string, sku string, price string, size string, brand string, "
    "description string, images string"
)

PAGE = _schema("page_id bigint, url string, html string")

SCORED_TEXT = _schema("_source string, _text string")
