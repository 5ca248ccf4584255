"""Forum posts: extract a subset, score it, summarize it."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.constants import FORUM_MONTHS, FORUM_SUBREDDITS, FORUM_YEARS, MIN_TOKENS
from hemline.functions.text import clean_text, compose_text, mentions_brand
from hemline.operators.aggregates import sentiment_by_period
from hemline.operators.filters import month_in, name_in_ci, year_between
from hemline.operators.lexicon import Lexicon, with_sentiment
from hemline.operators.shaping import flatten_struct
from hemline.schemas import FORUM_COMMENTS, FORUM_SUBMISSIONS
from hemline.sources.readers import read_json_typed, read_parquet
from hemline.sources.writers import write_csv, write_json_gzip, write_parquet_once
from hemline.valence import DEFAULT_LEXICON

TEXT = {"submissions": "selftext", "comments": "body"}
SCHEMAS = {"submissions": FORUM_SUBMISSIONS, "comments": FORUM_COMMENTS}
DETAIL = (
    "id", "subreddit", "year", "month", "title", "selftext", "text_clean",
    "vader_neg", "vader_neu", "vader_pos", "vader_compound",
)


def select_posts(df: DataFrame, years=FORUM_YEARS, months: Iterable[int] = FORUM_MONTHS,
                 subreddits: Iterable[str] = FORUM_SUBREDDITS, brands: Iterable[str] = (),
                 text: str | None = None) -> DataFrame:
    """Posts of the wanted years, months and forums; with ``brands``, only those naming one."""
    kept = df.where(year_between(*years)).where(month_in(months)).where(name_in_ci(subreddits, "subreddit"))
    return kept.where(mentions_brand(text, brands)) if brands and text else kept


def extract_forum(spark: SparkSession, sources: Mapping[str, str], output: str, years=FORUM_YEARS,
                  months: Iterable[int] = FORUM_MONTHS, subreddits: Iterable[str] = FORUM_SUBREDDITS,
                  files: int | None = None, brands: Iterable[str] = ()) -> None:
    """Write the wanted part of each given dataset (submissions, comments) as gzip JSON.

    With ``brands``, only posts whose text names one of them.
    """
    for kind, path in sources.items():
        posts = select_posts(
            read_json_typed(spark, path, SCHEMAS[kind]), years, months, subreddits, brands, TEXT[kind])
        write_json_gzip(posts, f"{output}/{kind}", files)


def read_posts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Submissions as Parquet, or as the gzip JSON that ``extract_forum`` writes."""
    return read_json_typed(spark, path, FORUM_SUBMISSIONS) if fmt == "json" else read_parquet(spark, path)


def with_clean_text(df: DataFrame, text: Column, minimum: int = MIN_TOKENS) -> DataFrame:
    """Add ``text_clean`` and keep texts of at least ``minimum`` tokens.

    The text sits in an array of one or none, so that the patterns run once per
    row: a filter would be pushed below the projection and run them again.
    Cleaned text has single blanks only, so a plain split counts its tokens.
    """
    long_enough = F.filter(F.array(clean_text(text)), lambda cleaned: F.size(F.split(cleaned, " ")) >= minimum)
    return df.select("*", F.explode(long_enough).alias("text_clean"))


def score_posts(df: DataFrame, minimum: int = MIN_TOKENS,
                lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Add text_clean and the four scores to posts with title and selftext."""
    cleaned = with_clean_text(df, F.trim(compose_text("title", "selftext")), minimum)
    return flatten_struct(with_sentiment(cleaned, "text_clean", lexicon, "vader"), "vader", prefix="vader_")


def forum_sentiment(spark: SparkSession, source: str, output: str, fmt: str = "parquet",
                    minimum: int = MIN_TOKENS, files: int | None = None,
                    lexicon: Lexicon = DEFAULT_LEXICON) -> None:
    """Write the scored posts, then the summary made from what was written.

    Reading the written scores back costs seven narrow columns; scoring every
    text a second time for the summary would cost far more.
    """
    detail = f"{output}/detailed_parquet"
    scored = score_posts(read_posts(spark, source, fmt), minimum, lexicon).select(*DETAIL)
    write_parquet_once(scored, detail, files)
    summary = sentiment_by_period(read_parquet(spark, detail, scored.schema))
    write_csv(summary, f"{output}/aggregates_csv", single=True)
