"""Text cleaning and phrase scores."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemline.constants import CLAIM_KEYWORDS, DURABLE_PHRASES, FORUM_NOISE, FRAGILE_PHRASES
from hemline.functions.common import ColumnLike, col, contains_any


def compose_text(*columns: ColumnLike) -> Column:
    """Join with one blank; a null counts as the empty text."""
    return F.concat_ws(" ", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns])


def clean_text(text: ColumnLike) -> Column:
    """Lower case, then links, addresses, handles, tags and punctuation out."""
    return F.trim(reduce(
        lambda cleaned, noise: F.regexp_replace(cleaned, noise, " "),
        FORUM_NOISE,
        F.lower(col(text)),
    ))


def token_count(text: ColumnLike) -> Column:
    """Pieces of a split at white space; the empty text has one piece."""
    return F.size(F.split(col(text), r"\s+"))


def durability_score(text: ColumnLike, positive=DURABLE_PHRASES, negative=FRAGILE_PHRASES) -> Column:
    """Distinct positive phrases present minus distinct negative ones; null gives 0."""
    lowered = F.lower(col(text))

    def hits(phrases):
        return reduce(add, [F.contains(lowered, F.lit(p)).cast("int") for p in phrases])

    return F.coalesce(hits(positive) - hits(negative), F.lit(0))


def has_claim(text: ColumnLike, keywords=CLAIM_KEYWORDS) -> Column:
    """True if any keyword occurs as a substring; null gives false."""
    return F.coalesce(contains_any(F.lower(col(text)), keywords), F.lit(False))


def mentions_brand(text: ColumnLike, brands) -> Column:
    """True if a brand occurs as a whole word, in any case."""
    words = "|".join(rf"\Q{brand.lower()}\E" for brand in brands)
    return F.lower(col(text)).rlike(rf"(?U)\b({words})\b")
