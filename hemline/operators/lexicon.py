"""Sentiment with a lexicon that is a mapping or a table of any size."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.functions.common import ColumnLike, col
from hemline.functions.sentiment import PLAN_BUCKETS, bucket_of, lexicon_sentiment, sentiment_words
from hemline.valence import DEFAULT_LEXICON

HELD_TERMS = 500_000        # terms that every task may hold, some 50 MB
BUCKETS = 16                # of the terms of one text

Lexicon = Mapping[str, float] | DataFrame

log = logging.getLogger(__name__)


def lexicon_entries(lexicon: DataFrame) -> DataFrame:
    """(term, valence) with one row per term, the least valence if there are several."""
    return lexicon.where("term IS NOT NULL AND valence IS NOT NULL").groupBy("term").agg(
        F.min(F.col("valence").cast("double")).alias("valence"))


def lexicon_column(entries: DataFrame) -> Column:
    """The whole table as one value (a scalar subquery): an array of maps, each term in that of its checksum."""
    maps = entries.groupBy(bucket_of(F.col("term"), PLAN_BUCKETS).alias("bucket")).agg(
        F.map_from_entries(F.collect_list(F.struct("term", "valence"))).alias("terms"))
    whole = maps.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "terms"))).alias("m"))
    places = F.sequence(F.lit(0), F.lit(PLAN_BUCKETS - 1))
    return whole.select(F.transform(places, lambda b: F.try_element_at(F.col("m"), b)).alias("maps")).scalar()


def score_with_lexicon_table(df: DataFrame, text: ColumnLike, lexicon: DataFrame, alias: str = "sentiment",
                             first_context: bool = True, held_terms: int = HELD_TERMS) -> DataFrame:
    """Add the scores by a lexicon table (term, valence).

    A table of up to ``held_terms`` terms, which are counted, becomes one value
    that every task has: texts are read and cut once and nothing is shuffled.
    Beyond that the distinct words of each text are joined to it, without the
    text, and each text meets only its own terms; texts are told apart by their
    digest, so no key is needed and equal texts are looked up once.
    """
    text, entries = col(text), lexicon_entries(lexicon)
    if entries.count() <= held_terms:
        with_table = df.withColumn("_lexicon", lexicon_column(entries))
        return with_table.withColumn(alias, lexicon_sentiment(text, F.col("_lexicon"), first_context)).drop("_lexicon")
    keyed = df.withColumn("_text", F.sha2(text.cast("binary"), 256))
    words = keyed.select("_text", F.explode(F.array_distinct(F.transform(sentiment_words(text), F.lower))).alias("term"))
    found = (
        words.join(entries.withColumn("bucket", bucket_of(F.col("term"), BUCKETS)), "term")
        .groupBy("_text").agg(F.collect_set(F.struct("bucket", "term", "valence")).alias("_terms"))
    )
    buckets = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.map_from_entries(F.transform(
        F.filter(F.col("_terms"), lambda entry: entry["bucket"] == b),
        lambda entry: F.struct(entry["term"], entry["valence"]),
    )))
    return keyed.join(found, "_text", "left").withColumn(
        alias, lexicon_sentiment(text, buckets, first_context, BUCKETS)).drop("_text", "_terms")


def with_sentiment(df: DataFrame, text: ColumnLike, lexicon: Lexicon = DEFAULT_LEXICON, alias: str = "sentiment") -> DataFrame:
    """Add ``struct<neg, neu, pos, compound>`` by a mapping or a table."""
    if isinstance(lexicon, DataFrame):
        return score_with_lexicon_table(df, text, lexicon, alias)
    if lexicon is DEFAULT_LEXICON:
        log.warning("scored with the short built-in list of %d words; give a full lexicon for real use", len(lexicon))
    return df.withColumn(alias, lexicon_sentiment(text, lexicon))
