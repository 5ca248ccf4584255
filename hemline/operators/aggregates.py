"""Grouped summaries.

All of them are sums, counts and means, so Spark aggregates inside every map
task first: a group that holds a third of all rows still sends one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.constants import CATEGORIES, DURABLE_PHRASES, FRAGILE_PHRASES
from hemline.functions.common import ColumnLike, col, nan_to_null
from hemline.functions.prices import low_quality
from hemline.functions.text import durability_score, has_claim
from hemline.operators.filters import drop_missing
from hemline.operators.shaping import brand_or_source, complete_categories, pick, union_products

SENTIMENT_COLUMNS = ("vader_compound", "vader_pos", "vader_neg", "vader_neu")


def sentiment_by_period(scored: DataFrame, by: Iterable[str] = ("year", "month", "subreddit")) -> DataFrame:
    """Posts and the four mean scores per period and forum, in order."""
    keys = list(by)
    means = [F.avg(name).alias(name.replace("vader_", "avg_")) for name in SENTIMENT_COLUMNS]
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_posts"), *means).orderBy(*keys)


def _cpw_summary(df: DataFrame) -> DataFrame:
    """Mean and number of the costs present, per category.

    Missing costs are left to the aggregates: a filter would be pushed below
    the projection and work out every cost twice.
    """
    cost = nan_to_null("proxy_cpw")
    return df.groupBy("brand_category").agg(F.avg(cost).alias("avg_proxy_cpw"), F.count(cost).alias("n"))


def cpw_by_category(df: DataFrame) -> DataFrame:
    """Mean proxy cost per wear per brand category; nulls do not take part."""
    return _cpw_summary(df).where("brand_category is not null and n > 0").select("brand_category", "avg_proxy_cpw")


def cpw_by_category_complete(df: DataFrame, categories: Iterable[str] = CATEGORIES) -> DataFrame:
    """``cpw_by_category`` with counts and every category present."""
    return complete_categories(_cpw_summary(df), "brand_category", categories)


def claims(df: DataFrame, description: str = "description",
           quality: str = "objective_quality_score") -> DataFrame:
    """has_claim and quality of the rows that have a quality.

    A frame that already holds ``has_claim`` is taken at its word, so that the
    descriptions need not be read again.
    """
    flag = F.col("has_claim") if "has_claim" in df.columns else has_claim(description)
    return drop_missing(df.select(
        flag.alias("has_claim"), F.col(quality).alias("objective_quality_score"),
    ), "objective_quality_score")


def claim_low_quality_share(claim_rows: DataFrame) -> DataFrame:
    """Share of low quality with and without a claim."""
    flag = low_quality("objective_quality_score").cast("int")
    return claim_rows.groupBy("has_claim").agg(F.avg(flag).alias("share_low_quality"))


def claim_counts(claim_rows: DataFrame) -> DataFrame:
    return claim_rows.agg(
        F.count_if(~F.col("has_claim")).alias("n_no"), F.count_if("has_claim").alias("n_claim"))


def mean_profile(df: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """Mean of each column per key; NaN counts as missing, rows without a key go."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        *[F.avg(nan_to_null(F.col(name).cast("double"))).alias(name) for name in columns])


def brand_metrics(frames: Iterable[DataFrame]) -> DataFrame:
    """Mean price and mean sentiment per brand; a null brand is a group of its own.

    Rows of an input without a brand column fall into that group, unless no
    input has one: then the source tag takes its place.
    """
    def needed(df: DataFrame) -> DataFrame:
        texts = [F.col(name).cast("string") for name in ("brand", "_source") if name in df.columns]
        numbers = [
            nan_to_null(F.col(name).try_cast("double")).alias(name)
            for name in ("price", "vader_compound") if name in df.columns
        ]
        return df.select(*texts, *numbers)

    merged = union_products([needed(df) for df in frames])
    return merged.groupBy(brand_or_source(merged).alias("brand")).agg(
        F.avg(pick(merged, ("price",), "double")).alias("avg_price"),
        F.avg(pick(merged, ("vader_compound",), "double")).alias("avg_sentiment"))


def product_sentiment_mean(reviews: DataFrame, product: str, compound: ColumnLike) -> DataFrame:
    """Mean compound score per product over its reviews."""
    return reviews.groupBy(product).agg(
        F.avg(col(compound)).alias("sentiment_score"), F.count(F.lit(1)).alias("n_reviews"))


def product_durability_norm(reviews: DataFrame, product: str, text: ColumnLike,
                            positive=DURABLE_PHRASES, negative=FRAGILE_PHRASES) -> DataFrame:
    """(positive - negative phrase hits) per review, by product."""
    hits = durability_score(text, positive, negative)
    return reviews.groupBy(product).agg(
        (F.sum(hits) / F.count(F.lit(1))).alias("durability"), F.count(F.lit(1)).alias("n_reviews"))
