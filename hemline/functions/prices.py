"""Prices and the numbers made from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemline.constants import FIRST_NUMBER, LOW_QUALITY_LIMIT, NOT_PRICE
from hemline.functions.common import ColumnLike, col


def price_first_number(value: ColumnLike) -> Column:
    """First number in the text (the cleaners' rule): ``$1,299.00`` gives 1."""
    return F.regexp_extract(col(value).cast("string"), FIRST_NUMBER, 1).try_cast("double")


def price_strip(value: ColumnLike) -> Column:
    """All digits and dots read as one number (the analysis' rule): 1299."""
    return F.regexp_replace(col(value).cast("string"), NOT_PRICE, "").try_cast("double")


def proxy_cpw(price: ColumnLike, durability: ColumnLike) -> Column:
    """Cost per wear; null unless durability is positive."""
    durability = col(durability)
    return F.when(durability > 0, col(price) / durability)


def low_quality(score: ColumnLike, limit: float = LOW_QUALITY_LIMIT) -> Column:
    return col(score) <= F.lit(limit)


def level(value: ColumnLike, low: ColumnLike, high: ColumnLike) -> Column:
    """``low`` / ``mid`` / ``high`` against two cuts, ``n/a`` without a value."""
    value = col(value).cast("double")
    return (
        F.when(value.isNull() | F.isnan(value), F.lit("n/a"))
        .when(value < col(low), F.lit("low"))
        .when(value > col(high), F.lit("high"))
        .otherwise(F.lit("mid"))
    )


def cluster_name(cluster: ColumnLike, price: Column, quality: Column, durability: Column,
                 sentiment: Column) -> Column:
    """``C1 (price:low, quality:mid, durability:mid, sentiment:high)``."""
    return F.format_string(
        "C%d (price:%s, quality:%s, durability:%s, sentiment:%s)",
        col(cluster), price, quality, durability, sentiment,
    )
