"""Schema mapping, unions, duplicates and joins."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.functions.common import ColumnLike, col


def first_present(df: DataFrame, candidates: Iterable[str]) -> Column | None:
    """The first candidate that is a column of ``df``, compared with case."""
    present = set(df.columns)
    return next((F.col(f"`{name}`") for name in candidates if name in present), None)


def pick(df: DataFrame, candidates: Iterable[str], dtype: str = "string") -> Column:
    """``first_present`` cast to ``dtype``; a typed null if no candidate is there."""
    found = first_present(df, candidates)
    return F.lit(None).cast(dtype) if found is None else found.cast(dtype)


def flatten_struct(df: DataFrame, struct: str, prefix: str = "") -> DataFrame:
    """Fields of a struct as columns of their own, the struct dropped."""
    fields = df.schema[struct].dataType.names
    kept = [name for name in df.columns if name != struct]
    return df.select(*kept, *[F.col(f"{struct}.{name}").alias(prefix + name) for name in fields])


def brand_or_source(df: DataFrame) -> Column:
    """The brand column; only if the whole frame has none, the source tag."""
    return pick(df, ("brand",)) if "brand" in df.columns else pick(df, ("_source",))


def union_products(frames: Iterable[DataFrame]) -> DataFrame:
    """Frames under each other; a column missing in one is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_urls(df: DataFrame, url: str = "url", order: ColumnLike | None = None) -> DataFrame:
    """One row per address: the first by ``order``, or any of equals; any at all if no order is given.

    First the least order of each address, by a hash aggregate, then the rows that
    have it: nothing is sorted before it is combined, and a hot address sends one
    row per task.
    """
    if order is None:
        return df.dropDuplicates([url])
    place, own = col(order), df.select("*", col(order).alias("_order"))
    least = df.groupBy(F.col(url).alias("_url")).agg(F.min(place).alias("_least"))
    same = own[url].eqNullSafe(least["_url"]) & own["_order"].eqNullSafe(least["_least"])
    return own.join(least, same, "left_semi").drop("_order").dropDuplicates([url])


def first_n_distinct(df: DataFrame, n: int, url: str = "url", position: str = "position") -> DataFrame:
    """The first ``n`` distinct addresses in page order."""
    return (
        df.groupBy(url).agg(F.min(position).alias(position))
        .orderBy(position, url).limit(n)
    )


def attach_labels(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Left join on a unique key; a row without a label keeps a null."""
    return df.join(labels, key, "left")


def attach_names(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Left join onto a lookup table; Spark broadcasts it if its measured size allows."""
    return df.join(names, key, "left")


def category_lookup(df: DataFrame, column: str, table: Mapping[str, str], alias: str) -> DataFrame:
    """Exact lookup of the lower-cased value in a fixed mapping, inside the projection."""
    pairs = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    return df.withColumn(alias, F.try_element_at(pairs, F.lower(F.col(column))))


def complete_categories(summary: DataFrame, column: str, categories: Iterable[str],
                        counts: Iterable[str] = ("n",)) -> DataFrame:
    """Every category present; a missing one has count 0 and null means."""
    spark = summary.sparkSession
    listed = spark.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in categories])).alias(column))
    full = listed.join(summary, column, "left")
    return full.na.fill(0, subset=[name for name in counts if name in summary.columns])
