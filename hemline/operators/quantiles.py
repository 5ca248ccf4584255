"""Exact quantiles as one lazy plan at every size.

Distinct values are counted, and each falls into a range of nearby values; running totals over the ranges tell which
range holds a wanted rank.  Only that range is cut again, into ``FINE`` parts between its least and greatest value, and
only the part with the rank is put in order.  So no task orders more than a small part of the values, and what is
broadcast is one row per wanted rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hemline.functions.common import nan_to_null

COARSE = 1024       # ranges between two powers of two
FINE = 65_536


def _coarse(value: Column) -> Column:
    """A whole number that never falls as the value grows."""
    size = F.abs(value)
    power = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(size)).cast("double")))
    part = F.floor((size / F.pow(F.lit(2.0), power) - 1.0) * COARSE)
    place = (power + 1100) * COARSE + F.greatest(F.lit(0), F.least(F.lit(COARSE - 1), part))
    return F.when(size == 0, 0).otherwise(F.signum(value) * place).cast("long")


def _fine(value: Column, low: Column, high: Column) -> Column:
    return F.when(value >= high, FINE).otherwise(
        F.floor((value - low) / F.nullif(high - low, F.lit(0.0)) * FINE)).cast("long")


def _holding(cells: DataFrame, keys: Sequence[str], order: str, ranks: Column, *kept: str) -> DataFrame:
    """The cells (with a number ``n``) that hold a wanted rank, in ``order`` after ``before`` other values."""
    running = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    placed = cells.withColumn("upto", F.col("before") + F.sum("n").over(running))
    inside = F.filter(ranks, lambda rank: (rank >= F.col("upto") - F.col("n")) & (rank < F.col("upto")))
    return placed.select(*kept, (F.col("upto") - F.col("n")).alias("before"), F.explode(inside).alias("wanted"))


def quantile_table(df: DataFrame, columns: dict[str, Column], probabilities: Sequence[float],
                   aliases: Sequence[str]) -> DataFrame:
    """One row per column: ``feature`` and its linearly interpolated quantiles over the non-missing values."""
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("feature"), (nan_to_null(c.cast("double")) + 0.0).alias("v"))
        for name, c in columns.items()
    ])).alias("c")).select("c.*").where("v is not null")
    counts = values.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("coarse", _coarse(F.col("v")))

    ranges = counts.groupBy("feature", "coarse").agg(
        F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    ranges = ranges.select("*", F.lit(0).cast("long").alias("before"), F.sum("n").over(W.partitionBy("feature")).alias("m"))
    lower = [F.floor(p * (F.col("m") - 1)) for p in probabilities]
    upper = [F.least(rank + 1, F.col("m") - 1) for rank in lower]
    ranks = F.array_distinct(F.array(*lower, *upper))
    in_range = _holding(ranges, ["feature"], "coarse", ranks, "feature", "coarse", "low", "high", "m")

    fine = _fine(F.col("v"), F.col("low"), F.col("high"))
    keys = ["feature", "coarse", "low", "high", "m", "before", "wanted"]
    parts = counts.join(F.broadcast(in_range), ["feature", "coarse"]).groupBy(*keys, fine.alias("fine")).agg(
        F.sum("n").alias("n"))
    in_part = _holding(parts.withColumnRenamed("wanted", "rank"), ["feature", "rank"], "fine", F.array("rank"),
                       "feature", "coarse", "low", "high", "m", "fine", "rank").drop("wanted")

    few = counts.join(F.broadcast(in_part), ["feature", "coarse"]).where(fine == F.col("fine"))
    found = _holding(few, ["feature", "rank"], "v", F.array("rank"), "feature", "m", "rank", "v")

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("v")))

    def interpolated(p: float, low: Column, high: Column) -> Column:
        share = F.max(p * (F.col("m") - 1) - low)
        return at(low) + (at(high) - at(low)) * share

    known = found.groupBy("feature").agg(*[
        interpolated(p, low, high).alias(name) for p, low, high, name in zip(probabilities, lower, upper, aliases)])
    named = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(name) for name in columns])).alias("feature"))
    return named.join(known, "feature", "left")


def tercile_cuts(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """One row per column with its lower and upper cut."""
    return quantile_table(df, {name: F.col(name) for name in columns}, probabilities, ("lo", "hi"))


def quality_quartiles_by_claim(claim_rows: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """Quartile lines of quality with and without a claim."""
    quality = F.col("objective_quality_score")
    sides = {"true": F.when(F.col("has_claim"), quality), "false": F.when(~F.col("has_claim"), quality)}
    found = quantile_table(claim_rows, sides, probabilities, ("q1", "median", "q3"))
    return found.where("q1 is not null").select((F.col("feature") == "true").alias("has_claim"), "q1", "median", "q3")
