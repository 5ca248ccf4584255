"""Sums of doubles that are the same however the rows were dealt out.

A double is a whole number times a power of two. The whole numbers of equal powers are summed as integers, which no
order can change; the few sums of a column are put together in the order of their powers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = 18          # of a limb; a sum of 2**45 limbs still fits


def _two_to(power: Column) -> Column:
    return F.pow(F.lit(2.0), power.cast("double"))


def exact_sums(df: DataFrame, values: dict[str, Column], weight: Column | None = None) -> DataFrame:
    """(name, sum, n, low, high) over the finite values of each name that has any.

    Counts and limbs are combined in the map tasks, a row for each name and power of two. A row with a ``weight``
    counts as so many equal rows.
    """
    names = list(values)
    times = F.lit(1).cast("long") if weight is None else weight
    value = F.col("x")
    power = F.when(value == 0, 0).otherwise(F.greatest(F.lit(-900), F.floor(F.log2(F.abs(value))) - 1)).cast("int")
    whole = (value * _two_to(52 - F.col("power"))).cast("long")
    low_bits = (1 << _BITS) - 1
    cells = (
        df.select(F.posexplode(F.array(*[column.cast("double") for column in values.values()])).alias("nth", "x"), times.alias("times"))
        .where(F.abs(value) < float("inf")).withColumn("power", power).withColumn("whole", whole)
        .groupBy("nth", "power").agg(
            F.sum(F.col("whole").bitwiseAND(low_bits) * F.col("times")).alias("a"),
            F.sum(F.shiftright("whole", _BITS).bitwiseAND(low_bits) * F.col("times")).alias("b"),
            F.sum(F.shiftright("whole", 2 * _BITS) * F.col("times")).alias("c"),
            F.sum("times").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
        .select(F.get(F.array(*map(F.lit, names)), F.col("nth")).alias("name"), "*")
    )
    part = ((F.col("c") * F.lit(2.0 ** (2 * _BITS)) + F.col("b") * F.lit(2.0 ** _BITS) + F.col("a"))
            * _two_to(F.col("power") - 52))
    return cells.groupBy("name").agg(
        F.aggregate(F.sort_array(F.collect_list(F.struct("power", part.alias("part")))), F.lit(0.0),
                    lambda total, cell: total + cell["part"]).alias("sum"),
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _by_name(df: DataFrame, value: Column) -> Column:
    return df.agg(F.map_from_entries(F.collect_list(F.struct("name", value.alias("value"))))).scalar()


def moments(df: DataFrame, columns: list[str], weight: str | None = None) -> Column:
    """A scalar subquery: the mean and population deviation of each column that has a value, by name.

    The deviation is summed around the mean, in a second scan; that of a constant column is 0.
    """
    times = None if weight is None else F.col(weight)
    constant = F.col("low") == F.col("high")
    mean = F.when(constant, F.col("low")).otherwise(F.col("sum") / F.col("n"))
    first = _by_name(exact_sums(df, {name: F.col(name) for name in columns}, times),
                     F.struct(mean.alias("mean"), constant.alias("constant")))
    placed = df.select("*", first.alias("_first"))
    second = exact_sums(placed, {
        name: F.pow(F.col(name) - F.try_element_at("_first", F.lit(name))["mean"], F.lit(2.0)) for name in columns}, times)
    own = F.try_element_at("_first", F.col("name"))
    deviation = F.when(own["constant"], 0.0).otherwise(F.sqrt(F.col("sum") / F.col("n")))
    return _by_name(second.select("*", first.alias("_first")), F.struct(own["mean"].alias("mean"), deviation.alias("deviation")))
