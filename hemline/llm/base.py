"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def whole_text(name: str) -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the wanted ones that clash with no column of ``df``, whatever its case."""
    taken = {name.lower() for name in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def same(left: DataFrame, right: DataFrame, names: Iterable[str]) -> Column:
    """Null-safe equality of equally named columns."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def pieces(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``text`` in parts of about ``size``, cut at spaces only."""
    at = 0
    while at < len(text):
        cut = text.find(b" ", at + size) if at + size < len(text) else -1
        cut = len(text) if cut < 0 else cut
        yield text[at:cut]
        at = cut
