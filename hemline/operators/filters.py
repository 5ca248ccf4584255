"""Row filters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.constants import MIN_TOKENS
from hemline.functions.common import ColumnLike, col
from hemline.functions.text import token_count


def year_between(low: int, high: int, column: ColumnLike = "year") -> Column:
    return col(column).between(low, high)


def month_in(months: Iterable[int], column: ColumnLike = "month") -> Column:
    return col(column).isin(*sorted(set(months)))


def name_in_ci(names: Iterable[str], column: ColumnLike) -> Column:
    """Membership without regard to case."""
    return F.lower(col(column)).isin(*sorted({name.lower() for name in names}))


def min_tokens(text: ColumnLike, minimum: int = MIN_TOKENS) -> Column:
    """At least ``minimum`` pieces; a null text fails, the empty text counts one."""
    return token_count(text) >= minimum


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a null or NaN in any of ``columns`` go."""
    return df.na.drop(subset=list(columns))


def is_finite(column: ColumnLike) -> Column:
    """False for null, NaN and both infinities."""
    value = col(column).cast("double")
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def finite_only(df: DataFrame, *columns: str) -> DataFrame:
    for name in columns:
        df = df.where(is_finite(name))
    return df
