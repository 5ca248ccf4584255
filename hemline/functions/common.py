"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(value: ColumnLike) -> Column:
    """Trim every kind of white space, not blanks only."""
    return F.regexp_replace(col(value), r"(?U)^\s+|\s+$", "")


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True if any of ``words`` occurs in ``text`` as a substring."""
    return reduce(or_, [F.contains(text, F.lit(word)) for word in words], F.lit(False))


def nan_to_null(value: ColumnLike) -> Column:
    value = col(value)
    return F.when(~F.isnan(value), value)
