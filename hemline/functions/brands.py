"""Brand names and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemline.constants import CATEGORIES, FAST_FASHION_BRANDS, FILE_BRANDS, SUSTAINABLE_BRANDS
from hemline.functions.common import ColumnLike, col


def brand_category(brand: ColumnLike, fast=FAST_FASHION_BRANDS, sustainable=SUSTAINABLE_BRANDS) -> Column:
    """Exact match of the lower-cased brand; null for any other brand."""
    name = F.lower(col(brand))
    return (
        F.when(name.isin(*fast), F.lit(CATEGORIES[0]))
        .when(name.isin(*sustainable), F.lit(CATEGORIES[1]))
    )


def infer_brand(file_name: ColumnLike, markers=FILE_BRANDS) -> Column:
    """Brand from the base name of a file; the first marker found wins."""
    base = F.replace(F.lower(F.element_at(F.split(col(file_name), "/"), -1)), F.lit(" "), F.lit(""))
    return F.coalesce(*[F.when(F.contains(base, F.lit(mark)), F.lit(brand)) for mark, brand in markers])


def fill_brand(brand: ColumnLike, file_name: ColumnLike) -> Column:
    return F.coalesce(col(brand), infer_brand(file_name))
