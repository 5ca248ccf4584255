"""Listings of single shops to the cleaned product schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.constants import H_AND_M_SYNONYMS, PATAGONIA_SYNONYMS
from hemline.functions.materials import composition_from_attrs
from hemline.functions.prices import price_first_number
from hemline.operators.shaping import pick
from hemline.sources.readers import read_csv_delimited, read_csv_strings
from hemline.sources.writers import write_parquet_overwrite


def clean_products_generic(df: DataFrame, brand: str, synonyms: Mapping[str, tuple[str, ...]]) -> DataFrame:
    """url, name, sku, price, materials, brand; a column nobody supplies is null."""
    return df.select(
        pick(df, synonyms["url"]).alias("url"),
        pick(df, synonyms["name"]).alias("name"),
        pick(df, synonyms["sku"]).alias("sku"),
        price_first_number(pick(df, synonyms["price"])).alias("price"),
        pick(df, synonyms["materials"]).alias("materials"),
        F.lit(brand).alias("brand"),
    )


def clean_products_semicolon(df: DataFrame) -> DataFrame:
    """Price parsed, composition taken from the attribute list, size kept."""
    return df.select(
        "url", "name", "sku",
        price_first_number("price").alias("price"),
        "size", "brand",
        composition_from_attrs("description").alias("materials"),
    )


def clean_products_passthrough(df: DataFrame) -> DataFrame:
    """Description stands in for materials; a price that is no number is null."""
    return df.select("url", "name", "sku", F.col("price").try_cast("double").alias("price"),
                     F.col("description").alias("materials"), "brand")


CLEANERS = {
    "hm": lambda spark, path: clean_products_generic(read_csv_strings(spark, path), "H&M", H_AND_M_SYNONYMS),
    "patagonia": lambda spark, path: clean_products_generic(
        read_csv_strings(spark, path), "Patagonia", PATAGONIA_SYNONYMS),
    "shein": lambda spark, path: clean_products_semicolon(read_csv_delimited(spark, path)),
    "zara": lambda spark, path: clean_products_passthrough(read_csv_strings(spark, path)),
}


def clean_listing(spark: SparkSession, shop: str, source: str, target: str) -> None:
    """Read one shop's listing and replace its cleaned product set."""
    write_parquet_overwrite(CLEANERS[shop](spark, source), target)
