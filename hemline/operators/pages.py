"""Product pages and link pages as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.functions.pages import SiteRules, product_record, site_links
from hemline.functions.prices import price_first_number
from hemline.operators.shaping import distinct_urls


def extract_product_pages(pages: DataFrame, rules: SiteRules, html: str = "html", url: str = "url") -> DataFrame:
    """url, name, price_raw, price, materials, images, brand per page.

    A page that yields nothing becomes a row of nulls, or goes, as the shop's
    rules say.
    """
    records = pages.select(F.col(url).alias("url"), product_record(html, rules).alias("record"))
    rows = records.select(
        "url", "record.name", "record.price_raw",
        price_first_number("record.price_raw").alias("price"),
        "record.materials", "record.images", F.lit(rules.brand).alias("brand"),
    )
    return rows if rules.keep_incomplete else rows.na.drop(subset=["name", "price_raw", "materials"])


def gather_links(pages: DataFrame, rules: SiteRules, html: str = "html", order: str = "page_id") -> DataFrame:
    """Every distinct product address with the first place it was seen: a page, in the order of its unique key, and
    the place among the links of that page."""
    links = pages.select(order, site_links(html, rules).alias("links"))
    placed = links.select(order, "links", F.explode(F.array_distinct("links")).alias("url")).select(
        order, "url", (F.array_position("links", F.col("url")) - 1).cast("int").alias("place"))
    first = placed.groupBy("url").agg(F.min(order).alias("_page"), F.min_by("place", order).alias("_place"))
    return first.select("url", F.struct(F.col("_page").alias(order), F.col("_place").alias("place")).alias("position"))


def first_links(pages: DataFrame, rules: SiteRules, n: int, html: str = "html", order: str = "page_id") -> DataFrame:
    """The first ``n`` distinct product addresses in page order."""
    return gather_links(pages, rules, html, order).orderBy("position", "url").limit(n).select("url")


def distinct_links(pages: DataFrame, rules: SiteRules, html: str = "html") -> DataFrame:
    return distinct_urls(pages.select(F.explode(site_links(html, rules)).alias("url")))
