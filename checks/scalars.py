"""Scalar functions, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.expected import (
    PARTS, category, claim, clean, durability, first_number, price_strip,
)
from checks.inputs import (
    LISTING_SQL, PART_LISTING_SQL, POST_SQL, listing, part_listing, posts, table,
)
from checks.registry import query
from hemline.constants import H_AND_M_SYNONYMS, PATAGONIA_SYNONYMS
from hemline.functions.brands import brand_category, fill_brand, infer_brand
from hemline.functions.materials import canonical_material, material_quality_score, material_score, parse_materials
from hemline.functions.prices import level, low_quality, price_first_number, proxy_cpw
from hemline.functions.prices import price_strip as strip_price
from hemline.functions.text import (
    clean_text, compose_text, durability_score, has_claim, mentions_brand, token_count,
)
from hemline.operators.filters import drop_missing, finite_only, month_in, name_in_ci, year_between
from hemline.operators.shaping import category_lookup, flatten_struct, union_products
from hemline.plans.cleaners import clean_products_generic, clean_products_passthrough, clean_products_semicolon
from hemline.plans.forum import with_clean_text
from hemline.plans.products import normalize_frame


@query(f"""WITH posts AS ({POST_SQL}), cleaned AS (
  SELECT subreddit, {clean("concat_ws(' ', coalesce(title, ''), selftext)")} AS t FROM posts)
SELECT subreddit, count(*) AS n_posts,
       round(avg(len(string_split_regex(t, '\\s+'))), 6) AS avg_tokens
FROM cleaned WHERE len(string_split_regex(t, '\\s+')) >= 5 GROUP BY subreddit""")
def clean_text_by_source(spark, sf_dir):
    """Clean, keep five tokens or more, count per forum."""
    cleaned = with_clean_text(posts(spark, sf_dir), F.trim(compose_text("title", "selftext")))
    return (
        cleaned.groupBy("subreddit")
        .agg(F.count(F.lit(1)).alias("n_posts"),
             F.round(F.avg(token_count("text_clean")), 6).alias("avg_tokens"))
        .orderBy("subreddit")
    )


@query(f"""WITH posts AS ({POST_SQL})
SELECT id, {clean("selftext")} AS text_clean, CAST(len(string_split_regex({clean("selftext")}, '\\s+')) AS INT) AS tokens
FROM posts""")
def clean_text_rows(spark, sf_dir):
    cleaned = posts(spark, sf_dir).select("id", clean_text("selftext").alias("text_clean"))
    return cleaned.withColumn("tokens", token_count("text_clean"))


@query(f"""WITH posts AS ({POST_SQL})
SELECT id, trim(concat(coalesce(title, ''), ' ', coalesce(selftext, ''))) AS text_raw FROM posts""")
def composed_text(spark, sf_dir):
    return posts(spark, sf_dir).select("id", F.trim(compose_text("title", "selftext")).alias("text_raw"))


@query(f"""WITH listing AS ({LISTING_SQL})
SELECT doc_id, price_text, {first_number("price_text")} AS first_number, {price_strip("price_text")} AS stripped
FROM listing""")
def price_rules(spark, sf_dir):
    """The two price rules side by side."""
    return listing(spark, sf_dir, "doc_id", "price_text").select(
        "doc_id", "price_text", price_first_number("price_text").alias("first_number"),
        strip_price("price_text").alias("stripped"))


@query(f"""WITH listing AS ({LISTING_SQL}), scored AS (
  SELECT doc_id, {price_strip("price_text")} AS price, {durability("review_text")} AS d FROM listing)
SELECT doc_id, round(CASE WHEN d > 0 THEN price / d END, 6) AS proxy_cpw FROM scored""")
def cost_per_wear(spark, sf_dir):
    return listing(spark, sf_dir, "doc_id", "price_text", "review_text").select(
        "doc_id",
        F.round(proxy_cpw(strip_price("price_text"), durability_score("review_text")), 6).alias("proxy_cpw"))


@query("""SELECT l_orderkey, l_linenumber,
  CASE WHEN l_extendedprice < 20000 THEN 'low' WHEN l_extendedprice > 40000 THEN 'high' ELSE 'mid' END AS price_level,
  CASE WHEN l_discount = 0 THEN 'n/a' WHEN l_discount < 0.03 THEN 'low' WHEN l_discount > 0.07 THEN 'high' ELSE 'mid' END AS discount_level,
  l_quantity <= 4.0 AS low_quality
FROM lineitem""")
def value_levels(spark, sf_dir):
    discount = F.when(F.col("l_discount") != 0, F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        level("l_extendedprice", F.lit(20000.0), F.lit(40000.0)).alias("price_level"),
        level(discount, F.lit(0.03), F.lit(0.07)).alias("discount_level"),
        low_quality("l_quantity").alias("low_quality"))


@query(f"WITH {PARTS} SELECT l.doc_id, l.materials, round(q.quality, 6) AS quality FROM listing l LEFT JOIN quality q USING (doc_id)")
def material_quality(spark, sf_dir):
    return listing(spark, sf_dir, "doc_id", "materials").select(
        "doc_id", "materials", F.round(material_quality_score("materials"), 6).alias("quality"))


@query(f"""WITH {PARTS} SELECT doc_id, material, base, round(CAST(frac AS DOUBLE), 6) AS frac, round(CAST(score AS DOUBLE), 6) AS score
FROM scored_parts""")
def material_fractions(spark, sf_dir):
    """Every part of every composition with its share, canonical name and score."""
    parts = listing(spark, sf_dir, "doc_id", "materials").select(
        "doc_id", F.explode(parse_materials("materials")).alias("part"))
    return parts.select(
        "doc_id", "part.material", canonical_material("part.material").alias("base"),
        F.round("part.frac", 6).alias("frac"), F.round(material_score("part.material"), 6).alias("score"))


@query(f"""WITH listing AS ({LISTING_SQL})
SELECT doc_id, {durability("description")} AS durability_score, {claim("description")} AS has_claim FROM listing""")
def durability_and_claims(spark, sf_dir):
    return listing(spark, sf_dir, "doc_id", "description").select(
        "doc_id", durability_score("description").alias("durability_score"),
        has_claim("description").alias("has_claim"))


@query(f"""WITH listing AS ({LISTING_SQL}), bases AS (SELECT *, replace(lower(string_split(file_name, '/')[-1]), ' ', '') AS base FROM listing), inferred AS (
  SELECT doc_id, brand, file_name, CASE
    WHEN contains(base, 'reformation') THEN 'reformation' WHEN contains(base, 'patagonia') THEN 'patagonia'
    WHEN contains(base, 'everlane') THEN 'everlane' WHEN contains(base, 'shein') THEN 'shein'
    WHEN contains(base, 'zara') THEN 'zara' 
    WHEN contains(base, 'h&m') OR contains(base, 'hm') THEN 'h&m' END AS inferred
  FROM bases)
SELECT doc_id, inferred, coalesce(brand, inferred) AS filled, {category("brand")} AS brand_category FROM inferred""")
def brand_inference(spark, sf_dir):
    return listing(spark, sf_dir, "doc_id", "brand", "file_name").select(
        "doc_id", infer_brand("file_name").alias("inferred"), fill_brand("brand", "file_name").alias("filled"),
        brand_category("brand").alias("brand_category"))


@query(f"""WITH listing AS ({LISTING_SQL})
SELECT doc_id, CASE lower(brand) WHEN 'zara' THEN 'fast_fashion' WHEN 'everlane' THEN 'sustainable' END AS category FROM listing""")
def category_from_table(spark, sf_dir):
    rows = listing(spark, sf_dir, "doc_id", "brand")
    return category_lookup(rows, "brand", {"zara": "fast_fashion", "everlane": "sustainable"}, "category").select(
        "doc_id", "category")


@query(f"""WITH listing AS ({PART_LISTING_SQL}) SELECT url, CASE
  WHEN description LIKE '[{{%Composition%' THEN regexp_extract(description, '''Composition'': ''([^'']*)''', 1) END AS composition
FROM listing""")
def composition_texts(spark, sf_dir):
    from hemline.functions.materials import composition_from_attrs
    return part_listing(spark, sf_dir).select("url", composition_from_attrs("description").alias("composition"))


@query(f"""WITH listing AS ({PART_LISTING_SQL})
SELECT url, name, sku, {first_number("price")} AS price, size, brand, CASE
  WHEN description LIKE '[{{%Composition%' THEN regexp_extract(description, '''Composition'': ''([^'']*)''', 1) END AS materials
FROM listing""")
def cleaned_semicolon_listing(spark, sf_dir):
    return clean_products_semicolon(part_listing(spark, sf_dir))


@query(f"""WITH listing AS ({PART_LISTING_SQL})
SELECT url, name, CAST(NULL AS STRING) AS sku, {first_number("price")} AS price, description AS materials, 'Patagonia' AS brand FROM listing
UNION ALL SELECT url, name, sku, {first_number("price")}, description, 'H&M' FROM listing""")
def cleaned_generic_listings(spark, sf_dir):
    """Two shops with differing headers in one cleaned set."""
    rows = part_listing(spark, sf_dir)
    first = rows.select(F.col("url").alias("URL"), F.col("name").alias("Name"), "sku",
                        F.col("price").alias("Price"), F.col("description").alias("Description"))
    second = rows.select(F.col("url").alias("product_url"), F.col("name").alias("product_name"),
                         F.col("sku").alias("product_id"), "price",
                         F.col("description").alias("product_description"))
    return union_products([
        clean_products_generic(first, "Patagonia", PATAGONIA_SYNONYMS),
        clean_products_generic(second, "H&M", H_AND_M_SYNONYMS),
    ])


@query(f"""WITH listing AS ({PART_LISTING_SQL})
SELECT url, name, sku, CASE WHEN CAST(size AS INT) % 2 = 0 THEN CAST(replace(price, '$', '') AS DOUBLE) END AS price,
description AS materials, brand FROM listing""")
def cleaned_passthrough_listing(spark, sf_dir):
    """Every other price is a number."""
    price = F.expr("CASE WHEN int(size) % 2 = 0 THEN replace(price, '$', '') ELSE price END")
    return clean_products_passthrough(part_listing(spark, sf_dir).withColumn("price", price))


@query(f"""WITH a AS ({LISTING_SQL}), b AS ({PART_LISTING_SQL})
SELECT 'store_zara.csv' AS source_file, coalesce(brand, 'zara') AS brand, title, description, materials, review_text,
       sku AS product_id, {price_strip("price_text")} AS price FROM a
UNION ALL SELECT 'handm.csv', brand, name, description, NULL, NULL, sku, {price_strip("price")} FROM b""")
def normalized_products(spark, sf_dir):
    """Two inputs with differing headers in the normalized schema."""
    first = listing(spark, sf_dir).withColumnsRenamed({
        "brand": "seller", "price_text": "sale_price", "title": "Title", "description": "details",
        "materials": "Composition", "review_text": "Comments"}).drop("url", "file_name", "doc_id")
    second = part_listing(spark, sf_dir)
    return union_products([
        normalize_frame(first, "store_zara.csv"),
        normalize_frame(second.withColumnRenamed("brand", "store"), "handm.csv"),
    ])


@query("""SELECT o_orderkey, o_orderstatus, o_orderpriority, year(o_orderdate) AS year, month(o_orderdate) AS month
FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1999 AND month(o_orderdate) IN (1, 2, 3)
  AND lower(o_orderpriority) IN ('1-urgent', '3-medium', '5-low')""")
def period_and_name_filters(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return orders.where(
        year_between(1996, 1999) & month_in([3, 1, 2, 1])
        & name_in_ci(["1-Urgent", "3-MEDIUM", "5-Low"], "o_orderpriority"))


@query(f"""WITH listing AS ({LISTING_SQL}), texts AS (
  SELECT doc_id, coalesce(brand, '') || ' ' || description AS t FROM listing)
SELECT doc_id FROM texts WHERE regexp_matches(lower(t), '\\b(zara|h&m|everlane)\\b')""")
def brand_mentions(spark, sf_dir):
    texts = listing(spark, sf_dir, "doc_id", "brand", "description").select(
        "doc_id", F.concat(F.coalesce("brand", F.lit("")), F.lit(" "), "description").alias("t"))
    return texts.where(mentions_brand("t", ["Zara", "H&M", "Everlane"])).select("doc_id")


_RATIOS = """CASE WHEN l_discount = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l_tax = 0 THEN CAST('NaN' AS DOUBLE)
WHEN l_linenumber = 7 THEN NULL ELSE l_tax + l_discount END"""


@query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, {_RATIOS} AS ratio FROM lineitem)
SELECT 'finite' AS kept, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM r WHERE ratio IS NOT NULL AND isfinite(ratio)
UNION ALL SELECT 'present', count(*), round(sum(l_quantity), 6) FROM r WHERE ratio IS NOT NULL AND NOT isnan(ratio)""")
def missing_and_infinite(spark, sf_dir):
    """Rows left by dropping missing values, and by dropping infinities too."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_quantity", f"{_RATIOS} AS ratio")

    def summary(df, label):
        return df.agg(F.lit(label).alias("kept"), F.count(F.lit(1)).alias("n"),
                      F.round(F.sum("l_quantity"), 6).alias("quantity"))

    return union_products([
        summary(finite_only(rows, "ratio"), "finite"), summary(drop_missing(rows, "ratio"), "present")])


@query("SELECT event_id, user_id AS s_user, event_type AS s_type, round(value, 6) AS s_value FROM events")
def flattened_struct(spark, sf_dir):
    nested = table(spark, sf_dir, "events").select("event_id", F.struct(
        F.col("user_id").alias("user"), F.col("event_type").alias("type"),
        F.round("value", 6).alias("value")).alias("s"))
    return flatten_struct(nested, "s", prefix="s_")
