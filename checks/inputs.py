"""Inputs derived from the given tables.

The tables hold no products, so every query derives its columns from whole
tables with expressions that both SQL dialects read alike; each is written
once here and used on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(key: str, values: list[str | None]) -> str:
    """One of ``values`` by the remainder of ``key``."""
    def literal(value: str | None) -> str:
        return "NULL" if value is None else "'" + value.replace("'", "''") + "'"

    cases = " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


PHRASES = [
    "Durable and well made, I recommend it.",
    "VERY good, but it ripped after a week!!",
    "Not worth it: the hole is a problem, never so good.",
    "Plain tee.",
    "Eco-friendly and organic, sturdy and robust.",
    "It fell apart and pilled, worthless.",
    "Kind of nice, at least it lasted.",
    "GREAT fit? I love it. Really, really great???",
    "This isn't a good one, sort of bad.",
    "The least good of all, :( so sad",
    "Conscious choice, long lasting; low-impact.",
]

MATERIALS = [
    "100% Organic Cotton", "60% Cotton / 40% Recycled Polyester", "100% Virgin Polyester",
    "100% Recycled Cotton", "100% Merino Wool", "Cotton, Linen", "Cotton, 50% Linen",
    "150% Wool, 50% Cotton", "cotton 100%", "50% (x), 50% Cotton", "95.5% Cotton",
    "Shell: 100% Nylon; Lining: 100% Polyester", "100", " ", None, "95% Polyester, 5% Elastane",
    "70% Polyamide+30% Spandex",
]

MARKUP = [
    "See [my fit](http://x.co/a) by /u/bob @ann <b>NICE!!</b> www.a.com", "menu/list here",
    "<div class=\"x\">A&B</div>", "https://shop.example/item?id=7 u/someone", "Plain",
]

_MIXED = "concat(CAST(n_chars % 101 AS STRING), '% Cotton, ', CAST(100 - n_chars % 101 AS STRING), '% Hemp')"

# One product per document.
LISTING = {
    "doc_id": "doc_id",
    "url": "concat('/products/', CAST(doc_id AS STRING))",
    "sku": "concat('SKU-', CAST(doc_id AS STRING))",
    "title": "concat(source, ' ', lang)",
    "brand": _pick("doc_id", ["Zara", "H&M", "SHEIN", "Patagonia", "everlane", "Reformation", "ZARA ", "ROMWE", None]),
    "file_name": "concat('data/', " + _pick("doc_id", [
        "store_zara.csv", "H M_products.csv", "h&m.csv", "handm.csv", "Patagonia_Items.csv", "everlane_products.csv",
        "reformation_products.csv", "shein sample.csv"]) + ")",
    "price_text": "CASE WHEN n_chars % 11 = 0 THEN 'n/a' WHEN n_chars % 11 = 1 THEN '1.2.3' ELSE concat("
                  "'$', CAST(CAST(floor(n_chars / 1000) AS INT) AS STRING), ',', "
                  "lpad(CAST(n_chars % 1000 AS STRING), 3, '0'), '.50 USD') END",
    "materials": f"CASE WHEN doc_id % 18 = 17 THEN {_MIXED} ELSE ({_pick('(doc_id % 18)', MATERIALS)}) END",
    "review_text": _pick("doc_id", PHRASES),
    "description": f"CASE WHEN doc_id % 10 = 9 THEN NULL ELSE concat({_pick('(doc_id + 3)', PHRASES)}, ' ', text) END",
}

# One forum post per document.
POST = {
    "id": "CAST(doc_id AS STRING)",
    "subreddit": "source",
    "year": "CAST(2022 + doc_id % 4 AS INT)",
    "month": "CAST(1 + doc_id % 12 AS INT)",
    "title": f"CASE WHEN doc_id % 7 = 6 THEN NULL ELSE ({_pick('doc_id', PHRASES)}) END",
    "selftext": f"concat(text, ' ', {_pick('(doc_id + 1)', MARKUP)})",
}

# One semicolon listing row per part.
PART_LISTING = {
    "url": "concat('https://shop.example/p-', CAST(p_partkey AS STRING))",
    "name": "p_name",
    "sku": "concat('SKU: ', CAST(p_partkey AS STRING))",
    "price": "concat('$', CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING), '.25')",
    "size": "CAST(p_size AS STRING)",
    "brand": "p_brand",
    "description": "CASE WHEN p_size % 5 = 0 THEN concat('[{''Color'': ''', p_type, '''}]') "
                   "WHEN p_size % 5 = 1 THEN concat('{''Composition'': ''', p_type, '''}') "
                   "WHEN p_size % 5 = 2 THEN '[broken' "
                   "ELSE concat('[{''Color'': ''Red''}, {''Composition'': ''', CAST(p_size AS STRING), "
                   "'% Polyester, ', p_type, '''}, {''Composition'': ''second''}]') END",
}

REVIEW = {
    "conv_id": "conv_id",
    "text": f"concat({_pick('(conv_id + turn)', PHRASES)}, ' ', text)",
}


def select_sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + f" FROM {source}"


LISTING_SQL = select_sql(LISTING, "documents")
POST_SQL = select_sql(POST, "documents")
PART_LISTING_SQL = select_sql(PART_LISTING, "part")
REVIEW_SQL = select_sql(REVIEW, "conversations")


def derived(df: DataFrame, columns: dict[str, str], *names: str) -> DataFrame:
    wanted = names or tuple(columns)
    return df.selectExpr(*[f"{columns[name]} AS {name}" for name in wanted])


def listing(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return derived(table(spark, sf_dir, "documents"), LISTING, *names)


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "documents"), POST)


def part_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "part"), PART_LISTING)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(table(spark, sf_dir, "conversations"), REVIEW)
