"""Readers and writers, checked by writing whole tables and reading them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.expected import DEFAULT_LEXICON, ENRICHED, clean, price_strip, sentiment
from checks.inputs import LISTING_SQL, PART_LISTING_SQL, POST_SQL, listing, part_listing, posts, table
from checks.registry import query
from checks.statistics import exact_p
from hemline.operators.correlation import pearson, with_p_value
from hemline.operators.shaping import pick
from hemline.plans.brand_report import brand_report
from hemline.plans.cleaners import clean_listing
from hemline.plans.forum import extract_forum, forum_sentiment, select_posts
from hemline.plans.products import normalize_products
from hemline.plans.research import research_analysis
from hemline.plans.texts import batch_sentiment
from hemline.schemas import CLEANED_PRODUCT, FORUM_COMMENTS, FORUM_SUBMISSIONS
from hemline.session import scratch_path
from hemline.sources.readers import (
    read_csv_delimited, read_csv_inferred, read_json_typed, read_optional, read_parquet, with_source_file,
)
from hemline.sources.writers import (
    append_csv, append_parquet, run_tagged_path, write_csv, write_json_gzip, write_metrics,
    write_parquet_once, write_parquet_overwrite,
)


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_inferred(spark, sf_dir):
    path = scratch_path(spark, "csv")
    write_csv(table(spark, sf_dir, "part"), path)
    return read_csv_inferred(spark, path).withColumn("p_partkey", F.col("p_partkey").cast("bigint"))


@query(f"SELECT url, name || ' é' AS name, sku, price, size, brand, description FROM ({PART_LISTING_SQL})")
def csv_delimited_latin(spark, sf_dir):
    """Semicolons and ISO-8859-1."""
    path = scratch_path(spark, "semicolon")
    rows = part_listing(spark, sf_dir).withColumn("name", F.concat("name", F.lit(" é")))
    rows.write.option("sep", ";").option("header", True).option("encoding", "iso-8859-1").csv(path)
    return read_csv_delimited(spark, path)


def _comments(spark, sf_dir):
    """Orders in the declared schema of forum comments, their dates as year and month."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("body"),
        F.col("o_orderpriority").alias("subreddit"), F.col("o_custkey").alias("score"),
        F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return rows.select(*[pick(rows, (f.name,), f.dataType).alias(f.name) for f in FORUM_COMMENTS])


@query("""SELECT CAST(o_orderkey AS STRING) AS id, o_orderstatus AS body, o_orderpriority AS subreddit, o_custkey AS score,
year(o_orderdate) AS year, month(o_orderdate) AS month FROM orders
WHERE year(o_orderdate) BETWEEN 1996 AND 1998 AND month(o_orderdate) IN (1, 2, 3, 6) AND lower(o_orderpriority) IN ('1-urgent', '5-low')""")
def forum_comments_extract(spark, sf_dir):
    """Partitioned JSON with a declared schema, filtered, written as gzip JSON, read again."""
    source, output = scratch_path(spark, "comments"), scratch_path(spark, "extract")
    write_json_gzip(_comments(spark, sf_dir), source, partition_by=("year", "month"))
    extract_forum(spark, {"comments": source}, output, (1996, 1998), [1, 2, 3, 6, 1], ["1-Urgent", "5-low"], files=2)
    return read_json_typed(spark, f"{output}/comments", FORUM_COMMENTS).select(
        "id", "body", "subreddit", "score", "year", "month")


@query(f"""SELECT id, title, selftext, subreddit, year, month FROM ({POST_SQL})
WHERE year BETWEEN 2023 AND 2024 AND month IN (1, 2, 3) AND lower(subreddit) IN ('src0', 'src1', 'src2', 'src3')
AND regexp_matches(lower(concat(coalesce(title, ''), ' ', selftext)), '\\b(plain|organic)\\b')""")
def forum_submissions_with_brand(spark, sf_dir):
    """Submissions of some forums that name one of the wanted words."""
    rows = posts(spark, sf_dir).withColumn("t", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), "selftext"))
    return select_posts(rows, subreddits=["SRC0", "src1", "src2", "src3"], brands=["Plain", "organic"], text="t").drop("t")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, 'check' AS run FROM customer")
def parquet_once_with_run(spark, sf_dir):
    """Parquet in a run folder, read back with the run as a column."""
    base = scratch_path(spark, "runs")
    write_parquet_once(table(spark, sf_dir, "customer"), run_tagged_path(base, "check"), files=4)
    return read_parquet(spark, base)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def parquet_overwrite(spark, sf_dir):
    path = scratch_path(spark, "overwrite")
    write_parquet_overwrite(table(spark, sf_dir, "customer"), path)
    write_parquet_overwrite(table(spark, sf_dir, "supplier"), path)
    return read_parquet(spark, path)


@query("SELECT event_id, user_id, event_type, value FROM events UNION ALL SELECT event_id, user_id, event_type, value FROM events")
def appended_batches(spark, sf_dir):
    """Two batches in one growing folder, as Parquet."""
    path = scratch_path(spark, "append")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    append_parquet(rows, path)
    append_parquet(rows, path)
    return read_parquet(spark, path, rows.schema)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def appended_csv_batches(spark, sf_dir):
    path = scratch_path(spark, "append-csv")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    append_csv(rows, path)
    append_csv(rows, path)
    return read_csv_inferred(spark, path, rows.schema)


@query(f"""SELECT url, name, sku, CAST(NULL AS DOUBLE) AS price, description AS materials, brand FROM ({PART_LISTING_SQL})""")
def optional_inputs(spark, sf_dir):
    """One readable input among paths that do not exist."""
    path = scratch_path(spark, "optional")
    write_parquet_overwrite(part_listing(spark, sf_dir).select(
        "url", "name", "sku", F.lit(None).cast("double").alias("price"),
        F.col("description").alias("materials"), "brand"), path)
    return read_optional(spark, [path + "-absent", path], read_parquet, CLEANED_PRODUCT)


@query("SELECT r_regionkey, r_name, 'region.parquet' AS source_file FROM region")
def source_files(spark, sf_dir):
    return with_source_file(table(spark, sf_dir, "region").select("r_regionkey", "r_name", "_metadata")).drop("_metadata")


def _text_files(spark, sf_dir):
    """Posts as quoted CSV, comments as another, a third without any text column."""
    base = scratch_path(spark, "texts")
    write_csv(posts(spark, sf_dir).select("id", "title", "selftext"), f"{base}/posts")
    write_csv(table(spark, sf_dir, "conversations").select("conv_id", F.col("text").alias("body")), f"{base}/turns")
    write_csv(table(spark, sf_dir, "nation"), f"{base}/nation")
    return [f"{base}/posts", f"{base}/turns", f"{base}/nation"]


@query(f"""WITH posts AS ({POST_SQL}), bodies AS (
  SELECT 'p' || id AS key, concat(coalesce(title, ''), ' ', selftext) AS body FROM posts
  UNION ALL SELECT 't' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING), text FROM conversations), {
  sentiment("SELECT key, body FROM bodies", DEFAULT_LEXICON)}
SELECT 'csv' AS _source, t.body AS _text, neg AS vader_neg, pos AS vader_pos, compound AS vader_compound FROM texts t JOIN sentiment USING (key)""")
def batch_text_sentiment(spark, sf_dir):
    """Present text columns of several CSV files, joined and scored."""
    scored = batch_sentiment(spark, _text_files(spark, sf_dir), multiline=True)
    return scored.withColumn("_source", F.regexp_extract("_source", "[.]([a-z]+)$", 1))


@query("""SELECT brand, round(avg(price), 6) AS avg_price, round(avg(c), 6) AS avg_sentiment FROM (
  SELECT p_brand AS brand, p_retailprice AS price, CAST(NULL AS DOUBLE) AS c FROM part
  UNION ALL SELECT NULL, NULL, value FROM events) GROUP BY brand""")
def brand_report_from_files(spark, sf_dir):
    """A Parquet folder of products, a CSV of scores, and a path that is not there."""
    base = scratch_path(spark, "brands")
    write_parquet_overwrite(table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price")), f"{base}/products")
    write_csv(table(spark, sf_dir, "events").select(
        F.col("event_type").alias("_source"), F.col("value").alias("vader_compound")), f"{base}/scores.csv")
    report = brand_report(spark, [f"{base}/products", f"{base}/scores.csv", f"{base}/absent"])
    return report.select(
        "brand", F.round("avg_price", 6).alias("avg_price"), F.round("avg_sentiment", 6).alias("avg_sentiment"))


@query(f"""WITH {exact_p("SELECT corr(quality, toxic) AS r, count(*) AS n FROM labels")},
c AS (SELECT corr(l_quantity, l_discount) AS c FROM lineitem)
SELECT 'pearson(objective_quality_score, sentiment_score): r=' || printf('%.4f', r) || ', p=' || format('{{:.4g}}', p)
    || ', n=' || CAST(n AS STRING) AS value FROM s, exact
UNION ALL SELECT 'point_biserial(has_claim, objective_quality_score) = ' || printf('%.4f', c) FROM c""")
def metrics_file(spark, sf_dir):
    """Metrics as two lines of text."""
    path = scratch_path(spark, "metrics")
    claims = table(spark, sf_dir, "lineitem").agg(F.corr("l_quantity", "l_discount").alias("claims_r")).scalar()
    summary = with_p_value(pearson(table(spark, sf_dir, "labels"), "quality", "toxic"))
    write_metrics(summary.withColumn("claims_r", claims), path)
    return spark.read.text(path)


@query("""SELECT 'u' || CAST(p_partkey AS STRING) AS url, p_name AS name, '00' || CAST(p_partkey AS STRING) AS sku,
CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END AS price, p_type AS materials, p_brand AS brand FROM part""")
def cleaned_listing_files(spark, sf_dir):
    """A listing written as CSV and cleaned: keys keep their zeros, a price that is no number is null."""
    source, target = scratch_path(spark, "listing"), scratch_path(spark, "cleaned")
    part = table(spark, sf_dir, "part").selectExpr(
        "concat('u', p_partkey) AS url", "p_name AS name", "concat('00', p_partkey) AS sku",
        "CASE WHEN p_size % 3 = 0 THEN 'ask' ELSE string(p_retailprice) END AS price", "p_type AS description", "p_brand AS brand")
    write_csv(part, source)
    clean_listing(spark, "zara", source, target)
    return spark.read.parquet(target)


def _put_csv(df, path):
    """As ``write_csv`` does, but a blank at the end of a value stays."""
    df.write.option("header", True).option("escape", '"').option("ignoreTrailingWhiteSpace", False).csv(path)


@query(f"""SELECT 'listing_zara.csv' AS source_file, coalesce(brand, 'zara') AS brand, title, sku AS product_id,
{price_strip("price_text")} AS price FROM ({LISTING_SQL})""")
def normalized_product_files(spark, sf_dir):
    """Listings read from CSV, a missing one skipped, a missing brand taken from the file name."""
    path = f"{scratch_path(spark, 'products')}/listing_zara.csv"
    rows = listing(spark, sf_dir, "brand", "title", "sku", "price_text").withColumnsRenamed({"price_text": "price"})
    _put_csv(rows, path)
    return normalize_products(spark, [path, f"{path}.absent"]).select("source_file", "brand", "title", "product_id", "price")


_FORUM = f"""posts AS ({POST_SQL}), wanted AS (SELECT * FROM posts WHERE year BETWEEN 2023 AND 2024 AND month IN (1, 2, 3)
AND lower(subreddit) IN ('src0', 'src1', 'src2', 'src3') AND regexp_matches(lower(selftext), '\\b(someone|great)\\b'))"""


@query(f"""WITH {_FORUM}, cleaned AS (
  SELECT id, subreddit, year, month, {clean("concat(coalesce(title, ''), ' ', coalesce(selftext, ''))")} AS t FROM wanted), {
  sentiment("SELECT id AS key, t AS body FROM cleaned WHERE len(string_split_regex(t, '\\s+')) >= 5", DEFAULT_LEXICON)}
SELECT year, month, subreddit, count(*) AS n_posts, round(avg(compound), 9) AS avg_compound FROM cleaned JOIN sentiment ON id = key GROUP BY ALL""")
def forum_job(spark, sf_dir):
    """Submissions that name a brand, extracted, scored and summarized by the two jobs, from files to files."""
    source, subset, output = (scratch_path(spark, name) for name in ("submissions", "subset", "scored"))
    rows = posts(spark, sf_dir)
    typed = rows.select(*[pick(rows, (f.name,), f.dataType).alias(f.name) for f in FORUM_SUBMISSIONS])
    write_json_gzip(typed, source, partition_by=("year", "month"))
    extract_forum(spark, {"submissions": source}, subset, months=[1, 2, 3],
                  subreddits=["src0", "SRC1", "src2", "src3"], brands=["Someone", "great"])
    forum_sentiment(spark, f"{subset}/submissions", output, "json")
    summary = read_csv_inferred(spark, f"{output}/aggregates_csv")
    return summary.select(
        F.col("year").cast("long").alias("year"), F.col("month").cast("long").alias("month"), "subreddit",
        F.col("n_posts").cast("long").alias("n_posts"), F.round("avg_compound", 9).alias("avg_compound"))


@query(f"""WITH {ENRICHED} SELECT 'cpw ' || brand_category AS measure, round(avg(cpw), 4) AS value FROM enriched
WHERE brand_category IS NOT NULL AND cpw IS NOT NULL GROUP BY brand_category
UNION ALL SELECT 'products', count(*) FROM enriched
UNION ALL SELECT 'claims ' || CAST(claim AS STRING), round(avg(CASE WHEN quality <= 4.0 THEN 1.0 ELSE 0.0 END), 4)
FROM (SELECT has_claim AS claim, quality FROM enriched WHERE quality IS NOT NULL) GROUP BY claim""")
def research_job(spark, sf_dir):
    """The study from a CSV listing to its tables."""
    source, output = f"{scratch_path(spark, 'study')}/listing.csv", scratch_path(spark, "study-out")
    _put_csv(listing(spark, sf_dir).withColumnsRenamed({"price_text": "price"}), source)
    research_analysis(spark, [source], output, multiline=True)
    tables = f"{output}/tables"
    cpw = read_csv_inferred(spark, f"{tables}/proxy_cpw_by_category").select(
        F.concat(F.lit("cpw "), "brand_category").alias("measure"), F.round("avg_proxy_cpw", 4).alias("value"))
    claims = read_csv_inferred(spark, f"{tables}/claims_vs_quality").select(
        F.concat(F.lit("claims "), F.col("has_claim").cast("string")).alias("measure"),
        F.round("share_low_quality", 4).alias("value"))
    products = spark.read.parquet(f"{output}/enriched_parquet").agg(
        F.lit("products").alias("measure"), F.count(F.lit(1)).cast("double").alias("value"))
    return cpw.unionByName(claims).unionByName(products)
