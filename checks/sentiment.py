"""Sentiment and the jobs built on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.expected import DEFAULT_LEXICON, ENRICHED, clean, sentiment
from checks.inputs import LISTING_SQL, POST_SQL, listing, posts, table
from checks.registry import query
from checks.statistics import kmeans_sql, named_sql
from hemline.constants import CLUSTER_FEATURES
from hemline.functions.sentiment import lexicon_sentiment
from hemline.operators.aggregates import sentiment_by_period
from hemline.operators.lexicon import score_with_lexicon_table
from hemline.operators.shaping import flatten_struct
from hemline.plans.forum import score_posts
from hemline.plans.products import enrich_products, normalize_frame
from hemline.plans.research import study, study_metrics

_BODY = "SELECT doc_id AS key, concat(review_text, ' ', coalesce(description, '')) AS body FROM listing"


@query(f"""WITH listing AS ({LISTING_SQL}), {sentiment(_BODY, DEFAULT_LEXICON)}
SELECT key AS doc_id, neg, neu, pos, compound FROM sentiment""")
def text_sentiment(spark, sf_dir):
    """Scores of whole texts with the default lexicon, in one projection."""
    texts = listing(spark, sf_dir, "doc_id", "review_text", "description").select(
        "doc_id", F.concat("review_text", F.lit(" "), F.coalesce("description", F.lit(""))).alias("body"))
    return flatten_struct(texts.select("doc_id", lexicon_sentiment("body").alias("s")), "s")


# Every distinct word of the benchmark texts gets a valence from its length.
_WORD_LEXICON = """SELECT term, CAST((length(term) % 9 - 4) AS DOUBLE) / 2 AS valence FROM (
  SELECT DISTINCT unnest(string_split_regex(lower(regexp_replace(text, '[^a-zA-Z]+', ' ', 'g')), ' +')) AS term FROM benchmark)
  WHERE length(term) > 1"""


@query(f"""WITH listing AS ({LISTING_SQL}), {sentiment(_BODY, _WORD_LEXICON)}
SELECT key AS doc_id, neg, neu, pos, compound FROM sentiment""")
def text_sentiment_by_lexicon_table(spark, sf_dir):
    """The same scores when the lexicon is a table that grows with the data."""
    words = F.split(F.lower(F.regexp_replace("text", "[^a-zA-Z]+", " ")), " +")
    lexicon = (
        table(spark, sf_dir, "benchmark").select(F.explode(words).alias("term")).distinct()
        .where(F.length("term") > 1)
        .withColumn("valence", (F.length("term") % 9 - 4).cast("double") / 2)
    )
    texts = listing(spark, sf_dir, "doc_id", "review_text", "description").select(
        "doc_id", F.concat("review_text", F.lit(" "), F.coalesce("description", F.lit(""))).alias("body"))
    scored = score_with_lexicon_table(texts, "body", lexicon)
    return flatten_struct(scored.select("doc_id", "sentiment"), "sentiment")


_SCORED_POSTS = f"""posts AS ({POST_SQL}), cleaned AS (
  SELECT id, subreddit, year, month, {clean("concat(coalesce(title, ''), ' ', coalesce(selftext, ''))")} AS t FROM posts), {
  sentiment("SELECT id AS key, t AS body FROM cleaned WHERE len(string_split_regex(t, '\\s+')) >= 5", DEFAULT_LEXICON)}"""


@query(f"""WITH {_SCORED_POSTS}
SELECT year, month, subreddit, count(*) AS n_posts, round(avg(compound), 9) AS avg_compound, round(avg(pos), 9) AS avg_pos,
       round(avg(neg), 9) AS avg_neg, round(avg(neu), 9) AS avg_neu
FROM cleaned JOIN sentiment ON id = key GROUP BY ALL""")
def forum_sentiment_by_period(spark, sf_dir):
    """Compose, clean, keep five tokens, score, summarize."""
    summary = sentiment_by_period(score_posts(posts(spark, sf_dir)))
    means = ["avg_compound", "avg_pos", "avg_neg", "avg_neu"]
    return summary.select("year", "month", "subreddit", "n_posts", *[F.round(m, 9).alias(m) for m in means])


@query(f"""WITH {_SCORED_POSTS}
SELECT id, t AS text_clean, neg AS vader_neg, neu AS vader_neu, pos AS vader_pos, compound AS vader_compound
FROM cleaned JOIN sentiment ON id = key""")
def forum_sentiment_detail(spark, sf_dir):
    return score_posts(posts(spark, sf_dir)).select(
        "id", "text_clean", "vader_neg", "vader_neu", "vader_pos", "vader_compound")


def _products(spark, sf_dir):
    rows = listing(spark, sf_dir).withColumnsRenamed({"price_text": "price"})
    return normalize_frame(rows, F.lit("listing.csv")), rows


@query(f"""WITH {ENRICHED}
SELECT 'SKU-' || CAST(doc_id AS STRING) AS product_id, price, durability_score, round(quality, 6) AS objective_quality_score,
       compound AS sentiment_score, brand_category, round(cpw, 6) AS proxy_cpw FROM enriched""")
def enriched_products(spark, sf_dir):
    """Every derived column of every product."""
    products, _ = _products(spark, sf_dir)
    return enrich_products(products).select(
        "product_id", "price", "durability_score",
        F.round("objective_quality_score", 6).alias("objective_quality_score"),
        "sentiment_score", "brand_category", F.round("proxy_cpw", 6).alias("proxy_cpw"))


@query(f"""WITH {ENRICHED}
SELECT round((SELECT corr(quality, compound) FROM enriched), 6) AS r, count(quality) AS n,
       round((SELECT corr(quality, CASE WHEN has_claim THEN 1.0 ELSE 0.0 END) FROM enriched WHERE quality IS NOT NULL), 6) AS claims_r
FROM enriched""")
def study_correlations(spark, sf_dir):
    """Quality against sentiment and claim against quality, one pass."""
    products, _ = _products(spark, sf_dir)
    return study_metrics(enrich_products(products)).select(
        F.round("r", 6).alias("r"), "n", F.round("claims_r", 6).alias("claims_r"))


@query(f"""WITH {ENRICHED}, quality_cut AS (SELECT * FROM enriched)
SELECT coalesce(brand_category, 'other') AS brand_category, count(*) AS n, round(avg(price), 4) AS avg_price,
       round(avg(cpw), 4) AS avg_proxy_cpw, round(avg(quality), 6) AS avg_quality, round(avg(compound), 6) AS avg_sentiment,
       round(avg(durability_score), 6) AS avg_durability
FROM quality_cut GROUP BY 1""")
def category_summary(spark, sf_dir):
    """All measures per brand category: the study in one table."""
    products, _ = _products(spark, sf_dir)
    enriched = enrich_products(products)
    return enriched.groupBy(F.coalesce("brand_category", F.lit("other")).alias("brand_category")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("price"), 4).alias("avg_price"),
        F.round(F.avg("proxy_cpw"), 4).alias("avg_proxy_cpw"),
        F.round(F.avg("objective_quality_score"), 6).alias("avg_quality"),
        F.round(F.avg("sentiment_score"), 6).alias("avg_sentiment"),
        F.round(F.avg("durability_score"), 6).alias("avg_durability"))


_STUDY = f"""RECURSIVE {ENRICHED}, rows AS MATERIALIZED (
  SELECT row_number() OVER () AS place, price, compound AS sentiment_score, durability_score, quality AS objective_quality_score
  FROM enriched), features AS MATERIALIZED (SELECT place, price::DOUBLE AS price, sentiment_score::DOUBLE AS sentiment_score,
  durability_score::DOUBLE AS durability_score, objective_quality_score::DOUBLE AS objective_quality_score FROM rows),
{kmeans_sql("features", CLUSTER_FEATURES, "place")},
labelled AS (SELECT f.*, c.cluster FROM features f LEFT JOIN clusters c USING (place)), {named_sql("labelled")}"""


@query(f"""WITH {_STUDY} SELECT cluster, cluster_name, count(*) AS n, round(avg(price), 4) AS avg_price
FROM labelled LEFT JOIN names USING (cluster) GROUP BY ALL""")
def study_segments(spark, sf_dir):
    """The whole study up to its named segments, numbered by their centres."""
    products, _ = _products(spark, sf_dir)
    return study(products).products().groupBy("cluster", "cluster_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("price"), 4).alias("avg_price"))
