"""Normalized and enriched products."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.constants import PRODUCT_SYNONYMS
from hemline.functions.brands import brand_category, fill_brand
from hemline.functions.common import ColumnLike
from hemline.functions.materials import material_quality_score
from hemline.functions.prices import price_strip, proxy_cpw
from hemline.functions.text import compose_text, durability_score
from hemline.operators.lexicon import Lexicon, with_sentiment
from hemline.operators.shaping import pick, union_products
from hemline.schemas import NORMALIZED_PRODUCT
from hemline.sources.readers import read_all, read_csv_text
from hemline.valence import DEFAULT_LEXICON


def normalize_frame(df: DataFrame, source_file: ColumnLike, synonyms=PRODUCT_SYNONYMS) -> DataFrame:
    """One input in the normalized schema; a missing brand comes from the file name."""
    source = F.lit(source_file) if isinstance(source_file, str) else source_file
    return df.select(
        source.alias("source_file"),
        fill_brand(pick(df, synonyms["brand"]), source).alias("brand"),
        *[pick(df, synonyms[name]).alias(name)
          for name in ("title", "description", "materials", "review_text", "product_id")],
        price_strip(pick(df, synonyms["price"])).alias("price"),
    )


def normalize_products(spark: SparkSession, paths: Iterable[str], multiline: bool = False) -> DataFrame:
    """Every readable listing in one frame; none gives an empty frame."""
    frames = [
        normalize_frame(df, path.rstrip("/").rsplit("/", 1)[-1])
        for path, df in read_all(spark, paths, lambda s, p: read_csv_text(s, p, multiline))
    ]
    return union_products(frames) if frames else spark.createDataFrame([], NORMALIZED_PRODUCT)


def enrich_products(df: DataFrame, lexicon: Lexicon = DEFAULT_LEXICON) -> DataFrame:
    """Add text_for_sentiment, the three scores, the brand category and cost per wear."""
    with_text = df.withColumn("text_for_sentiment", compose_text("review_text", "description"))
    scored = with_sentiment(with_text, "text_for_sentiment", lexicon, "_sentiment").select(
        *with_text.columns,
        durability_score("text_for_sentiment").alias("durability_score"),
        material_quality_score("materials").alias("objective_quality_score"),
        F.col("_sentiment.compound").alias("sentiment_score"),
        brand_category("brand").alias("brand_category"),
    )
    return scored.withColumn("proxy_cpw", proxy_cpw("price", "durability_score"))
