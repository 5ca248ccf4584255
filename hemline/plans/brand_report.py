"""Mean price and sentiment per brand over whatever inputs exist."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from hemline.operators.aggregates import brand_metrics
from hemline.sources.readers import read_all, read_table_or_csv


def brand_report(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """brand, avg_price, avg_sentiment; empty if no input can be read."""
    frames = [df for _, df in read_all(spark, paths, read_table_or_csv)]
    if not frames:
        return spark.createDataFrame([], "brand string, avg_price double, avg_sentiment double")
    return brand_metrics(frames)
