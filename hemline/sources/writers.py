"""Writers."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.functions.common import ColumnLike, col


def _in_files(df: DataFrame, files: int | None) -> DataFrame:
    """``files`` output files.  A shuffle of the result, so that the work before it
    keeps its own number of tasks; without ``files`` every task writes its own."""
    return df.repartition(files) if files else df


def write_parquet_overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_parquet_once(df: DataFrame, path: str, files: int | None = None) -> None:
    """Fails if the target exists."""
    _in_files(df, files).write.mode("error").parquet(path)


def write_json_gzip(df: DataFrame, path: str, files: int | None = None,
                    partition_by: Iterable[str] = ()) -> None:
    """Gzip JSON lines; fails if the target exists."""
    _in_files(df, files).write.mode("error").partitionBy(*partition_by).json(path, compression="gzip")


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; fails if the target exists.  ``single`` is for aggregates."""
    (df.coalesce(1) if single else df).write.mode("error").option("header", True).option(
        "escape", '"').csv(path)


def append_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).option("escape", '"').csv(path)


def run_tagged_path(base: str, tag: str | None = None, no_suffix: bool = False) -> str:
    """``base/run=<tag or UTC time>``, which Spark reads back as a partition column."""
    if no_suffix:
        return base
    return f"{base}/run={tag or datetime.now(timezone.utc).strftime('%Y%m%d_%H%M%S')}"


def _significant(value: ColumnLike, digits: int = 4) -> Column:
    """Significant digits without trailing zeros, ``nan`` for a missing value."""
    value = col(value)
    text = F.format_string(f"%.{digits}g", value)
    short = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    return F.coalesce(F.when(value == 0, F.lit("0")).when(value.isNotNull(), short), F.lit("nan"))


def _fixed(value: ColumnLike) -> Column:
    value = col(value)
    return F.coalesce(F.when(value.isNotNull(), F.format_string("%.4f", value)), F.lit("nan"))


def metrics_text(metrics: DataFrame) -> DataFrame:
    """Two lines of text from one row (r, p, n, claims_r)."""
    return metrics.select(F.explode(F.array(
        F.concat(
            F.lit("pearson(objective_quality_score, sentiment_score): r="), _fixed("r"),
            F.lit(", p="), _significant("p"), F.lit(", n="), F.col("n").cast("string"),
        ),
        F.concat(F.lit("point_biserial(has_claim, objective_quality_score) = "), _fixed("claims_r")),
    )).alias("value"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics_text(metrics).coalesce(1).write.mode("error").text(path)
