"""Readers.  Declared schemas where the layout is known; no inference pass there."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hemline.constants import MISSING_TEXTS
from hemline.functions.text import compose_text
from hemline.operators.shaping import union_products
from hemline.schemas import SCORED_TEXT


def read_csv_inferred(spark: SparkSession, path, schema: StructType | None = None) -> DataFrame:
    """CSV with a header; types inferred unless ``schema`` saves that pass."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_csv_strings(spark: SparkSession, path) -> DataFrame:
    """CSV with a header, every column as it stands: one pass, and types that never follow the data."""
    return spark.read.option("header", True).option("escape", '"').csv(path)


def read_csv_delimited(spark: SparkSession, path, sep: str = ";", encoding: str = "iso-8859-1",
                       header: bool = True, schema: StructType | None = None) -> DataFrame:
    """Delimited text in a given encoding, all strings."""
    reader = spark.read.option("sep", sep).option("encoding", encoding).option("header", header)
    return (reader.schema(schema) if schema is not None else reader).csv(path)


def _quoted_csv(spark: SparkSession, path, multiline: bool) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", multiline).csv(path)


def _text_or_null(name: str) -> Column:
    value = F.col(f"`{name}`")
    return F.when(~value.isin(*MISSING_TEXTS), value)


def read_csv_text(spark: SparkSession, path, multiline: bool = False) -> DataFrame:
    """CSV with a header, all strings, the usual texts for a missing value as null.

    Files are split among tasks.  ``multiline`` accepts line breaks inside
    quotes, at the price of one task per file.
    """
    df = _quoted_csv(spark, path, multiline)
    return df.select(*[_text_or_null(name).alias(name) for name in df.columns])


def read_json_typed(spark: SparkSession, path, schema: StructType) -> DataFrame:
    """JSON lines, plain or gzip, with a declared schema.

    Columns laid out as ``year=/month=`` folders come from the paths, so a
    filter on them skips whole folders.
    """
    return spark.read.schema(schema).json(path)


def read_parquet(spark: SparkSession, path, schema: StructType | None = None) -> DataFrame:
    reader = spark.read
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


def with_source_file(df: DataFrame, alias: str = "source_file") -> DataFrame:
    """Base name of the file each row came from."""
    return df.select("*", F.col("_metadata.file_name").alias(alias))


log = logging.getLogger(__name__)


def _unreadable(error: Exception) -> bool:
    """No such path, no schema to be found there, or not a file of that format.

    Anything else, such as a lost executor, is no reason to leave data out.
    """
    return isinstance(error, AnalysisException) or "CANNOT_READ_FILE_FOOTER" in str(error)


def read_all(spark: SparkSession, paths: Iterable[str], read: Callable[[SparkSession, str], DataFrame]
             ) -> list[tuple[str, DataFrame]]:
    """(path, frame) of every path that exists and can be read."""
    frames = []
    for path in paths:
        try:
            frames.append((path, read(spark, path)))
        except (PySparkException, Py4JJavaError) as error:
            if not _unreadable(error):
                raise
            log.warning("skipped %s: %s", path, type(error).__name__)
    return frames


def read_optional(spark: SparkSession, paths: Iterable[str], read: Callable[[SparkSession, str], DataFrame],
                  schema: StructType) -> DataFrame:
    """Union of the readable paths; no such path gives an empty frame of ``schema``."""
    frames = [df for _, df in read_all(spark, paths, read)]
    return union_products(frames) if frames else spark.createDataFrame([], schema)


def read_table_or_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file by its ending, else Parquet."""
    return read_csv_text(spark, path) if path.endswith(".csv") else read_parquet(spark, path)


def load_texts(spark: SparkSession, paths: Iterable[str], text_columns: Iterable[str],
               multiline: bool = False) -> DataFrame:
    """_source, _text: the present text columns joined; a file with none is left out."""
    frames = []
    for path in paths:
        df = _quoted_csv(spark, path, multiline)
        present = [name for name in text_columns if name in df.columns]
        if present:
            frames.append(df.select(
                F.col("_metadata.file_name").alias("_source"),
                compose_text(*[_text_or_null(name) for name in present]).alias("_text")))
    return union_products(frames) if frames else spark.createDataFrame([], SCORED_TEXT)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(term, valence) from a tab-separated list: term, mean valence, further fields."""
    return (
        spark.read.option("sep", "\t").option("quote", "").schema("term string, valence double").csv(path)
        .where("term is not null and valence is not null")
    )
