"""Product records appended as new page files arrive.

The output grows batch by batch; the checkpoint remembers which files are done,
so a restarted job neither repeats nor loses a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hemline.functions.pages import SiteRules
from hemline.operators.pages import extract_product_pages
from hemline.schemas import PAGE


def page_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None, glob: str = "*.parquet"
                ) -> DataFrame:
    reader = spark.readStream.schema(PAGE).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The pages of one table, which is a single file or a folder of part files."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    reader = spark.readStream.schema(PAGE)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{{{name}}}")       # as a pattern, since a plain path has to be a folder


def append_product_records(pages: DataFrame, rules: SiteRules, output: str, checkpoint: str) -> StreamingQuery:
    """Extract every page seen so far and append it to ``output``, then stop."""
    return (
        extract_product_pages(pages, rules)
        .writeStream.format("parquet").outputMode("append")
        .option("path", output).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
