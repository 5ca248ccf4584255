"""Exact duplicates: frequent digests are found first and removed without a shuffle.

Each task keeps a Misra-Gries summary of ``counters`` digests. Their sum over all tasks undercounts a digest by at
most ``rows / (counters + 1)``, so every digest with more than twice that many rows passes the threshold, and no
more than ``counters`` digests can. Those few are counted exactly (verified) and broadcast; their copies are
recognised in the map tasks. All other digests are shuffled, and none of them can fill a task.

Defined results: a null text counts as empty, and so equals other null and empty texts; of equal texts the
smallest id stays, a null id last; rows that repeat id and text leave exactly one; an empty table gives an empty
result. Other columns never matter, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemline.llm.base import fresh, whole_text
from hemline.session import written

COUNTERS = 1024


def text_digest(text: str) -> Column:
    """SHA-256 of the text with each run of ASCII white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(whole_text(text), "[\\x20\\x09-\\x0D]+", " ").cast("binary"), 256))


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """A task's summary: at most ``counters`` values, each undercounted by rows / (counters + 1) at most."""
    kept: Counter = Counter()
    for batch in batches:
        kept.update(batch.column(0).to_pylist())
        if len(kept) > counters:                        # lower all by the largest count that has to go
            cut = sorted(kept.values(), reverse=True)[counters]
            kept = Counter({value: count - cut for value, count in kept.items() if count > cut})
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], ["digest", "n"])


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, keep_id, group_size) of at most ``counters`` digests, among them all that are frequent."""
    rows = digests.count()
    found = (
        digests.select("digest")
        .mapInArrow(lambda batches: misra_gries(batches, counters), "digest binary, n long")
        .groupBy("digest").agg(F.sum("n").alias("n"))
        .filter((F.col("n") > rows / (counters + 1)) & (F.col("n") > 1))
        .select("digest")
    )
    verified = (
        digests.join(F.broadcast(found), "digest")      # at most ``counters`` rows of 32 bytes
        .groupBy("digest").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return written(verified, "frequent-digests")


def exact_groups(df: DataFrame, id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    digests = written(df.select(F.col(f"`{id}`").alias("id"), text_digest(text).alias("digest")), "digests")
    marked = digests.join(
        F.broadcast(frequent(digests, counters).withColumnsRenamed({"keep_id": "top_id", "group_size": "top_size"})),
        "digest", "left")
    copy = F.col("top_size").isNotNull() & ~F.col("id").eqNullSafe(F.col("top_id"))
    group = Window.partitionBy("digest")
    rest = marked.filter(~copy).select(
        "id", "digest",
        F.coalesce("top_id", F.min("id").over(group)).alias("keep_id"),
        F.coalesce("top_size", F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col("id").asc_nulls_last())) == 1).alias("kept"),
    )
    copies = marked.filter(copy).select(
        "id", "digest", F.col("top_id").alias("keep_id"), F.col("top_size").alias("group_size"),
        F.lit(False).alias("kept"))
    return copies.unionByName(rest).select(
        F.col("id").alias(id), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def exact_distinct(df: DataFrame, id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with the columns of ``df``; texts of frequent copies are not shuffled."""
    digest, top_id, top_size, place = fresh(df, "digest", "top_id", "top_size", "place")
    digests = written(df.select(F.col(f"`{id}`").alias("id"), text_digest(text).alias("digest")), "digests")
    top = frequent(digests, counters).select(
        F.col("digest").alias(digest), F.col("keep_id").alias(top_id), F.col("group_size").alias(top_size))
    group = Window.partitionBy(digest).orderBy(F.col(f"`{id}`").asc_nulls_last())
    return (
        df.withColumn(digest, text_digest(text))
        .join(F.broadcast(top), digest, "left")
        .filter(F.col(top_size).isNull() | F.col(f"`{id}`").eqNullSafe(F.col(top_id)))
        .withColumn(place, F.row_number().over(group)).filter(F.col(place) == 1)
        .select(*[F.col(f"`{name}`") for name in df.columns])
    )
