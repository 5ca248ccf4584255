"""Shards of bounded size by extendible hashing.

A row's hash is the first 60 bits of the MD5 of its id and text. The directory starts as one bucket; a bucket over
the byte limit splits on its next hash bit, and only such buckets do. ``STEP`` bits are handled together: bytes are
summed by cell (a prefix ``STEP`` bits longer, with a combine in the map tasks), cells are summed up to every shorter
prefix, and the shortest prefix that fits is a shard. Rows of cells that are still too large go to the next step. Only
(id, hash, bytes) of a row is shuffled, and copies of one text spread by their ids.

Defined results: a null text has no bytes, a null id counts as the empty text; rows that repeat id and text share all
bits, so they stay together, and such a shard, or a single row over the limit, is marked ``oversized``; an empty table
gives an empty result; other columns never matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.llm.base import fresh, whole_text
from hemline.session import written

LIMIT = 64 << 20            # bytes of text in a shard
BITS, STEP = 60, 12


def row_hash(id: str, text: str) -> Column:
    key = F.concat(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")), F.lit(":"), whole_text(text))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(hash: str, depth: int) -> Column:
    return F.shiftright(hash, BITS - depth)


def _cell_shards(rows: DataFrame, base: int, limit: int) -> DataFrame:
    """(cell, depth, shard_docs, shard_bytes) of rows (hash, bytes) in buckets of ``base`` bits; depth null: too large."""
    cells = rows.groupBy(_prefix("hash", base + STEP).alias("cell")).agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs"), F.min("hash").alias("low"),
        F.max("hash").alias("high"))
    cells = written(cells, "cells")
    shortest = 0 if base == 0 else 1                    # the bucket itself is known to be too large
    depths = F.explode(F.sequence(F.lit(shortest), F.lit(STEP)))
    spread = cells.select("*", depths.alias("k"))
    at = F.expr(f"shiftright(cell, {STEP} - k)")
    fits = (
        spread.groupBy("k", at.alias("prefix")).agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"), F.min("low").alias("low"),
            F.max("high").alias("high"))
        .filter((F.col("shard_bytes") <= limit) | (F.col("low") == F.col("high")))
        .select("k", "prefix", "shard_bytes", "shard_docs")
    )
    chosen = (
        spread.select("cell", "k", at.alias("prefix")).join(fits, ["k", "prefix"])
        .groupBy("cell").agg(F.min(F.struct("k", "shard_docs", "shard_bytes")).alias("best"))
    )
    return cells.select("cell").join(chosen, "cell", "left").select(
        "cell", (F.col("best.k") + base).alias("depth"), "best.shard_docs", "best.shard_bytes")


def shards(df: DataFrame, id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, hash, shard (its bits), depth, shard_docs, shard_bytes, oversized."""
    left = written(df.select(
        F.col(f"`{id}`").alias("id"), row_hash(id, text).alias("hash"),
        F.octet_length(whole_text(text)).cast("long").alias("bytes")), "row-hashes")
    parts = []
    for base in range(0, BITS, STEP):
        cells = written(_cell_shards(left, base, limit), "shards")
        joined = left.withColumn("cell", _prefix("hash", base + STEP)).join(
            F.broadcast(cells) if base == 0 else cells, "cell")                 # at most 2 ** STEP cells at first
        parts.append(joined.filter(F.col("depth").isNotNull()))
        if cells.filter(F.col("depth").isNull()).isEmpty():
            break
        left = written(joined.filter(F.col("depth").isNull()).select("id", "hash", "bytes"), "row-hashes")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    bits = F.expr(f"CASE WHEN depth = 0 THEN '' ELSE lpad(bin(shiftright(hash, {BITS} - depth)), depth, '0') END")
    return found.select(
        F.col("id").alias(id), "hash", bits.alias("shard"), "depth", "shard_docs", "shard_bytes",
        (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(df: DataFrame, path: str, id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """Write ``df`` as Parquet, a folder per shard (``shard=<bits>``), each written by one task."""
    hash, shard = fresh(df, "hash", "shard")
    directory = shards(df, id, text, limit).select(F.col("hash").alias(hash), F.col("shard").alias(shard)).distinct()
    (df.withColumn(hash, row_hash(id, text)).join(directory, hash).drop(hash)
     .repartition(shard).write.partitionBy(shard).parquet(path))
