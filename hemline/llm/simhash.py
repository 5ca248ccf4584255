"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

Two fingerprints that differ in at most ``2 h`` bits have a common variant that differs from either in at most
``h`` bits, and two that share such a variant differ in at most ``2 h``. So every distinct fingerprint emits its
variants within ``h`` bits, and fingerprints that meet on a variant are linked. Variants are shuffled by their
leading bits: a fingerprint goes to each prefix that one of its variants has, and the variants that have the prefix
are made there, in slices of bounded size. Where many fingerprints meet, links form a star, never all pairs.

Defined results: a null text counts as empty; a text without words has fingerprint zero and links like any other;
equal fingerprints belong together; the component is named by its smallest id, null ids last; an empty table gives
an empty result. Other columns never matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.llm.base import fresh, same
from hemline.llm.components import components
from hemline.session import written

WIDTH, RADIUS = 4, 4
SEED = 42
SLICE = 1 << 22             # variants that are held at once
BLOCK = 1 << 15             # shingles whose bits are summed at once


def simhash(text: str, width: int = WIDTH) -> int:
    """Unsigned fingerprint: a bit is set if it is set in over half the hashes of the shingles, repeats included.

    Words are runs without ASCII white space, A-Z lower-cased.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    take = min(width, len(words))
    first, last = starts[:len(words) - take + 1].tolist(), ends[take - 1:].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        hashes = b"".join([digest(joined[i:j], SEED) for i, j in zip(first[at:at + BLOCK], last[at:at + BLOCK])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(first)).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprinted(df: DataFrame, alias: str, text: str = "text", width: int = WIDTH) -> DataFrame:
    """The columns of ``df`` and the fingerprint as a signed long."""
    place = df.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_signed(simhash(value or "", width)) for value in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.int64())], names=[*batch.schema.names, alias])

    return df.mapInArrow(each, df.select("*").schema.add(alias, "long"))


def flips(bits: int, most: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``most`` of them set, fewest first."""
    return np.array([sum(1 << i for i in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)],
                    np.uint64)


def _ones(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values)


def meet(prints: np.ndarray, left: np.ndarray, bits: int, slice_size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in ``prints`` that meet on a variant; ``left[i]`` of the low ``bits`` may still be flipped.

    All share the bits above. While the variants are too many, the next bits split them.
    """
    half = int(left.max()) if len(left) else 0
    if len(prints) < 2:
        return
    made = sum(int((left == r).sum()) * sum(math.comb(bits, n) for n in range(r + 1)) for r in range(half + 1))
    if made > slice_size and bits > 8:
        step = 4
        ahead = (prints >> np.uint64(bits - step)) & np.uint64((1 << step) - 1)
        for value in range(1 << step):
            rest = left - _ones(ahead ^ np.uint64(value)).astype(np.int64)
            kept = np.flatnonzero(rest >= 0)
            for a, b in meet(prints[kept], rest[kept], bits - step, slice_size):
                yield kept[a], kept[b]
        return
    low = prints & np.uint64((1 << bits) - 1)
    variants, owners = [], []
    for r in range(half + 1):
        at = np.flatnonzero(left == r)
        masks = flips(bits, r)
        variants.append((low[at][:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(at, len(masks)))
    variant, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variant)
    variant, owner = variant[order], owner[order]
    again = np.flatnonzero(variant[1:] == variant[:-1]) + 1
    if not len(again):
        return
    starts = np.flatnonzero(np.r_[True, variant[1:] != variant[:-1]])
    head = owner[starts[np.searchsorted(starts, again, side="right") - 1]]      # a star for each variant
    pairs = np.unique(head.astype(np.int64) * len(prints) + owner[again])
    yield pairs // len(prints), pairs % len(prints)


def linked(prints: np.ndarray, prefix: int, prefix_bits: int, half: int, slice_size: int = SLICE):
    """Links (smaller, larger) that join all fingerprints meeting on a variant that begins with ``prefix``."""
    lead = (prints >> np.uint64(64 - prefix_bits)) ^ np.uint64(prefix)
    left = half - _ones(lead).astype(np.int64)
    root = np.arange(len(prints))                       # prints are sorted: a smaller place is a smaller value
    for a, b in meet(prints, left, 64 - prefix_bits, slice_size):
        near = _ones(prints[a] ^ prints[b]) <= 2 * half                         # verified
        a, b = a[near], b[near]
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
            if (before == root).all():
                break
    found = np.flatnonzero(root != np.arange(len(prints)))
    return prints[root[found]], prints[found]


def links(prints: DataFrame, radius: int = RADIUS, slice_size: int = SLICE) -> DataFrame:
    """(a, b): links whose components are those of all pairs of fingerprints within ``radius`` bits.

    ``prints`` has one column of distinct signed longs. The number of leading bits grows with their number, so that
    a prefix has about ``slice_size`` variants at every size.
    """
    if radius % 2:
        raise ValueError("the radius is even: both sides flip half of it")
    half = radius // 2
    per_print = sum(math.comb(64, n) for n in range(half + 1))
    prefix_bits = min(40, max(5, math.ceil(math.log2(max(1, prints.count() * per_print / slice_size)))))
    ways = [int(mask) for mask in flips(prefix_bits, half)]

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The fingerprints of a batch for each prefix, packed."""
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            lead = (values >> np.uint64(64 - prefix_bits)).astype(np.int64)
            prefixes = (lead[:, None] ^ np.array(ways, np.int64)[None, :]).ravel()
            owners = np.repeat(values, len(ways))
            order = np.argsort(prefixes, kind="stable")
            prefixes, owners = prefixes[order], owners[order]
            starts = np.flatnonzero(np.r_[True, prefixes[1:] != prefixes[:-1]]) if len(prefixes) else []
            packed = [part.tobytes() for part in np.split(owners, starts[1:])] if len(starts) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(prefixes[starts] if len(starts) else [], pa.int64()), pa.array(packed, pa.binary())],
                ["prefix", "prints"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by prefix; those of one prefix are gathered and linked."""
        current, parts = None, []

        def close():
            values = np.sort(np.frombuffer(b"".join(parts), np.uint64))
            a, b = linked(values, current, prefix_bits, half, slice_size)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            for prefix, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if prefix != current:
                    if parts:
                        yield close()
                    current, parts = prefix, []
                parts.append(part)
        if parts:
            yield close()

    return (
        prints.mapInArrow(emitted, "prefix long, prints binary")
        .repartition("prefix").sortWithinPartitions("prefix")
        .mapInArrow(met, "a long, b long").distinct()
    )


def near_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``prints`` (id, print): id, print, component, kept.

    Exactly one row of a component is kept, that with the smallest id, null ids last. Ids may repeat.
    """
    prints = written(prints, "fingerprints")
    least = prints.groupBy("print").agg(F.min("id").alias("least"))
    least = written(least, "distinct-fingerprints")
    return labelled(prints, least, written(components(links(least.select("print"), radius)), "roots"))


def labelled(prints: DataFrame, least: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``near_groups`` from (print, least) and the components (node, root) of the prints."""
    rooted = least.join(found, least["print"] == found["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root"))
    named = rooted.groupBy("root").agg(
        F.min("least").alias("component"),
        F.min(F.struct(F.col("least").isNull(), "least", "print")).alias("first"))
    labels = rooted.join(named, "root").select(
        "print", "component", (F.col("first.print") == F.col("print")).alias("leads"))
    return prints.join(labels, "print").select(
        "id", "print", "component", (F.col("leads") & F.col("id").eqNullSafe(F.col("component"))).alias("kept"))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH,
                    radius: int = RADIUS) -> DataFrame:
    """One row per input row: id, fingerprint as 16 hex digits, component_id."""
    read = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    prints = fingerprinted(read, "print", "text", width).select("id", "print")
    return near_groups(prints, radius).select(
        F.col("id").alias(id), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


def near_distinct(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH,
                  radius: int = RADIUS) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``df``; rows that repeat id and text count once."""
    (print_,) = fresh(df, "print")
    carried = written(fingerprinted(df, print_, text, width), "fingerprinted")
    groups = near_groups(carried.select(F.col(f"`{id}`").alias("id"), F.col(print_).alias("print")), radius)
    stays = groups.filter("kept").select(F.col("id").alias(id), F.col("print").alias(print_))
    return (
        carried.join(stays, same(carried, stays, [id, print_]), "left_semi")
        .dropDuplicates([id, print_]).select(*[F.col(f"`{name}`") for name in df.columns])
    )
