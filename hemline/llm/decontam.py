"""Benchmark decontamination: SimHash over item-sized windows, Hamming blocks, exact weighted shingles.

A document is read as overlapping windows, each as many words long as the item it is held against. Windows and items
have 64-bit SimHash fingerprints of their five-word shingles, a shingle counting as often as it occurs. Fingerprints
are cut into ``radius + 1`` blocks: two within the radius agree in a block at least, so looking up every block finds
all of them. The pairs found are verified by the exact similarity of the two weighted shingle sets (sum of the
smaller over sum of the larger counts).

A window that shares no shingle with an item has similarity zero, so only windows over a shared shingle are
fingerprinted; their number follows the contamination, not the text. Similar sets as large as these (0.8) differ in
9.7 of 64 bits on average with a deviation of 2.9; the radius of 24 lies five deviations away.

Documents are read once per block of items and never shuffled. A block is bounded by ``block_bytes`` of item text;
a larger benchmark is gone through block by block.

Defined results: words are runs of letters and digits, lower-cased; an item of fewer than five words is one shingle;
a document shorter than an item is one window; null and empty texts match nothing; of equally similar windows the
first is reported; rows that repeat are each reported; empty tables give an empty result; other columns never matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from hemline.llm.base import whole_text

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 24
BLOCK_BYTES = 32 << 20
STARTS = 1 << 14            # windows that are fingerprinted at once

_words = re.compile(r"[^\W_]+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _words(text.lower())


def _rolled(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` values in a row."""
    total = np.zeros(len(values) - width + 1, np.uint64)
    for i in range(width):
        total = total * _MIX + values[i:i + len(total)]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def _hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def fingerprints(words: list[str], size: int, width: int) -> np.ndarray:
    """SimHash of every window of ``size`` words."""
    bits = np.unpackbits(_rolled(_hashes(words), width).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(bits) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, dtype=np.int32, out=sums[1:])
    shingles = size - width + 1
    ones = sums[shingles:] - sums[:-shingles]
    return np.packbits(2 * ones > shingles, axis=1).view(">u8").astype(np.uint64).ravel()


def weights(words: list[str], width: int) -> Counter:
    return Counter(zip(*[words[i:] for i in range(width)]))


def similarity(a: Counter, b: Counter) -> float:
    common = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


class Index:
    """Items of one block, for lookup by shingle and by blocks of the fingerprint."""

    def __init__(self, items: list[tuple], width: int = WIDTH, least: float = SIMILARITY, radius: int = RADIUS):
        self.least, self.radius = least, radius
        self.ids, self.words, self.widths, self.weights = [], [], [], []
        for key, text in items:
            words = words_of(text or "")
            if words:
                self.ids.append(key)
                self.words.append(len(words))
                self.widths.append(min(width, len(words)))
                self.weights.append(weights(words, self.widths[-1]))
        self.place = {w: i + 1 for i, w in enumerate(sorted({w for found in self.weights for k in found for w in k}))}
        shared: dict[int, dict[int, set[int]]] = {}
        prints = []
        for item, (key, text) in enumerate((k, t) for k, t in items if words_of(t or "")):
            words, own = words_of(text), self.widths[item]
            prints.append(fingerprints(words, len(words), own)[0])
            for shingle in _rolled(np.array([self.place[w] for w in words], np.uint64), own).tolist():
                shared.setdefault(own, {}).setdefault(shingle, set()).add(item)
        self.prints = np.array(prints, np.uint64)
        self.shared = {own: {k: sorted(v) for k, v in found.items()} for own, found in shared.items()}
        self.keys = {own: np.array(sorted(found), np.uint64) for own, found in shared.items()}
        edges = np.linspace(0, 64, radius + 2).round().astype(int)
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])]

    def near(self, prints: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, found by equal blocks."""
        pairs = []
        for shift, mask in self.blocks:
            values = (self.prints[items] >> shift) & mask
            order = np.argsort(values, kind="stable")
            sought = (prints >> shift) & mask
            low, high = (np.searchsorted(values[order], sought, side) for side in ("left", "right"))
            count = high - low
            window = np.repeat(np.arange(len(prints)), count)
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            pairs.append(window * len(items) + order[at])
        window, item = np.divmod(np.unique(np.concatenate(pairs)), len(items))
        close = np.bitwise_count(prints[window] ^ self.prints[items[item]]) <= self.radius
        return window[close], items[item[close]]

    def hits(self, text: str) -> Iterator[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item that is in the text."""
        words = words_of(text)
        places = np.fromiter(map(self.place.get, words, repeat(0)), np.uint64, len(words))
        best: dict[int, tuple[float, int, int]] = {}
        for width, keys in self.keys.items():
            if len(words) < width:
                continue
            known = np.flatnonzero(np.convolve(places > 0, np.ones(width, np.int64), "valid") == width)
            if not len(known):
                continue
            rolled = _rolled(places, width)[known]
            found = keys[np.minimum(np.searchsorted(keys, rolled), len(keys) - 1)] == rolled
            by_size: dict[int, dict[int, list[int]]] = {}
            for at, key in zip(known[found].tolist(), rolled[found].tolist()):
                for item in self.shared[width][key]:
                    by_size.setdefault(min(self.words[item], len(words)), {}).setdefault(item, []).append(at)
            for size, where in by_size.items():
                self._windows(words, width, size, where, best)
        for item, (value, start, size) in sorted(best.items()):
            yield item, value, start, size

    def _windows(self, words, width, size, where, best) -> None:
        """Windows of ``size`` words over the shared shingles: fingerprints, block lookup, exact similarity."""
        items = np.array(sorted(where))
        reach = np.zeros(len(words) - size + 2, np.int64)
        for ats in where.values():
            at = np.array(ats)
            np.add.at(reach, np.maximum(at + width - size, 0), 1)
            np.add.at(reach, np.minimum(at, len(words) - size) + 1, -1)
        starts = np.flatnonzero(np.cumsum(reach[:-1]) > 0)
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for first in range(int(run[0]), int(run[-1]) + 1, STARTS):
                last = min(first + STARTS, int(run[-1]) + 1)
                prints = fingerprints(words[first:last - 1 + size], size, width)
                for window, item in zip(*(pair.tolist() for pair in self.near(prints, items))):
                    start = first + window
                    value = similarity(self.weights[item], weights(words[start:start + size], width))
                    if value >= self.least and value > best.get(item, (0.0,))[0]:
                        best[item] = (value, start, size)


def indexes(benchmark: DataFrame, id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
            **settings) -> Iterator[Index]:
    """Indexes of the benchmark's items, block by block; the driver holds one block."""
    items = benchmark.select(F.col(f"`{id}`").alias("id"), whole_text(text).alias("text")).filter("text <> ''")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = math.ceil(size / block_bytes)
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        yield Index([tuple(row) for row in part.orderBy("id", "text").collect()], **settings)


def contaminated(df: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text", block_bytes: int = BLOCK_BYTES, **settings) -> DataFrame:
    """(id, item, similarity, first_word, n_words): every item that a document contains, at its best window."""
    key, other = df.schema[id], benchmark.schema[item]
    read = df.select(F.col(f"`{id}`").alias(id), whole_text(text).alias("text")).filter("text <> ''")
    schema = (f"`{id}` {key.dataType.simpleString()}, `{item}` {other.dataType.simpleString()}, similarity double, "
              "first_word long, n_words long")
    kinds = [to_arrow_type(key.dataType), to_arrow_type(other.dataType), pa.float64(), pa.int64(), pa.int64()]
    found = df.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark, item, item_text, block_bytes, **settings):
        shared = df.sparkSession.sparkContext.broadcast(index)

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                rows = [(k, index.ids[i], value, start, size)
                        for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                        for i, value, start, size in index.hits(t)]
                columns = list(zip(*rows)) if rows else [()] * 5
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, [id, item, "similarity", "first_word", "n_words"])

        found = found.unionByName(read.mapInArrow(each, schema))
    return found


def decontaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                   item_text: str = "text", block_bytes: int = BLOCK_BYTES, **settings) -> DataFrame:
    """The rows that contain no item, with the columns of ``df``."""
    clean, place = df, df.columns.index(text)
    for index in indexes(benchmark, item, item_text, block_bytes, **settings):
        shared = df.sparkSession.sparkContext.broadcast(index)

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                texts = batch.column(place).to_pylist()
                yield batch.filter(pa.array([next(index.hits(t or ""), None) is None for t in texts], pa.bool_()))

        clean = clean.mapInArrow(each, df.schema)
    return clean
