"""Repeated passages by column-wise construction of a sorted suffix collection with common prefixes.

A passage is a byte string of ``LENGTH``. The sorted suffixes of a collection grow by one symbol per document and
round, from the last column to the first: the order of the suffixes that begin one column later, sorted stably by the
new symbol, is the order of the new suffixes, and the common prefix of two neighbours is one more than the least
common prefix between their places before, if their new symbols are equal. Neighbours with ``LENGTH`` symbols in common
repeat a passage.

Over whole documents that takes one round per byte of the longest, each through the whole collection. Here the
columns are those of short contexts instead, cut out so that equal passages stand in equal columns: of the grams of
``GRAM`` bytes in a passage the one with the least hash (the last of equals) is its anchor, so equal passages have
equal anchors at equal offsets. Spark keeps the anchors that occur at two places at least, shuffles a context of
``LENGTH - GRAM`` bytes before and ``LENGTH`` bytes from each, and every task builds its collection from groups of
equal anchors, in that many rounds. Text that shares no anchor is never moved. Columns are kept one after the other
and read in that order; nothing is written to a machine's own disk.

A text counts once for an anchor, however often it has it. Contexts that a task finds equal around an anchor are done
there, since all their passages are repeated: one of them goes to the collection, the spans of all to any task. The
passages of an anchor that would fill a task, with more than ``CROWD`` texts or different contexts, are told apart by
128-bit digests, which are aggregated with a combine in the map tasks; this is exact as well. Where the texts say so,
its contexts are not sent to one task before.

Equal texts are represented by one; with two of them every passage occurs elsewhere.

Defined results: a null text is empty; texts shorter than a passage keep everything; rows that repeat are documents of
their own, so they remove each other; an empty table gives an empty result; other columns never matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.llm.base import whole_text
from hemline.session import written

LENGTH, GRAM = 400, 64
BATCH = 16_384              # contexts in one collection, if groups of equal anchors allow
CUT = 8_192                 # different contexts that are handed on together
CROWD = 100_000             # texts or different contexts of one anchor that a task may hold
TEXTS = 500                 # texts that are searched for anchors together
STRETCH = 1 << 18           # bytes that are hashed at once
PAD = 0xFF                  # no byte of UTF-8

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WRAP = 1 << 64


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base % _WRAP, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP = [_powers(base, STRETCH) for base in _BASES]
_DOWN = [_powers(pow(base, -1, _WRAP), STRETCH) for base in _BASES]
_BYTES = [_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(base)) for base in _BASES]


def window_hashes(data: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of every ``size`` bytes in a row, for at most ``STRETCH`` bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[which][data] * _UP[which][:len(data)], out=sums[1:])
    return _mixed((sums[size:] - sums[:-size]) * _DOWN[which][:len(data) - size + 1])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` keys in a row, from running minima of blocks."""
    n = len(keys)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the anchors of all passages of the texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    inside = np.zeros(len(data) + 1, np.int8)           # where a passage begins that ends in the same text
    long = sizes >= length
    np.add.at(inside, (ends - sizes)[long], 1)
    np.add.at(inside, (ends - length + 1)[long], -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    low = np.uint64(0xFFFFFF)
    places, hashes = [], []
    for first in range(0, max(0, len(data) - length + 1), STRETCH - length + 1):
        part = data[first:first + STRETCH]
        if len(part) < length:
            break
        found = window_hashes(part, gram)
        keys = (found & ~low) | (low - np.arange(len(found), dtype=np.uint64))      # of equal hashes the last
        at = (low - (_least(keys, length - gram + 1) & low)).astype(np.int64)
        at = np.unique(at[inside[first:first + len(at)]])
        places.append(at + first)
        hashes.append(found[at])
    if not places:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    place, index = np.unique(np.concatenate(places), return_index=True)
    text = np.searchsorted(ends, place, side="right")
    return text, place - (ends - sizes)[text], np.concatenate(hashes)[index]


def shared_columns(contexts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every context and column: does the passage that begins there stand in another context, in the same column?

    ``contexts`` is a matrix of bytes, a context per row. Round by round a column is added before the others.
    """
    rows, columns = contexts.shape
    found = np.zeros((columns - length + 1, rows), bool)
    symbols = np.ascontiguousarray(contexts.T)
    order, common = np.arange(rows), np.zeros(rows, np.int32)
    for column in range(columns - 1, -1, -1):
        new = symbols[column][order]
        place = np.argsort(new, kind="stable")          # the old place of each, in the new order
        new = new[place]
        starts = np.flatnonzero(np.r_[True, new[1:] != new[:-1]])
        ends = np.r_[starts[1:], rows]
        after = np.zeros(rows, np.int32)
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b - a > 1:                               # least common prefix between the old places of neighbours
                own = place[a:b]
                after[a + 1:b] = np.minimum.reduceat(common[:own[-1] + 1], own[:-1] + 1) + 1
        order, common = order[place], after
        if column <= columns - length:
            alike = common >= length
            alike[:-1] |= alike[1:]
            found[column][order] = alike
    return found.T


Place = tuple[bytes, int, int]                          # key of the text, place of the anchor, size of the text


def repeated_spans(contexts: list[bytes], places: list[Place | None], length: int, gram: int
                   ) -> Iterator[list[tuple[bytes, int, int]]]:
    """(key, start, end) of the runs of repeated passages in the different contexts of one collection.

    A context without a place only stands for what it holds.
    """
    before, wide = length - gram, 2 * length - gram
    found = shared_columns(np.frombuffer(b"".join(contexts), np.uint8).reshape(len(contexts), wide), length)
    wanted = [i for i, place in enumerate(places) if place is not None]
    column = np.arange(before + 1)[None, :]
    for at in range(0, len(wanted), CUT):
        part = wanted[at:at + CUT]
        first = np.array([places[i][1] for i in part]) - before
        sizes = np.array([places[i][2] for i in part])
        inside = (column >= -first[:, None]) & (column <= (sizes - length - first)[:, None])
        edges = np.diff(np.pad(found[part] & inside, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, a = np.nonzero(edges == 1)
        _, b = np.nonzero(edges == -1)
        keys = [places[part[i]][0] for i in row.tolist()]
        yield list(zip(keys, (first[row] + a).tolist(), (first[row] + b - 1 + length).tolist()))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    runs: list[list[int]] = []
    for start, end in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
        else:
            runs.append([start, end])
    return [tuple(run) for run in runs]


SPANS = "key binary, start long, stop long, crowded boolean"
CONTEXTS = "anchor long, context binary, key binary, place long, stop long, done boolean"
_KINDS = {
    SPANS: [("key", pa.binary()), ("start", pa.int64()), ("stop", pa.int64()), ("crowded", pa.bool_())],
    CONTEXTS: [("anchor", pa.int64()), ("context", pa.binary()), ("key", pa.binary()), ("place", pa.int64()),
               ("stop", pa.int64()), ("done", pa.bool_())],
}


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    fields = _KINDS[schema]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kind) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _dealt(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _signed(found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return found[0], found[1], found[2].view(np.int64)


def _spans_by_columns(affected: DataFrame, length: int, gram: int, crowd: int) -> DataFrame:
    """Repeated spans around anchors; of anchors with too many contexts, the places instead (``crowded``)."""
    before = length - gram

    def whole(place: Place) -> tuple[int, int]:
        _, at, size = place
        return max(at - before, 0), min(at + length, size)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts, equal ones of an anchor together as far as they come together.

        Rows without a context need no task of their own, so any gets them: spans that are done, or, not done, places
        of crowded anchors.
        """
        held: dict[tuple[int, bytes], list[Place]] = {}
        crowded: set[int] = set()
        number = 0

        def handed() -> pa.RecordBatch:
            rows, done = [], {}
            for (anchor, context), places in held.items():
                key, place, size = places[0]
                if len(places) > 1:
                    for p in places:
                        done.setdefault(p[0], []).append(whole(p))
                if anchor in crowded:
                    rows.append((_dealt(key), None, key, place, place, False))
                else:
                    rows.append((anchor, context, key, place, size, len(places) > 1))
            rows += [(_dealt(key), None, key, *run, True) for key, spans in done.items() for run in merged(spans)]
            return _batch(rows, CONTEXTS)

        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                keys, texts, found = (batch.column(i).slice(first, TEXTS).to_pylist() for i in range(3))
                wanted = [{f["anchor"]: f["many"] for f in one} for one in found]
                for no, place, anchor in zip(*(a.tolist() for a in _signed(anchors(texts, length, gram)))):
                    if anchor not in wanted[no]:
                        continue
                    if wanted[no][anchor]:
                        crowded.add(anchor)
                    context = bytes([PAD]) * (before - place) + texts[no][max(0, place - before):place + length]
                    held.setdefault((anchor, context.ljust(before + length, bytes([PAD]))), []).append(
                        (keys[no], place, len(texts[no])))
                    number += 1
                    if len(held) >= CUT or number >= 8 * CUT:
                        yield handed()
                        held, crowded, number = {}, set(), 0
        if held:
            yield handed()

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; a collection takes whole groups of different contexts.

        Of a context that comes again every place is done at once: all its passages are repeated. So a task holds
        one place per different context.
        """
        contexts: list[bytes] = []                      # of earlier anchors
        places: list[Place | None] = []
        group: dict[bytes, Place | None] = {}           # of this anchor; None once its place is done
        first: dict[bytes, Place] = {}
        anchor, overflowed, out = None, False, []

        def closed():
            return [_batch([(*span, False) for span in part], SPANS)
                    for part in repeated_spans(contexts, places, length, gram)]

        for batch in batches:
            for at, context, key, place, stop, done in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if len(out) >= CUT:
                    yield _batch(out, SPANS)
                    out = []
                if context is None:
                    out.append((key, place, stop, not done))
                    continue
                if at != anchor:
                    if len(group) > 1:
                        contexts += group
                        places += group.values()
                    anchor, group, first, overflowed = at, {}, {}, False
                    if len(contexts) >= BATCH:
                        yield from closed()
                        contexts, places = [], []
                found = key, place, stop
                if overflowed:
                    out.append((key, place, place, True))
                elif context in group or done:
                    earlier = group.get(context)
                    out += [(p[0], *whole(p), False) for p in (earlier, None if done else found) if p is not None]
                    group[context] = None
                    first.setdefault(context, earlier or found)
                else:
                    group[context] = first[context] = found
                if not overflowed and len(group) > crowd:
                    out += [(key, place, place, True) for key, place, _ in first.values()]
                    group, first, overflowed = {}, {}, True
        if len(group) > 1:
            contexts += group
            places += group.values()
        if contexts:
            yield from closed()
        if out:
            yield _batch(out, SPANS)

    contexts = affected.select("key", "text", "found").mapInArrow(cut, CONTEXTS)
    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(built, SPANS)


def _spans_by_digests(crowded: DataFrame, affected: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans around crowded anchors (key, start): passages with equal digests at two places."""
    before = length - gram

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, places in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = np.frombuffer(text, np.uint8)
                for place in places:
                    first = max(0, place - before)
                    part = data[first:place + length]
                    a, b = (window_hashes(part, length, which).view(np.int64) for which in (0, 1))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a), pa.array(b), pa.array([key] * len(a), pa.binary()),
                         pa.array(np.arange(first, first + len(a)))], ["a", "b", "key", "start"])

    places = crowded.groupBy("key").agg(F.collect_set("start").alias("places"))
    passages = affected.select("key", "text").join(places, "key").mapInArrow(digests, "a long, b long, key binary, start long")
    who = F.xxhash64("key", "start")
    repeated = passages.groupBy("a", "b").agg(F.min(who).alias("one"), F.max(who).alias("other")).filter("one <> other")
    return passages.join(repeated.select("a", "b"), ["a", "b"], "left_semi").select(
        "key", "start", (F.col("start") + length).alias("stop"))


def repeats_removed(df: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                    crowd: int = CROWD) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start and stop)."""
    data = whole_text(text).cast("binary")
    read = df.select(F.col(f"`{id}`").alias("id"), data.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    read = read.select("id", "text", "sha", F.substring("sha", 1, 16).alias("key"))
    rows = written(read.select("id", "sha", "key", F.octet_length("text").cast("long").alias("n_bytes")), "text-digests")
    texts = rows.filter(F.col("n_bytes") >= length).groupBy("key").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                part = batch.slice(first, TEXTS)
                text_no, _, hashes = _signed(anchors(part.column(2).to_pylist(), length, gram))
                order = np.lexsort((hashes, text_no))
                text_no, hashes = text_no[order], hashes[order]
                new = np.flatnonzero((np.diff(text_no, prepend=-1) != 0) | (np.diff(hashes, prepend=0) != 0))
                again = np.diff(new, append=len(hashes)) > 1
                ends = np.searchsorted(text_no[new], np.arange(part.num_rows + 1)).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(hashes[new]), pa.array(again)], ["anchor", "again"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pairs)],
                    ["id", "key", "pairs"])

    long = F.octet_length("text") >= length
    sources = read.filter(long).select("id", "key", "text")
    schema = f"id {read.schema['id'].dataType.simpleString()}, key binary, pairs array<struct<anchor:long,again:boolean>>"
    found = sources.mapInArrow(anchored, schema)
    found = written(                                    # copies of a text count as one
        found.join(texts, (found["key"] == texts["key"]) & found["id"].eqNullSafe(texts["id"]))
        .select(found["key"], "pairs"), "anchors").select("key", F.inline("pairs"))
    who = F.xxhash64("key")
    shared = found.groupBy("anchor").agg(
        F.min(who).alias("one"), F.max(who).alias("other"), F.max("again").alias("again"), F.count(F.lit(1)).alias("n")
    ).filter("again OR one <> other").select("anchor", (F.col("n") > crowd).alias("many"))
    places = found.join(shared, "anchor").groupBy("key").agg(
        F.collect_set(F.struct("anchor", "many")).alias("found"))
    wanted = places.join(texts, "key")
    affected = written(
        sources.join(wanted, (sources["key"] == wanted["key"]) & sources["id"].eqNullSafe(wanted["id"]))
        .select(sources["key"], "text", "found", "copies").dropDuplicates(["key"]), "affected-texts")

    single = affected.filter("copies = 1").select("key", "text")
    spans = written(_spans_by_columns(affected, length, gram, crowd), "spans")
    crowded = spans.filter("crowded").select("key", "start")
    spans = spans.filter("NOT crowded").select("key", "start", "stop")
    if not crowded.isEmpty():
        spans = spans.unionByName(_spans_by_digests(crowded, affected, length, gram))
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                runs = merged([(s["start"], s["stop"]) for s in spans])
                left, at = hashlib.sha256(), 0
                for start, end in runs:
                    left.update(text[at:start])
                    at = end
                left.update(text[at:])
                made.append((sum(b - a for a, b in runs), left.digest(),
                             [{"start": a, "stop": b} for a, b in runs]))
            columns = list(zip(*made)) if made else [(), (), ()]
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["key", "n_removed", "kept", "runs"])

    cut = single.join(spans, "key").mapInArrow(
        kept, "key binary, n_removed long, kept binary, runs array<struct<start:long,stop:long>>")
    nothing = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    outcome = texts.filter("copies > 1").select("key", F.lit(True).alias("whole")).unionByName(
        cut.select("*", F.lit(False).alias("whole")), allowMissingColumns=True)
    whole = F.coalesce("whole", F.lit(False))
    runs = F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))).otherwise(
        F.coalesce("runs", F.array().cast("array<struct<start:long,stop:long>>")))
    return rows.join(outcome, "key", "left").select(
        F.col("id").alias(id), "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.size(runs).cast("long").alias("n_spans"),
        F.lower(F.hex(F.when(whole, nothing).otherwise(F.coalesce("kept", "sha")))).alias("kept_sha256"),
        runs.alias("spans"))
