"""Near duplicates by MinHash: universal hash minima, bands, signature check, exact check, components by stars.

A text is the set of its three-word shingles; two are linked if they share at least ``LEAST`` percent of their union.
Equal sets become one node. A signature holds the minima of ``BANDS * ROWS`` universal hashes; nodes with an equal
band meet in a bucket. A pair of 0.85 meets with probability 1 - (1 - 0.85^6)^24, in 99.999 of 100 cases, above more
often. Of a pair that meets, signatures that agree in too few places end it (eight deviations below what 0.85 gives);
then the full sets decide.

In a bucket all nodes are held against one head, the node that meets most others; then, ``TURNS`` times, all against
a node that does not hang on that head yet. What still lies in several components goes by an exact filter. All sets
that hang together by buckets are written as their differences from the shingles that most of them have. Two sets
this similar have differences in common, a known number of them, so with the rare ones in front they share one of the
first few; or both differ so little that they are alike in any case, and then both are alike to the one that differs
least. So every pair that meets is decided, while a group of copies costs a few comparisons a text and a group just
below the limit meets in rare differences only, not in all pairs.

Defined results: words are runs without ASCII white space, A-Z lower-cased; one or two words are one shingle; a text
without words, or a null one, has no shingle and is linked with nothing, so each such row is its own component;
repeated rows are linked; the component is named by its smallest id, null ids last (a component of null ids alone has
none and keeps no row); an empty table gives an empty result. Other columns never matter, whatever their names.
Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemline.llm.components import components
from hemline.llm.decontam import _rolled
from hemline.session import written

WIDTH, LEAST = 3, 85
BANDS, ROWS = 24, 6
SEED = 42
TURNS = 0                   # further heads of a bucket before the filter of differences
BLOCK = 1 << 10             # shingles that are hashed at once
SKETCH = 1 << 18            # counters for the frequency of shingles, summed on the driver

_random = np.random.default_rng(SEED)
_FACTOR = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False) | np.uint64(1)
_ADDED = _random.integers(0, 1 << 64, BANDS * ROWS, np.uint64, endpoint=False)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    if not words:
        return np.zeros(0, np.uint64)
    known = {word: xxhash.xxh64_intdigest(word, SEED) for word in set(words)}
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    return np.unique(_rolled(hashes, min(width, len(words))))


def signature(own: np.ndarray) -> np.ndarray:
    """The minima of all hashes (a x + b, of whose 64 bits the upper 32 stay)."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(own), BLOCK):
        hashes = own[at:at + BLOCK, None] * _FACTOR
        hashes += _ADDED
        np.minimum(least, hashes.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(minima: np.ndarray) -> list[int]:
    keys = [xxhash.xxh64_intdigest(minima[i * ROWS:(i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def node_of(own: np.ndarray) -> int | None:
    return int(np.array([xxhash.xxh3_64_intdigest(own.tobytes())], np.uint64).view(np.int64)[0]) if len(own) else None


def agreeing(least: int = LEAST) -> int:
    """Places in which signatures agree at least, eight deviations below the mean of a pair on the limit."""
    share, places = least / 100, BANDS * ROWS
    return max(1, int(share * places - 8 * (share * (1 - share) * places) ** 0.5))


def similar(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= least * (len(a) + len(b) - common)


def slack(apart: int, size: int, least: int = LEAST) -> int:
    """What a set adds to the number of common differences that a pair needs, in parts of 2 * (100 + least).

    Sets with differences A and B from a third set, ``least`` percent alike, have |A xor B| <= (100 - least) /
    (100 + least) * (their sizes), so |A and B| >= (slack of one + slack of the other) / (200 + 2 * least).
    """
    return (100 + least) * apart - (100 - least) * size


def offered_places(apart: int, size: int, least: int = LEAST) -> int:
    """How many of the first differences any similar set may have to share one of."""
    own, partner = slack(apart, size, least), 100 * size // least              # the largest set similar to this one
    other = max(-(100 - least) * partner, own - 2 * (100 - least) * partner)    # it differs from this one by so little
    return apart - max(1, -(-(own + other) // (200 + 2 * least))) + 1


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(id, node, size, keys, minima) of (id, text)."""
    for batch in batches:
        sets = [shingles(words_of(value or ""), width) for value in batch.column(1).to_pylist()]
        minima = [signature(own) if len(own) else None for own in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()),
             pa.array([None if m is None else band_keys(m) for m in minima], pa.list_(pa.int64())),
             pa.array([None if m is None else m.tobytes() for m in minima], pa.binary())],
            ["id", "node", "size", "keys", "minima"])


def _packed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(node, size, shingles) of (text)."""
    for batch in batches:
        sets = [shingles(words_of(value or ""), width) for value in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(map(node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()),
             pa.array([own.tobytes() for own in sets], pa.binary())], ["node", "size", "shingles"])


def _rows_of(column: pa.Array) -> np.ndarray:
    """Signatures as the rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)


def likely(pairs: DataFrame, nodes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures allow a link."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = (_rows_of(batch.column(2)) == _rows_of(batch.column(3))).sum(axis=1) >= agreeing(least)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(alike, pa.bool_()))

    one, two = (nodes.select(F.col("node").alias(n), F.col("size").alias(f"{n}_size"), F.col("minima").alias(f"{n}_minima"))
                for n in "ab")
    bound = 100 * F.least("a_size", "b_size") >= least * F.greatest("a_size", "b_size")
    return pairs.join(one, "a").join(two, "b").filter(bound).select("a", "b", "a_minima", "b_minima").mapInArrow(
        each, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) that are similar by their full sets."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), least)
                    for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"{n}_set")) for n in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "a_set", "b_set").mapInArrow(each, "a long, b long")


def _frequencies(differences: DataFrame) -> np.ndarray:
    """How often differences occur, in ``SKETCH`` counters; the driver gets those, whatever the number of sets."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(SKETCH, np.int64)
        for batch in batches:
            found = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64) % np.uint64(SKETCH)
            counters += np.bincount(found.astype(np.int64), minlength=SKETCH)
        at = np.flatnonzero(counters)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counters[at], pa.int64())], ["at", "n"])

    table = differences.select("apart").mapInArrow(each, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counters = np.zeros(SKETCH, np.int64)
    counters[table.column("at").to_numpy()] = table.column("n").to_numpy()
    return counters


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(family, shingle) of (family, shingles)."""
    for batch in batches:
        packed = batch.column(1).to_pylist()
        at = np.repeat(np.arange(len(packed)), [len(b) // 8 for b in packed])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at)), pa.array(np.frombuffer(b"".join(packed), np.int64))], ["family", "shingle"])


def differing(sets: DataFrame) -> DataFrame:
    """(family, node, size, root, n, apart): the shingles in which a set and the majority of its family differ.

    Hashed with the family, so that differences of other families are others. A majority has fewer than twice as
    many shingles as the mean set.
    """
    held = sets.select("family", "shingles").mapInArrow(_exploded, "family long, shingle long").groupBy(
        "family", "shingle").agg(F.count(F.lit(1)).alias("n"))
    sizes = sets.groupBy("family").agg(F.count(F.lit(1)).alias("nodes"))
    usual = held.join(sizes, "family").filter("2 * n > nodes").groupBy("family").agg(
        F.sort_array(F.collect_list("shingle")).alias("usual"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for family, own, usual in zip(*(batch.column(i).to_pylist() for i in (0, 4, 5))):
                apart = np.setxor1d(np.frombuffer(own, np.uint64), np.array(usual or [], np.int64).view(np.uint64))
                found.append(_rolled(np.ravel(np.column_stack([np.full(len(apart), family).view(np.uint64), apart])), 2)[::2]
                             if len(apart) else apart)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(map(len, found), pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())],
                ["family", "node", "size", "root", "n", "apart"])

    return sets.join(usual, "family", "left").select("family", "node", "size", "root", "shingles", "usual").mapInArrow(
        each, "family long, node long, size long, root long, n long, apart binary")


def sharing_differences(sets: DataFrame, least: int = LEAST) -> DataFrame:
    """Pairs (a, b) of sets (family, node, size, root, shingles) of one family and different roots: all similar ones
    that the components need, and few others. Any one order of the differences would do; rare ones come first."""
    scale = 200 + 2 * least
    apart = written(differing(sets), "differences")
    counters = sets.sparkSession.sparkContext.broadcast(_frequencies(apart))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, places, owners = [], [], []
            sizes = batch.column(1).to_pylist()
            for at, own in enumerate(map(lambda b: np.frombuffer(b, np.uint64), batch.column(4).to_pylist())):
                order = np.lexsort((own, counters.value[(own % np.uint64(SKETCH)).astype(np.int64)]))
                take = order[:max(0, offered_places(len(own), sizes[at], least))]
                found.append(own[take])
                places.append(np.arange(len(take)))
                owners.append(np.full(len(take), at))
            if found:
                at = pa.array(np.concatenate(owners))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(places)),
                     *(batch.column(i).take(at) for i in range(4))], ["difference", "place", "node", "size", "root", "n"])

    offered = written(apart.select("node", "size", "root", "n", "apart").mapInArrow(
        each, "difference long, place long, node long, size long, root long, n long"), "offered-differences")
    live = offered.groupBy("difference").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    offered = offered.join(live.select("difference"), "difference", "left_semi")
    own = (F.col("n") * (100 + least) - F.col("size") * (100 - least)).alias("slack")
    one, two = (offered.select("difference", own.alias(f"{s}_slack"), *[F.col(c).alias(f"{s}_{c}") for c in (
        "place", "node", "size", "root", "n")]) for s in "ab")
    need = F.ceil((F.col("a_slack") + F.col("b_slack")) / scale)
    sharing = one.join(two, "difference").filter(
        (F.col("a_node") < F.col("b_node")) & (F.col("a_root") != F.col("b_root"))
        & (100 * F.least("a_size", "b_size") >= least * F.greatest("a_size", "b_size"))
        & (F.col("a_place") <= F.col("a_n") - need) & (F.col("b_place") <= F.col("b_n") - need)
    ).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))

    sloped = apart.select("family", "node", "root", own)
    centre = sloped.groupBy("family").agg(F.min(F.struct("slack", "node", "root")).alias("c")).select("family", "c.*")
    sure = sloped.join(centre.toDF("family", "c_slack", "c_node", "c_root"), "family").filter(
        "slack + c_slack <= 0 and root <> c_root").select(F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b"))
    return sharing.unionByName(sure).distinct()


def _crowned(members: DataFrame, turn: int) -> DataFrame:
    """(bucket, head, head_root) of the buckets that hold nodes of several roots.

    First the member that meets most others; then any that does not hang on it.
    """
    mixed = members.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"),
        F.max(F.struct("crowd", "node", "root")).alias("top")).filter("low <> high").select("bucket", "top")
    if not turn:
        return mixed.select("bucket", F.col("top.node").alias("head"), F.col("top.root").alias("head_root"))
    apart = members.join(mixed, "bucket").filter(F.col("root") != F.col("top.root"))
    return apart.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "root")).alias("top")).select(
        "bucket", F.col("top.node").alias("head"), F.col("top.root").alias("head_root"))


def linked(members: DataFrame, nodes: DataFrame, sets: DataFrame, least: int = LEAST, turns: int = TURNS) -> DataFrame:
    """(node, root) of the components of all similar pairs that share a bucket; ``members`` is (bucket, node, crowd)."""
    spark = members.sparkSession
    links, roots, tested = spark.createDataFrame([], "a long, b long"), None, None
    for turn in range(turns + 2):
        if roots is None:
            state = members.withColumn("root", F.col("node"))
        else:
            state = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        if turn <= turns:
            heads = _crowned(state, turn)
            met = state.join(heads, "bucket").filter("root <> head_root").select(
                F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
        else:
            mixed = state.groupBy("bucket").agg(
                F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("least")).filter("low <> high")
            rest = written(state.join(mixed.select("bucket", "least"), "bucket").select("least", "node", "root"), "rest")
            if rest.isEmpty():
                break
            families = components(rest.select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
            apart = rest.select("node", "root").distinct().join(
                families.select("node", F.col("root").alias("family")), "node")
            met = sharing_differences(written(sets.join(apart, "node"), "families"), least)
        met = written(met if tested is None else met.join(tested, ["a", "b"], "left_anti"), "met-pairs")
        if met.isEmpty():
            continue
        tested = met if tested is None else tested.unionByName(met)
        found = written(confirmed(likely(met, nodes, least), sets, least), "similar-pairs")
        if found.isEmpty():
            continue
        links = links.unionByName(found)
        roots = written(components(links if roots is None else roots.select(
            F.col("root").alias("a"), F.col("node").alias("b")).unionByName(found)), "roots")
    return components(links) if roots is None else roots


def near_groups(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = WIDTH, least: int = LEAST,
                turns: int = TURNS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept (id = component_id)."""
    read = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = read.schema["id"].dataType
    signed = written(read.mapInArrow(lambda b: _signed(b, width), T.StructType([
        T.StructField("id", kind), T.StructField("node", T.LongType()), T.StructField("size", T.LongType()),
        T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("minima", T.BinaryType())])), "signatures")
    spoken = signed.filter("node is not null")
    named = written(spoken.groupBy("node").agg(F.min("id").alias("least"), F.first("size").alias("size")), "sets")
    buckets = spoken.select(F.explode("keys").alias("bucket"), "node").distinct()
    crowds = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = written(buckets.join(crowds, "bucket"), "shared-buckets")
    crowd = shared.groupBy("node").agg(F.sum("n").alias("crowd"))
    members = written(shared.select("bucket", "node").join(crowd, "node"), "bucket-members")

    met = written(crowd.select("node"), "met-nodes")
    nodes = written(spoken.join(met, "node", "left_semi").groupBy("node").agg(
        F.first("size").alias("size"), F.first("minima").alias("minima")), "met-signatures")
    first = named.join(met, "node", "left_semi").select(F.col("least").alias("first")).distinct()
    texts = read.join(first, F.col("id").eqNullSafe(F.col("first")), "left_semi").select("text")
    sets = written(texts.mapInArrow(lambda b: _packed(b, width), "node long, size long, shingles binary").filter(
        "node is not null").groupBy("node").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles")), "shingle-sets")

    roots = linked(members, nodes, sets, least, turns)
    rooted = named.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component"))
    labels = rooted.join(names, "root").select("node", "component")
    labelled = spoken.select("id", "node", "size").join(labels, "node").select("id", "size", "component")
    silent = signed.filter("node is null").select("id", "size", F.col("id").alias("component"))
    return labelled.unionByName(silent).select(
        F.col("id").alias(id), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))
