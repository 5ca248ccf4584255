"""Standardization, k-means and named segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import md5
from operator import add, and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemline.constants import (
    CLUSTER_FEATURES, CLUSTER_ITERATIONS, CLUSTER_SEED, CLUSTER_TOLERANCE, CLUSTERS, TERCILES,
)
from hemline.functions.prices import cluster_name, level
from hemline.operators.aggregates import mean_profile
from hemline.operators.filters import is_finite
from hemline.operators.moments import moments
from hemline.operators.quantiles import tercile_cuts
from hemline.operators.shaping import attach_names
from hemline.session import written

GRID = 1 << 20              # steps of a standard deviation; whole numbers sum alike in any order

Centre = tuple[float, ...]


def all_finite(columns: Iterable[str]) -> Column:
    return reduce(and_, [is_finite(name) for name in columns])


def standardize(df: DataFrame, columns: Iterable[str], prefix: str = "z_") -> DataFrame:
    """Add zero-mean, unit-variance columns; a constant column becomes 0.

    Moments come from the rows where every column is finite, as scalar
    subqueries of order-independent sums; a row outside gets nulls.
    """
    columns = list(columns)
    found = moments(df.where(all_finite(columns)).select(*columns), columns)
    own = {name: F.try_element_at("found", F.lit(name)) for name in columns}
    scale = df.sparkSession.range(1).select(found.alias("found")).select(F.struct(*[F.struct(
        x["mean"].alias("mean"), F.coalesce(F.nullif(x["deviation"], F.lit(0.0)), F.lit(1.0)).alias("deviation"),
    ).alias(f"s{i}") for i, x in enumerate(own.values())])).scalar()
    whole, at = f"{prefix}whole", f"{prefix}scale"
    placed = df.select("*", all_finite(columns).alias(whole), scale.alias(at))
    return placed.select(*df.columns, *[
        F.when(F.col(whole), (F.col(name) - F.col(f"{at}.s{i}.mean")) / F.col(f"{at}.s{i}.deviation")).alias(prefix + name)
        for i, name in enumerate(columns)])


Scale = dict[str, tuple[float, float]]


def _scaled(values: Iterable[str], z: Iterable[str], scale: Scale) -> list[Column]:
    """Values in deviations from the mean; a constant counts as if its deviation were 1."""
    return [((F.col(value) - scale[name][0]) / (scale[name][1] or 1.0)).alias(name) for value, name in zip(values, z)]


def _placed(z: Iterable[str]) -> list[Column]:
    """Standardized values as places on the grid."""
    return [F.floor(F.col(name) * GRID + 0.5).cast("long").alias(name) for name in z]


def _distance(z: list[str], centre: Centre) -> Column:
    return reduce(add, [(F.col(name) - value) * (F.col(name) - value) for name, value in zip(z, centre)])


def _nearest(z: list[str], centres: list[Centre]) -> Column:
    """The number of the nearest centre, the first of equals.

    Each distance is written out twice and no more, of places without nulls, so that the code of a row stays within the
    8,000 bytes up to which the JVM compiles it.
    """
    distances = F.array(*[_distance(z, centre) for centre in centres])
    return F.array_position(distances, F.array_min(distances)) - 1


def _whole(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"i{len(data) // n}").astype(np.int64)


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, of the narrowest kind that holds them all."""
    low, high = int(values.min()), int(values.max())
    kind = next(kind for kind in (np.int8, np.int16, np.int32, np.int64)
                if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max)
    return values.astype(kind).tobytes()


def _blocks(points: DataFrame, z: list[str]) -> DataFrame:
    """The points in blocks of a batch each, a row with the bytes of every column: a round hands on few rows."""
    names = [*z, "weight"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                packed = [pa.array([_narrow(column.to_numpy())], pa.binary()) for column in batch.columns]
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), *packed], ["n", *names])

    return points.select(*names).mapInArrow(each, ", ".join(["n long", *(f"`{name}` binary" for name in names)]))


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Places and weights of the points of each block."""
    for batch in batches:
        for size, *packed in zip(*(column.to_pylist() for column in batch.columns)):
            *places, weight = (_whole(data, size) for data in packed)
            yield places, weight


def _apart(places: list[np.ndarray], centres: list[Centre]) -> list[np.ndarray]:
    """Squared distances of the points from each centre."""
    floats = [x.astype(np.float64) for x in places]
    return [reduce(add, [(x - c) * (x - c) for x, c in zip(floats, centre)]) for centre in centres]


def _hashed(places: list[np.ndarray], seed: int, nth: int) -> np.ndarray:
    """A number between 0 and 1 for each point, from 48 bits of the MD5 of the seed, the draw and the place."""
    texts = pc.binary_join_element_wise(*[pa.array(x).cast(pa.string()) for x in places], ",").cast(pa.binary()).to_pylist()
    start = md5(f"{seed},{nth},".encode(), usedforsecurity=False)

    def digest(text: bytes) -> bytes:
        own = start.copy()
        own.update(text)
        return own.digest()

    first = np.frombuffer(b"".join(map(digest, texts)), ">u8")[::2] >> np.uint64(16)
    return (first.astype(np.float64) + 0.5) / float(1 << 48)


def _drawn(blocks: DataFrame, z: list[str], centres: list[Centre], seed: int) -> Centre | None:
    """A further start, drawn by weight and squared distance from the starts so far; None if no point is left.

    Each point waits a time of its own, -ln(u) over its share, with u from a hash of the point, and the first one is
    taken: the draw of k-means++ as one aggregate, the same however the points lie. Every task hands on its first.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple[float, ...] | None = None
        for places, weight in _unpacked(batches):
            share = weight.astype(np.float64)
            if centres:
                share = share * reduce(np.minimum, _apart(places, centres))
            left = share > 0
            if left.any():
                places = [x[left] for x in places]
                wait = -np.log(_hashed(places, seed, len(centres))) / share[left]
                soonest = np.flatnonzero(wait == wait.min())
                own = min((float(wait[i]), *(int(x[i]) for x in places)) for i in soonest)
                first = own if first is None else min(first, own)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first[0]]), *(pa.array([x], pa.int64()) for x in first[1:])], ["wait", *z])

    found = blocks.mapInArrow(each, ", ".join(["wait double", *(f"`{name}` long" for name in z)])).collect()
    return tuple(float(x) for x in min(map(tuple, found))[1:]) if found else None


def _totals(blocks: DataFrame, z: list[str], centres: list[Centre]) -> dict[int, list[int]]:
    """For each centre the summed weight and weighted places of its points, in whole numbers.

    Every task hands on a row for each centre; the driver adds these up.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[0] * (len(z) + 1) for _ in centres]
        for places, weight in _unpacked(batches):
            nearest = np.argmin(_apart(places, centres), axis=0)
            heavy = int(weight.max()) * max(int(np.abs(x).max()) for x in places) * len(weight) >= 1 << 62
            for i, total in enumerate(totals):
                own = nearest == i
                n = weight[own].astype(object) if heavy else weight[own]
                for j, values in enumerate([n, *(n * x[own] for x in places)]):
                    total[j] += int(values.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(centres)), pa.int32()), pa.array([[str(v) for v in t] for t in totals], pa.list_(pa.string()))],
            ["nearest", "totals"])

    found: dict[int, list[int]] = {}
    for nearest, totals in blocks.mapInArrow(each, "nearest int, totals array<string>").collect():
        own = found.setdefault(nearest, [0] * len(totals))
        found[nearest] = [a + int(b) for a, b in zip(own, totals)]
    return found


def fit_kmeans(points: DataFrame, z: list[str], k: int = CLUSTERS, seed: int = CLUSTER_SEED) -> list[Centre]:
    """Centres of weighted points on the grid, in lexicographic order; no more than there are distinct points.

    A round sums whole numbers, so the centres do not depend on partitioning. A centre without points stays. It stops
    once the squared shifts of all centres sum to no more than ``CLUSTER_TOLERANCE``. The draws and rounds read blocks of
    the points that are kept in memory; a lost one is made again from ``points``.
    """
    centres: list[Centre] = []
    blocks = _blocks(points, z).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        while len(centres) < k and (drawn := _drawn(blocks, z, centres, seed)) is not None:
            centres.append(drawn)
        for _ in range(CLUSTER_ITERATIONS if centres else 0):
            found = _totals(blocks, z, centres)
            moved = [tuple(float(v) / float(found[i][0]) for v in found[i][1:]) if found[i][0] else centre
                     for i, centre in enumerate(centres)]
            shift = sum((a - b) * (a - b) for old, new in zip(centres, moved) for a, b in zip(old, new))
            centres = moved
            if shift <= CLUSTER_TOLERANCE * GRID * GRID:
                break
    finally:
        blocks.unpersist()
    return sorted(centres)


def kmeans(df: DataFrame, columns: Iterable[str] = CLUSTER_FEATURES, k: int = CLUSTERS,
           seed: int = CLUSTER_SEED) -> DataFrame:
    """Add ``cluster``; null where a feature is missing.

    Clusters are numbered by their centres, the smallest first feature first. ``df`` is read once for the fit: equal
    rows are one with a weight, written, and moments and points come from these. The label is computed in place, so
    nothing has to be joined back by row; it sits in an array of one, which keeps the optimizer from repeating the
    distances in a filter on it.
    """
    columns = list(columns)
    z = [f"_z_{name}" for name in columns]
    known = written(df.where(all_finite(columns)).groupBy(*[F.col(name).cast("double").alias(at) for name, at in zip(columns, z)])
                    .agg(F.count(F.lit(1)).alias("weight")), "known")
    found = df.sparkSession.range(1).select(moments(known, z, "weight").alias("found")).first()["found"]
    if len(found) < len(z):
        return df.withColumn("cluster", F.lit(None).cast("int"))
    scale = {name: tuple(own) for name, own in found.items()}
    scaled = known.select("weight", *_scaled(z, z, scale)).where(all_finite(z))
    points = written(scaled.select("weight", *_placed(z)).groupBy(*z).agg(F.sum("weight").alias("weight")), "points")
    centres = fit_kmeans(points, z, k, seed)
    if not centres:
        return df.withColumn("cluster", F.lit(None).cast("int"))
    label = F.when(all_finite(columns), _nearest(z, centres)).cast("int")
    placed = df.select(*df.columns, *_scaled([f"`{name}`" for name in columns], z, scale)).select(
        *df.columns, *[F.coalesce(x.cast("double"), F.lit(0.0)).alias(name) for x, name in zip(_placed(z), z)])
    return placed.select(*df.columns, F.explode(F.array(label)).alias("cluster"))


def cluster_profile(df: DataFrame, columns: Iterable[str] = CLUSTER_FEATURES) -> DataFrame:
    """Mean of each feature per cluster."""
    return mean_profile(df, "cluster", columns)


def cluster_names(profile: DataFrame, cuts: DataFrame) -> DataFrame:
    """cluster, cluster_name from cluster means against the global cuts (feature, lo, hi)."""
    found = cuts.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lo", "hi"))))).scalar()

    def leveled(name: str) -> Column:
        cut = F.try_element_at(found, F.lit(name))
        return level(name, cut["lo"], cut["hi"])

    return profile.select("cluster", cluster_name(
        "cluster", leveled("price"), leveled("objective_quality_score"),
        leveled("durability_score"), leveled("sentiment_score"),
    ).alias("cluster_name"))


def name_clusters(df: DataFrame) -> DataFrame:
    """Add ``cluster_name`` to a frame that has ``cluster``."""
    cuts = tercile_cuts(df, CLUSTER_FEATURES, TERCILES)
    return attach_names(df, cluster_names(cluster_profile(df), cuts), "cluster")


def cluster_products(df: DataFrame, k: int = CLUSTERS, seed: int = CLUSTER_SEED) -> DataFrame:
    """Segments of products by price, sentiment, durability and quality, with names."""
    labelled = kmeans(df, CLUSTER_FEATURES, k, seed)
    return name_clusters(labelled).select(*df.columns, "cluster", "cluster_name")
