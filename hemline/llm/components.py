"""Connected components over links, by alternating large and small stars.

Every round joins and aggregates links as DataFrames and writes them to the shared folder, so a lost executor costs
at most one round. A node with very many neighbours is an ordinary aggregate (combined in the map tasks) and a
join that adaptive execution may split. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.session import written


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node now hangs on the smallest node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
    return both.filter("b > a").join(least, "a").select(F.col("root").alias("a"), "b").filter("a < b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours hang on the smallest of them."""
    least = links.groupBy("b").agg(F.min("a").alias("root"))
    moved = links.join(least, "b").filter("a <> root").select(F.col("root").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("root").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of the links (a, b) with the smallest node that it can reach."""
    links = written(
        links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        links = written(_small_star(_large_star(links)), "links")
        seen = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.hash("a", "b"))).first()
        if seen == mark:                                # two equal rounds: every link leads to a root
            break
        mark = seen
    roots = links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
