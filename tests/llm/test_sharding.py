import hashlib
import random

import pytest

from hemline.llm import sharding


def slow(rows, limit):
    """Split on one more bit while a bucket is too large and can be split."""
    hashes = [int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16) for i, t in rows]
    sizes = [len((t or "").encode()) for _, t in rows]
    out = {}

    def bucket(members, depth):
        if sum(sizes[m] for m in members) <= limit or len({hashes[m] for m in members}) == 1:
            for m in members:
                out[m] = (f"{hashes[m]:060b}"[:depth], depth, len(members), sum(sizes[m] for m in members),
                          sum(sizes[m] for m in members) > limit)
        else:
            for bit in (0, 1):
                part = [m for m in members if hashes[m] >> (59 - depth) & 1 == bit]
                if part:
                    bucket(part, depth + 1)

    bucket(list(range(len(rows))), 0)
    return sorted((str(rows[m][0]), *v) for m, v in out.items())


@pytest.mark.parametrize("limit", [10, 100, 3000, 10**9])
def test_agrees_with_splitting_one_by_one(docs, limit):
    r = random.Random(1)
    rows = [(i, "x" * r.randint(0, 60)) for i in range(300)] + [(None, "a" * 30), (None, "b" * 30), (1000, "é" * 2000)]
    rows += [(2000, "copy")] * 40 + [(3000 + i, "hot text") for i in range(150)] + [(4000, None), (4001, "")]
    found = sharding.shards(docs(rows), limit=limit).collect()
    assert sorted((str(r["doc_id"]), r["shard"], r["depth"], r["shard_docs"], r["shard_bytes"], r["oversized"])
                  for r in found) == slow(rows, limit)


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    rows = [(i, "x" * (i % 50)) for i in range(200)] + [(7, "x" * 7), (None, None)]
    path = str(tmp_path / "shards")
    sharding.write_shards(docs(rows), path, limit=500)
    back = spark.read.option("basePath", path).schema(docs([]).schema.add("shard", "string")).parquet(path)
    assert sorted((str(r["doc_id"]), r["text"]) for r in back.collect()) == sorted((str(i), t) for i, t in rows)
    sums = back.selectExpr("shard", "coalesce(octet_length(text), 0) AS n").groupBy("shard").sum("n").collect()
    assert len(sums) > 8 and all(r[1] <= 500 for r in sums)


def test_empty_table(docs):
    assert sharding.shards(docs([])).count() == 0
