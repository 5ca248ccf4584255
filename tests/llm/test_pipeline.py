"""The pipeline's stages against brute force on whole small tables, and the registered queries."""

import os
import re

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from checks.compare import connect, difference
from hemline.llm import decontam, packing, queries, simhash
from hemline.llm.base import table

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    rows, problem = difference(spark, connect(SF_DIR), SF_DIR, queries.QUERIES[name], queries.ORACLES.get(name))
    assert problem is None
    assert rows > 0


def test_all_are_registered():
    names = contract.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def groups_of(prints):
    """Places of the first of each group of fingerprints linked by four bits or fewer."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_stages_against_brute_force(spark):
    docs = table(spark, SF_DIR, "documents")
    columns = docs.columns
    rows = sorted((tuple(r) for r in docs.collect()))
    stages = dict(corpus_pipeline.STAGES)

    def run(name, kept):
        df = stages[name](spark, spark.createDataFrame(kept, docs.schema) if kept else docs.limit(0), SF_DIR)
        assert df.columns == columns
        return sorted(tuple(r) for r in df.collect())

    odd = [(10**9, None, "en", "s", 0), (10**9 + 1, "12 34", "en", "s", 5), (10**9 + 2, "", None, None, None)]
    spoken = run("language", rows + odd)
    assert spoken == rows                               # every document of the table has a language

    first = {}
    for row in spoken:
        first.setdefault(re.sub(r"[ \t-\r]+", " ", row[1]), row)
    exact = run("exact_duplicates", spoken)
    assert exact == sorted(first.values())

    prints = [simhash.simhash(r[1]) for r in exact]
    near = run("near_duplicates", exact)
    assert near == [exact[i] for i in sorted(set(groups_of(prints)))]

    items = [decontam.words_of(r["text"]) for r in table(spark, SF_DIR, "benchmark").collect()]

    def dirty(text):
        words = decontam.words_of(text)
        for item in items:
            own, size = decontam.weights(item, 5), min(len(item), len(words))
            for at in range(len(words) - size + 1):
                if words[at] in item or words[at + size - 1] in item:
                    part = words[at:at + size]
                    if len(set(part) & set(item)) > len(set(item)) // 2 and decontam.similarity(
                            own, decontam.weights(part, 5)) >= 0.8:
                        return True
        return False

    clean = run("benchmark", near)
    assert clean == [r for r in near if not dirty(r[1])] and len(clean) < len(near)

    pieces = stages["packing"](spark, spark.createDataFrame(clean, docs.schema), SF_DIR).collect()
    words = packing.Words(queries.word_tokenizer())
    for row in clean:
        own = sorted((p["start"], p["ids"]) for p in pieces if p["doc_id"] == row[0])
        assert b"".join(ids for _, ids in own) == words.ids(row[1]) + np.array([2], np.uint32).tobytes()


def test_run_passes_every_stage(spark):
    done = corpus_pipeline.run(spark, SF_DIR)
    assert done.count() > 0 and {"doc_id", "sequence_id", "ids"} <= set(done.columns)


def test_empty_documents(spark):
    docs = table(spark, SF_DIR, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
