import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from hemline.llm import suffixes


def slow(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                covered[i:i + length] = b"\1" * length
        kept = bytes(b for b, c in zip(t, covered) if not c)
        runs = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((len(t), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return out


def mutated(r, n):
    texts = ["", "ab" * 40, "a" * 90, "é" * 30]
    for _ in range(n):
        k = r.random()
        if k < 0.3:
            base = r.choice(texts)
            cut = r.randint(0, len(base))
            texts.append(base[:cut] + "".join(r.choice("abc é") for _ in range(r.randint(0, 9))) + base[r.randint(0, len(base)):])
        elif k < 0.4:
            texts.append(r.choice(texts))
        else:
            texts.append("".join(r.choice("abcdefé ") for _ in range(r.randint(0, 80))))
    return texts


@pytest.mark.parametrize("crowd", [10**6, 3])           # by columns alone, and by digests for frequent anchors
@pytest.mark.parametrize("length,gram", [(12, 5), (20, 8)])
def test_agrees_with_brute_force(docs, length, gram, crowd):
    texts = mutated(random.Random(length), 150)
    rows = list(enumerate(texts)) + [(None, None), (None, "abcdefabcdefabcdefabcdef"), (7, texts[7]), (7, texts[7])]
    found = suffixes.repeats_removed(docs(rows), length=length, gram=gram, crowd=crowd).collect()
    want = slow([(t or "").encode() for _, t in rows], length)
    assert sorted(((str(r["doc_id"]), *tuple(r)[1:5]) for r in found)) == sorted(
        (str(i), *w) for (i, _), w in zip(rows, want))
    for row in found:
        assert sum(s["stop"] - s["start"] for s in row["spans"]) == row["n_removed"]


def test_long_texts_cross_stretches(monkeypatch):
    r = random.Random(2)
    texts = [bytes(r.choice(b"abcd") for _ in range(r.randint(0, 4000))) for _ in range(12)] + [b"z" * 3000]
    whole = [a.tolist() for a in suffixes.anchors(texts, 30, 10)]
    monkeypatch.setattr(suffixes, "STRETCH", 512)
    assert [a.tolist() for a in suffixes.anchors(texts, 30, 10)] == whole


def test_every_passage_has_an_anchor_that_its_copies_share():
    r = random.Random(3)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 300))) for _ in range(30)]
    text, place, _ = suffixes.anchors(texts, 24, 6)
    at = {}
    for t, p in zip(text.tolist(), place.tolist()):
        at.setdefault(t, set()).add(p)
    offsets = {}
    for t, data in enumerate(texts):
        for i in range(len(data) - 23):
            inside = frozenset(p - i for p in at[t] if i <= p <= i + 18)
            assert inside
            offsets.setdefault(data[i:i + 24], []).append(inside)
    for found in offsets.values():                      # a common anchor for any two copies
        assert frozenset.intersection(*found)


def test_columns_agree_with_brute_force():
    r = random.Random(4)
    rows = np.array([[r.choice(b"ab") for _ in range(14)] for _ in range(60)], np.uint8)
    got = suffixes.shared_columns(rows, 6)
    for column in range(9):
        seen = Counter(row[column:column + 6].tobytes() for row in rows)
        assert got[:, column].tolist() == [seen[row[column:column + 6].tobytes()] > 1 for row in rows]


def test_empty_table(docs):
    assert suffixes.repeats_removed(docs([])).count() == 0


def test_production_length(docs):
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(700))
    rows = [(1, "x" + passage[:399] + "y"), (2, passage[:400] + "?"), (3, "tail " + passage), (4, "none"), (5, None)]
    found = {r["doc_id"]: r for r in suffixes.repeats_removed(docs(rows)).collect()}
    assert [found[i]["n_removed"] for i in range(1, 6)] == [0, 400, 400, 0, 0]
    assert found[3]["spans"] == [(5, 405)] and found[2]["kept_sha256"] == hashlib.sha256(b"?").hexdigest()


def crowding(r, n):
    """Texts that share a passage between other words, and texts of one word over and over."""
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))                            # noqa: E731
    words = lambda k: " ".join(word() for _ in range(k))                                                    # noqa: E731
    passage = words(8)
    return [f"{words(9)} {passage} {words(9)}" for _ in range(n)] + ["tick " * 60 + words(5) for _ in range(n)]


def test_a_text_counts_once_for_an_anchor(docs, monkeypatch):
    kept, real = {}, suffixes.written
    monkeypatch.setattr(suffixes, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    texts = crowding(random.Random(6), 5)
    rows = list(enumerate(texts + texts[-1:] * 4))      # copies are one text
    found = suffixes.repeats_removed(docs(rows), length=20, gram=8).collect()
    assert sorted(tuple(r)[1:5] for r in found) == sorted(slow([t.encode() for _, t in rows], 20))
    assert kept["anchors"].count() == len(texts)        # a row per different text


@pytest.mark.parametrize("crowd", [10**6, 3])
def test_no_task_gets_a_crowded_anchor(spark, docs, monkeypatch, crowd):
    seen, frame = [], type(spark.range(1))
    real = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *a: (seen.append(self) if "anchor" in a else None, real(self, *a))[1])
    texts = crowding(random.Random(7), 12)
    found = suffixes.repeats_removed(docs(list(enumerate(texts))), length=20, gram=8, crowd=crowd).collect()
    assert sorted(tuple(r)[1:5] for r in found) == sorted(slow([t.encode() for t in texts], 20))
    places = [r["count"] for r in seen[0].filter("context IS NOT NULL").groupBy("anchor").count().collect()]
    assert max(places) >= 12 if crowd > 12 else max(places, default=0) <= 3
    assert max(r["count"] for r in seen[0].filter("context IS NULL").groupBy("key", "done").count().collect()) < 20
