import random
import re
from collections import Counter, defaultdict

import numpy as np

from hemline.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n int, `value` string, term string, `rank` int"


def slow(rows, least=10, top=10):
    """(lang, source, part, item, value, rank) from dense counts, in Python's whole numbers."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in terms]
        groups[lang].add(source)
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    found = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def p_of(own):
            mass = sum(own[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (own[t] + 2) // mass for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q, ps = p_of(whole), {s: p_of(counts[lang, s]) for s in sources}

        def gap(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = sorted((-sum(gap(ps[s][t], ps[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-gap(ps[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and ps[s][t] > q[t])
            found |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)}
            found |= {(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(terms[:top], 1)}
    return found


def run(spark, rows, **parameters):
    df = spark.createDataFrame([(i, *row, 1, "v", "t", 2) for i, row in enumerate(rows)], SCHEMA)
    found = [tuple(r) for r in divergence.divergence(df, **parameters).collect()]
    assert len(found) == len(set(found))
    return set(found)


def made(seed, n=260):
    drawn = random.Random(seed)
    words = [f"{a}{b}" for a in "stÄéß漢" for b in ("ab", "o", "ing", "É", "x", "д")] + ["The", "the", "x1y", "a-b"]
    rows = []
    for _ in range(n):
        text = " ".join(drawn.choice(words[:drawn.choice([8, 40])]) for _ in range(drawn.randrange(30)))
        rows.append((text, drawn.choice(["en", "de", None, "en"]), drawn.choice(["a", "b", "ü", None, "a", "a", ""])))
    rows += [drawn.choice(rows[:20]) for _ in range(n)]              # copies, in the same source and in others
    return rows + [(rows[i][0], rows[i][1], drawn.choice("abz")) for i in range(n // 2)]


def test_against_dense_counts(spark):
    for seed in (1, 2):
        rows = made(seed)
        assert run(spark, rows) == slow(rows)


def test_one_count_flushed_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(divergence, "FLUSH", 3)
    monkeypatch.setattr(divergence, "PAIRS", 2)
    rows = made(3, 80)
    assert run(spark, rows, least_docs=4, top_terms=3) == slow(rows, 4, 3)


def test_odd_documents(spark):
    rows = [(None, None, None), ("", "xx", "only"), (None, "yy", "a"), ("", "yy", "b"), ("word " * 3, "zz", "a")]
    assert run(spark, rows) == slow(rows)
    assert {r for r in run(spark, rows) if r[0] == "yy"} == {("yy", "a", "pair", "b", 0, 1), ("yy", "b", "pair", "a", 0, 1)}
    rows += [("tie tye " * 400_000, "en", "s"), ("x" * 100_000, "en", None)] * 6 + [("tie tye", "en", "t")] * 9
    assert run(spark, rows) == slow(rows)
    assert run(spark, []) == set()


def test_shares_of_huge_counts_do_not_overflow(spark):
    drawn = random.Random(4)
    cases = [(drawn.randrange(10 ** drawn.randint(1, 14)), 10 ** drawn.randint(1, 14)) for _ in range(200)]
    cases = [(min(n, m), m + 2) for n, m in cases]
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, n, m) for i, (n, m) in enumerate(cases)], "i long, n long, m long")
    found = [r[0] for r in df.orderBy("i").select(divergence.share(F.col("n"), F.col("m"))).collect()]
    assert found == [1 + 10**9 * (n + 2) // m for n, m in cases]


def test_terms_by_pieces():
    drawn = np.random.default_rng(1)
    text = bytes(drawn.integers(0, 128, 5000, np.uint8))
    want = re.findall(rb"[A-Za-z]+", text)
    assert [t for part in divergence.terms_of(text) for t in part] == [w.lower() for w in want]
