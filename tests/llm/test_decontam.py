import random
from collections import Counter

import numpy as np
import pytest

from hemline.llm import decontam


def slow_similarity(a, b, width):
    x, y = (Counter(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) for w in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def slow(docs, items):
    """Every window of every document against every item."""
    out = {}
    for d, text in docs:
        words = decontam.words_of(text or "")
        for i, item in items:
            own = decontam.words_of(item or "")
            width, size = min(5, len(own)), min(len(own), len(words))
            best = (0.0, 0)
            for start in range(len(words) - size + 1 if own and size >= width else 0):
                value = slow_similarity(words[start:start + size], own, width)
                if value >= 0.8 and value > best[0]:
                    best = (value, start)
            if best[0]:
                out[d, i] = (round(best[0], 12), best[1], size)
    return out


@pytest.fixture(scope="module")
def cases():
    r = random.Random(1)
    vocabulary = [f"{a}{b}" for a in "klmnprst" for b in "aeiou"]
    prose = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(prose(r.randint(18, 40)))) for i in range(12)]
    items += [(50, "short one"), (51, None), (52, ""), (53, "..."), (54, "ka " * 30), (55, items[0][1])]
    docs = []
    for i in range(60):
        words = prose(r.randint(0, 120))
        for _ in range(r.randint(0, 2)):
            passage = r.choice(items)[1] or ""
            part = passage.split()
            for _ in range(r.randint(0, 3)):
                if part:
                    part[r.choice([0, -1, r.randrange(len(part))])] = r.choice(vocabulary)
            at = r.randint(0, len(words))
            words[at:at] = part[r.randint(0, 2):]
        docs.append((i, r.choice([" ", "  ", ", "]).join(w.upper() if r.random() < 0.1 else w for w in words)))
    docs += [(100, None), (101, ""), (102, "ka " * 20_000), (103, " ".join(items[1][1].split()[:-1])), (104, "Short, ONE!"),
             (105, "short"), (106, items[2][1]), (106, items[2][1]), (None, items[3][1])]
    return docs, items


def frames(spark, docs_fixture, cases):
    docs, items = cases
    return docs_fixture(docs), spark.createDataFrame([(i, t, 1) for i, t in items], "item_id int, text string, similarity int")


def test_agrees_with_every_window(spark, docs, cases):
    df, benchmark = frames(spark, docs, cases)
    want = slow([c for c in cases[0] if c[0] != 102], cases[1])
    for block_bytes in (decontam.BLOCK_BYTES, 800):         # in one block of items, and in several
        rows = decontam.contaminated(df, benchmark, block_bytes=block_bytes).collect()
        got = {(r[0], r[1]): (round(r[2], 12), r[3], r[4]) for r in rows if r[0] != 102}
        assert got == want
        assert sum(r[0] == 106 for r in rows) == 2 * sum(k[0] == 106 for k in want)
        assert {(r[0], r[1]) for r in rows if r[0] == 102} == {(102, 54)}
    clean = decontam.decontaminated(df, benchmark)
    assert clean.columns == df.columns
    dirty = {k[0] for k in want} | {102}
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, _ in cases[0] if i not in dirty)


def test_blocks_find_all_within_the_radius():
    r = random.Random(2)
    index = decontam.Index([(i, f"w{i} a b c d e f g") for i in range(200)], radius=6)
    index.prints = np.array([r.getrandbits(64) for _ in range(200)], np.uint64)
    sought = []
    for p in index.prints.tolist():
        for n in range(0, 9):
            q = p
            for bit in r.sample(range(64), n):
                q ^= 1 << bit
            sought.append(q)
    window, item = index.near(np.array(sought, np.uint64), np.arange(200))
    want = {(w, i) for w, q in enumerate(sought) for i, p in enumerate(index.prints.tolist()) if (p ^ q).bit_count() <= 6}
    assert set(zip(window.tolist(), item.tolist())) == want


def test_empty_tables(spark, docs, cases):
    df, benchmark = frames(spark, docs, cases)
    assert decontam.contaminated(df.limit(0), benchmark).count() == 0
    assert decontam.contaminated(df, benchmark.limit(0)).count() == 0
    assert decontam.decontaminated(df, benchmark.limit(0)).count() == len(cases[0])
