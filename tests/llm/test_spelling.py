import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from hemline.llm import spelling


def slow_variants(rows, least_letters=6, least_count=5):
    counted = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            counted[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in counted.items() if len(w) >= least_letters and c >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    found = {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 5 * n[w] else None
        found[w] = [n[w], len(others), form, n[form] if form else None]
    for w, row in found.items():
        root = w
        while found[root][2]:
            root = found[root][2]
        row.append(root)
    return {(w, *row) for w, row in found.items()}


def variants(df, **parameters):
    rows = [tuple(r) for r in spelling.variants(df, **parameters).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_texts(seed, families=25):
    drawn, texts = random.Random(seed), []
    signs = "abcdeÀéÿ×÷z"
    for family in range(families):
        base = [drawn.choice(signs) for _ in range(drawn.choice([5, 6, 7, 8, 12]))]
        for step in range(4):
            word = "".join(base)
            texts += [word] * drawn.choice([1, 5, 6, 30, 160])
            kind, place = drawn.randrange(3), drawn.randrange(len(base))
            base[place:place + (kind > 0)] = [drawn.choice(signs)] if kind < 2 else []
    drawn.shuffle(texts)
    return [(i, " ".join(texts[i::60]).upper() if i % 3 else "\n".join(texts[i::60])) for i in range(60)]


@pytest.mark.parametrize("leaf, leaves", [(2048, 4096), (3, 4096), (1, 4)])
def test_against_all_pairs(docs, leaf, leaves):
    rows = made_texts(leaf)
    assert variants(docs(rows), leaf=leaf, leaves=leaves) == slow_variants(rows)


def test_chains_are_followed(docs):
    words = {"letters": 5, "lettere": 25, "lettert": 25, "lettes": 130, "lettesx": 700}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    rows = [(4, text)]
    found = {r[0]: r for r in variants(docs(rows))}
    assert found == {r[0]: r for r in slow_variants(rows)}
    assert len({r[5] for r in found.values()}) < len(found)


def test_odd_texts(docs):
    long = " ".join(["strange"] * 40_000 + ["strangle"] * 6 + ["x" * 70_000] * 5)
    rows = [(None, "Straße strasse " * 9), (None, None), (7, ""), (7, None), (1, long), (1, "strangeĀstrange _strange9"),
            (3, "ΑΒΓΔΕΖΗ привет 漢字漢字漢字"), (3, "strangÈ strangè " * 5), (3, "strangÈ strangè " * 5), (5, "abcdef badcef " * 9)]
    assert variants(docs(rows)) == slow_variants(rows)
    assert variants(docs([])) == set()
    assert variants(docs([(1, None), (2, "")])) == set()


def test_words_that_share_all_letters(docs):
    drawn, rows = random.Random(5), []
    for i in range(80):
        letters = list("abcdefgh")
        drawn.shuffle(letters)
        rows.append((i, " ".join(["".join(letters)] * 6 + ["".join(letters[:-1])] * 40)))
    assert variants(docs(rows), leaf=4) == slow_variants(rows)


def test_boxes_reach_every_near_word():
    drawn = random.Random(9)
    words = ["".join(drawn.choice("abcd") for _ in range(6)).encode() for _ in range(300)]
    points = spelling.vectors(words)
    tree = spelling.grown(points, 2)
    leaves = tree.leaves(points)
    reached = {(row, node) for node, rows in tree.reached(points, 1, 1) for row in rows.tolist()}
    letters = np.array([list(w) for w in words])
    for a in range(len(words)):
        for b in range(len(words)):
            if (letters[a] != letters[b]).sum() == 1:
                assert (a, int(leaves[b])) in reached
