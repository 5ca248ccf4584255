import random

import pytest

from hemline.llm import minhash


def sets_of(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def slow_groups(rows):
    sets, label = [sets_of(t) for _, t in rows], list(range(len(rows)))
    pairs = [(a, b) for a in range(len(rows)) for b in range(a)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    members = {}
    for i, root in enumerate(label):
        members.setdefault(root, []).append(rows[i][0])
    least = {root: min((i for i in ids if i is not None), default=None) for root, ids in members.items()}
    return sorted(((i, len(s), least[r], i is not None and i == least[r]) for (i, _), s, r in zip(rows, sets, label)), key=str)


def groups(df, **parameters):
    return sorted((tuple(r) for r in minhash.near_groups(df, **parameters).collect()), key=str)


def edited(words, spots, drawn):
    made = list(words)
    for at in spots:
        made[at] = f"new{drawn.random()}"
    return made


@pytest.fixture(scope="module")
def rows():
    """Families around the limit, a chain, texts that all lie just below the limit, copies."""
    drawn = random.Random(7)
    texts = []
    for family in range(20):
        base = [f"w{drawn.randrange(3000)}" for _ in range(150)]
        texts += [" ".join(base), " ".join(edited(base, drawn.sample(range(150), 1 + family % 6), drawn)).upper()]
    chain = [f"c{i}" for i in range(150)]
    for step in range(6):
        texts.append(" ".join(chain))
        chain = edited(chain, range(step * 20, step * 20 + 9), drawn)
    base = [f"s{i}" for i in range(150)]
    texts += [" ".join(edited(base, drawn.sample(range(150), drawn.randrange(8)), drawn)) for _ in range(40)]
    texts += ["one two", "One  two", "one two three", "one", "a b c a b c a b c", "a b c a b c"] + texts[:3]
    drawn.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("turns", [0, 2])
def test_against_all_pairs(docs, rows, turns):
    assert groups(docs(rows), turns=turns) == slow_groups(rows)


def test_differences_decide_what_heads_leave(docs, rows, monkeypatch):
    monkeypatch.setattr(minhash, "band_keys", lambda minima: [1])              # all meet in one bucket
    assert groups(docs(rows), turns=0) == slow_groups(rows)


def family_of(sets):
    return [(1, i, len(s), s.tobytes(), i) for i, s in enumerate(sets)]


SETS = "family long, node long, size long, shingles binary, root long"


def test_differences_hold_what_components_need(spark):
    """Sets around a common one, some of them within the limit of others: the pairs join them alike."""
    drawn = random.Random(6)
    for _ in range(6):
        base = [f"s{i}" for i in range(60)]
        texts = [edited(base, drawn.sample(range(60), drawn.randrange(5)), drawn)[:drawn.randint(54, 60)] for _ in range(60)]
        texts += [edited(texts[i], drawn.sample(range(50), 1), drawn) for i in range(20)]
        sets = list({s.tobytes(): s for s in (minhash.shingles([w.encode() for w in t]) for t in texts)}.values())
        met = {tuple(r) for r in minhash.sharing_differences(spark.createDataFrame(family_of(sets), SETS)).collect()}
        near = {(a, b) for b in range(len(sets)) for a in range(b) if minhash.similar(sets[a], sets[b])}

        def roots(pairs):
            label, changed = list(range(len(sets))), True
            while changed:
                changed = False
                for a, b in pairs:
                    if label[a] != label[b]:
                        label[a] = label[b] = min(label[a], label[b])
                        changed = True
            return label

        assert roots(met & near) == roots(near)


@pytest.mark.parametrize("edits", [4, 6, 12])
def test_below_the_limit_few_pairs_meet(spark, edits):
    """Texts with edits of their own, less than the limit alike: few of all pairs meet."""
    drawn, base = random.Random(4), [f"s{i}" for i in range(147)]
    sets = [minhash.shingles([w.encode() for w in edited(base, drawn.sample(range(147), edits), drawn)]) for _ in range(200)]
    assert minhash.sharing_differences(spark.createDataFrame(family_of(sets), SETS)).count() < 200 * 199 / 2 / 5


def test_odd_texts(docs):
    rows = [(3, None), (2, ""), (1, " \n"), (4, "a b c"), (4, "a b c"), (None, "A b  c"), (None, "other words here"),
            (None, "other words here"), (None, None), (9, "x y"), (8, "X\x0by"), (6, "w " * 90_000), (5, "w " * 90_000),
            (7, "z" * 100_000), (10, "é È"), (11, "É è")]
    assert groups(docs(rows)) == slow_groups(rows)
    assert groups(docs([])) == []
    assert groups(docs([(1, None), (2, "")])) == [(1, 0, 1, True), (2, 0, 2, True)]
