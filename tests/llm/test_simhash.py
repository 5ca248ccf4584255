import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from hemline.llm import components, simhash


def slow_print(text):
    words, word = [], ""
    for sign in text + " ":
        if sign in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += sign.lower() if "A" <= sign <= "Z" else sign
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes) and hashes)


def slow_components(prints):
    """Smallest id reachable over links of four bits or fewer."""
    ids = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 4 and ids[a] != ids[b]:
                    ids[a] = ids[b] = min(ids[a], ids[b])
                    changed = True
    return ids


TEXTS = ["", None, " \n", "one", "One TWO  three", "one two three four", "one two three four five", "É été", "é été",
         "a b c d " * 3000, "word " * 70_000, "\x1cone two", "x" * 100_000]


def test_fingerprints_agree_with_the_definition():
    r = random.Random(3)
    texts = [t or "" for t in TEXTS[:-3]] + [
        " ".join(r.choice("the of And to In ß ñ".split()) for _ in range(r.randint(1, 90))) for _ in range(40)]
    assert [simhash.simhash(t) for t in texts] == [slow_print(t) for t in texts]


def test_spark_hashes_shingles_alike(spark):
    value = spark.range(1).select(F.xxhash64(F.lit("one two three four"))).first()[0] % (1 << 64)
    assert simhash.simhash("One two three FOUR") == value


def test_every_link_is_found_at_any_slice_size(spark):
    r = random.Random(4)
    prints = [r.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        base = r.choice(prints)
        for bit in r.sample(range(64), r.randint(1, 6)):
            base ^= 1 << bit
        prints.append(base)
    prints = sorted(set(prints) | {0, (1 << 64) - 1, 15})
    want = slow_components(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print long")
    for slice_size in (1 << 10, 1 << 22):
        root = list(range(len(prints)))
        at = {simhash._signed(p): i for i, p in enumerate(prints)}
        pairs = [(at[r["a"]], at[r["b"]]) for r in simhash.links(df, slice_size=slice_size).collect()]
        assert all((prints[a] ^ prints[b]).bit_count() <= 64 for a, b in pairs)
        for _ in prints:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        assert root == want


def test_groups_of_documents(docs):
    r = random.Random(5)
    long = " ".join(str(r.randint(0, 9999)) for _ in range(400))
    rows = list(enumerate(TEXTS, 10)) + [(3, long), (5, long + " end"), (5, long + " end"), (4, long.replace(" ", "\n"))]
    rows += [(None, "one two three four")]
    found = simhash.near_duplicates(docs(rows)).collect()
    assert len(found) == len(rows)
    prints = sorted((i, t or "") for i, t in rows if i is not None)
    want = slow_components([slow_print(t) if len(t) < 9000 else simhash.simhash(t) for _, t in prints])
    assert sorted((r["doc_id"], r["component_id"]) for r in found if r["doc_id"] is not None) == sorted(
        (i, prints[c][0]) for (i, _), c in zip(prints, want))
    stays = simhash.near_distinct(docs(rows))
    assert stays.columns == docs(rows).columns
    ids = [r["doc_id"] for r in stays.collect()]
    assert len(ids) == len({r["component_id"] for r in found}) and {3, 10} <= set(ids) and not {4, 5, 11, None} & set(ids)


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    assert simhash.near_distinct(docs([])).count() == 0


def test_components_of_long_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500 - i, 500) for i in range(1, 40)] + [(7, 8), (8, 7), (9, 9)]
    order = chain + star
    random.Random(6).shuffle(order)
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(order, "a long, b long")).collect()}
    assert {found[n] for n in range(100, 161)} == {100}
    assert {found[500 - i] for i in range(40)} == {461} and found[7] == found[8] == 7


def test_flips():
    masks = simhash.flips(10, 2)
    assert len(set(masks.tolist())) == 1 + 10 + 45 and np.bitwise_count(masks).max() == 2
