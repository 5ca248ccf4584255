import hashlib
import random
import re

from hemline.llm import exact

ROWS = [(4, "a  b"), (2, "a\t\nb"), (9, "a b"), (5, None), (6, ""), (7, " "), (8, " "), (None, "a b"), (3, "x" * 50_000),
        (3, "x" * 50_000), (1, "x" * 50_000 + "y"), (10, "A b")]


def expected(rows):
    groups = {}
    texts = [re.sub(r"[ \t-\r]+", " ", t or "") for _, t in rows]
    for (i, _), t in zip(rows, texts):
        groups.setdefault(t, []).append(i)
    out = []
    for (i, _), t in zip(rows, texts):
        keep = min((x for x in groups[t] if x is not None), default=None)
        out.append((i, keep, len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:3] + (r["text_sha256"],) for r in df.collect()), key=str)


def test_groups_agree_with_brute_force(docs):
    r = random.Random(1)
    rows = ROWS + [(100 + i, r.choice(["hot", "hot ", "hot\n"]) if i % 3 else f"{r.randint(0, 60)}") for i in range(400)]
    for counters in (1, 3, 1024):                       # many, some and no digests beyond the summary
        assert got(exact.exact_groups(docs(rows), counters=counters)) == expected(rows)


def test_exactly_one_row_of_a_group_stays(docs):
    for counters in (1, 1024):
        groups = exact.exact_groups(docs(ROWS), counters=counters)
        assert groups.filter("kept").count() == len({h for *_, h in expected(ROWS)})
        stays = exact.exact_distinct(docs(ROWS), counters=counters)
        assert stays.columns == docs(ROWS).columns
        assert sorted((r["doc_id"], r["text"]) for r in stays.collect()) == sorted(
            [(1, "x" * 50_000 + "y"), (2, "a\t\nb"), (3, "x" * 50_000), (5, None), (7, " "), (8, " "), (10, "A b")])


def test_empty_table(docs):
    assert exact.exact_groups(docs([])).count() == 0
    assert exact.exact_distinct(docs([])).count() == 0


def test_summary_keeps_what_is_frequent():
    import pyarrow as pa

    values = [b"a"] * 40 + [str(i).encode() for i in range(60)] + [b"b"] * 30
    random.Random(2).shuffle(values)
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i:i + 13], pa.binary())], ["digest"]) for i in range(0, 130, 13)]
    (summary,) = exact.misra_gries(iter(batches), 5)
    found = dict(zip(summary.column(0).to_pylist(), summary.column(1).to_pylist()))
    assert len(found) <= 5
    for value, count in ((b"a", 40), (b"b", 30)):
        assert count - 130 / 6 <= found[value] <= count
