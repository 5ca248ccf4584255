import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from hemline.llm import warc

ROWS = [(5, "http://a/", "<p>x</p>"), (2, "http://b/ c\n", "<p>x</p>"), (9, None, "<p>x</p>"), (1, "http://d/", None),
        (3, "http://e/", ""), (4, "http://f/é", "WARC/1.1\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n\r\n\r\n"),
        (6, "http://g/", "é" * 40_000 + "\r\n\r\n"), (7, "", "é" * 40_000 + "\r\n\r\n"), (None, "http://h/", "y"),
        (8, "http://h/", "y"), (10, "http://i/", "z\x00\x01"), (11, "http://j/", "same"), (11, "http://j/", "same")]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", 0) for r in rows], "page_id long, url string, html string, type string, place int")


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        again = len((html or "").encode()) >= least and first.get(html or "") != i
        out.append((i, len((html or "").encode()), digest(html), "revisit" if again else "response",
                    first[html or ""] if again else None))
    return out


@pytest.mark.parametrize("least", [0, 1, 5])
def test_archives_hold_what_was_written(spark, least):
    rows = ROWS + [(100 + i, f"http://h{i}/", random.Random(i).choice(["hot", "hot", str(i)])) for i in range(80)]
    got = warc.deduplicated_archives(pages(spark, rows), least_bytes=least).collect()
    want = expected([r for r in rows if r[0] != 11], least)
    assert sorted((tuple(r)[:5] for r in got if r[0] != 11), key=str) == sorted(want, key=str)
    twice = sorted(((r["record_type"], r["refers_to"]) for r in got if r[0] == 11), key=str)     # one key, one payload
    assert twice == [("response", None), ("revisit", 11) if least <= 4 else ("response", None)]


def test_revisits_have_no_payload_and_name_the_original(spark, tmp_path):
    source, target = str(tmp_path / "a"), str(tmp_path / "b")
    warc.deduplicated_archives(pages(spark, ROWS), source=source, target=target).collect()
    records = [r for f in sorted((tmp_path / "b").glob("*.gz")) for r in warc.walk(f.read_bytes())]
    assert len(records) == len(ROWS)
    ids = {h["x-record-key"]: h["warc-record-id"] for h, _, _ in records if "x-record-key" in h}
    for headers, http, payload in records:
        assert http.startswith(b"HTTP/1.1 200 OK")
        if headers["warc-type"] == "revisit":
            assert payload == b"" and headers["warc-profile"] == warc.REVISIT
            assert headers["warc-refers-to"] == ids[headers["x-refers-to-key"]]
        else:
            assert headers["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert not any(" " in h.get("warc-target-uri", "") for h, _, _ in records)


def test_plain_and_joined_gzip_members(tmp_path):
    import gzip

    one = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [p for _, _, p in warc.walk(one + one)] == [b"abc"] * 2
    assert [p for _, _, p in warc.walk(gzip.compress(one) + gzip.compress(one))] == [b"abc"] * 2


def test_base32(spark):
    texts = ["", "a", "é", "z" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(warc.base32_sha1(F.col("t").cast("binary"))).collect()]
    assert got == [digest(t) for t in texts]


def test_empty_table(spark):
    assert warc.deduplicated_archives(pages(spark, ROWS).limit(0)).count() == 0
