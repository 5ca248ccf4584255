"""One query per operator over its whole table; ``ORACLES`` has the SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hemline.llm import (
    decontam, divergence, exact, language, minhash, packing, pii, secrets, sharding, simhash, spelling, suffixes, warc,
)
from hemline.llm.base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def word_tokenizer() -> str:
    """The place of the vocabulary file that packing uses."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


WARC_SQL = """
WITH payloads AS (
    SELECT page_id, url, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
digests AS (
    SELECT page_id, url, octet_length(payload) AS payload_bytes, list_aggregate(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(('0x' || substr(hex, 1 + i // 4 * 5, 5))::BIGINT
            // (32 ** (3 - i % 4))::BIGINT % 32 AS BIGINT), 1)), 'string_agg', '') AS payload_digest
    FROM payloads),
firsts AS (SELECT payload_digest, min(page_id) AS first_id FROM digests GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END
    AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to, url AS uri
FROM digests JOIN firsts USING (payload_digest)
"""


@query(WARC_SQL)
def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.deduplicated_archives(table(spark, sf_dir, "pages"))


@query()
def op2_benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


SURROGATE_KEY = b"key of the test tables"       # a real run keeps its key apart from code and data


@query()
def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymised(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    counts = [F.coalesce(F.try_element_at("entities", F.lit(kind)), F.lit(0)).alias(f"n_{kind}") for kind in pii.KINDS]
    return done.select("doc_id", "text", *counts)


SHARD_SQL = f"""
WITH hashed AS (
    SELECT doc_id, strlen(coalesce(text, '')) AS bytes, CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR),
        ''), ':', coalesce(text, ''))), 1, 15) AS BIGINT) AS hash FROM documents),
depths AS (SELECT unnest(range(0, 25)) AS depth),
prefixes AS (
    SELECT depth, hash >> (60 - depth) AS prefix, CAST(sum(bytes) AS BIGINT) AS shard_bytes, count(*) AS shard_docs
    FROM hashed, depths GROUP BY ALL HAVING sum(bytes) <= {sharding.LIMIT} OR min(hash) = max(hash)),
chosen AS (
    SELECT doc_id, hash, min(depth) AS depth FROM hashed, depths JOIN prefixes USING (depth)
    WHERE prefix = hash >> (60 - depth) GROUP BY ALL)
SELECT doc_id, hash, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INT), '0') END AS shard,
    CAST(depth AS INT) AS depth, shard_docs, shard_bytes, shard_bytes > {sharding.LIMIT} AS oversized
FROM chosen JOIN prefixes USING (depth) WHERE prefix = hash >> (60 - depth)
"""


@query(SHARD_SQL)
def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


@query()
def op6_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), word_tokenizer())


@query()
def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats_removed(table(spark, sf_dir, "documents")).drop("spans")


@query()
def op8_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


@query()
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


EXACT_SQL = r"""
WITH texts AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
    FROM documents),
groups AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM texts JOIN groups USING (text_sha256)
"""


@query(EXACT_SQL)
def op10_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SPELLING_SQL = rf"""
WITH RECURSIVE bits AS (
    SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS t
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)),
runs AS (
    SELECT doc_id, run, count(*) AS n FROM (
        SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run
        FROM documents WHERE text IS NOT NULL)
    WHERE length(run) >= 6 GROUP BY ALL),
spelled AS (SELECT *, hex(encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run))) AS signs FROM runs),
summed AS (
    SELECT run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(length(signs) // 2),
            lambda i: CAST('0x' || substr(signs, 1 + 2 * i, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, t[1 + CAST(xor(c, b) & 255 AS INT)]))) AS h FROM spelled, bits),
words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
            ELSE run END AS word, n FROM summed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (
    SELECT word, n, i, left(word, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
formed AS (
    SELECT w.word, any_value(w.n) AS n, count(near) AS n_near,
        CASE WHEN max(near_n) >= 5 * any_value(w.n) THEN min(struct_pack(less := -near_n, near := near)).near END AS form,
        CASE WHEN max(near_n) >= 5 * any_value(w.n) THEN max(near_n) END AS form_n
    FROM words w LEFT JOIN pairs p USING (word) GROUP BY w.word),
chains AS (
    SELECT word, word AS reached, 0 AS steps FROM formed
    UNION ALL SELECT c.word, f.form, steps + 1 FROM chains c JOIN formed f ON f.word = c.reached WHERE f.form IS NOT NULL)
SELECT f.*, root FROM formed f JOIN (SELECT word, arg_max(reached, steps) AS root FROM chains GROUP BY word) USING (word)
"""


@query(SPELLING_SQL)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS place, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
        coalesce(source, '') AS source FROM documents),
uses AS (
    SELECT place, lang, source, unnest(regexp_extract_all({_LOWER.format("text")},
        '[^\x{{00}}-\x{{40}}\x{{5B}}-\x{{60}}\x{{7B}}-\x{{7F}}]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM uses GROUP BY ALL HAVING count(DISTINCT place) >= 10),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM uses SEMI JOIN kept USING (lang, term) GROUP BY ALL),
masses AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL),
valued AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(m.n, 0) + 2 * s.v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (k.n + 2)) // (s.n + 2 * s.v)::HUGEINT AS q
    FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN masses m USING (lang, source)
        LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM valued a JOIN valued b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM valued WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(place AS INT) AS rank FROM ranked
WHERE part = 'pair' OR place <= 10
"""


@query(DIVERGENCE_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


MINHASH_SQL = rf"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^ 	-
]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(
        list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS own FROM split),
shingles AS (SELECT doc_id, len(own) AS size, unnest(own) AS shingle FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.size, b.size HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM sets UNION SELECT r.doc_id, b FROM reach r JOIN edges ON a = r.other)
SELECT doc_id, CAST(len(any_value(own)) AS BIGINT) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach JOIN sets USING (doc_id) GROUP BY doc_id
"""


@query(MINHASH_SQL)
def op13_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))
