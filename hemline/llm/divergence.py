"""How far the sources of a language differ in their words, exactly and with every text tokenized once.

Equal texts of a language become one, with the number of its copies in each source. A text's terms are counted once
and weighted: by its copies in a source for the counts, by all its copies for the document frequency. Terms found in
at least ``LEAST_DOCS`` documents of the language are kept.

Every group gives each kept term a whole number p, about a billion times its share. The distance of two groups is a
sum over all kept terms, but only terms that both have are held against each other one by one: a term that one has
counts through how often each p occurs in it, and one that neither has by its number. So the work follows what
occurs, not terms times sources squared; all arithmetic is in whole numbers.

Defined results: a null text, lang or source counts as empty; a group without terms still has all its pairs; a
language without kept terms has pairs of value 0; ties are ordered by item; repeated rows count as copies; an empty
table gives an empty result. Other columns never matter, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hemline.llm.base import pieces, whole_text
from hemline.session import written

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE_STEPS = 3             # a billion, a thousand at a time
FLUSH = 400_000             # terms a task counts before it hands them on
PAIRS = 1 << 19             # pairs of groups held at once

# Letters of ASCII in lower case and all bytes beyond it make terms.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, piece by piece."""
    for piece in pieces(text.translate(_TABLE)):
        yield piece.split()


def collapsed(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, text, copies): each distinct text of a language once, with its number of copies by source."""
    rows = df.select(whole_text(lang).alias("lang"), whole_text(source).alias("source"),
                     whole_text(text).cast("binary").alias("text"))
    marked = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    copies = marked.groupBy("lang", "digest", "source").agg(F.count(F.lit(1)).alias("n")).groupBy("lang", "digest").agg(
        F.collect_list(F.struct("source", "n")).alias("copies"))
    texts = marked.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    return texts.join(copies, ["lang", "digest"]).select("lang", "text", "copies")


def _handed(counts: dict, frequencies: dict) -> pa.RecordBatch:
    """The counts so far as rows (lang, source, term, n); without a source n is a number of documents."""
    langs, sources, terms, numbers = [], [], [], []
    for (lang, source), found in [*counts.items(), *(((lang, None), found) for lang, found in frequencies.items())]:
        langs += [lang] * len(found)
        sources += [source] * len(found)
        terms += found.keys()
        numbers += found.values()
    counts.clear()
    frequencies.clear()
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()),
         pa.array(numbers, pa.int64())], ["lang", "source", "term", "n"])


def weighted_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n) of a task's collapsed texts."""
    counts, frequencies = defaultdict(Counter), defaultdict(Counter)
    for batch in batches:
        for lang, text, copies in zip(*(column.to_pylist() for column in batch.columns)):
            own, once = Counter(), len(copies) == 1 and copies[0]["n"] == 1
            if once:
                for terms in terms_of(text):
                    counts[lang, copies[0]["source"]].update(terms)
                    own.update(set(terms))
                frequencies[lang].update(own.keys())
            else:
                for terms in terms_of(text):
                    own.update(terms)
                for copy in copies:
                    held, n = counts[lang, copy["source"]], copy["n"]
                    for term, times in own.items():
                        held[term] += times * n
                held, n = frequencies[lang], sum(copy["n"] for copy in copies)
                for term in own:
                    held[term] += n
            if sum(map(len, counts.values())) > FLUSH:
                yield _handed(counts, frequencies)
    yield _handed(counts, frequencies)


def kept_terms(df: DataFrame, text: str, lang: str, source: str, least_docs: int) -> DataFrame:
    """(lang, term, uses): the kept terms with (source, n) of the sources that have them."""
    counted = collapsed(df, text, lang, source).mapInArrow(
        weighted_counts, "lang string, source string, term binary, n long")
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"))
    return summed.groupBy("lang", "term").agg(
        F.sum(F.when(F.col("source").isNull(), F.col("n"))).alias("docs"),
        F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n"))).alias("uses"),
    ).filter(F.col("docs") >= least_docs).select("lang", F.col("term").cast("string").alias("term"), "uses")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, mass: Column) -> Column:
    """1 + floor(1,000,000,000 * (count + 2) / mass), divided a few digits at a time so that nothing overflows."""
    whole, rest = _div(count + 2, mass), (count + 2) % mass
    for _ in range(SCALE_STEPS):
        whole, rest = whole * 1000 + _div(rest * 1000, mass), (rest * 1000) % mass
    return whole + 1


def gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value) for groups a < b: what their common terms add beyond what each term adds by itself.

    A row is (lang, uses), uses the (group, p, p of an absent term) of all groups with a term.
    """
    found: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        langs, uses = batch.column(0).to_pylist(), batch.column(1)
        offsets = uses.offsets.to_numpy().astype(np.int64)
        group, p, none = (uses.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        ends = np.repeat(offsets[1:], np.diff(offsets))             # of the term that an entry belongs to
        first = int(offsets[0])
        rows = np.repeat(np.arange(len(langs)), np.diff(offsets))
        partners = ends - np.arange(first, first + len(ends)) - 1
        cuts = np.searchsorted(np.cumsum(partners), np.arange(PAIRS, int(partners.sum()) + PAIRS, PAIRS)) + 1
        start = 0
        for cut in np.minimum(cuts, len(partners)).tolist():
            n = partners[start:cut]
            one = np.repeat(np.arange(start, start + len(n)), n)
            two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(n) - n, n)
            start = cut
            if not len(one):
                continue
            row, one, two = rows[one], one + first, two + first
            value = _gap(p[one], p[two]) - _gap(p[one], none[two]) - _gap(none[one], p[two]) + _gap(none[one], none[two])
            low, high = np.minimum(group[one], group[two]), np.maximum(group[one], group[two])
            for lang in set(langs):
                own = np.array([x == lang for x in langs])[row]
                keys, at = np.unique((low[own] << 32) | high[own], return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, at, value[own])
                for key, total in zip(keys.tolist(), sums.tolist()):
                    found[lang][key] += total
    rows = [(lang, key >> 32, key & 0xFFFFFFFF, value) for lang, own in found.items() for key, value in own.items()]
    lang, a, b, value = zip(*rows) if rows else ((), (), (), ())
    yield pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), *(pa.array(x, pa.int64()) for x in (a, b, value))], ["lang", "a", "b", "value"])


def divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
               least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): the other sources of the language and their distance, all of them
    (``pair``), and the terms by which a source stands out from its language, ``top_terms`` of them (``term``)."""
    terms = written(kept_terms(df, text, lang, source, least_docs), "kept-terms")
    uses = terms.select("lang", "term", F.inline("uses"))
    sizes = terms.groupBy("lang").agg(
        F.count(F.lit(1)).alias("v"), F.sum(F.aggregate("uses", F.lit(0).cast("long"), lambda s, u: s + u["n"])).alias("n"))
    masses = uses.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = df.select(whole_text(lang).alias("lang"), whole_text(source).alias("source")).distinct()
    # The result has a row for each two groups of a language, so their number is small beside it.
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    groups = written(
        groups.join(masses, ["lang", "source"], "left").join(sizes.select("lang", "v"), "lang", "left").select(
            "lang", "source", number.alias("group"), F.coalesce("v", F.lit(0)).alias("v"),
            (F.coalesce("n", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("mass")), "groups")
    langs = sizes.select("lang", (F.col("n") + 2 * F.col("v")).alias("lang_mass"))

    whole = F.aggregate("uses", F.lit(0).cast("long"), lambda s, u: s + u["n"])
    valued = terms.join(langs, "lang").select(
        "lang", "term", share(whole, F.col("lang_mass")).alias("q"), F.inline("uses"))
    placed = groups.select("lang", "source", "group", "mass")
    occurring = written(valued.join(placed, ["lang", "source"]).select(
        "lang", "source", "term", "group", "q", share(F.col("n"), F.col("mass")).alias("p"),
        share(F.lit(0).cast("long"), F.col("mass")).alias("none")), "occurring-terms")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    standing_out = occurring.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")
    ).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)

    one = groups.filter("v > 0").select("lang", F.col("group").cast("long").alias("a"), "v", share(
        F.lit(0).cast("long"), F.col("mass")).alias("a_none"))
    two = one.select("lang", F.col("a").alias("b"), F.col("a_none").alias("b_none"))
    absent = one.join(two, "lang").filter("a <> b").select(
        "lang", "a", "b", (F.col("v") * gap(F.col("a_none"), F.col("b_none"))).alias("value"))
    uneven = occurring.groupBy("lang", F.col("group").cast("long").alias("a"), "p", F.col("none").alias("a_none")).agg(
        F.count(F.lit(1)).alias("n")).join(two, "lang").filter("a <> b").select(
        "lang", "a", "b", (F.col("n") * (gap(F.col("p"), F.col("b_none")) - gap(F.col("a_none"), F.col("b_none")))).alias("value"))
    shared = occurring.groupBy("lang", "term").agg(F.collect_list(F.struct("group", "p", "none")).alias("uses")).select(
        "lang", "uses").mapInArrow(common, "lang string, a long, b long, value long")
    oneway = uneven.unionByName(shared)
    both = absent.unionByName(oneway).unionByName(
        oneway.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    sums = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ids = groups.select("lang", "source", F.col("group").cast("long").alias("a"))
    others = ids.select("lang", F.col("source").alias("item"), F.col("a").alias("b"))
    pairs = ids.join(others, "lang").filter("a <> b").join(sums, ["lang", "a", "b"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")
    ).withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(standing_out)
