"""Secret scan: known forms, and a battery of randomness tests on every other token.

Known forms (``assign``, ``access``, ``hex``) always count. Beyond them each token of ``SHORTEST`` or more characters
with letters and digits gets the smallest encoding whose alphabet holds it, and three tests of the hypothesis that
its characters are random: chi-squared for an even use of the alphabet, the number of runs above and below the middle,
and the correlation of neighbours. Fisher's method joins the three p-values. Tokens for which randomness is rejected
are words, paths or identifiers; the others are reported as ``random``. A longer token tells more than a short one, so
the rejections are controlled for false discovery (Benjamini-Hochberg at ``RATE``) within classes of length, over all
tokens of the collection.

The scan reads each text once and shuffles only counts of p-values, in bins of 2 % width: bounded by the number of
bins, whatever the number of tokens.

Defined results: a null text counts as empty; spans are code points, end exclusive; a random span inside a span of a
known form is not reported again; rows that repeat are each reported; an empty table gives an empty result; other
columns never matter.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemline.llm.base import whole_text
from hemline.session import written

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
# A run of hex digits ends only at another character, so asking for the length in the pattern finds the same runs.
LONG_HEX = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")
KINDS = ("assign", "access", "hex", "random")           # in the order of equal starts

SHORTEST = 20
TOKEN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}+")
CLASSES = (32, 48, 80)      # lengths at which a new class begins
RATE = 0.05
BINS = 50                   # of a p-value's natural logarithm, per unit
SMALLEST = 1e-300

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABETS = {               # smallest first; a token has the first that holds all its characters
    "hex": _DIGITS + "abcdef", "HEX": _DIGITS + "ABCDEF", "base32": _UPPER + "234567", "lower36": _DIGITS + _LOWER,
    "upper36": _DIGITS + _UPPER, "base62": _DIGITS + _UPPER + _LOWER, "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_", "mixed": _UPPER + _LOWER + _DIGITS + "+/-_=",
}
_SETS = {name: frozenset(signs) for name, signs in ALPHABETS.items()}


def encoding_of(token: str) -> str | None:
    """The name of the smallest alphabet; none for a token without both letters and digits."""
    signs = set(token.rstrip("="))
    if not signs & set(_DIGITS) or not any(s.isalpha() for s in signs):
        return None
    return next(name for name, alphabet in _SETS.items() if signs <= alphabet)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_p(statistic: float, freedom: int) -> float:
    """Upper tail, by the cube root's nearness to a normal variable."""
    if statistic <= 0:
        return 1.0
    part = 2 / (9 * freedom)
    return 0.5 * math.erfc(((statistic / freedom) ** (1 / 3) - (1 - part)) / math.sqrt(2 * part))


def randomness(token: str, encoding: str) -> float:
    """Joint p-value of the three tests under random characters."""
    signs, body = ALPHABETS[encoding], token.rstrip("=")
    place = {s: i for i, s in enumerate(signs)}
    at = np.array([place[s] for s in body], float)
    n, size = len(at), len(signs)
    groups = min(size, max(2, n // 5))                  # five characters in each are expected, about
    sizes = np.bincount(np.arange(size) * groups // size, minlength=groups) * n / size
    seen = np.bincount((at.astype(int) * groups) // size, minlength=groups)
    even = chi_squared_p(float(((seen - sizes) ** 2 / sizes).sum()), groups - 1)
    high = at >= size / 2
    share = float(np.count_nonzero(np.arange(size) >= size / 2)) / size
    flips = int(np.count_nonzero(high[1:] != high[:-1]))
    p = 2 * share * (1 - share)
    spread = (n - 1) * p * (1 - p) + 2 * (n - 2) * (share * (1 - share) * 1.0 - p * p)
    runs = _two_sided((flips - (n - 1) * p) / math.sqrt(max(spread, 0.25 * (n - 1) * p)))
    centred = at - at.mean()
    power = float(centred @ centred)
    serial = _two_sided((float(centred[1:] @ centred[:-1]) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    half = -sum(math.log(max(value, SMALLEST)) for value in (even, runs, serial))
    return max(SMALLEST, math.exp(-half) * (1 + half + half * half / 2)) if half < 690 else SMALLEST


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known forms, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def tested_tokens(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """(start, end, class of length, p-value) of the tokens outside the known forms."""
    found = []
    for m in TOKEN.finditer(text):
        start, end = m.span()
        if any(a <= start and end <= b for a, _, b in known):
            continue
        encoding = encoding_of(m.group())
        if encoding is not None:
            found.append((start, end, sum(end - start >= c for c in CLASSES), randomness(m.group(), encoding)))
    return found


SCANNED = ("base array<struct<start:long,kind:int,stop:long>>, "
           "tested array<struct<start:long,stop:long,length_class:int,p:double>>")


def scanned(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, the spans of known forms, and the tested tokens with their p-values."""
    read = df.select(F.col(f"`{id}`").alias("id"), whole_text(text).alias("text"))
    kinds = [
        pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())])),
        pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("length_class", pa.int32()),
                            ("p", pa.float64())]))]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, tested = [], []
            for value in batch.column(1).to_pylist():
                known = known_spans(value)
                base.append([dict(zip(("start", "kind", "stop"), s)) for s in known])
                tested.append([dict(zip(("start", "stop", "length_class", "p"), t))
                               for t in tested_tokens(value, known)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, kinds[0]), pa.array(tested, kinds[1])], ["id", "base", "tested"])

    return read.mapInArrow(each, f"id {read.schema['id'].dataType.simpleString()}, {SCANNED}")


def rejection_limits(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """(length_class, limit) from (length_class, p): randomness is rejected for p-values up to the limit."""
    binned = tested.groupBy("length_class", F.floor(-F.log("p") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    below = Window.partitionBy("length_class").orderBy(F.desc("bin"))
    everything = Window.partitionBy("length_class")
    edge = F.exp(-F.col("bin") / BINS)                  # the largest p-value of the bin
    return (
        binned.select("length_class", edge.alias("edge"), F.sum("n").over(below).alias("rank"),
                      F.sum("n").over(everything).alias("m"))
        .filter(F.col("edge") <= rate * F.col("rank") / F.col("m"))
        .groupBy("length_class").agg(F.max("edge").alias("limit"))
    )


def secrets(df: DataFrame, id: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    found = written(scanned(df, id, text), "secret-scan")
    limits = rejection_limits(found.select(F.explode("tested").alias("t")).select("t.*"), rate).collect()
    limit = F.create_map(*[F.lit(v) for row in limits for v in row]) if limits else None    # a row per length class
    kept = found["tested"]
    if limit is not None:
        kept = F.filter("tested", lambda t: t["p"] > F.coalesce(F.try_element_at(limit, t["length_class"]), F.lit(0.0)))
    random = F.transform(kept, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["stop"].alias("stop")))
    names = F.array(*[F.lit(name) for name in KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")

    def of(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        F.col("id").alias(id), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", random))).alias("spans"), F.size(random).cast("long").alias("n_random"))
