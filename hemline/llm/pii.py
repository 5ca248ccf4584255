"""Personal data replaced by surrogates of the same type and form.

Detected are e-mail addresses, phone, IPv4, card and social security numbers and names after a title. A surrogate comes
from a keyed permutation of all values of the entity's form (a Feistel network over mixed radices, walked on until
the value is valid): letters stay letters of the same script, vowels vowels, capitals capitals, digits digits, marks
stay. So equal entities have equal surrogates in every document, and different ones of the same form different ones,
without a table. A name keeps its title and the last letter of its words, which carry the gender, and a card keeps
the state of its check digit.

A permutation can still hit a value that occurs in the collection. Entities are therefore collected (distinct, with a
combine in the map tasks) and checked: while a surrogate is a real entity or one that another entity has, the entity
takes the next value of the walk. The few that have moved are joined to the documents that hold them; Spark broadcasts
them if their written size allows, and shuffles otherwise. All other documents are rewritten in one pass.

Defined results: a null text stays null, an empty one empty; rows that repeat are each rewritten; without entities a
text is unchanged; an entity whose form has a single value, or no free one, is masked with ``#``; an empty table gives
an empty result; other columns are kept by ``pseudonymised`` and ignored by ``surrogates``.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hemline.llm.base import fresh
from hemline.session import written

ROUNDS = 8                  # of the network
WALK = 1000                 # steps before a value counts as having no surrogate
TRIES = 20                  # rounds of the collision check

_EMAIL = r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
_IP = r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))"
_CARD = r"(?P<card>(?<![\w.+-])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?:(?P=gap)\d{4}){2}|\d{4}(?P<space>[ -])\d{6}(?P=space)\d{5})(?![\w-]))"
_SSN = r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
# What stands behind a phone and is no part of it: an address, a card, a social security number, another phone.
_NEXT = ("(?!" + _IP.replace("?P<ip>", "?:") + r"|(?:\d{13,19}|\d{4}[ -]\d{4}(?:[ -]\d{4}){2}(?![ -]\d{4})|\d{4}[ -]\d{6}[ -]\d{5}"
         r"|\d{3}-\d{2}-\d{4})(?![\w-])|\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w))")
_PHONE = (r"(?P<phone>(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}[ .-]?\d{2,4}(?:[ .-]?" + _NEXT + r"\d{2,4}){0,3}"
          r"|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w]))")
# Titles say where a name follows.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Sr", "Sra", "Monsieur", "Madame",
          "Mme", "Mlle", "Г-н", "Г-жа")
_NAME = r"(?:\b(?:" + "|".join(TITLES) + r")\.?[ ])(?P<name>[^\W\d_a-z][^\W\d_]+(?:[ -][^\W\d_a-z][^\W\d_]+){0,2})"
FIND = re.compile("|".join((_CARD, _EMAIL, _IP, _SSN, _PHONE, _NAME)))
_sign = re.compile(r"[\d@]").search          # \d as in the patterns: digits of every script
KINDS = ("email", "ip", "card", "ssn", "phone", "name")

# Digits by script; letters by script, vowels apart; a sign is replaced within its own list.
DIGITS = tuple("".join(chr(zero + i) for i in range(10)) for zero in range(sys.maxunicode + 1)
               if unicodedata.decimal(chr(zero), None) == 0)
ALPHABETS = (*DIGITS, "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "àèìòù", "äöü", "âêîôû", "аеиоуыэюя",
             "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ")
_LIST = {sign: alphabet for alphabet in ALPHABETS for sign in alphabet}
_PLACE = {sign: i for alphabet in ALPHABETS for i, sign in enumerate(alphabet)}


def normal(kind: str, value: str) -> str:
    """What makes two mentions the same entity."""
    if kind == "card":
        return re.sub(r"[ -]", "", value)
    return value.lower() if kind in ("email", "name") else value


def found_in(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the entities; every kind has a digit, an @ or a title."""
    if not _sign(text) and not any(title in text for title in TITLES):
        return []
    found = ((next(kind for kind in KINDS if m[kind] is not None), m) for m in FIND.finditer(text))
    return [(kind, *m.span(kind)) for kind, m in found]


def _check_digit(digits: str) -> int:
    """The digit that completes a card number by the rule of doubled digits."""
    total = 0
    for i, sign in enumerate(reversed(digits)):
        n = int(sign) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _free_places(kind: str, value: str) -> list[int]:
    """Places whose signs may change."""
    end = len(value)
    if kind == "email":
        end = value.rindex(".")
    elif kind == "card":
        end -= 1
    start = len(re.match(r"\+\d{1,3}(?=[ .(-])|", value).group()) if kind == "phone" else 0
    if kind == "name":
        last = {m.end() - 1 for m in re.finditer(r"\w+", value)}
        return [i for i in range(end) if value[i] in _LIST and i not in last]
    return [i for i in range(start, end) if value[i] in _LIST]


def _valid(kind: str, value: str) -> bool:
    if kind != "ip":
        return True
    parts = value.split(".")
    return all(int(p) < 256 and (len(p) == 1 or int(p[0]) > 0) for p in parts)


class Surrogates:
    """Surrogates under a key. ``skip`` valid values of the walk are passed over."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _mixed(self, tweak: bytes, step: int, value: int, size: int) -> int:
        digest = hashlib.blake2b(tweak + bytes([step]) + value.to_bytes((value.bit_length() + 7) // 8 + 1, "big"),
                                 key=self.key, digest_size=32).digest()
        return int.from_bytes(digest, "big") % size

    def _permuted(self, value: int, size: int, tweak: bytes) -> int:
        """A keyed permutation of range(size)."""
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            for step in range(0, ROUNDS, 2):
                left = (left + self._mixed(tweak, step, right, a)) % a
                right = (right + self._mixed(tweak, step + 1, left, b)) % b
            value = left * b + right
            if value < size:
                return value

    def of(self, kind: str, value: str, skip: int = 0) -> str:
        """The surrogate of a normal value, itself a normal value of the same form."""
        places = _free_places(kind, value)
        lists = [_LIST[value[i]] for i in places]
        size = math.prod(map(len, lists))
        shape = "".join("\0" if i in set(places) else sign for i, sign in enumerate(value))
        if kind == "card":
            state = (int(value[-1]) - _check_digit(value[:-1])) % 10
            shape = str(state) if value[-1] in DIGITS[0] else f"{state} {_LIST[value[-1]][0]}"
        tweak = repr((kind, shape, [signs[0] for signs in lists])).encode()
        number = 0
        for i, signs in zip(places, lists):
            number = number * len(signs) + _PLACE[value[i]]
        for _ in range(WALK if size > 1 else 0):
            number = self._permuted(number, size, tweak)
            made, rest = list(value), number
            for i, signs in zip(reversed(places), reversed(lists)):
                rest, at = divmod(rest, len(signs))
                made[i] = signs[at]
            if kind == "card":
                made[-1] = _LIST[value[-1]][(_check_digit("".join(made[:-1])) + state) % 10]
            result = "".join(made)
            if result != value and _valid(kind, result):
                if not skip:
                    return result
                skip -= 1
        return "#" * len(value)


def worded(kind: str, mention: str, surrogate: str) -> str:
    """A normal surrogate in the writing of the mention: its capitals and its separators."""
    signs = iter(surrogate)
    if kind == "card":
        return "".join(next(signs) if sign.isdigit() else sign for sign in mention)
    return "".join(s.upper() if m.isupper() else s for m, s in zip(mention, signs))


ENTITY = "kind string, value string"


def entities(df: DataFrame, text: str = "text") -> DataFrame:
    """(kind, value) of the distinct entities of a collection."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(kind, normal(kind, t[a:b])) for t in batch.column(0).to_pylist() for kind, a, b in found_in(t)}
            kinds, values = zip(*sorted(rows)) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())],
                                             ["kind", "value"])

    return df.select(F.col(f"`{text}`").alias("text")).dropna().mapInArrow(each, ENTITY).distinct()


def surrogates(known: DataFrame, key: bytes, tries: int = TRIES) -> DataFrame:
    """(kind, value, surrogate, skip): no surrogate is an entity, and no two entities share one."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Surrogates(key)
        for batch in batches:
            made = [maker.of(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())],
                                             ["kind", "value", "skip", "surrogate"])

    known = written(known, "entities")
    schema = f"{ENTITY}, skip int, surrogate string"
    table = written(known.select("kind", "value", F.lit(0).alias("skip")).mapInArrow(each, schema), "surrogates")
    for _ in range(tries):
        masked = F.col("surrogate").startswith("#")
        real = table.filter(~masked).join(known.withColumnRenamed("value", "surrogate"), ["kind", "surrogate"], "left_semi")
        shared = table.filter(~masked).groupBy("kind", "surrogate").agg(
            F.min(F.struct("skip", "value")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        later = table.join(shared, ["kind", "surrogate"]).filter(F.col("first.value") != F.col("value"))
        clash = written(real.select("kind", "value").unionByName(later.select("kind", "value")).distinct(), "clashes")
        if clash.isEmpty():
            return table
        moved = table.join(clash, ["kind", "value"]).select("kind", "value", (F.col("skip") + 1).alias("skip"))
        table = written(table.join(clash, ["kind", "value"], "left_anti").unionByName(moved.mapInArrow(each, schema)),
                        "surrogates")
    last = table.join(clash, ["kind", "value"], "left_anti")                # no free value: masked
    return last.unionByName(clash.select("kind", "value", F.lit(-1).alias("skip"), F.regexp_replace(
        "value", "(?s).", "#").alias("surrogate")))


def pseudonymised(df: DataFrame, key: bytes, id: str = "doc_id", text: str = "text", counts: str = "entities") -> DataFrame:
    """The columns of ``df`` with the text rewritten, and the number of entities by kind as a map."""
    mark, moved_name = fresh(df, "text_mark", "moved")
    own = f"`{text}`"
    table = surrogates(entities(df, text), key).filter("skip <> 0")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(mark, kind, value) of what documents hold."""
        for batch in batches:
            rows = {(m, kind, normal(kind, t[a:b])) for m, t in zip(*(c.to_pylist() for c in batch.columns))
                    for kind, a, b in found_in(t)}
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.string(), pa.string()))], ["mark", "kind", "value"])

    digest = F.unhex(F.md5(F.col(own).cast("binary")))              # of the text, so copies have one
    moved = None
    if not table.isEmpty():
        moved = written(
            df.select(digest.alias("mark"), F.col(own).alias("text")).dropna()
            .mapInArrow(held, f"mark binary, {ENTITY}").join(table, ["kind", "value"])
            .groupBy("mark").agg(F.collect_set(F.struct("kind", "value", "surrogate")).alias("moved")), "moved")
    marked = df.select("*", digest.alias(mark))
    if moved is None:
        marked = marked.withColumn(moved_name, F.lit(None).cast("array<struct<kind:string,value:string,surrogate:string>>"))
    else:
        moved = moved.select(F.col("mark").alias(mark), F.col("moved").alias(moved_name))
        marked = marked.join(moved, mark, "left")
    names, place = list(df.columns), df.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Surrogates(key)
        known: dict[tuple[str, str], str] = {}
        for batch in batches:
            texts, numbers = [], []
            for value, own in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist()):
                if value is None:
                    texts.append(None)
                    numbers.append([])
                    continue
                other = {(m["kind"], m["value"]): m["surrogate"] for m in own or ()}
                parts, at, number = [], 0, dict.fromkeys(KINDS, 0)
                for kind, a, b in found_in(value):
                    entity = (kind, normal(kind, value[a:b]))
                    made = other.get(entity) or known.get(entity)
                    if made is None:
                        if len(known) > 100_000:
                            known.clear()
                        made = known[entity] = maker.of(*entity)
                    parts += [value[at:a], worded(kind, value[a:b], made)]
                    at, number[kind] = b, number[kind] + 1
                texts.append("".join(parts) + value[at:])
                numbers.append([(k, n) for k, n in number.items() if n])
            columns = [c for i, c in enumerate(batch.columns[:len(names)])]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(numbers, pa.map_(pa.string(), pa.int64()))], names=[*names, counts])

    schema = df.select("*").schema.add(counts, T.MapType(T.StringType(), T.LongType()))
    return marked.select(*[F.col(f"`{n}`") for n in names], moved_name).mapInArrow(each, schema)
