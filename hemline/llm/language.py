"""Language identification: known words first, then ever shorter character n-grams.

A model holds log frequencies per language of words and of the n-grams of words (with a space at either end). A
known word scores by its word frequencies; an unseen one by the longest n-grams of it that are known, from
``LONGEST`` characters down to one. A document scores the mean over its words.

The model is learned with Spark aggregates from labelled rows. Of each language it reads the rows whose hashed text
falls below a share that gives about ``sample_rows`` rows (all rows of a smaller language), and it keeps the
``model_words`` most frequent words and ``model_grams`` n-grams of each length per language: both bounds make the
model small enough for every task. Predictions read whole texts.

Defined results: a null text, or one without letters, is ``und`` with score 0; a text of which nothing is known
takes the language with the most labelled rows and score 0; ties go to the first name in order; without labelled
rows everything is ``und``. Rows may repeat; other columns never matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemline.llm.base import fresh
from hemline.session import written

UNKNOWN = "und"
SAMPLE_ROWS = 5_000         # labelled rows per language, about
MODEL_WORDS = 20_000        # per language
MODEL_GRAMS = 5_000         # per language and length
LONGEST = 4
FLUSH = 100_000             # distinct entries a task counts before it hands them on
CACHED = 100_000            # words whose scores a task remembers
PIECE = 50_000              # words of a text that are scored at once
MIN_SCORE = 0.2             # below it a document is rejected by ``recognised``

_words = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters; numbers that are no digits (a half, Roman eight, a circled one) end them."""
    words = _words(text.lower())
    if "".join(words).isalpha() or not words:
        return words
    return "".join(sign if sign.isalpha() else " " for sign in " ".join(words)).split()


def grams_of(word: str, size: int) -> list[str]:
    padded = f" {word} "
    return [padded[i:i + size] for i in range(len(padded) - size + 1)] if size > 1 else list(word)


def _handed(counted: Counter, names: list[str]) -> pa.RecordBatch:
    """The counts so far as rows; the counter starts anew."""
    columns = list(zip(*counted)) if counted else [()] * (len(names) - 1)
    kinds = [pa.int32() if name == "size" else pa.string() for name in names[:-1]]
    arrays = [*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(list(counted.values()), pa.int64())]
    counted.clear()
    return pa.RecordBatch.from_arrays(arrays, names)


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, entry, n) of the words of a task's texts."""
    counted, names = Counter(), ["lang", "entry", "n"]
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = words_of(text)
            for at in range(0, len(words), PIECE):
                counted.update(zip(repeat(lang), words[at:at + PIECE]))
                if len(counted) > FLUSH:
                    yield _handed(counted, names)
    yield _handed(counted, names)


def gram_counts(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """(lang, size, entry, n) of the n-grams of counted words (lang, entry, n)."""
    counted, names = Counter(), ["lang", "size", "entry", "n"]
    for batch in batches:
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
            for size in range(1, longest + 1):
                for gram in grams_of(word, size):
                    counted[lang, size, gram] += n
            if len(counted) > FLUSH:
                yield _handed(counted, names)
    yield _handed(counted, names)


class Model:
    """Log frequencies: for size 0 (words) to ``longest`` the entries' places in a matrix of one column per language.

    ``entries`` is (lang, size, entry, n), ``totals`` gives the summed n and the number of entries of (lang, size).
    """

    def __init__(self, prior: dict[str, int], entries: list[tuple], totals: dict[tuple[str, int], tuple[int, int]],
                 longest: int = LONGEST):
        self.langs, self.longest = sorted(prior), longest
        self.usual = min(self.langs, key=lambda lang: (-prior[lang], lang), default=UNKNOWN)
        column = {lang: i for i, lang in enumerate(self.langs)}
        self.tables: list[dict[str, int]] = [{} for _ in range(longest + 1)]
        self.values: list[np.ndarray] = []
        for size, places in enumerate(self.tables):
            own = [e for e in entries if e[1] == size]
            at = [places.setdefault(e[2], len(places)) for e in own]
            counts = np.zeros((len(places), len(self.langs)))
            counts[at, [column[e[0]] for e in own]] = [e[3] for e in own]
            seen = np.array([totals.get((lang, size), (0, 0)) for lang in self.langs], float).reshape(-1, 2)
            self.values.append(np.log((counts + 0.5) / (seen[:, 0] + 0.5 * (seen[:, 1].sum() + 1))))

    def word(self, word: str) -> np.ndarray | None:
        at = self.tables[0].get(word)
        if at is not None:
            return self.values[0][at]
        for size in range(self.longest, 0, -1):
            known = [at for at in map(self.tables[size].get, grams_of(word, size)) if at is not None]
            if known:
                return np.add.reduce(self.values[size].take(known, axis=0)) / len(known)
        return None


class Scorer:
    """Scores texts; remembers the scores of up to ``CACHED`` words."""

    def __init__(self, model: Model):
        self.model, self.places = model, {}
        self.matrix = np.zeros((CACHED + 1, max(1, len(model.langs))))         # row 0: of no known word or n-gram

    def _scores(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Summed scores and number of the words of which something is known."""
        places = self.places
        new = set(words).difference(places)
        if len(places) + len(new) > CACHED:
            places.clear()
            new = set(words)
        for word in new:
            value = self.model.word(word)
            places[word] = 0 if value is None else len(places) + 1
            if value is not None:
                self.matrix[places[word]] = value
        at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        return self.matrix[at].sum(axis=0), int(np.count_nonzero(at))

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.model.langs:
            return UNKNOWN, 0.0
        total, known = np.zeros(len(self.model.langs)), 0
        for at in range(0, len(words), PIECE):
            part, n = self._scores(words[at:at + PIECE])
            total, known = total + part, known + n
        if not known:
            return self.model.usual, 0.0
        mean = total / known
        best = int(np.argmax(mean))
        return self.model.langs[best], float(known / len(words) / np.exp(mean - mean[best]).sum())


def learn(df: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS,
          model_words: int = MODEL_WORDS, model_grams: int = MODEL_GRAMS, longest: int = LONGEST) -> Model:
    """The model of the rows that have a text and a language."""
    labelled = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).dropna()
    prior = {row["lang"]: row["n"] for row in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(prior)
    if not langs:
        return Model({}, [], {}, longest)
    share = F.lit(1.0)
    for name in langs:
        share = F.when(F.col("lang") == name, min(1.0, sample_rows / prior[name])).otherwise(share)
    part = F.pmod(F.xxhash64("text"), F.lit(1_000_003)) / 1_000_003
    words = written(
        labelled.filter(part < share).mapInArrow(word_counts, "lang string, entry string, n long")
        .groupBy("lang", "entry").agg(F.sum("n").alias("n")), "word-counts")
    grams = words.mapInArrow(lambda b: gram_counts(b, longest), "lang string, size int, entry string, n long").groupBy(
        "lang", "size", "entry").agg(F.sum("n").alias("n"))
    counts = written(words.select("lang", F.lit(0).alias("size"), "entry", "n").unionByName(grams), "language-counts")
    totals = {(r["lang"], r["size"]): (r["n"], r["distinct"]) for r in counts.groupBy("lang", "size").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct")).collect()}
    order = Window.partitionBy("lang", "size").orderBy(F.desc("n"), "entry")
    kept = counts.withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= F.when(F.col("size") == 0, model_words).otherwise(model_grams))
    entries = kept.select("lang", "size", "entry", "n").toArrow()      # bounded by the parameters
    return Model(prior, list(zip(*[column.to_pylist() for column in entries.columns])), totals, longest)


def predicted(df: DataFrame, model: Model, label: str, score: str, text: str = "text") -> DataFrame:
    """The columns of ``df``, with the language and its score (0 to 1)."""
    shared, place = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            made = [scorer.predict(value) for value in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] for m in made], pa.float64())], names=[*batch.schema.names, label, score])

    return df.mapInArrow(each, df.select("*").schema.add(label, "string").add(score, "double"))


def held_out(id: str, folds: int = 5):
    """True for the fold that no model may see; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).cast("binary")) % folds == 0


def identified(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score. Learns from rows outside the held-out fold only."""
    model = learn(df.filter(~held_out(id)), text, lang)
    read = df.select(F.col(f"`{id}`").alias("id"), held_out(id).alias("held_out"), F.col(f"`{text}`").alias("text"))
    return predicted(read, model, "lang_pred", "score").select(
        F.col("id").alias(id), "held_out", "lang_pred", "score")


def recognised(df: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
               min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose language is recognised, with the columns of ``df``."""
    label, score = fresh(df, "lang_pred", "score")
    model = learn(df.filter(~held_out(id)), text, lang)
    return predicted(df, model, label, score, text).filter(
        (F.col(label) != UNKNOWN) & (F.col(score) >= min_score)).select(*[F.col(f"`{name}`") for name in df.columns])
