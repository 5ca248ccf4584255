"""Lexicon sentiment of one text as a single native expression.

No row leaves its partition and no Python runs: a text is split once, only the
words found in the lexicon are looked at with the three words before them, and
their valences are folded into four scores.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemline import valence as V
from hemline.functions.common import ColumnLike, col, contains_any, let

PLAN_BUCKETS = 1024

# A text without any of these words holds no idiom and no two-word dampener.
_PHRASE_WORDS = sorted(
    {phrase.split()[-1] for phrase, _ in V.IDIOMS} | {pair.split()[0] for pair in V.DAMPENER_PAIRS})


def sentiment_words(text: ColumnLike) -> Column:
    """Words longer than one character, freed of punctuation at one end."""
    longer = F.filter(F.split(col(text), r"(?U)\s+"), lambda word: F.length(word) > 1)
    marks = F.lit(V.PUNCTUATION)
    return F.transform(longer, lambda word: F.when(         # most words have no mark to cut, which two letters tell
        F.contains(marks, F.right(word, F.lit(1))) | F.contains(marks, F.left(word, F.lit(1))),
        let(F.btrim(word, marks), lambda core: F.when(_one_edge_cut(word, core), core).otherwise(word)),
    ).otherwise(word))


def _one_edge_cut(word: Column, core: Column) -> Column:
    """Is ``core`` a plain word, and what was cut off one known mark at one end?

    Comparisons instead of a pattern: this runs for every word of every text.
    """
    after = F.substr(word, F.length(core) + F.lit(1))
    before = F.left(word, F.length(word) - F.length(core))
    return (
        (F.length(core) > 1)
        & ((F.startswith(word, core) & after.isin(*V.WORD_EDGES))
           | (F.endswith(word, core) & before.isin(*V.WORD_EDGES)))
        & (F.translate(core, V.PUNCTUATION, "") == core)
    )


def _bucketed(lexicon: Mapping[str, float]) -> Column:
    """The lexicon as one constant array of small maps, found by a checksum of the term."""
    buckets: list[dict[str, float]] = [{} for _ in range(PLAN_BUCKETS)]
    for term, value in lexicon.items():
        buckets[zlib.crc32(term.encode()) % PLAN_BUCKETS][term] = float(value)
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,double>>")


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term), F.lit(buckets)).cast("int")


def _valences_of(lowered: Column, buckets: Column, count: int) -> Column:
    """Valence per word, null for a word outside the lexicon; one lookup per word."""
    return F.transform(lowered, lambda word: F.try_element_at(F.get(buckets, bucket_of(word, count)), word))


def _is_upper(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def _one_of(word: Column, words) -> Column:
    return F.coalesce(word.isin(*words), F.lit(False))


def _away_from_zero(value: Column, by: Column) -> Column:
    return value + F.when(value > 0, by).otherwise(-by)


class _Context:
    """The words of one text, and what a position in it means for the score."""

    def __init__(self, words: Column, prepared: Column):
        self.words = words
        self.lowered, self.valences = prepared["lowered"], prepared["valences"]
        self.mixed_case, self.phrases = prepared["mixed_case"], prepared["phrases"]

    def in_lexicon(self, at: Column) -> Column:
        """Is the word in the lexicon and not an intensifier?"""
        return (
            F.get(self.valences, at).isNotNull()
            & ~F.get(self.lowered, at).isin(*V.INTENSIFIERS, *V.DAMPENERS)
        )

    def kind_of(self, at: Column) -> Column:
        return (F.get(self.lowered, at) == "kind") & F.coalesce(
            F.get(self.lowered, at + 1) == "of", F.lit(False))

    def value(self, at: Column) -> Column:
        """Valence of the word at ``at`` as its neighbours change it; none in ``kind of``."""
        plain = F.get(self.valences, at)
        shouted = self.mixed_case & _is_upper(F.get(self.words, at))
        start = let(plain, lambda v: F.when(
            shouted, _away_from_zero(v, F.lit(V.CAPITALS_BOOST))).otherwise(v))
        stepped = F.aggregate(
            F.array(*[F.lit(k) for k in (1, 2, 3)]), start,
            lambda v, back: F.when(self._plain_before(at, back), self._step(v, at, back)).otherwise(v),
        )
        idiomatic = let(stepped, lambda v: F.when(
            self.phrases & self._plain_before(at, F.lit(3)), self._idioms(v, at)).otherwise(v))
        return F.when(self.kind_of(at), F.lit(0.0)).otherwise(idiomatic * self._least(at))

    def _plain_before(self, at: Column, back: Column) -> Column:
        """There is a word ``back`` places before, and the lexicon does not hold it."""
        return (at >= back) & F.get(self.valences, at - back).isNull()

    def _step(self, v: Column, at: Column, back: Column) -> Column:
        word = F.get(self.lowered, at - back)
        boost = (
            F.when(word.isin(*V.INTENSIFIERS), F.lit(V.BOOST))
            .when(word.isin(*V.DAMPENERS), F.lit(-V.BOOST))
        )
        signed = F.when(v < 0, -boost).otherwise(boost)
        shouted = self.mixed_case & _is_upper(F.get(self.words, at - back))
        loud = F.when(v > 0, F.lit(V.CAPITALS_BOOST)).otherwise(F.lit(-V.CAPITALS_BOOST))
        weight = F.get(F.array(*[F.lit(w) for w in V.DISTANCE_WEIGHTS]), back - 1)
        change = F.coalesce((signed + F.when(shouted, loud).otherwise(F.lit(0.0))) * weight, F.lit(0.0))
        return (v + change) * self._negation(at, back)

    def _negation(self, at: Column, back: Column) -> Column:
        word = F.get(self.lowered, at - back)
        negated = word.isin(*V.NEGATIONS) | F.contains(word, F.lit("n't"))

        def is_so(places: int) -> Column:
            return _one_of(F.get(self.words, at - places), ("so", "this"))

        def is_never(places: int) -> Column:
            return F.get(self.words, at - places) == "never"

        never_so_second = (back == 2) & is_never(2) & is_so(1)
        never_so_third = (back == 3) & ((is_never(3) & is_so(2)) | is_so(1))
        return (
            F.when(never_so_second, F.lit(V.NEVER_FACTORS[1]))
            .when(never_so_third, F.lit(V.NEVER_FACTORS[2]))
            .when(negated, F.lit(V.NEGATION_FACTOR))
            .otherwise(F.lit(1.0))
        )

    def _phrase(self, at: Column, first: int, last: int) -> Column:
        """The words from ``first`` to ``last`` places after ``at``; null beyond the text."""
        return F.array_join(F.when(
            at + last < F.size(self.words),
            F.slice(self.words, at + first + 1, F.lit(last - first + 1)),
        ), " ")

    def _idioms(self, v: Column, at: Column) -> Column:
        def idiom(phrase: Column) -> Column:
            return F.coalesce(*[F.when(phrase == text, F.lit(value)) for text, value in V.IDIOMS])

        behind = [(-1, 0), (-2, 0), (-2, -1), (-3, -1), (-3, -2)]
        ahead = [(0, 2), (0, 1)]
        held = F.coalesce(*[let(self._phrase(at, *span), idiom) for span in ahead + behind], v)
        dampened = reduce_or(
            _one_of(self._phrase(at, *span), V.DAMPENER_PAIRS) for span in ((-3, -2), (-2, -1))
        )
        return held + F.when(dampened, F.lit(-V.BOOST)).otherwise(F.lit(0.0))

    def _least(self, at: Column) -> Column:
        """``least`` before the word turns it, unless ``at`` or ``very`` comes first."""
        turned = (
            self._plain_before(at, F.lit(1))
            & (F.get(self.lowered, at - 1) == "least")
            & ~((at > 1) & _one_of(F.get(self.lowered, at - 2), ("at", "very")))
        )
        return F.when(turned, F.lit(V.NEGATION_FACTOR)).otherwise(F.lit(1.0))


def reduce_or(conditions) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def _totals(context: _Context, first_context: bool) -> Column:
    """Sum of the valences, sums and number of the positive and negative ones.

    With ``first_context`` the scored words are sorted, so that equal words
    stand together and only the first of them is valued: long texts with many
    repeats stay linear.
    """
    places = F.when(F.size(context.words) > 0, F.sequence(F.lit(0), F.size(context.words) - 1))
    scored = F.filter(places, context.in_lexicon)
    if first_context:
        entries = F.array_sort(F.transform(scored, lambda at: F.struct(
            F.get(context.words, at).alias("word"), at.alias("at"))))
    else:
        entries = F.transform(scored, lambda at: F.struct(F.lit("").alias("word"), at.alias("at")))

    zero = F.struct(
        F.lit("").alias("word"), F.lit(0.0).alias("value"),
        F.lit(0.0).alias("all"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), F.lit(0).alias("n"),
    )

    def fold(but: Column) -> Column:
        def add(t: Column, entry: Column) -> Column:
            at = entry["at"]
            side = (
                F.when((but >= 0) & (at < but), F.lit(V.BEFORE_BUT))
                .when((but >= 0) & (at > but), F.lit(V.AFTER_BUT))
                .otherwise(F.lit(1.0))
            )
            repeated = (entry["word"] == t["word"]) & (entry["word"] != "")
            value = F.when(repeated, t["value"]).otherwise(context.value(at))
            return let(value, lambda own: let(own * side, lambda v: F.struct(
                entry["word"].alias("word"), own.alias("value"),
                (t["all"] + v).alias("all"),
                F.when(v > 0, t["pos"] + v + 1).otherwise(t["pos"]).alias("pos"),
                F.when(v < 0, t["neg"] + v - 1).otherwise(t["neg"]).alias("neg"),
                F.when(v != 0, t["n"] + 1).otherwise(t["n"]).alias("n"),
            )))

        return F.aggregate(entries, zero, add)

    return let(F.array_position(context.lowered, "but").cast("int") - 1, fold)


def _punctuation(text: Column) -> Column:
    def count(mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    questions = count("?")
    return F.least(count("!"), F.lit(V.EXCLAMATION_LIMIT)) * V.EXCLAMATION_WEIGHT + (
        F.when(questions > V.QUESTION_LIMIT, F.lit(V.QUESTION_MAXIMUM))
        .when(questions > 1, questions * V.QUESTION_WEIGHT)
        .otherwise(F.lit(0.0))
    )


def _scores(total: Column, emphasis: Column, n_words: Column) -> Column:
    whole = total["all"] + F.signum(total["all"]) * emphasis
    pos = total["pos"] + F.when(total["pos"] > -total["neg"], emphasis).otherwise(F.lit(0.0))
    neg = -total["neg"] + F.when(total["pos"] < -total["neg"], emphasis).otherwise(F.lit(0.0))
    parts = F.struct(
        neg.alias("neg"), (n_words - total["n"]).cast("double").alias("neu"), pos.alias("pos"),
        whole.alias("all"),
    )

    def shares(p: Column) -> Column:
        mass = p["neg"] + p["neu"] + p["pos"]
        return F.struct(
            F.bround(p["neg"] / mass, 3).alias("neg"),
            F.bround(p["neu"] / mass, 3).alias("neu"),
            F.bround(p["pos"] / mass, 3).alias("pos"),
            F.bround(p["all"] / F.sqrt(p["all"] * p["all"] + V.NORMALIZATION), 4).alias("compound"),
        )

    return let(parts, shares)


def lexicon_sentiment(text: ColumnLike, lexicon: Mapping[str, float] | Column = V.DEFAULT_LEXICON,
                      first_context: bool = True, buckets: int = PLAN_BUCKETS) -> Column:
    """``struct<neg, neu, pos, compound>``; four zeros for a null or blank text.

    ``lexicon`` is a mapping of lower-case terms, or a column holding ``buckets``
    maps with every term in the map its checksum points to.  With
    ``first_context`` a repeated word takes the neighbours of its first
    occurrence, as the library in common use does; without it every occurrence
    takes its own.
    """
    text = col(text)
    zeros = F.struct(*[F.lit(0.0).alias(name) for name in ("neg", "neu", "pos", "compound")])

    def over(words: Column, table: Column) -> Column:
        def score(prepared: Column) -> Column:
            total = _totals(_Context(words, prepared), first_context)
            return let(total, lambda t: _scores(t, _punctuation(text), F.size(words)))

        prepared = let(F.transform(words, F.lower), lambda lowered: F.struct(
            lowered.alias("lowered"),
            _valences_of(lowered, table, buckets).alias("valences"),
            (F.exists(words, _is_upper) & F.exists(words, lambda w: ~_is_upper(w))).alias("mixed_case"),
            (contains_any(text, _PHRASE_WORDS)              # the cheaper look at the text settles most of them
             & F.arrays_overlap(words, F.array(*[F.lit(w) for w in _PHRASE_WORDS]))).alias("phrases"),
        ))
        return F.when(F.size(words) > 0, let(prepared, score))

    table = lexicon if isinstance(lexicon, Column) else _bucketed(lexicon)
    scored = let(table, lambda t: let(sentiment_words(text), lambda words: over(words, t)))
    return F.coalesce(F.when(text.isNotNull(), scored), zeros)
