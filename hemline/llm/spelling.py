"""Spelling variants: words one edit apart, found by K-d trees over letter counts.

A word is a vector of how often each letter occurs in it. One inserted or deleted letter changes one count by one,
one replaced letter raises one count and lowers another: the L1 distance is at most two. The words of each length
have a K-d tree whose leaves are boxes of letter counts. Its upper part, at most ``LEAVES`` leaves in all, is grown
level by level from counts that Spark sums over all words; every word goes to the leaves whose boxes it can reach
with one letter more, fewer or replaced (lengths l and l, and l and l + 1). There the tree is grown further, boxes
are pruned once more, and the order of letters decides.

Words are runs of Latin letters, each of which is one byte in Latin-1, so a word is handled as those bytes.

Defined results: a null text has no words; a null id counts as the empty text; A-Z alone are lower-cased; of near words
equally frequent the first in code-point order is taken; rows that repeat count again; an empty table gives an empty
result. Other columns never matter, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.llm.base import pieces
from hemline.session import written

LEAST_LETTERS, LEAST_COUNT = 6, 5
DROPPED = 199               # a run loses a letter where this divides its checksum
TIMES = 5                   # a form is at least so many times as frequent
LEAF, LEAVES = 2048, 4096   # words of a leaf, unless that gave too many leaves
SMALL = 24                  # words of a leaf within a task
FLUSH = 400_000             # words a task counts before it hands them on
BLOCK = 1 << 14             # words that are routed at once
LETTERS = 26 + 64

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
_PLACE = np.zeros(256, np.int64)
_PLACE[97:123] = np.arange(26)
_PLACE[0xC0:] = np.arange(26, LETTERS)


def runs_of(text: bytes) -> Counter:
    """How often each lower-cased run of a UTF-8 text occurs, as Latin-1 bytes."""
    found = Counter()
    for piece in pieces(text.decode("utf-8", "replace").encode("latin-1", "replace").translate(_TABLE)):
        found.update(piece.split())
    return found


def damaged(run: bytes, seed: int) -> bytes:
    """The run, or what is left if its checksum after the id takes a letter away; ``seed`` is the checksum of the id."""
    checksum = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if checksum % DROPPED:
        return run
    at = checksum % len(run)
    return run[:at] + run[at + 1:]


def word_counts(batches: Iterator[pa.RecordBatch], least: int = LEAST_LETTERS) -> Iterator[pa.RecordBatch]:
    """(word, n) of (id as text, text as bytes)."""
    counted = Counter()

    def handed():
        made = pa.RecordBatch.from_arrays(
            [pa.array(counted.keys(), pa.binary()), pa.array(counted.values(), pa.int64())], ["word", "n"])
        counted.clear()
        return made

    for batch in batches:
        for id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seed = zlib.crc32(f"{id}:".encode())
            for run, n in runs_of(text).items():
                if len(run) >= least:
                    word = damaged(run, seed)
                    if len(word) >= least:
                        counted[word] += n
            if len(counted) > FLUSH:
                yield handed()
    yield handed()


def vectors(words: list[bytes]) -> np.ndarray:
    """Letter counts, one row a word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    places = _PLACE[np.frombuffer(b"".join(words), np.uint8)]
    rows = np.repeat(np.arange(len(words)), lengths)
    return np.bincount(rows * LETTERS + places, minlength=len(words) * LETTERS).reshape(-1, LETTERS).astype(np.int32)


class Tree:
    """A K-d tree: nodes split by (letter, most on the left side); a leaf has a number."""

    def __init__(self):
        self.splits: dict[int, tuple[int, int, int, int]] = {}      # node: letter, bound, left node, right node
        self.nodes = 1

    def split(self, node: int, letter: int, bound: int) -> tuple[int, int]:
        left, right = self.nodes, self.nodes + 1
        self.splits[node] = letter, bound, left, right
        self.nodes += 2
        return left, right

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        found = np.zeros(len(points), np.int64)
        waiting = [(0, np.arange(len(points)))]
        while waiting:
            node, at = waiting.pop()
            if node not in self.splits:
                found[at] = node
                continue
            letter, bound, left, right = self.splits[node]
            low = points[at, letter] <= bound
            waiting += [(left, at[low]), (right, at[~low])]
        return found

    def reached(self, points: np.ndarray, more: int, fewer: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows) for the leaves whose box a row reaches with ``more`` letters added and ``fewer`` taken away."""
        n = len(points)
        waiting = [(0, np.arange(n), np.full(n, more), np.full(n, fewer), {})]
        while waiting:
            node, at, up, down, box = waiting.pop()
            if not len(at):
                continue
            if node not in self.splits:
                yield node, at
                continue
            letter, bound, left, right = self.splits[node]
            low, high = box.get(letter, (0, 1 << 30))
            own = points[at, letter]
            lower = down - np.maximum(own - bound, 0) + np.maximum(own - high, 0)
            upper = up - np.maximum(bound + 1 - own, 0) + np.maximum(low - own, 0)
            on = lower >= 0
            waiting.append((left, at[on], up[on], lower[on], {**box, letter: (low, bound)}))
            on = upper >= 0
            waiting.append((right, at[on], upper[on], down[on], {**box, letter: (bound + 1, high)}))


def best_split(histogram: np.ndarray) -> tuple[int, int] | None:
    """The most even split of (letter x count) numbers of words; None if all words are alike."""
    below = np.cumsum(histogram, axis=1)[:, :-1]
    smaller = np.minimum(below, below[0, -1] + histogram[0, -1] - below) if below.size else below
    if not smaller.size or not smaller.max():
        return None
    letter, bound = np.unravel_index(int(np.argmax(smaller)), smaller.shape)
    return int(letter), int(bound)


def _histogram(points: np.ndarray) -> np.ndarray:
    width = int(points.max(initial=0)) + 1
    return np.bincount((np.arange(LETTERS) * width + points).ravel(), minlength=LETTERS * width).reshape(LETTERS, width)


def grown(points: np.ndarray, small: int = SMALL) -> Tree:
    """A tree over the rows, down to leaves of ``small`` or of rows that are alike."""
    tree, waiting = Tree(), [(0, np.arange(len(points)))]
    while waiting:
        node, at = waiting.pop()
        chosen = best_split(_histogram(points[at])) if len(at) > small else None
        if chosen:
            left, right = tree.split(node, *chosen)
            low = points[at, chosen[0]] <= chosen[1]
            waiting += [(left, at[low]), (right, at[~low])]
    return tree


def _by_length(words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths).tolist():
        yield length, np.flatnonzero(lengths == length)


def forest(words: DataFrame, leaf: int = LEAF, leaves: int = LEAVES) -> dict[int, Tree]:
    """The upper tree of each length, from letter counts summed over all words, a level a round.

    The driver gets a histogram of each leaf that is still too large; there are at most ``leaves`` of these.
    """
    sizes = {r["length"]: r["n"] for r in words.groupBy(F.length("word").alias("length")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    leaf = max(leaf, -(-2 * sum(sizes.values()) // leaves))
    trees = {length: Tree() for length in sizes}
    large = {(length, 0) for length, n in sizes.items() if n > leaf}
    while large:
        shared = words.sparkSession.sparkContext.broadcast((trees, large))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, (trees, large) = defaultdict(int), shared.value
            for batch in batches:
                own = batch.column(0).to_pylist()
                for length, at in _by_length(own):
                    if not any(size == length for size, _ in large):
                        continue
                    points = vectors([own[i] for i in at])
                    places = trees[length].leaves(points)
                    for node in np.unique(places).tolist():
                        if (length, node) in large:
                            counts = _histogram(points[places == node])
                            for letter, n in zip(*np.nonzero(counts)):
                                found[length, node, int(letter), int(n)] += int(counts[letter, n])
            columns = list(zip(*found)) if found else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns), pa.array(found.values(), pa.int64())],
                ["length", "node", "letter", "times", "n"])

        summed = words.select("word").mapInArrow(each, "length long, node long, letter long, times long, n long").groupBy(
            "length", "node", "letter", "times").agg(F.sum("n").alias("n")).toArrow()
        found = defaultdict(list)
        for length, node, letter, times, n in zip(*(c.to_pylist() for c in summed.columns)):
            found[length, node].append((letter, times, n))
        large = set()
        for (length, node), cells in sorted(found.items()):
            counts = np.zeros((LETTERS, max(times for _, times, _ in cells) + 1), np.int64)
            for letter, times, n in cells:
                counts[letter, times] = n
            chosen = best_split(counts)
            if chosen:
                left, right = trees[length].split(node, *chosen)
                low = int(counts[chosen[0], :chosen[1] + 1].sum())
                sides = {left: low, right: int(counts[0].sum()) - low}
                large |= {(length, side) for side, n in sides.items() if n > leaf}
    return trees


def _routed(batches: Iterator[pa.RecordBatch], trees: dict[int, Tree]) -> Iterator[pa.RecordBatch]:
    """(length, leaf, role, word, n): every word for its own leaf (role 0) and for all other leaves it may reach.

    A word asks among words of its length only in leaves after its own, so that two words meet once.
    """
    for batch in batches:
        words = batch.column(0).to_pylist()
        for length, at in _by_length(words):
            for start in range(0, len(at), BLOCK):
                part = at[start:start + BLOCK]
                points = vectors([words[i] for i in part])
                own = trees[length].leaves(points)
                made = [(length, own, np.zeros(len(part), np.int64), part)]
                for node, rows in trees[length].reached(points, 1, 1):
                    rows = rows[own[rows] < node]
                    made.append((length, np.full(len(rows), node), np.ones(len(rows), np.int64), part[rows]))
                if length + 1 in trees:
                    for node, rows in trees[length + 1].reached(points, 1, 0):
                        made.append((length + 1, np.full(len(rows), node), np.full(len(rows), 2), part[rows]))
                taken = pa.array(np.concatenate([m[3] for m in made]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([np.full(len(m[1]), m[0]) for m in made])),
                     pa.array(np.concatenate([m[1] for m in made])), pa.array(np.concatenate([m[2] for m in made])),
                     batch.column(0).take(taken), batch.column(1).take(taken)], ["length", "leaf", "role", "word", "n"])


def _letters(words: list[bytes]) -> np.ndarray:
    """Words of one length as the rows of a matrix."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def one_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows differ by one letter replaced, or inserted into the shorter ``a``."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= a.shape[1]


class Leaf:
    """The words of a leaf with their own tree, and what has been found for them."""

    def __init__(self, words: list[bytes], n: list[int]):
        self.words, self.n = words, np.array(n, np.int64)
        self.letters, points = _letters(words), vectors(words)
        self.tree = grown(points)
        places = self.tree.leaves(points)
        order = np.argsort(places, kind="stable")
        cuts = np.flatnonzero(np.diff(places[order])) + 1
        self.parts = {int(places[part[0]]): part for part in np.split(order, cuts)}
        # Counts that differ by one in two letters at most differ in parity there: a quick test of two words.
        self.parity = self._parity(points)

    @staticmethod
    def _parity(points: np.ndarray) -> np.ndarray:
        odd = np.zeros((len(points), 128), np.uint64)
        odd[:, :LETTERS] = points & 1
        return np.bitwise_xor.reduce((odd[:, :64] ^ odd[:, 64:]) << np.arange(64, dtype=np.uint64), axis=1)

    def pairs(self, words: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``words``, place here) of near words; without ``words`` those among the leaf's own, each once."""
        inner = words is None
        asked = self.words if inner else words
        letters, points = self.letters if inner else _letters(asked), vectors(asked)
        parity = self.parity if inner else self._parity(points)
        same = letters.shape[1] == self.letters.shape[1]
        ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for node, rows in self.tree.reached(points, 1, int(same)):
            own = self.parts[node]
            near = np.bitwise_count(parity[rows][:, None] ^ self.parity[own][None, :]) <= 2
            if inner:
                near &= rows[:, None] < own[None, :]
            one, two = np.nonzero(near)
            one, two = rows[one], own[two]
            for at in range(0, len(one), BLOCK):
                a, b = one[at:at + BLOCK], two[at:at + BLOCK]
                hit = one_apart(letters[a], self.letters[b])
                ones.append(a[hit])
                twos.append(b[hit])
        return np.concatenate(ones), np.concatenate(twos)


class Best:
    """For each word: how many near words, and the most frequent of them, the first of equals."""

    def __init__(self):
        self.found: dict[bytes, list] = {}

    def add(self, word: bytes, near: bytes, n: int) -> None:
        held = self.found.get(word)
        if held is None:
            self.found[word] = [1, n, near]
            return
        held[0] += 1
        if (-n, near) < (-held[1], held[2]):
            held[1:] = n, near

    def batch(self) -> pa.RecordBatch:
        rows = list(zip(*self.found.values())) or [(), (), ()]
        made = pa.RecordBatch.from_arrays(
            [pa.array(self.found.keys(), pa.binary()), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()),
             pa.array(rows[2], pa.binary())], ["word", "n_near", "near_n", "near"])
        self.found = {}
        return made


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, near_n, near) of routed rows that come sorted by length, leaf and role.

    A leaf's own words are held; those that ask pass by in blocks.
    """
    leaf, key, role, words, n = None, None, None, [], []
    best = Best()

    def close():
        nonlocal leaf
        if not words:
            return
        if role == 0:
            leaf = Leaf(words, n)
        elif leaf is None:
            return                                      # no word of the table lies in this leaf
        asked, times = (leaf.words, leaf.n) if role == 0 else (words, n)
        for a, b in zip(*(x.tolist() for x in leaf.pairs(None if role == 0 else words))):
            best.add(asked[a], leaf.words[b], int(leaf.n[b]))
            best.add(leaf.words[b], asked[a], int(times[a]))

    for batch in batches:
        for length, node, kind, word, times in zip(*(column.to_pylist() for column in batch.columns)):
            if (length, node) != key or kind != role or (kind and len(words) >= BLOCK):
                close()
                if (length, node) != key:
                    leaf = None
                key, role, words, n = (length, node), kind, [], []
                if len(best.found) > BLOCK:
                    yield best.batch()
            words.append(word)
            n.append(times)
    close()
    yield best.batch()


def near_words(words: DataFrame, leaf: int = LEAF, leaves: int = LEAVES) -> DataFrame:
    """(word, n_near, near_n, near): of each word with near ones their number and the most frequent; of (word, n)."""
    trees = forest(words, leaf, leaves)
    shared = words.sparkSession.sparkContext.broadcast(trees)
    routed = words.select("word", "n").mapInArrow(
        lambda batches: _routed(batches, shared.value), "length long, leaf long, role long, word binary, n long")
    met = routed.repartition("length", "leaf").sortWithinPartitions("length", "leaf", "role").mapInArrow(
        _met, "word binary, n_near long, near_n long, near binary")
    return met.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of (word, form) lead. A form is more frequent than its word, so they end."""
    roots = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = written(roots.join(further, roots["root"] == further["at"], "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return roots


def variants(df: DataFrame, id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS,
             least_count: int = LEAST_COUNT, times: int = TIMES, leaf: int = LEAF, leaves: int = LEAVES) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    read = df.select(F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("id"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    words = written(
        read.mapInArrow(lambda batches: word_counts(batches, least_letters), "word binary, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count), "words")
    near = near_words(words, leaf, leaves)
    is_form = F.col("near_n") >= times * F.col("n")
    formed = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near")).alias("form"),
        F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    roots = rooted(formed.filter("form is not null"))

    def spelled(name: str):
        return F.decode(name, "ISO-8859-1").alias(name)

    return formed.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")).select(
        spelled("word"), "n", "n_near", spelled("form"), "form_n", spelled("root"))
