"""Packing of tokenized documents into sequences of several lengths.

Each task tokenizes its rows and packs them as they come, holding a bounded number of pieces. A document longer than
the largest window gives full windows; what is left goes to the smallest tier (window length) that holds it. A
tier's pieces are packed best fit first, from the longest tier down; what stays open in a long window is filled from
the shorter tiers, at the end by cutting one piece to the very length. Finished sequences are dealt to step groups,
the longest first to the group with the fewest tokens, so that steps cost alike. No row is shuffled: a hot source or
group of copies changes nothing, and a lost task is repeated alone.

Only the last windows of a task stay partly empty, at most one of each power of two. Sequence ids carry the task's
number in their upper bits, so they depend on how the input is split, but each id lies in exactly one piece.

Defined results: a null or empty text is its end token alone; rows that repeat are packed each; an empty table gives
an empty result; other columns never matter.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemline.llm.base import whole_text

WINDOW = 4096
SHORTEST = 512              # tiers are 4096, 2048, 1024, 512
END = 2
PENDING = 1 << 19           # tokens that wait in the tiers of a task before they are packed
STEP_TOKENS = 1 << 17       # tokens of a step group, about
REMEMBERED = 300_000        # words of which a task remembers the ids, in each of two generations
LATIN = "\u0250"            # letters below need no normalization, and none changes with its neighbours
CONTROLS = re.compile("[\x1c-\x1f]").search     # str.split takes these for white space, the tokenizer doesn't


def byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte: itself if it shows, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTE_SIGNS = byte_signs()


class Words:
    """Token ids of texts, exactly as the tokenizer gives them, by remembering those of words.

    The tokenizer's pattern drops white space and never reaches across it, and neither its normalizer nor its
    special tokens do, so a text's ids are those of its words in a row.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _word(self, word: str) -> bytes:
        """Letters alone come from their own entry, since the same word comes with different marks around it."""
        core = word.rstrip(".,;:!?%&*$#")
        if not core.isalpha() or max(core) >= LATIN or not (lower := core.lower()).isalpha():
            return self._whole(word)
        if core != word:
            return self._known(core) + self._known(word[len(core):])
        if lower != word:
            return self._known(lower)
        made = self.model.tokenize(word.encode().decode("latin-1").translate(BYTE_SIGNS))
        return np.array([token.id for token in made], np.uint32).tobytes()

    def _known(self, word: str) -> bytes:
        found = self.new.get(word)
        if found is None:
            found = self.old.pop(word, None)
            if found is None:
                found = self._word(word)
            if len(self.new) >= REMEMBERED:
                self.old, self.new = self.new, {}
            self.new[word] = found
        return found

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if CONTROLS(text):
            return self._whole(text)
        words = text.split()
        try:
            new = self.new
            return b"".join([new[word] for word in words])
        except KeyError:
            return b"".join([self._known(word) for word in words])


_loaded: dict[str, Words] = {}      # a worker keeps its words from task to task


class Packer:
    """Packs pieces (row, start, length) of one task; ``out`` gets (sequence, tier, pieces)."""

    def __init__(self, window: int = WINDOW, shortest: int = SHORTEST, pending: int = PENDING):
        self.tiers = []
        while window >= shortest:
            self.tiers.append(window)
            window //= 2
        self.waiting: dict[int, list] = {tier: [] for tier in self.tiers}
        self.tokens, self.pending, self.out = 0, pending, []

    def add(self, row: int, length: int) -> None:
        start, top = 0, self.tiers[0]
        while length - start >= top:
            self.out.append((top, [(row, start, top)]))
            start += top
        if length > start:
            self._wait((row, start, length - start))
            self.tokens += length - start
        if self.tokens >= self.pending:
            self.pack(False)

    def _wait(self, piece: tuple[int, int, int]) -> None:
        tier = next(t for t in reversed(self.tiers) if t >= piece[2])
        insort(self.waiting[tier], piece, key=lambda p: p[2])

    def _fill(self, window: list, room: int, below: list[int]) -> int:
        """Fill ``room`` from the tiers ``below``: whole pieces, the longest first, then one cut to the length."""
        for tier in below:
            kept = []
            for piece in reversed(self.waiting[tier]):
                if piece[2] <= room:
                    window.append(piece)
                    room -= piece[2]
                else:
                    kept.append(piece)
            self.waiting[tier] = kept[::-1]
            if not room:
                return 0
        for tier in reversed(below):                    # nothing whole fits: cut the shortest that is long enough
            if self.waiting[tier]:
                row, start, length = self.waiting[tier].pop(0)
                window.append((row, start, room))
                self._wait((row, start + room, length - room))
                return 0
        return room

    def pack(self, last: bool) -> None:
        """Close the windows that can be filled; with ``last`` also those that cannot."""
        held = []
        for place, tier in enumerate(self.tiers):
            below = self.tiers[place:]
            while self.waiting[tier]:
                piece = self.waiting[tier].pop()
                window, room = [piece], tier - piece[2]
                if room:
                    room = self._fill(window, room, below)
                if room:
                    held += window                      # all shorter pieces are used up
                else:
                    self.out.append((tier, window))
        if last and held:
            self._close(held)
            held = []
        self.tokens = sum(piece[2] for piece in held)
        for piece in held:
            self._wait(piece)

    def _close(self, pieces: list) -> None:
        """The rest of a task: full windows of every tier, and one that is padded."""
        left = sum(piece[2] for piece in pieces)
        for tier in self.tiers:
            while left >= tier:
                window, room = [], tier
                while room:
                    row, start, length = pieces.pop()
                    used = min(room, length)
                    window.append((row, start, used))
                    room -= used
                    if length > used:
                        pieces.append((row, start + used, length - used))
                self.out.append((tier, window))
                left -= tier
        if pieces:
            self.out.append((self.tiers[0], pieces))


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A group for each sequence, so that the groups' tokens differ little: the longest go first, to the emptiest."""
    groups = max(1, round(sum(sizes) / step_tokens))
    heap = [(0, group) for group in range(groups)]
    found = [0] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, group = heapq.heappop(heap)
        found[at] = group
        heapq.heappush(heap, (load + sizes[at], group))
    return found


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, " \
          "tier long, step_group long"


def packed(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", window: int = WINDOW,
           shortest: int = SHORTEST, end: int = END, pending: int = PENDING, step_tokens: int = STEP_TOKENS,
           with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    ``tokenizer`` is the path of a tokenizer file that every executor can read. ``with_ids`` adds the piece's token
    ids (little-endian unsigned 32-bit) as ``ids``.
    """
    read = df.select(F.col(f"`{id}`").alias(id), whole_text(text).alias("text"))
    schema = read.schema[id].simpleString().split(":", 1)[1]
    close = np.array([end], np.uint32).tobytes()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = Words(tokenizer)
        words, packer = _loaded[tokenizer], Packer(window, shortest, pending)
        first = TaskContext.get().partitionId() << 36
        rows: dict[int, list] = {}                      # of documents with pieces that wait: id, ids, tokens left
        number = sequences = groups = 0

        def done() -> pa.RecordBatch:
            nonlocal sequences, groups
            made, out = [], packer.out
            packer.out = []
            dealt = step_groups([sum(p[2] for p in pieces) for _, pieces in out], step_tokens) if out else []
            for (tier, pieces), group in zip(out, dealt):
                offset = 0
                for row, start, length in pieces:
                    key, ids, left = rows[row]
                    part = ids[4 * start:4 * (start + length)]
                    made.append((key, start, length, zlib.crc32(part), len(ids) // 4, first + sequences, offset, tier,
                                 first + groups + group, part if with_ids else None))
                    offset += length
                    if left == length:
                        del rows[row]
                    else:
                        rows[row][2] = left - length
                sequences += 1
            groups += max(dealt, default=-1) + 1
            columns = list(zip(*made)) if made else [()] * 10
            kinds = [kind, *[pa.int64()] * 8, pa.binary()]
            arrays = [pa.array(column, k) for column, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(
                arrays[:9 + with_ids], [id, *[c.split()[0] for c in COLUMNS.split(", ")], "ids"][:9 + with_ids])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.ids(value) + close
                rows[number] = [key, ids, len(ids) // 4]
                packer.add(number, len(ids) // 4)
                number += 1
                if len(packer.out) >= 512:
                    yield done()
        if number:
            packer.pack(True)
            yield done()

    return read.mapInArrow(each, f"`{id}` {schema}, {COLUMNS}" + (", ids binary" if with_ids else ""))
