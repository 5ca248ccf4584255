import random
import zlib

import numpy as np
import pytest

from hemline.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "it's THE cat's 12 a1b2", "ciónado Ñandú, ß! Σας ΣΑΣ İstanbul", "été ﬁn Å", "a\x1cb\x1dc",
       "x\xa0y z　w", "<|endoftext|> a<|startoftext|>b", "日本語 テキスト", "!!%%% word%%% .,;", "퟿\U0001f600 ok", "A" * 30_000,
       "and. " * 9_000, "don't we'll They'RE", "ŉ ǆ ŀ"]


def test_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    plain, words = Tokenizer.from_file(PATH), packing.Words(PATH)
    r = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(r.choice("ab'sS é.,!ñÑ\n\t0ſK") for _ in range(60)) for _ in range(300)]
    for _ in range(2):                                  # unseen, then remembered
        for text in texts:
            assert np.frombuffer(words.ids(text), np.uint32).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(monkeypatch):
    texts = [" ".join(f"w{chr(97 + i % 26)}{'x' * (i % 7)}" for i in range(n)) for n in range(1, 80)]
    want = [packing.Words(PATH).ids(t) for t in texts]
    monkeypatch.setattr(packing, "REMEMBERED", 5)
    words = packing.Words(PATH)
    assert [words.ids(t) for t in texts] == want


def layout(sizes, **settings):
    packer = packing.Packer(**settings)
    for row, size in enumerate(sizes):
        packer.add(row, size)
    packer.pack(True)
    return packer.out


@pytest.mark.parametrize("sizes", [[], [1], [64], [65], [1] * 300, [63, 1, 62, 2, 40, 30, 20, 10], [1000], [64] * 5])
@pytest.mark.parametrize("pending", [1, 100, 1 << 20])
def test_every_token_once_and_windows_full(sizes, pending):
    out = layout(sizes, window=64, shortest=8, pending=pending)
    seen = {row: [] for row in range(len(sizes))}
    loose = 0
    for tier, pieces in out:
        used = sum(p[2] for p in pieces)
        assert 0 < used <= tier
        loose += used < tier
        for row, start, length in pieces:
            seen[row] += range(start, start + length)
    assert all(sorted(seen[row]) == list(range(size)) for row, size in enumerate(sizes))
    assert loose <= 1


def test_random_sizes_are_packed_tight():
    r = random.Random(2)
    sizes = [int(r.lognormvariate(4, 1.5)) + 1 for _ in range(3000)]
    out = layout(sizes, window=256, shortest=32, pending=5000)
    assert sum(sum(p[2] for p in pieces) < tier for tier, pieces in out) <= 1
    assert {tier for tier, _ in out} <= {256, 128, 64, 32}


def test_step_groups_are_even():
    sizes = [4096] * 10 + [512] * 40 + [1024] * 7
    groups = packing.step_groups(sizes, 8192)
    loads = [sum(s for s, g in zip(sizes, groups) if g == k) for k in set(groups)]
    assert max(loads) - min(loads) <= 512 * 2 and packing.step_groups([5], 100) == [0]


def test_pieces_of_documents(docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    rows = list(enumerate(ODD)) + [(None, "no id"), (3, "again"), (3, "again")]
    found = packing.packed(docs(rows), PATH, with_ids=True).collect()
    want = sorted((str(i), tuple(plain.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    pieces, sequences = {}, {}
    for p in found:
        ids = np.frombuffer(p["ids"], np.uint32)
        assert len(ids) == p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
        sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["tier"]))
        pieces.setdefault((str(p["doc_id"]), p["doc_tokens"]), []).append((p["start"], tuple(ids.tolist())))
    for parts in sequences.values():
        at = 0
        for offset, length, tier in sorted(parts):
            assert offset == at
            at += length
        assert at <= tier <= 4096
    joined = []
    for (i, size), parts in pieces.items():
        copies = sum(start == 0 for start, _ in parts)
        parts.sort()
        assert sum(len(ids) for _, ids in parts) == size * copies
        if copies == 1:
            joined.append((i, tuple(x for _, ids in parts for x in ids)))
    assert sorted(joined) == sorted(w for w in want if want.count(w) == 1)
    assert packing.packed(docs([]), PATH).count() == 0
