import random
import zlib

import pytest

from hemline.llm import language

SAMPLES = {"en": "the of and to in is that with for", "de": "der die und in den von zu das mit", "fr": "le la les de et des en que"}


def prose(lang, n, r):
    return " ".join(r.choice(SAMPLES[lang].split()) for _ in range(n))


def test_known_words_then_ngrams():
    counts = [("a", 0, "cat", 8), ("b", 0, "dog", 8)] + [("a", 2, g, 8) for g in (" c", "ca", "at", "t ")] + [
        ("b", 2, g, 8) for g in (" d", "do", "og", "g ")]
    model = language.Model({"a": 5, "b": 9}, counts, {("a", 0): (8, 1), ("b", 0): (8, 1), ("a", 2): (32, 4), ("b", 2): (32, 4)}, 2)
    scorer = language.Scorer(model)
    assert scorer.predict("Cat")[0] == "a" and scorer.predict("DOG dog cat")[0] == "b"
    assert scorer.predict("bat")[0] == "a"                      # by "at"
    assert scorer.predict("xyz") == ("b", 0.0)                  # nothing known: the usual language
    assert scorer.predict("12 !") == scorer.predict("") == scorer.predict(None) == ("und", 0.0)
    assert language.Scorer(language.Model({}, [], {})).predict("cat") == ("und", 0.0)


def test_scores_do_not_depend_on_what_is_remembered(monkeypatch):
    r = random.Random(1)
    entries = [(lang, 0, w, r.randint(1, 9)) for lang in SAMPLES for w in SAMPLES[lang].split()]
    model = language.Model(dict.fromkeys(SAMPLES, 1), entries, {(lang, 0): (40, 9) for lang in SAMPLES}, 0)
    texts = [prose(lang, 50, r) for lang in SAMPLES for _ in range(20)]
    want = [language.Scorer(model).predict(t) for t in texts]
    monkeypatch.setattr(language, "CACHED", 30)
    monkeypatch.setattr(language, "PIECE", 7)
    scorer = language.Scorer(model)
    for text, (lang, score) in zip(texts, want):
        got = scorer.predict(text)
        assert got[0] == lang and got[1] == pytest.approx(score)


def test_identified(docs):
    r = random.Random(2)
    langs = [r.choice(list(SAMPLES)) for _ in range(150)]
    rows = [(i, prose(lang, 30, r)) for i, lang in enumerate(langs)]
    rows += [(900, None), (901, "123 ..."), (902, ""), (None, "the and of"), (903, "the " * 60_000), (903, "the " * 60_000)]
    langs += [None, "en", "en", "en", None, "xx"]
    found = language.identified(docs(rows, langs))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"] and found.count() == len(rows)
    by_id = {row["doc_id"]: row for row in found.collect()}
    for i, lang in enumerate(langs[:150]):
        assert by_id[i]["lang_pred"] == lang and 0 < by_id[i]["score"] <= 1
        assert by_id[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert [by_id[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by_id[None]["held_out"]
    kept = language.recognised(docs(rows, langs))
    assert kept.columns == docs([]).columns
    assert {row["doc_id"] for row in kept.collect()} == set(range(150)) | {None, 903}


def test_held_out_rows_teach_nothing(docs):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    rows = [(i, "secretword" if i in held else "the of") for i in range(200)]
    langs = ["zz" if i in held else "en" for i in range(200)]
    assert {row["lang_pred"] for row in language.identified(docs(rows, langs)).collect()} == {"en"}


def test_without_labels_or_rows(docs):
    assert {row["lang_pred"] for row in language.identified(docs([(1, "a"), (2, None)])).collect()} == {"und"}
    assert language.identified(docs([])).count() == 0 and language.recognised(docs([])).count() == 0


def test_counts_in_parts_add_up(monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["ab ab cd", "ef", "ab"]), pa.array(["x", "x", "y"])], ["text", "lang"])

    def total(parts):
        out = {}
        for row in (row for part in parts for row in part.to_pylist()):
            key = (row["lang"], row.get("size", 0), row["entry"])
            out[key] = out.get(key, 0) + row["n"]
        return out

    def both():
        words = list(language.word_counts(iter([batch])))
        return total(words), total(language.gram_counts(iter(words), 2))

    words, grams = both()
    assert words == {("x", 0, "ab"): 2, ("x", 0, "cd"): 1, ("x", 0, "ef"): 1, ("y", 0, "ab"): 1}
    assert grams["x", 2, "ab"] == 2 and grams["x", 1, "a"] == 2 and grams["y", 2, " a"] == 1
    monkeypatch.setattr(language, "FLUSH", 0)
    assert both() == (words, grams)


def test_numbers_are_no_letters(docs):
    assert language.words_of("Ab½c ② Ⅷ x² é_9ß") == ["ab", "c", "x", "é", "ß"]
    rows = [(i, "the and of", ) for i in range(30)] + [(100, "½"), (101, "② ²"), (102, "½ the"), (103, "Ⅷ")]
    found = {r["doc_id"]: r["lang_pred"] for r in language.identified(docs(rows, ["en"] * 34)).collect()}
    assert [found[i] for i in (100, 101, 102, 103)] == ["und", "und", "en", "und"]
