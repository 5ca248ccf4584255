import random

import pytest

from hemline.llm import pii

KEY = b"test"
TEXT = ("Mail Bob.X@Mail.example.com or bob.x@mail.example.com; call +1 (632) 555-4827, 555-123-4567. IP 10.2.30.4, card "
        "4111 1111 1111 1111 = 4111111111111111, no 078-05-1120. Mrs. Maria Gómez met Dr Иван Петров and Mrs Maria Gómez.")


def test_what_is_found():
    found = [(kind, TEXT[a:b]) for kind, a, b in pii.found_in(TEXT)]
    assert found == [
        ("email", "Bob.X@Mail.example.com"), ("email", "bob.x@mail.example.com"), ("phone", "+1 (632) 555-4827"),
        ("phone", "555-123-4567"), ("ip", "10.2.30.4"), ("card", "4111 1111 1111 1111"), ("card", "4111111111111111"),
        ("ssn", "078-05-1120"), ("name", "Maria Gómez"), ("name", "Иван Петров"), ("name", "Maria Gómez")]
    assert pii.found_in("version 1.2.3.4.5, 12345678901234567890123, a@b, 999.1.1.1, Mr. he") == []
    assert [k for k, *_ in pii.found_in("2353820953013749 4550997810720808 x")] == ["card", "card"]


def test_form_is_kept():
    maker = pii.Surrogates(KEY)
    for kind, a, b in pii.found_in(TEXT):
        mention = TEXT[a:b]
        made = pii.worded(kind, mention, maker.of(kind, pii.normal(kind, mention)))
        assert made != mention and len(made) == len(mention) and pii.found_in(f"Mrs. {made}" if kind == "name" else made)
        for old, new in zip(mention, made):
            assert old.isupper() == new.isupper() and old.isdigit() == new.isdigit() and old.isalpha() == new.isalpha()
            assert old == new if not old.isalnum() else (old < "ɐ") == (new < "ɐ")
        if kind == "name":
            assert [w[-1] for w in made.split()] == [w[-1] for w in mention.split()]
        if kind == "phone" and mention[0] == "+":
            assert made[:2] == "+1"
    card = maker.of("card", "4111111111111111")
    assert pii._check_digit(card[:-1]) == int(card[-1])
    other = maker.of("card", "4111111111111112")
    assert (int(other[-1]) - pii._check_digit(other[:-1])) % 10 == 1
    assert pii.Surrogates(b"other").of("card", "4111111111111111") != card


def test_same_form_gives_distinct_surrogates():
    maker = pii.Surrogates(KEY)
    values = [f"{a}{b}.{n}@x.com" for a in "bcdfghjklmnpqrstvwxyz" for b in "aeiou" for n in range(10)]
    assert len({maker.of("email", v) for v in values}) == len(values)
    ips = [f"1.2.{a}.{b}" for a in range(10) for b in range(10)]
    made = [maker.of("ip", v) for v in ips]
    assert len(set(made)) == 100 and all(pii._valid("ip", v) and len(v) == 7 for v in made)
    assert maker.of("name", "x") == "#"                      # no other value


NAMES = [f"{a}{b}t" for a in "bcdfghjklmnpqrstvwxyz" for b in "aeiou"]        # all names of one form


def test_collection_is_free_of_collisions(spark):
    values = random.Random(1).sample(NAMES, 40) + ["x"]
    known = spark.createDataFrame([("name", v) for v in values], "kind string, value string")
    rows = pii.surrogates(known, KEY).collect()
    made = [row["surrogate"] for row in rows if not row["surrogate"].startswith("#")]
    assert len(rows) == len(values) and len(set(made)) == len(made) >= 30 and not set(made) & set(values)
    assert any(row["skip"] > 0 for row in rows)


def test_documents(spark, docs, monkeypatch):
    rows = [(1, TEXT), (2, "again bob.x@mail.example.com"), (3, None), (4, ""), (5, "nothing here"), (6, "x " * 40_000 + "10.2.30.4"),
            (2, "again bob.x@mail.example.com"), (None, "10.2.30.4")]
    df = docs(rows)
    done = pii.pseudonymised(df, KEY)
    assert done.columns == [*df.columns, "entities"]
    found = done.collect()
    assert len(found) == len(rows)
    texts = {row["doc_id"]: row["text"] for row in found}
    maker = pii.Surrogates(KEY)
    mail, ip = maker.of("email", "bob.x@mail.example.com"), maker.of("ip", "10.2.30.4")
    assert texts[2] == f"again {mail}" and texts[3] is None and texts[4] == "" and texts[5] == "nothing here"
    assert texts[6] == "x " * 40_000 + ip and texts[None] == ip and f" {mail};" in texts[1]
    assert not [m for m in ("4111", "Gómez", "Петров", "4827", "05-1120") if m in texts[1]]
    assert {row["doc_id"]: row["entities"] for row in found}[1] == {"email": 2, "ip": 1, "card": 2, "ssn": 1, "phone": 2, "name": 3}


def test_moved_surrogates_reach_the_documents(docs):
    values = [v.capitalize() for v in random.Random(2).sample(NAMES, 40)]
    rows = [(i, f"Mr {v} and Mr {values[0]}") for i, v in enumerate(values)]
    found = {row["doc_id"]: row["text"] for row in pii.pseudonymised(docs(rows), KEY).collect()}
    pairs = {}
    for i, text in rows:
        for old, new in zip(text.split()[1::3], found[i].split()[1::3]):
            assert pairs.setdefault(old, new) == new         # one surrogate wherever it occurs
    made = [v for v in pairs.values() if not v.startswith("#")]
    assert len(set(made)) == len(made) >= 30 and not set(made) & set(pairs)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "plain")]])
def test_nothing_to_do(docs, rows):
    assert pii.pseudonymised(docs(rows), KEY).select("doc_id", "text").collect() == [tuple(r) for r in rows]


def test_prefilter_never_changes_what_is_found():
    drawn = random.Random(4)
    parts = ["plain", "Mr ", "Ivan", "a@b.com", "@", ".", "-", " ", "+", "(555) ", "555-123-4567", "+1 632 555 4827", "10.2.30.4"]
    for _ in range(3000):
        text = "".join(drawn.choice(parts) for _ in range(drawn.randrange(6)))
        text = text.translate(dict(zip(range(48, 58), drawn.choice(pii.DIGITS))))
        assert pii.found_in(text) == [
            (m.lastgroup, *m.span(m.lastgroup)) if m.lastgroup in pii.KINDS else
            next((k, *m.span(k)) for k in pii.KINDS if m[k] is not None) for m in pii.FIND.finditer(text)]


@pytest.mark.parametrize("zero", ["\u0660", "\u06f0", "\u0966", "\u0e50", "\uff10"])
def test_digits_of_other_scripts(docs, zero):
    script = {48 + i: chr(ord(zero) + i) for i in range(10)}
    text = "+966 50 123 4567 and 078-05-1120 and 4111 1111 1111 1111".translate(script)
    assert [kind for kind, *_ in pii.found_in(text)] == ["phone", "ssn", "card"]
    row = pii.pseudonymised(docs([(1, text)]), KEY).first()
    assert row["entities"] == {"phone": 1, "ssn": 1, "card": 1}
    for old, new in zip(text.split(" and "), row["text"].split(" and "), strict=True):
        assert old != new and "#" not in new
        assert all(a == b if not a.isdigit() else ord(zero) <= ord(b) < ord(zero) + 10 for a, b in zip(old, new, strict=True))


@pytest.mark.parametrize("phone", ["+1 (826) 555-4081", "+1 826 555 4081", "+1 8265554081", "+966 50 123 4567"])
@pytest.mark.parametrize("kind,other", [("ip", "190.137.223.204"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"),
                                        ("ssn", "078-05-1120"), ("phone", "555-123-4567"), ("email", "1a@b.com")])
def test_entities_side_by_side(phone, kind, other):
    for pair in ([("phone", phone), (kind, other)], [(kind, other), ("phone", phone)]):
        text = " ".join(value for _, value in pair)
        assert [(k, text[a:b]) for k, a, b in pii.found_in(text)] == pair


@pytest.mark.parametrize("phone", ["+49 30.12.34.56", "+49 (30) 12.34.56.78", "+33 142.68.53.00", "+44 20 7946 0958", "+966 50 123 45 67"])
def test_phones_with_dots_stay_whole(phone):
    assert [(k, phone[a:b]) for k, a, b in pii.found_in(phone)] == [("phone", phone)]
