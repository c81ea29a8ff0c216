"""Pseudonyms: one-to-one, valid, linked, reversible."""

import random
import re

import pytest
from conftest import listed

from firmloom.llm.pseudonyms import (
    DAYS, Feistel, find_values, iban_check, luhn_digit, pseudonymise, pseudonym_report, replace_values, restore, restore_values, value_spans)

KEY = b"a test key"
F = Feistel(KEY)


@pytest.mark.parametrize("size", [1, 2, 7, 26, 100, 999])
def test_permutation(size):
    images = [F.permute(i, size, b"t") for i in range(size)]
    assert sorted(images) == list(range(size))
    assert [F.permute(i, size, b"t", back=True) for i in images] == list(range(size))
    if size > 20:
        assert images != [F.permute(i, size, b"u") for i in range(size)] != [Feistel(b"x").permute(i, size, b"u") for i in range(size)]


def test_large_domains():
    for size in (DAYS, 10**14, 26**30):
        for v in (0, 1, size // 3, size - 1):
            assert F.permute(F.permute(v, size, b"t"), size, b"t", back=True) == v


def one(text):
    found = find_values(text, F)
    return replace_values(text, found), [k for _, _, k, _ in found]


def there_and_back(text):
    found = find_values(text, F)
    return restore_values(replace_values(text, found), value_spans(text, found), F)


VALID = [
    ("card", "4337166598464399"), ("card", "4337 1665 9846 4399"), ("card", "378282246310005"), ("phone", "+1 (988) 555-2485"),
    ("phone", "(212) 555-0187"), ("phone", "+44 20 7946 0958"), ("ipv4", "70.123.182.155"), ("ssn", "219-09-9999"), ("date", "2024-02-29"),
    ("date", "29.02.2024"), ("date", "31/12/1999"), ("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432"),
    ("email", "Jo.Smith42@Mail8.example.com"),
]


@pytest.mark.parametrize("kind, value", VALID)
def test_format_and_validity(kind, value):
    new, kinds = one(f"é {value}, x")
    assert kinds == [kind]
    pseudonym = new[2:-3]
    assert pseudonym != value and len(pseudonym) == len(value) or kind == "ipv4"
    same = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))
    if kind != "ipv4":
        assert same(pseudonym) == same(value)
    assert one(new)[1] == [kind], "the pseudonym is valid itself"
    assert there_and_back(f"é {value}, x") == f"é {value}, x"
    digits = re.sub("[^0-9]", "", pseudonym)
    if kind == "card":
        assert luhn_digit(digits[:-1]) == digits[-1] and digits[0] == value[0]
    if kind == "iban":
        bare = pseudonym.replace(" ", "")
        assert iban_check(bare[:2], bare[4:]) == bare[2:4]


@pytest.mark.parametrize("text", [
    "4337166598464398", "0810992847249404", "300.1.2.3", "1.2.3.4.5", "2023-02-29", "31.04.2020", "2024-13-01", "000-12-3456", "666-12-3456",
    "DE88 3704 0044 0532 0130 00", "a4337166598464399", "43371665984643990000000", "version 2.0.1", "12345", "a@b", "", "1850-01-01",
])
def test_invalid_values_stay(text):
    assert one(text) == (text, [])


def test_linked_in_any_layout():
    digits = lambda s: re.sub("[^0-9]", "", s)
    assert digits(one("+1 (988) 555-2485")[0]) == digits(one("+1 988 555 2485")[0]) == digits(one("1-988-555-2485")[0])
    assert digits(one("4337166598464399")[0]) == digits(one("4337-1665-9846-4399")[0])
    assert one("Anna@x.org")[0].lower() == one("anna@x.org")[0]
    days = [one(d)[0] for d in ("2001-02-03", "03.02.2001", "03/02/2001")]
    assert days[0] == "-".join(reversed(days[1].split("."))) == "-".join(reversed(days[2].split("/")))


def test_over_a_table(spark, docs):
    secret = "call +1 (826) 555-4081 190.137.22.10 or 4337166598464399###"
    rows = [(1, secret, "x", 3), (2, None, "y", 4), (3, "", None, None), (None, f"Again {secret}", "x", 3), (4, "plain " * 50_000 + secret, "z", 1), (1, secret, "x", 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rest string, `values` int").repartition(3)
    done = pseudonymise(df, KEY)
    assert done.columns == ["doc_id", "text", "rest", "values", "found_values"]
    texts = [r.text for r in done.collect() if r.text]
    assert not any(v in t for t in texts for v in ("826) 555-4081", "190.137.22.10", "4337166598464399"))
    assert len({t[t.index("call"):] for t in texts}) == 1
    back = restore(done, KEY)
    assert back.columns == df.columns and listed(back) == listed(df)
    plain = pseudonymise(docs, KEY)
    assert sorted((r.doc_id or -1, r.text or "") for r in plain.filter("size(values) = 0").collect()) == sorted(
        (r.doc_id or -1, r.text or "") for r in docs.collect() if not find_values(r.text or "", F))


def test_report(spark, nothing):
    df = spark.createDataFrame([(1, "2001-02-03 a@b.cd 4337166598464399"), (2, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pseudonym_report(pseudonymise(df, KEY)).collect()}
    assert (rows[1].n_date, rows[1].n_email, rows[1].n_card, rows[1].n_phone) == (1, 1, 1, 0) and rows[2].text is None and rows[2].n_card == 0
    assert pseudonym_report(pseudonymise(nothing, KEY)).count() == 0


CARD, IBAN = "4111 1111 1111 1111", "ES91 2100 0418 4502 0005 1332"
BESIDE = [
    (f"{CARD} 123", CARD), ("4111111111111111 12", "4111111111111111"), ("3782 822463 10005 2027", "3782 822463 10005"),
    (f"{IBAN} EUR", IBAN), ("2024-01-31T10:00:00Z", "2024-01-31"), ("12/31/2020", "12/31/2020"),
]


@pytest.mark.parametrize("text, value", BESIDE)
def test_values_beside_other_groups(text, value):
    new, kinds = one(f"x {text}, y")
    assert len(kinds) == 1 and value not in new and new.endswith(text[len(value):] + ", y")
    assert there_and_back(f"x {text}, y") == f"x {text}, y"


def test_groups_around_cards_come_back():
    rng = random.Random(7)
    for _ in range(300):
        cells = []
        for _ in range(rng.randint(1, 4)):
            payload = "4" + "".join(rng.choice("0123456789") for _ in range(14))
            card = payload + luhn_digit(payload)
            cells.append(" ".join(card[i:i + 4] for i in range(0, 16, 4)) if rng.random() < 0.7 else card)
            cells += [str(rng.randint(1, 9999)) for _ in range(rng.randint(0, 2))]
        text = " ".join(cells)
        assert one(text)[0] != text and there_and_back(text) == text


def test_month_first_dates_are_linked():
    for m in range(1, 13):
        for d in range(13, 29):
            us, iso, dotted = (one(x)[0] for x in (f"{m:02d}/{d:02d}/2020", f"2020-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.2020"))
            year, month, day = iso.split("-")
            assert us == f"{month}/{day}/{year}" and dotted == f"{day}.{month}.{year}"
            assert there_and_back(f"{m:02d}/{d:02d}/2020") == f"{m:02d}/{d:02d}/2020"
    assert one("13/32/2020")[1] == [] == one("02/30/2020")[1]


@pytest.mark.parametrize("value", [CARD, "4111111111111111", "3782 822463 10005", IBAN])
def test_one_value_has_one_pseudonym_beside_any_groups(value):
    alone, rng = one(value)[0], random.Random(11)
    for _ in range(1000):
        behind = "".join(f" {rng.randint(0, 10 ** n - 1):0{n}d}" for n in [rng.randint(1, 4) for _ in range(rng.randint(1, 3))])
        ahead = f"{rng.randint(400, 999)} " if rng.random() < 0.5 and len(alone) == len(CARD) else ""
        text = f"{ahead}{value}{behind}"
        assert one(text)[0].startswith(ahead + alone) and there_and_back(text) == text


def test_text_alone_and_empty_table(spark):
    only = spark.createDataFrame([(f"{CARD} 123, 12/31/2020, 1.2.3.4, 5.6.7.8",), (None,), ("",)], "text string")
    done = pseudonymise(only, KEY)
    assert done.columns == ["text", "values"] and listed(restore(done, KEY)) == listed(only)
    assert restore(pseudonymise(only.limit(0), KEY), KEY).count() == 0
    clash = only.selectExpr("text", "1 as values", "2 as found_values", "3 as pad", "4 as doc_id", "'x' as rest", "5 as spans")
    done = pseudonymise(clash, KEY)
    assert done.columns[-1] == "found_found_values" and listed(restore(done, KEY)) == listed(clash)
    assert sorted(r.n_card for r in pseudonym_report(done).collect()) == [0, 0, 1]
