"""Finding and replacing personal information."""

import re
from datetime import date

import heldout
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunklake.llm import pii
from chunklake.llm import pseudonyms as ps

NOBODY = pii.Names([])
NAMES = pii.Names([("Hira", "given"), ("Marsh", "family"), ("Flint", "given"), ("Amber", "given"), ("Reed", "given"), ("Torvik", "given"), ("Alvik", "given"), ("Sorvik", "given")])


def score(texts):
    hit = extra = missed = 0
    for marked in texts:
        text, cases = heldout.parse(marked)
        got = {(k, a) for k, a, _ in pii.find(text, NOBODY)}
        hit, extra, missed = hit + len(got & cases), extra + len(got - cases), missed + len(cases - got)
    return hit / (hit + missed), hit / (hit + extra)


@pytest.mark.parametrize("texts", [heldout.TEXTS, heldout.HARD], ids=["texts", "hard"])
def test_texts_of_other_templates(texts):
    recall, precision = score(texts)
    assert recall >= 0.9 and precision >= 0.9


CASES = [
    ("to <hira [at] post [dot] lake [dot] test> or a(at)b.example or c at d dot test.", [("email", "hira [at] post [dot] lake [dot] test"), ("email", "a(at)b.example"), ("email", "c at d dot test")]),
    ("連絡先はhira@lake.exampleです。", [("email", "hira@lake.example")]),
    ("use lake/model-3b@v1 and send 3 @ 2 per second, see x@2025-03", []),
    ("his number (335-555-0192) and ((618) 555-0188)", [("phone", "335-555-0192"), ("phone", "(618) 555-0188")]),
    ("+49(0)30/23125-688; (0171) 3920012; 030-23125879; 01.99.00.56.34", [("phone", x) for x in ("+49(0)30/23125-688", "(0171) 3920012", "030-23125879", "01.99.00.56.34")]),
    ("lines 120-133-3427, 10.68.3.307, 3 797 782 312 of 9,443,933,492 on 2025-04-25 12:00", []),
    ("Ticket 4471-88-20391, job 4471/88/203, offset 1-078-912, the phone app shows 1783568945", []),
    ("Ana Ruiz;05373213053;555 09 50 26;2025-03-01", [("name", "Ana Ruiz"), ("identity", "05373213053"), ("phone", "555 09 50 26")]),
    ("at Flat 2, 103 Tanner St.\nHarrow Fen QX6 9QX and 14 St. Mary's Lane, Ely, ZZ 00453.", [("address", "Flat 2, 103 Tanner St.\nHarrow Fen QX6 9QX"), ("address", "14 St. Mary's Lane, Ely, ZZ 00453")]),
    ("Mühlenstr. 29, 99922 Harnau; 135, avenue des Puits; C/ Mayor Vieja n.º 88", [("address", "Mühlenstr. 29, 99922 Harnau"), ("address", "135, avenue des Puits"), ("address", "C/ Mayor Vieja n.º 88")]),
    ("Lane 3 of the loader, Street View tiles go to lane 4.", []),
    ("Kind regards, hira marsh", [("name", "hira marsh")]),
    ("Contact: HIRA MARSH", [("name", "HIRA MARSH")]),
    ('The machine Flint is slow. Reed switches report, the marsh sensor too. Release "Amber" is next', []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_finds(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.find(text, NAMES)] == want


def test_finds_edges():
    assert pii.find(None, NAMES) == pii.find("", NAMES) == pii.find(" \n", NAMES) == []
    long = "x" * 30_000 + " 1" * 10_000 + " A" * 10_000
    assert pii.find(long + " mail v@l.test", NAMES)[-1] == ("email", len(long) + 6, len(long) + 14)
    assert pii.find("🙂 v@l.test", NAMES) == [("email", 2, 10)]  # code points


@given(st.text(max_size=400))
@settings(max_examples=300, deadline=None)
def test_any_text_is_searched_and_redacted(text):
    finds = pii.find(text, NAMES)
    assert all(a < b <= len(text) and k in pii.KINDS for k, a, b in finds)
    assert all(x[2] <= y[1] for x, y in zip(finds, finds[1:]))
    pii.redact(text, NAMES, b"k")


# ---------------------------------------------------------------- pseudonyms


@given(st.text("0123456789ABZ", min_size=1, max_size=18), st.binary(min_size=1, max_size=32))
@settings(max_examples=200, deadline=None)
def test_characters_are_permuted_and_come_back(chars, key):
    new = ps.permute(chars, key)
    assert [c.isdigit() for c in new] == [c.isdigit() for c in chars] and ps.permute(new, key, back=True) == chars


def test_permutation_is_one_to_one():
    for n in (1, 2, 3):
        assert len({ps.permute_digits(f"{i:0{n}}", b"k") for i in range(10**n)}) == 10**n
    assert len({ps.permute_day(date(2025, 1, d), b"k") for d in range(1, 32)}) == 31
    assert len({ps.pseudonym_phone(f"+44 7700 9{i:05}", b"k") for i in range(3000)}) == 3000
    assert len({ps.pseudonym_identity(f"{i:08}" + ps._DNI[i % 23], b"k") for i in range(3000)}) == 3000
    assert len({ps.pseudonym_identity(f"X{i:07}{ps._DNI[i % 23]}", b"k") for i in range(1000)}) == 1000


@pytest.mark.parametrize(
    "spellings",
    [
        ["+44 7700 900779", "0044 7700 900779", "07700 900779", "+44-7700-900779", "+44 (0)7700 900779", "(+44) 7700900779"],
        ["+1 212 555 0187", "(212) 555-0187", "212.555.0187", "1-212-555-0187", "001 212 555 0187"],
        ["+33 1 99 00 56 34", "01.99.00.56.34", "01 99 00 56 34", "0033 199005634"],
        ["+49 30 23125688", "030 23125688", "+49(0)30/23125-688"],
        ["+34 655 042 890", "655042890"],
    ],
)
def test_all_spellings_of_a_phone_number_share_a_pseudonym(spellings):
    new = [ps.pseudonym_phone(x, b"k") for x in spellings]
    assert len({ps.canonical_phone(x) for x in spellings}) == len({ps.canonical_phone(x) for x in new}) == 1
    for old, x in zip(spellings, new):
        assert ps.canonical_phone(x) != ps.canonical_phone(old)
        assert re.sub(r"\d", "0", x) == re.sub(r"\d", "0", old)  # the format
        assert ps.phone_parts(x)[0] == ps.phone_parts(old)[0]  # the country
        assert ps.pseudonym_phone(x, b"k", back=True) == old


def test_checks_of_published_numbers():
    for number, name in (
        ("12345678Z", "dni"), ("X1234567L", "nie"), ("86095742719", "steuer"), ("12345678909", "cpf"), ("234123412346", "aadhaar"), ("123456789018", "my_number"), ("123456789", "nif"),
        ("255081416802538", "nir"),
    ):
        assert ps.scheme(number)[0] == name


@pytest.mark.parametrize("text", ["12.345.678-Z", "X-1234567-L", "86 095 742 719", "123.456.789-09", "2341 2341 2346", "2 55 08 14 168 025 38"])
def test_valid_identity_numbers_stay_valid(text):
    new = ps.pseudonym_identity(text, b"k")
    assert new != text and ps.scheme(ps.compact(new))[0] == ps.scheme(ps.compact(text))[0]
    assert ps.pseudonym_identity(new, b"k", back=True) == text
    assert ps.compact(new) == ps.pseudonym_identity(ps.compact(text), b"k")


def test_other_identity_numbers_stay_without_a_check():
    for text in ("078-05-1120", "QQ 21 65 83 B", "L05X13K285", "12345678A"):
        new = ps.pseudonym_identity(text, b"k")
        assert ps.scheme(ps.compact(new)) is None and ps.pseudonym_identity(new, b"k", back=True) == text
        assert [c.isalpha() for c in new] == [c.isalpha() for c in text] and sum(a == b for a, b in zip(new, text) if a.isalnum()) < len(text) // 2


def test_dates():
    for d in ("2025-02-28", "28.02.2025", "28/02/2025", "28 Feb 2025", "03 March 2024"):
        new = ps.pseudonym_date(d, b"k")
        assert new != d and ps.DATE.fullmatch(new) and ps.pseudonym_date(new, b"k", back=True) == d
    for d in ("2025-02-30", "30 Feb 2025", "soon"):
        assert ps.pseudonym_date(d, b"k") == d


def test_redaction_replaces_dates():
    text = "born 1980-05-03, seen 2025-02-28T10:00, 28.02.2025. Not 2025-02-30, 1.2.2025, 10.12.2024.5 or 12025-02-28"
    out = pii.redact(text, NAMES, b"k")
    assert out == pii.redact(text, NAMES, b"k") and out.endswith(". Not 2025-02-30, 1.2.2025, 10.12.2024.5 or 12025-02-28")
    new = re.match(r"born (\d{4}-\d\d-\d\d), seen (\d{4}-\d\d-\d\d)T10:00, (\d\d\.\d\d\.\d{4})\.", out).groups()
    assert [ps.pseudonym_date(x, b"k", back=True) for x in new] == ["1980-05-03", "2025-02-28", "28.02.2025"]
    assert {f[0] for f in pii.find(text, NAMES)} <= set(pii.KINDS)


def test_redaction(spark):
    text = "Call +44 7700 900779, ask for Hira. Bye"
    out = pii.redact(text, NAMES, b"k")
    assert out.startswith("Call <phone:+44 7") and ", ask for <name:" in out and out.endswith(">. Bye")
    docs = spark.createDataFrame([(1, text, 1), (2, None, 1), (3, "", 1), (1, text, 1)], "doc_id long, text string, kind int")
    names = spark.createDataFrame([("Hira", "given"), (None, "family"), ("X", None)], "name string, role string")
    got = sorted(tuple(r) for r in pii.find_all(docs, names).collect())
    assert [g[1:] for g in got] == [("name", 30, 4), ("name", 30, 4), ("phone", 5, 15), ("phone", 5, 15)]
    rows = pii.redact_all(docs, names, b"secret").collect()
    assert len(rows) == 4 and {r["text"] for r in rows if r["doc_id"] == 2} == {None}
    assert pii.find_all(docs.limit(0), names.limit(0)).count() == 0


def test_the_key_comes_from_the_session(spark):
    random = pii.secret(spark)
    assert len(random) == 32 and pii.secret(spark) == random
    spark.conf.set(pii.KEY_CONF, "a")
    try:
        given_ = pii.secret(spark)
        assert given_ != random and given_ == pii.secret(spark)
    finally:
        spark.conf.unset(pii.KEY_CONF)
