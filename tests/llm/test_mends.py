"""Forms of surrogates over generated entities, licence expressions against a plain evaluation, passages of rows given twice."""

import itertools
import random
import re
import string
import time

import pytest

from zonalis.llm import license_scan as L
from zonalis.llm import pii_surrogates as P
from zonalis.llm import unit_dedup as U

MAKE = P.Surrogates(b"a test's key")


def form(text):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", text)))


def replaced(text):
    return P.replace(text, MAKE, {})


@pytest.mark.parametrize("length", range(13, 20))
def test_cards_of_all_lengths(length):
    r = random.Random(length)
    for _ in range(50):
        body = "".join(r.choice(string.digits) for _ in range(length - 1))
        good = body + P.luhn_digit(body)
        for number in (good, body + str((int(good[-1]) + 1) % 10), "0" * length):
            new = MAKE.surrogate("card", number)
            assert form(new) == form(number) and new[0] == number[0]
            assert (P.luhn_digit(number[:-1]) == number[-1]) <= (P.luhn_digit(new[:-1]) == new[-1])
            out, spans = replaced(f"card {number} x")
            assert out != f"card {number} x" and form(out) == form(f"card {number} x") and spans[0]["kind"] == "card"


def some_iban(r, size, letters, valid):
    body = "".join(r.choice(string.digits + (string.ascii_uppercase if letters else "")) for _ in range(size))
    country = r.choice(["DE", "ES", "FR", "GB", "ZZ"])
    check = P.iban_check(country, body)
    return country + (check if valid else f"{(int(check) + 5) % 97:02d}") + body


@pytest.mark.parametrize("size", range(11, 31))
def test_account_numbers_stay_in_their_form(size):
    r = random.Random(size)
    for letters, valid in itertools.product((False, True), (False, True)):
        value = some_iban(r, size, letters, valid)
        new = MAKE.surrogate("iban", value)
        assert form(new) == form(value) and new[:2] == value[:2] and new != value
        if valid:
            assert int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1
        spaced = " ".join(value[k : k + 4] for k in range(0, len(value), 4))
        out, spans = replaced(f"pay {spaced}.")
        assert form(out) == form(f"pay {spaced}.")


def test_a_known_account_number():
    assert P.iban_check("DE", "370400440532013000") == "89" and P.iban_check("GB", "WEST12345698765432") == "82"


@pytest.mark.parametrize("length", range(8, 41))
def test_secrets_of_all_lengths(length):
    r = random.Random(length)
    for signs in (string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/_-"):
        value = "".join(r.choice(signs) for _ in range(length))
        out, spans = replaced(f"token={value} end")
        new = out[len("token=") : -len(" end")]
        assert len(new) == length
        if signs == "0123456789abcdef" and length >= 16 and re.search("[a-f]", value):
            assert set(new) <= set(signs)
        else:
            assert form(new) == form(value)


def test_other_digits_are_no_crash():
    for text in ("DE٣٣ ABCD EFGH IJKL", "+٤٤ 123 456 7890", "٣".join(["4123"] * 5), "card ４１２３４５６７８９０１２３４５", "İ@x.org and İx.İ@a.com", "DE33 ABCD EFGH IJKL"):
        replaced(text)
    assert replaced("DE٣٣ ABCD EFGH IJKL")[1] == []


def test_surrogates_are_distinct_over_a_form():
    values = [f"{k:08d}" for k in range(3000)]
    assert len({MAKE.shaped(v, "t") for v in values}) == 3000
    hexes = [f"{k:015x}a" for k in range(3000)]
    assert len({MAKE.surrogate("secret", v) for v in hexes}) == 3000


def test_words_that_are_names_too():
    out, spans = replaced("Mr. Will Smith came. Will you go? Smith said so, and Will Smith too.")
    assert "Will you go?" in out and "Smith" not in out and len(spans) == 5
    out, _ = replaced("Mrs. May Jones came in May. Jones left.")
    assert "in May." in out and "Jones" not in out


# Licences


def some_expression(r, depth):
    """(text, tree) with trees of (op, a, b) and identifiers."""
    names = ["mit", "apache-2.0", "gpl-3.0-only", "gpl-2.0+", "bsd-3-clause", "cc-by-4.0", "cc-by-nc-4.0", "bsl-1.0", "cc0-1.0", "hippocratic-2.1", "mit-hello", "unicode-dfs-2016", "x9"]
    if depth == 0 or r.random() < 0.2:
        name = r.choice(names)
        return name, name
    op = r.choice(["and", "or", "with"])
    if op == "with":
        name = r.choice(names)
        return f"{name} with some-exception", name
    (a, x), (b, y) = some_expression(r, depth - 1), some_expression(r, depth - 1)
    return f"({a}) {op} ({b})", (op, x, y)


FAMILY = {"mit": "mit", "apache-2.0": "apache", "gpl-3.0-only": "gpl", "gpl-2.0+": "gpl", "bsd-3-clause": "bsd", "cc-by-4.0": "cc-by", "cc-by-nc-4.0": "cc-by-nc", "bsl-1.0": "bsl", "cc0-1.0": "cc0", "unicode-dfs-2016": "unicode-dfs-2016"}


def plain(tree, allowed):
    if isinstance(tree, str):
        kind = FAMILY.get(tree, "unknown")
        return kind in allowed, {kind}
    op, a, b = tree
    (x, s), (y, t) = plain(a, allowed), plain(b, allowed)
    return (x and y if op == "and" else x or y), s | t


@pytest.mark.parametrize("seed", range(200))
def test_generated_expressions(seed):
    r = random.Random(seed)
    text, tree = some_expression(r, r.randint(0, 5))
    allowed = frozenset(r.sample(["mit", "apache", "gpl", "bsd", "cc-by", "cc-by-nc", "bsl", "cc0", "unicode-dfs-2016", "unknown"], 5))
    ok, families = plain(tree, allowed - {"unknown"})
    row = L.Scanner(allowed).scan(f"x\nSPDX-License-Identifier: {text.upper()}\nmore".encode())
    assert (row[8], set(row[5].split(","))) == (ok, families) and row[6] == 1.0


@pytest.mark.parametrize(
    ("text", "permitted", "labels"),
    [
        ("MIT AND Hippocratic-2.1", False, "mit,unknown"), ("MIT OR Hippocratic-2.1", True, "mit,unknown"), ("MIT-hello", False, "unknown"), ("Unicode-DFS-2016", False, "unicode-dfs-2016"), ("python is great", None, ""),
        ("LicenseRef-mine AND MIT", False, "licenseref-mine,mit"), ("DocumentRef-a:LicenseRef-b", False, "documentref-a:licenseref-b"), ("GPL-2.0-only WITH Classpath-exception-2.0", False, "gpl"), ("MIT and everyone", True, "mit"),
    ],
)
def test_whole_identifiers(text, permitted, labels):
    row = L.Scanner().scan(f"SPDX-License-Identifier: {text}".encode())
    assert (row[8], row[5], row[6]) == (permitted, labels, 0.0 if permitted is None else 1.0)


def test_long_expressions_take_linear_time():
    text = "spdx-license-identifier: " + " or ".join(["gpl-2.0-only", "mit"] * 50_000)
    began = time.perf_counter()
    row = L.Scanner().scan(text.encode())
    assert row[8] is True and row[7].count("gpl-2.0-only") == 50_000 and time.perf_counter() - began < 5


# Passages


def plain_passages(rows, min_words):
    """Repeats by units of each text and a search through all of them, as a list."""
    units = sorted({(i, *u) for i, t in rows if i is not None for u in U.passage_units(t or "", min_words)})
    groups = {}
    for doc, start, size, words, digest in units:
        groups.setdefault(digest, []).append((doc, start, size, words))
    out = set()
    for places in groups.values():
        doc, start, size, _ = min(places)
        out |= {(d, s, n, w, doc, start) for d, s, n, w in places if d != doc or s >= start + size}
    return sorted(out)


def test_passages_of_rows_given_twice(spark):
    text = "One sentence of six or more words. Another one.\n\nA paragraph of its own, of so many words."
    rows = [(1, text), (2, text), (2, text), (3, f"Before.\n{text}"), (None, text), (4, None), (5, "")]
    got = [tuple(r) for r in U.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got) == plain_passages(rows, U.MIN_WORDS) and len(got) == len(set(got)) > 3


def test_passages_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = [tuple(r) for r in U.repeated_passages(spark, docs).collect()]
    assert sorted(got) == plain_passages([(r.doc_id, r.text) for r in docs.collect()], U.MIN_WORDS)


# Benchmark items


def test_items_in_blocks_and_given_twice(spark):
    from zonalis.llm import decontaminate as D

    words = [f"word{k}" for k in range(400)]
    texts = {k: " ".join(words[20 * k : 20 * k + 20]) for k in range(20)}
    items = spark.createDataFrame([(k, t) for k, t in texts.items() for _ in range(2)] + [(50, texts[3]), (None, texts[4]), (51, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {texts[3]} y {texts[7]}"), (2, "clean"), (None, texts[5]), (4, None), (5, texts[19]), (5, texts[19])], "doc_id long, text string")
    whole = sorted(map(str, D.contaminated(spark, docs, items).collect()))
    assert sorted(map(str, D.contaminated(spark, docs, items, block_chars=300).collect())) == whole
    assert [(r.doc_id, r.item_id) for r in D.contaminated(spark, docs, items, block_chars=300).orderBy("doc_id", "item_id").collect()] == [(None, 5), (1, 3), (1, 7), (1, 50), (5, 19), (5, 19)]
    for size in (300, 10**6):
        assert sorted(str(r.doc_id) for r in D.drop_contaminated(spark, docs, items, block_chars=size).collect()) == ["2", "4"]
