"""Periodic runs against a search of all periods."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest

from zonalis.llm import periodic_runs as P


def plain_runs(x):
    """(start, length, period) of all runs: for each period the stretches of equal words, and no smaller period."""
    n, out, known = len(x), [], []
    for q in range(1, n // 4 + 1):
        s = 0
        while s < n - q:
            e = s
            while e < n - q and x[e] == x[e + q]:
                e += 1
            if e + q - s >= max(6, 4 * q) and not any(q % d == 0 and a <= s and e + q <= b for a, b, d in known):
                out.append((s, e + q - s, q))
                known.append((s, e + q, q))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def found_runs(x):
    by = P.find_runs(np.array([*x, -1], np.int64), len(x))
    return sorted(((s, e - s, q) for q, spans in by.items() for s, e in spans), key=lambda r: (r[0], r[2]))


def some_words(r):
    """A text with runs of many periods, some of them within the period of others, over few or many words."""
    out, letters = [], r.choice([1, 2, 3, 50])
    while len(out) < 700:
        kind = r.random()
        root = [r.randrange(letters) for _ in range(r.choice([1, 2, 3, 7, 15, 16, 17, 24, 31, 32, 33, 40, 63, 64, 65, 100]))]
        if kind < 0.3:
            root = [root[0]] * len(root) + [9]
        elif kind < 0.4:
            root = root[:3] * 5 + root[:4] * 6 + [8]
        times = r.choice([1, 2, 4, 5])
        out += root * times + root[: r.randrange(len(root) + 1)]
        if r.random() < 0.3 and out:
            out[r.randrange(len(out))] = 77
    return out


@pytest.mark.parametrize("seed", range(60))
def test_all_runs_of_all_periods(seed):
    x = some_words(random.Random(seed))
    assert found_runs(x) == plain_runs(x)


@pytest.mark.parametrize("x", [[], [1], [1] * 5, [1] * 6, [1, 2] * 4, [1, 2, 1, 2, 1, 2, 1], [0] * 300, [0, 1, 1] * 100])
def test_small(x):
    assert found_runs(x) == plain_runs(x)


def test_thue_morse_and_fibonacci_words():
    t = [bin(k).count("1") % 2 for k in range(1024)]
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    for x in (t, b, t + t + t + t, [v for v in t[:64] for _ in range(9)]):
        assert found_runs(x) == plain_runs(x)


def plain_row(doc_id, text, planted):
    words = (text or "").encode().split()
    if planted and doc_id is not None and words:
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    start, length, period = best or (None, None, None)
    listing = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(runs), start, length, period, best and 1000 * length // period, sha256(listing.encode()).hexdigest(), sha256(kept).hexdigest()


def key(row):
    return tuple((v is not None, v) for v in row)


def test_rows_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) < 6000")
    want = [plain_row(d["doc_id"], d["text"], True) for d in docs.collect()]
    got = [tuple(r) for r in P.periodic_runs(docs, planted=True).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in got) > 5


def test_odd_rows(spark):
    rows = [(1, None), (None, "a " * 20), (2, ""), (3, " \x0b\x0c\r "), (4, "é é é é " * 9), (4, "é é é é " * 9), (5, "a b c d e " * 5), (11, "x y " * 40)]
    docs = spark.createDataFrame([(a, b, "t", 7) for a, b in rows], "doc_id long, text string, words string, start int")
    for planted in (False, True):
        got = [tuple(r) for r in P.periodic_runs(docs, planted=planted).collect()]
        assert sorted(got, key=key) == sorted((plain_row(a, b, planted) for a, b in rows), key=key)
    assert P.periodic_runs(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    period = [f"w{k}" for k in range(30_000)]
    text = " ".join(["start", *period * 5, "end"])
    row = P.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (1, 1, 150_000, 30_000, 5000)
    assert row.collapsed_sha256 == sha256(" ".join(["start", *period, "end"]).encode()).hexdigest()
