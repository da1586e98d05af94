"""Quality ranking over whole tables: every labelled row counts, in whatever way the rows are dealt out."""

import random
import zlib

import numpy as np
import pytest

from zonalis.llm import quality_ranking as R


def training(i):
    return zlib.crc32(str(i).encode()) % 3 != 1


@pytest.fixture(scope="module")
def table():
    """20,000 texts, more of both classes than a sample of 6,000 a class would hold of one."""
    r = random.Random(11)
    rows = []
    for i in range(20_000):
        good = i % 4 > 0
        words = r.choices(["plain", "words", "of", "prose,", "and", "an", "end."] if good else ["BUY", "now!!", "|", "0.99", "plain", "end."], k=r.randrange(3, 9))
        rows.append((i, " ".join(words), int(good)))
    return rows


def frames(spark, rows, parts):
    return spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(parts), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int").repartition(parts)


def test_every_labelled_row_counts(spark, table):
    made = R.fit_ranking(*frames(spark, table, 3))
    x = np.array([R.features(t.encode()) for i, t, _ in table if training(i)])
    y = np.array([q for i, _, q in table if training(i)])
    assert len(y) > 12_000 and np.allclose(made.mean, x.mean(0)) and np.allclose(made.scale, x.std(0) + 1e-6)
    worth = np.sort(made.worth(x))
    bad = int((y == 0).sum())
    assert made.threshold == (worth[bad - 1] + worth[bad]) / 2
    assert np.abs(made.weights).max() > 0.1


def test_dealing_changes_nothing(spark, table):
    a, b = (R.fit_ranking(*frames(spark, rows, parts)) for rows, parts in ((table[:3000], 1), (table[2999::-1], 7)))
    assert (a.mean == b.mean).all() and (a.scale == b.scale).all() and (a.weights == b.weights).all() and a.threshold == b.threshold


def test_rare_class_and_repeated_rows(spark):
    rows = [(i, f"some plain words {i}", 1) for i in range(3000)] + [(9_000, "! ! |", 0)] * 5 + [(9_001, None, 1)]
    assert training(9_000)
    made = R.fit_ranking(*frames(spark, rows, 3))
    kept = [r for r in rows if training(r[0])]
    x = np.array([R.features((t or "").encode()) for _, t, _ in kept])
    assert np.allclose(made.mean, x.mean(0))
    assert int((made.worth(x) < made.threshold).sum()) == 5


@pytest.mark.parametrize("good, bad", [(1, 300), (300, 1), (7919, 3)])
def test_every_row_is_in_a_pair(good, bad):
    y = np.array([1] * good + [0] * bad)
    x = np.random.default_rng(2).normal(size=(good + bad, 16))
    gap = R._gaps(x, y, np.zeros(16), np.ones(16), 16)
    z = np.tanh(x / 3)
    each = len(gap) // bad
    assert len({g.tobytes() for g in np.round(gap + np.repeat(z[good:], each, 0), 9)}) == good


def test_neighbours_of_a_rank(spark):
    r = random.Random(5)
    for values in ([0.0], [2.5] * 9, [r.choice([0.1, 0.1 + 2**-55, 3.0, -4.0]) for _ in range(50)], [r.gauss(0, 1) for _ in range(500)] + [1e300, 5e-324]):
        df, ranked = spark.createDataFrame([(v,) for v in values], "worth double"), sorted(values)
        for k in {1, len(values) // 2, len(values) - 1} - {0, len(values)}:
            assert R._neighbours(df, k) == (ranked[k - 1], ranked[k])
