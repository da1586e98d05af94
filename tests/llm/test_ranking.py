"""Quality ranking: features, loss and threshold against plain forms."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from zonalis.llm import quality_ranking as R


def plain_features(text):
    raw = text.encode()
    words = [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", text) if w]
    if not words:
        return [0.0] * 16
    n, size = len(words), len(raw)
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    each = lambda pattern: len(re.findall(pattern, text))
    return [
        math.log(n), min(20.0, size / n), each(r"[#*$%&|<>]") / n, text.count("|") / n, upper / max(1, upper + lower), each("[0-9]") / size, text.count("!") / n, text.count(".") / n, text.count(",") / n,
        each(r"[!-/:-@\[-`{-~]") / n, sum(b >= 128 for b in raw) / size, len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(set(lines)) / len(lines), max(Counter(words).values()) / n, len(zlib.compress(raw, 1)) / size,  # noqa: B905
    ]


@pytest.mark.parametrize("text", ["", " \n", "a", "One, two! Three.\nOne, two! Three.\n\n|x| 12% é~ a a a", "ÄÖ ß " * 30, "A\x0bB\x0cC\rD", "x" * 5000])
def test_features(text):
    assert np.allclose(R.features(text.encode()), plain_features(text))


def test_features_of_random_texts():
    r = random.Random(3)
    for _ in range(100):
        text = "".join(r.choice("aB 9,.!|#\n\té~`@[") for _ in range(r.randrange(300)))
        assert np.allclose(R.features(text.encode()), plain_features(text))


def loss(weights, gaps):
    return sum(math.log1p(math.exp(-float(g @ weights))) for g in gaps) / len(gaps) + R.L2 / 2 * float(weights @ weights)


def test_weights_make_the_pairs_loss_least():
    rng = np.random.default_rng(5)
    y = (np.arange(120) % 3 > 0).astype(float)
    x = rng.normal(size=(120, 16)) + 0.8 * y[:, None] * (np.arange(16) < 5)
    made = R.fit_pairs(x, y, pairs=3)
    z = np.tanh((x - x.mean(0)) / (x.std(0) + 1e-6) / 3)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    gaps = [z[good[(k * 7919) % len(good)]] - z[bad[k // 3]] for k in range(3 * len(bad))]
    best = loss(made.weights, gaps)
    assert best < 0.7 * loss(np.zeros(16), gaps)
    for _ in range(200):
        assert loss(made.weights + rng.normal(size=16) * rng.choice([0.01, 0.1, 1.0]), gaps) >= best - 1e-4
    # as many rows lie under the threshold as have label 0
    assert int((made.worth(x) < made.threshold).sum()) == len(bad)
    assert np.allclose(made.worth(x), z @ made.weights) and np.all((made.score(x) >= 0.5) == (made.worth(x) >= made.threshold))
