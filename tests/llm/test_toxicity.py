"""Toxicity: features and wording against plain loops, and held-out recall and precision of the labelled documents."""

import math
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard

from zonalis.llm import compression_toxicity as C


def plain_features(text, distances):
    """Each window compressed by a compressor of its own."""
    rules = zstandard.ZstdCompressionParameters.from_level(C.LEVEL, min_match=C.MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)

    def size(content, window):
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=rules)
        return len(zstandard.ZstdCompressor(dict_data=words, compression_params=rules).compress(window))

    starts, at = [0], 0
    while at + C.WINDOW_BYTES < len(text):
        at += C.STRIDE
        starts.append(at)
    saved = [size(distances.ordinary, text[a : a + C.WINDOW_BYTES]) - size(distances.toxic + distances.ordinary, text[a : a + C.WINDOW_BYTES]) for a in starts]
    hits = [sum(min(max(s, 0), C.SAVINGS) == k for s in saved) for k in range(1, C.SAVINGS + 1)]
    return [*(math.log1p(h * 20 / len(saved)) for h in hits), *(min(h, 3) for h in hits), min(max(saved), C.SAVINGS), sum(saved) / len(saved), math.log(len(saved))]


@pytest.mark.parametrize("size", [0, 1, 30, 47, 48, 49, 72, 73, 500])
def test_features_of_all_windows(size):
    distances = C.Distances(b"the ordinary words of every day and more of them " * 5, b" scoundrel rascal knave ")
    text = C.plain(("an ordinary day and a scoundrel came by with words " * 20)[:size])
    assert np.allclose(C.distance_features(text, distances.compressors()), plain_features(text, distances))


def plain_marked(texts, toxic, least):
    seen = {True: defaultdict(set), False: defaultdict(set)}
    for t, y in zip(texts, toxic, strict=True):
        words = [b"", *t.split(), b""]
        for w in set(words[1:-1]):
            k = words.index(w, 1)
            seen[y][w].add((words[k - 1], words[k + 1]))
    total = [sum(map(len, seen[y].values())) for y in (True, False)]
    share, out = total[0] / sum(total), []
    for w, places in seen[True].items():
        a, b = len(places), len(seen[False][w]) if w in seen[False] else 0
        k = a / (a + b)
        if a >= least and k > share:
            tail = a * math.log(k / share) + (b * math.log((1 - k) / (1 - share)) if b else 0)
            if tail >= math.log(len(seen[True])):
                out.append((a, w))
    return [w for _, w in sorted(out)]


def test_wording_is_what_chance_does_not_explain():
    r = np.random.default_rng(1)
    words = [b"w%d" % k for k in range(60)]
    texts = [b" ".join(r.choice(words, 30)) for _ in range(300)]
    toxic = [k % 10 == 0 for k in range(300)]
    texts = [t + b" rascal " + t.split()[k % 7] if y and k % 20 == 0 else t for k, (t, y) in enumerate(zip(texts, toxic, strict=True))]
    copies = [b"a passage of a slur that many texts share"] * 40  # copies count once
    texts, toxic = texts + copies, toxic + [True] * 40
    wording = C.Wording(texts, toxic)
    assert wording.marked(np.arange(len(texts))) == plain_marked(texts, toxic, C.LEAST_SEEN) == [b"rascal"]
    some = np.arange(0, len(texts), 2)
    assert wording.marked(some) == plain_marked([texts[k] for k in some], [toxic[k] for k in some], C.LEAST_SEEN)


def test_degenerate_samples():
    for texts, toxic, score in (([], [], 0.0), ([b" a "], [True], 1.0), ([b" a ", b" b "], [False, False], 0.0)):
        model = C.fit_texts(texts, toxic)
        x = C.distance_features(C.plain("any text at all"), model.distances.compressors())
        assert round(float(model.score(x[None])[0])) == score
    model = C.fit_texts([b"  ", b" x ", b" y "], [True, False, False])
    assert np.isfinite(model.score(C.distance_features(b"  ", model.distances.compressors())[None])).all()


def test_held_out_recall_and_precision(spark, sf_dir):
    """Of the labelled documents whose labels weren't learnt, in all languages."""
    larger = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.1")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    model = C.fit_toxicity(docs, labels)
    label = {r.doc_id: r.toxic for r in labels.filter("toxic is not null").collect()}
    rows = [(r.predicted, label[r.doc_id]) for r in C.score_toxicity(spark, docs.filter("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), model).collect() if r.held_out and r.doc_id in label]
    hits = sum(p and y for p, y in rows)
    assert sum(y for _, y in rows) >= 100
    assert hits / sum(y for _, y in rows) >= 0.85 and hits / sum(p for p, _ in rows) >= 0.85


def test_held_out_is_by_the_id(spark):
    table = spark.createDataFrame([(k, "x") for k in range(20)] + [(None, "x")], "doc_id long, text string")
    rows = C.score_toxicity(spark, table, C.fit_texts([], [])).collect()
    assert {r.doc_id: r.held_out for r in rows} == {k: k is not None and zlib.crc32(str(k).encode()) % 4 == 2 for k in [*range(20), None]}
