"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled texts: one on ordinary text, one on toxic wording. A text is cut into overlapping
windows; each is compressed once with the ordinary dictionary and once with the toxic one before the ordinary one, so that both know
ordinary text alike. The bytes that the toxic wording saves are the window's distance, and a logistic function, calibrated on
documents whose toxic texts the dictionary hasn't seen, turns the distances of a document into its score.

Most of a toxic text is ordinary prose. Its wording is the words that stand in toxic texts more than chance allows among all words of the
sample, each counted once for each pair of neighbours that it has, so that copies and shared passages count once; all of them come
into the dictionary, rare ones like common ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.common import keyed_text, labelled_sample, remainder, slices

#: Dictionaries and calibration are fitted on at most so many labelled documents of a class, those with the smallest hashes
#: of their ids; longer texts than MAX_FIT_CHARS are left out of the fit.
TOXIC_ROWS, ORDINARY_ROWS = 3_000, 6_000
MAX_FIT_CHARS = 20_000
WINDOW_BYTES, STRIDE = 48, 24
#: Bytes of the dictionaries (the first is the library's own default), and of a sample that the ordinary one is trained on.
ORDINARY_DICT, TOXIC_DICT, SAMPLE_BYTES = 112_640, 8_192, 128
LEVEL, MIN_MATCH = 12, 5
#: Least number of different surroundings that a toxic word has been seen in.
LEAST_SEEN = 3
#: Parts of the sample: what calibrates is scored with the wording of the others.
FOLDS = 5
#: Savings of 1, 2, ... bytes that are counted apart.
SAVINGS = 12


def plain(text: str | None) -> bytes:
    """A-Z lower-cased, white space squeezed, a blank at both ends."""
    return b" " + b" ".join((text or "").encode().lower().split()) + b" "


class Wording:
    """The words of labelled texts with their surroundings; every text is read once, whatever the number of folds."""

    def __init__(self, texts: list[bytes], toxic: list[bool]):
        self.ids: dict[bytes, int] = {}
        self.toxic = np.array(toxic, bool)
        self.found = [self._words(t) for t in texts]

    def _words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The distinct words of a text, and a number for each with the words around its first place."""
        a = np.array([0, *(self.ids.setdefault(w, len(self.ids) + 1) for w in text.split()), 0], np.int64)
        words, at = np.unique(a[1:-1], return_index=True)
        with np.errstate(over="ignore"):
            around = (words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (a[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (a[at + 2].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return words, around

    def _seen(self, rows: np.ndarray) -> np.ndarray:
        """In how many different surroundings each word stands in some of the texts."""
        if not len(rows):
            return np.zeros(len(self.ids) + 1)
        words, around = (np.concatenate([self.found[r][k] for r in rows]) for k in (0, 1))
        _, first = np.unique(around, return_index=True)
        return np.bincount(words[first], minlength=len(self.ids) + 1).astype(float)

    def marked(self, rows: np.ndarray) -> list[bytes]:
        """Words that are in toxic texts more often than chance allows, the commonest last.

        By the bound of Chernoff on the binomial tail fewer than one of all words is expected here if no word told the classes apart.
        """
        a, b = self._seen(rows[self.toxic[rows]]), self._seen(rows[~self.toxic[rows]])
        n, share = a + b, max(a.sum(), 1e-9) / max(a.sum() + b.sum(), 1e-9)
        if share >= 1:
            return []
        k = np.clip(a / np.maximum(n, 1), 1e-12, 1 - 1e-12)
        chance = n * (k * np.log(k / share) + (1 - k) * np.log((1 - k) / (1 - share)))
        good = (a >= LEAST_SEEN) & (k > share) & (chance >= np.log(max(1, np.count_nonzero(a))))
        return sorted((w for w, i in self.ids.items() if good[i]), key=lambda w: (a[self.ids[w]], w))


def toxic_dictionary(words: list[bytes]) -> bytes:
    """The words, blanks between them; where they are too many, trained on them."""
    content = b" " + b" ".join(words) + b" "
    return content if len(content) <= TOXIC_DICT else train_dictionary([b" %b " % w for w in words], TOXIC_DICT)


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; where the samples are too few to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass(frozen=True)
class Distances:
    """Two dictionaries, and the compressors that a process makes of them."""

    ordinary: bytes
    toxic: bytes

    def compressors(self) -> tuple:
        rules = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
        out = []
        for content in (self.ordinary, self.toxic + self.ordinary):  # ordinary matches stay as near as they were
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=rules)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=rules).compress)
        return tuple(out)


def distance_features(text: bytes, compressors: tuple) -> np.ndarray:
    """Of all windows of a text: shares of windows by bytes saved, the largest saving, the mean one, and the length."""
    ordinary, toxic = compressors
    windows = (text[a : a + WINDOW_BYTES] for a in range(0, max(1, len(text) - WINDOW_BYTES + STRIDE), STRIDE))
    saved = [len(ordinary(w)) - len(toxic(w)) for w in windows]
    counts = np.bincount(np.clip(saved, 0, SAVINGS), minlength=SAVINGS + 1)[1:]
    n = len(saved)
    return np.array([*np.log1p(counts * 20 / n), *np.minimum(counts, 3), min(max(saved), SAVINGS), sum(saved) / n, np.log(n)], float)


@dataclass(frozen=True)
class ToxicityModel:
    distances: Distances
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.weights + self.bias, -30, 30)))


def calibrate(distances: Distances, x: np.ndarray, y: np.ndarray, l2: float = 0.01, steps: int = 40) -> ToxicityModel:
    """Logistic regression by Newton's method."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), l2 * len(x) / 100)
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return ToxicityModel(distances, mean, scale, w[:-1], float(w[-1]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learn from ``labels.toxic`` of documents whose crc32(id) mod ``modulus`` is not ``held_out``.

    The ids of the bounded sample are broadcast, and its distinct texts (each under MAX_FIT_CHARS) come to the driver. With a class missing
    all scores are those of the other class. Null and empty texts of the sample count as texts without words.
    """
    sample = labelled_sample(labels, "toxic", {0: ordinary_rows, 1: toxic_rows}, remainder("doc_id", modulus) != held_out, id_col)
    known = keyed_text(docs, id_col, text_col).filter(F.length("text") <= MAX_FIT_CHARS).join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("label").alias("label"))
    rows = sorted((plain(r.text), r.label) for r in known.collect())
    return fit_texts([t for t, _ in rows], [y == 1 for _, y in rows])


def fit_texts(texts: list[bytes], toxic: list[bool]) -> ToxicityModel:
    """The model of some normal texts: the wording of all for the dictionary, that of the other folds for each fold's calibration."""
    if all(toxic) or not any(toxic):
        zero = np.zeros(2 * SAVINGS + 3)
        return ToxicityModel(Distances(b" ", b" "), zero, zero + 1, zero, 3.0 if toxic and all(toxic) else -3.0)
    wording, flags = Wording(texts, toxic), np.array(toxic, bool)
    ordinary = train_dictionary([t[a : a + SAMPLE_BYTES] for t, y in zip(texts, toxic, strict=True) if not y for a in range(0, len(t), SAMPLE_BYTES)], ORDINARY_DICT)
    fold = np.zeros(len(texts), int)
    for y in (False, True):
        fold[flags == y] = np.arange(np.count_nonzero(flags == y)) % FOLDS
    x = np.zeros((len(texts), 2 * SAVINGS + 3))
    for f in range(FOLDS):
        own = Distances(ordinary, toxic_dictionary(wording.marked(np.flatnonzero(fold != f)))).compressors()
        for r in np.flatnonzero(fold == f):
            x[r] = distance_features(texts[r], own)
    return calibrate(Distances(ordinary, toxic_dictionary(wording.marked(np.arange(len(texts))))), x, flags.astype(float))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score_toxicity(spark: SparkSession, docs: DataFrame, model: ToxicityModel, cut: float = 0.3, modulus: int = 4, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; all windows of the whole text count.

    Null texts count as empty. A null id is never held out. One map, no shuffle; the model of fixed size is broadcast.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value.distances.compressors()
        for part in slices(batches):
            score = shared.value.score(np.array([distance_features(plain(t), own) for t in part.column(1).to_pylist()]))
            out = [i is not None and zlib.crc32(str(i).encode()) % modulus == held_out for i in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.bool_()), pa.array(score), pa.array((score >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
