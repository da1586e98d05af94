"""Quality classifier by Bradley-Terry ranking.

A text's score is a weighted sum of its features. The weights are learned from preference pairs (a text of label 1 is
preferred to one of label 0) by logistic loss on the difference of their features; a quantile of the scores, at the share
of label 0, then parts the two classes. All labelled rows take part in weights and quantile, dealt by a hash to blocks in
which the pairs are formed. Sums over blocks are of whole numbers: how Spark deals the rows out changes nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.common import ASCII_SPACE, Scratch, id_bitmap, id_hash, in_bitmap, keyed_text, remainder, slices, small_batches

#: Preferred texts that each text of label 0 is paired with; more, where else some text of label 1 would have no pair.
PAIRS = 16
L2 = 1e-3
#: Newton steps at most; they end where the gradient is below LEAST_SLOPE.
STEPS, LEAST_SLOPE = 100, 1e-8
#: Rows of the larger class in a block, about, and of the smaller one at least: where it has fewer, its rows are in several blocks.
BLOCK_ROWS, LEAST_ROWS = 512, 32
#: Parts that an interval of scores is cut into on the way to a quantile.
BINS = 4096

SYMBOLS = b"#*$%&|<>"
FEATURES = (
    "log_words", "word_length", "symbols", "pipes", "upper", "digits", "bangs", "stops", "commas", "other_marks",
    "non_ascii", "distinct_words", "same_as_last", "repeated_lines", "top_word", "squeezed",
)


def features(text: bytes) -> list[float]:
    """Features of the whole text; all zero without words."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip(ASCII_SPACE)]
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    marks = int(count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum())
    return [
        np.log(n),
        min(20.0, size / n),
        sum(int(count[c]) for c in SYMBOLS) / n,
        int(count[124]) / n,
        int(count[65:91].sum()) / letters,
        int(count[48:58].sum()) / size,
        int(count[33]) / n,
        int(count[46]) / n,
        int(count[44]) / n,
        marks / n,
        int(count[128:].sum()) / size,
        len(counts) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / len(lines),
        max(counts.values()) / n,
        len(zlib.compress(text, 1)) / size,
    ]


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    slope: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        """Bradley-Terry scores of rows of features, the same bits in whatever batch a row comes."""
        return (np.tanh((x - self.mean) / self.scale / 3) * self.weights).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; 0.5 at the threshold."""
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.worth(x) - self.threshold), -30, 30)))


def _gaps(x: np.ndarray, y: np.ndarray, mean: np.ndarray, scale: np.ndarray, pairs: int) -> np.ndarray:
    """Differences of the pairs' features: each row of label 0 meets ``pairs`` rows of label 1 in turn, or as many as it takes for all of these to be met."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros((0, x.shape[1]))
    z = np.tanh((x - mean) / scale / 3)
    each = max(pairs, -(-len(good) // len(bad)))
    stride = 7919 if len(good) % 7919 else 1
    won = good[(np.arange(len(bad) * each) * stride) % len(good)]
    return z[won] - z[np.repeat(bad, each)]


def _derivatives(gap: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Number of pairs, sum of their losses, its gradient and its second derivatives, in a row."""
    margin = gap @ weights
    p = 1 / (1 + np.exp(np.clip(margin, -700, 700)))
    return np.concatenate([[len(gap), np.logaddexp(0, -margin).sum()], -(gap * p[:, None]).sum(0), ((gap * (p * (1 - p))[:, None]).T @ gap).ravel()])


def _least(sums: Callable[[np.ndarray], np.ndarray], n: int, l2: float, steps: int) -> np.ndarray:
    """Weights of least mean loss, by Newton's steps, halved where the loss would grow."""

    def at(weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = sums(weights)
        return s[1] / s[0] + l2 / 2 * float(weights @ weights), s[2 : 2 + n] / s[0] + l2 * weights, s[2 + n :].reshape(n, n) / s[0] + l2 * np.eye(n)

    weights = np.zeros(n)
    value, slope, curve = at(weights)
    for _ in range(steps):
        if np.abs(slope).max() < LEAST_SLOPE:
            break
        way, length = np.linalg.solve(curve, slope), 1.0
        while length > 1e-6:
            there = weights - length * way
            found = at(there)
            if found[0] <= value - 1e-4 * length * float(slope @ way):
                break
            length /= 2
        else:
            break  # no step makes the loss less: it is as small as doubles tell
        weights, (value, slope, curve) = there, found
    return weights


def _one_class(mean: np.ndarray, scale: np.ndarray, good: bool) -> Ranking:
    return Ranking(mean, scale, np.zeros(len(FEATURES)), -1.0 if good else 1.0, 0.1)


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, l2: float = L2, steps: int = STEPS) -> Ranking:
    """Fit on rows of features ``x`` with labels ``y`` in memory, as one block; ``fit_ranking`` does the same for tables.

    With one class missing the scores are constant, 0.5 and a little on the side of the class that is there.
    """
    mean, scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    bad = int((y == 0).sum())
    if bad in (0, len(y)):
        return _one_class(mean, scale, bad < len(y))
    gap = _gaps(x, y, mean, scale, pairs)
    made = Ranking(mean, scale, _least(lambda w: _derivatives(gap, w), x.shape[1], l2, steps), 0.0, 1.0)
    worth = np.sort(made.worth(x))
    return Ranking(mean, scale, made.weights, float((worth[bad - 1] + worth[bad]) / 2), 1.0)


def _known_features(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, label, x) of the rows of ``docs`` (doc_id, text) whose id is in ``known`` (doc_id, label); x are the features' bytes.

    A bitmap leaves out most other rows before their features are computed; the join then is exact, and no text is shuffled.
    """
    bits = docs.sparkSession.sparkContext.broadcast(id_bitmap(known, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices([whole.filter(pa.array(in_bitmap(bits.value, whole.column(2))))]):
                x = [np.array(features((t or "").encode())).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.binary())], names=["doc_id", "x"])

    return docs.withColumn("place", id_hash(F.col("doc_id"))).mapInArrow(run, "doc_id long, x binary").join(known, "doc_id").select("doc_id", "label", "x")


def _blocks(rows: DataFrame, count: dict[int, int]) -> DataFrame:
    """(data): blocks of ``rows``, each a matrix of label, 1 for a row's own block (0 for a further one) and features.

    Rows go to blocks by a hash of id, features and their number among equal rows. A class of fewer than LEAST_ROWS rows a
    block has each of its rows in as many blocks, evenly, as make up for it.
    """
    n = max(1, max(count.values()) // BLOCK_ROWS)
    places = F.lit(1)
    for label, rows_of in count.items():
        places = F.when(F.col("label") == label, min(n, -(-LEAST_ROWS * n // rows_of))).otherwise(places)
    single = rows.groupBy("doc_id", "label", "x").count().select("label", "x", "doc_id", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    dealt = single.withColumn("key", F.xxhash64("doc_id", "x", "copy")).withColumn("places", places).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
    dealt = dealt.withColumn("block", F.pmod(F.pmod("key", F.lit(n)) + F.col("k") * F.floor(F.lit(n) / F.col("places")), F.lit(n)))

    def run(table: pa.Table) -> pa.Table:
        found = sorted(zip(*(table.column(c).to_pylist() for c in ("label", "key", "x", "k")), strict=True))
        x = np.frombuffer(b"".join(r[2] for r in found)).reshape(len(found), -1)
        data = np.column_stack([[r[0] for r in found], [r[3] == 0 for r in found], x])
        return pa.table({"data": pa.array([data.tobytes()], pa.binary())})

    return dealt.select("label", "key", "x", "k", "block").groupBy("block").applyInArrow(run, "data binary")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            yield np.frombuffer(data).reshape(-1, len(FEATURES) + 2)


#: Sums over blocks are of multiples of this.
GRAIN = 2.0**-40


def _summed(blocks: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(matrix)`` over the blocks, each value rounded to GRAIN and then added exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for matrix in _matrices(batches):
            add = [round(v / GRAIN) for v in of(matrix).tolist()]
            total = add if total is None else [a + b for a, b in zip(total, add, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["at", "value"])

    sums = blocks.mapInArrow(run, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.array([float(r["value"]) * GRAIN for r in sorted(sums)])


def _neighbours(worths: DataFrame, rank: int) -> tuple[float, float]:
    """The ``rank``-th smallest value of the column ``worth`` and the next one (from 1), exactly; the driver gets at most BINS rows a round."""
    (least, most), before = worths.agg(F.min("worth"), F.max("worth")).first(), 0
    while least < most:
        inside = worths.filter(F.col("worth").between(least, most))
        place = F.least(F.lit(BINS - 1), F.floor((F.col("worth") - least) / (most - least) * BINS))
        found = inside.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min("worth").alias("least"), F.max("worth").alias("most")).orderBy("place").collect()
        at = 0
        while before + found[at].n < rank:
            before, at = before + found[at].n, at + 1
        if before + found[at].n == rank:
            return found[at].most, found[at + 1].least
        least, most = found[at].least, found[at].most
    return least, least


def fit_ranking(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", pairs: int = PAIRS, l2: float = L2, steps: int = STEPS) -> Ranking:
    """Learn from ``labels.quality`` of all documents whose crc32(id) mod ``modulus`` is not ``held_out``.

    Features are computed once and kept in the shared folder; a Newton step is a pass over them, of which the driver gets sums. Null ids and
    other labels are left out, an id with several labels counts with the largest, rows of one id count each, null texts as empty.
    """
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull()).filter(remainder("doc_id", modulus) != held_out).groupBy("doc_id").agg(F.max("label").alias("label")).filter("label in (0, 1)")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(_known_features(keyed_text(docs, id_col, text_col), known), "features")
    count = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not count:
        scratch.drop("features")
        return _one_class(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), False)
    blocks = small_batches(scratch.table(_blocks(rows, count), "blocks"))
    own = lambda m: m[m[:, 1] == 1, 2:]
    total, d = sum(count.values()), len(FEATURES)
    mean = _summed(blocks, lambda m: own(m).sum(0)) / total
    scale = np.sqrt(_summed(blocks, lambda m: ((own(m) - mean) ** 2).sum(0)) / total) + 1e-6
    if len(count) < 2:
        scratch.drop("features", "blocks")
        return _one_class(mean, scale, 1 in count)
    weights = _least(lambda w: _summed(blocks, lambda m: _derivatives(_gaps(m[:, 2:], m[:, 0], mean, scale, pairs), w)), d, l2, steps)
    made = Ranking(mean, scale, weights, 0.0, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _matrices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(made.worth(own(m)))], names=["worth"])

    below, above = _neighbours(scratch.table(blocks.mapInArrow(run, "worth double"), "worths"), count[0])
    scratch.drop("features", "blocks", "worths")
    return Ranking(mean, scale, weights, (below + above) / 2, 1.0)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, worth double"


def rank_quality(spark: SparkSession, docs: DataFrame, ranking: Ranking, modulus: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, worth) for every row of ``docs``.

    ``worth`` is the Bradley-Terry score, ``score`` its logistic distance from the threshold. Null texts count as empty
    and get the score of all-zero features; a null id is never held out.
    """
    shared = spark.sparkContext.broadcast(ranking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = np.array([features((t or "").encode()) for t in part.column(1).to_pylist()]).reshape(part.num_rows, len(FEATURES))
            score = shared.value.score(x)
            ids = part.column(0).to_pylist()
            out = [i is not None and zlib.crc32(str(i).encode()) % modulus == held_out for i in ids]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(out, pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(shared.value.worth(x))],
                names=["doc_id", "held_out", "score", "predicted", "worth"],
            )

    return keyed_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)
