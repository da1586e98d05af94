"""Quality rules: counts of a text, and a log-likelihood ratio of hashed n-grams between trusted text and the raw corpus.

Byte n-grams are hashed into a fixed number of buckets. Two multinomials over the buckets are estimated: one from trusted
documents, one from all documents. A text's score is the mean log ratio of its n-grams, in fixed point, so that it is
the same however rows are dealt out; every document at or above the threshold passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.common import ASCII_SPACE, Scratch, id_bitmap, id_hash, in_bitmap, keyed_text, slices, small_batches

NGRAM = 4
BUCKETS = 1 << 16
#: Pseudo-count of every bucket, in both multinomials.
SMOOTHING = 0.5
#: A document passes if its mean log ratio is this or more.
MIN_RATIO = -0.5
#: Bytes of text whose n-grams are hashed at a time.
BLOCK_BYTES = 1 << 20
#: Log ratios are whole multiples of this.
UNIT = 2.0**-16

MIN_WORDS = 20
REPEAT_WINDOW = 8
#: A document fails if more than so many of 100 words stand in repeated windows.
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"


def ngram_buckets(text: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """The bucket of each n-gram of ``text`` (uint8)."""
    size = len(text) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(size, np.uint64)
    for k in range(n):
        h <<= np.uint64(8)
        h |= text[k : k + size]
    h *= np.uint64(0x9E3779B97F4A7C15)
    h >>= np.uint64(64 - (buckets.bit_length() - 1))
    return h.view(np.int64)


def text_blocks(text: bytes, n: int) -> Iterator[np.ndarray]:
    """A text in blocks that overlap by n - 1 bytes: each n-gram stands in one block."""
    for at in range(0, max(1, len(text) - n + 1), BLOCK_BYTES):
        yield np.frombuffer(text[at : at + BLOCK_BYTES + n - 1], np.uint8)


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that stand in a window of ``window`` words found twice or more, the first finding included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    if len(names) == len(words):
        return 0
    # A window's name is exact: the pair of the names of its halves, again and again.
    size = 1
    while size < window:
        step = min(size, window - size)
        _, ids = np.unique(ids[: len(ids) - step] * (len(words) + 1) + ids[step:], return_inverse=True)
        size += step
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    edge[at] += 1
    edge[at + window] -= 1
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def repeated_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line.strip(ASCII_SPACE):
            n += line in seen
            seen.add(line)
    return n


def base_rules(text: bytes) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = text.split()
    solid = np.frombuffer(text.translate(None, ASCII_SPACE), np.uint8)
    chars = int(np.count_nonzero((solid & 0xC0) != 0x80))
    repeats = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * len(words)
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), repeated_lines(text), repeats, failed


@dataclass(frozen=True)
class RatioModel:
    """Log ratios of the buckets in multiples of UNIT, and the least mean that passes."""

    ratios: np.ndarray
    n: int
    threshold: float

    def total(self, text: bytes) -> tuple[int, int]:
        """The sum of the n-grams' ratios and their number."""
        total = number = 0
        for block in text_blocks(text, self.n):
            h = ngram_buckets(block, self.n, len(self.ratios))
            total, number = total + int(self.ratios[h].sum()), number + len(h)
        return total, number

    def score(self, text: bytes) -> float | None:
        total, number = self.total(text)
        return total * UNIT / number if number else None


def _gathered(arrays: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The arrays end to end, in pieces of about BLOCK_BYTES items."""
    held, size = [], 0
    for a in arrays:
        held.append(a)
        size += len(a)
        if size >= BLOCK_BYTES:
            yield np.concatenate(held)
            held, size = [], 0
    if size:
        yield np.concatenate(held)


def fit_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = NGRAM, buckets: int = BUCKETS, threshold: float = MIN_RATIO) -> RatioModel:
    """Count the n-grams of all documents, and of all trusted ones (label ``quality`` 1).

    An id with several label rows counts once, with its largest label. Documents are flagged by a
    bitmap of the trusted ids; those that it takes for trusted ones and that an equality join on ids says are not have
    their texts counted once more, to be taken off. A task adds its counts up before
    the last shuffle, which gets at most ``buckets`` rows a task; the driver gets ``buckets`` rows. With no trusted document
    all ratios are zero, and every document passes.
    """
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    trusted = known.filter("label = 1").select("doc_id", F.lit(1).alias("trusted"))
    texts = keyed_text(docs, id_col, text_col).withColumn("place", id_hash(F.col("doc_id")))
    scratch = Scratch(docs.sparkSession)
    bits = docs.sparkSession.sparkContext.broadcast(id_bitmap(trusted, "doc_id"))

    def flagged(part: pa.RecordBatch, id_at: int = 0, place_at: int = 2) -> np.ndarray:
        return in_bitmap(bits.value, part.column(place_at)) & np.asarray(part.column(id_at).is_valid())

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            yield part.filter(pa.array(flagged(part, 0, 1))).select([0])

    def counted(flag, sign: int):
        """Adds up n-grams, as raw ones if ``sign`` is 1, and with ``sign`` as target ones where ``flag`` says so."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((2, buckets), np.int64)
            for part in slices(batches):
                chosen = flag(part)
                for own in (False, True):
                    texts = [(t or "").encode() for t, f in zip(part.column(1).to_pylist(), chosen.tolist(), strict=True) if f == own]
                    for found in _gathered((ngram_buckets(b, n, buckets) for t in texts for b in text_blocks(t, n))):
                        add = np.bincount(found, minlength=buckets)
                        counts[0] += add if sign > 0 else 0
                        counts[1] += sign * add if own else 0
            at = np.flatnonzero(counts.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0][at]), pa.array(counts[1][at])], names=["bucket", "raw", "target"])

        return run

    sums = "bucket long, raw long, target long"
    counts = texts.mapInArrow(counted(flagged, 1), sums)
    # documents that the bitmap takes for trusted ones: few, so only their texts are shuffled, and their counts taken off again
    wrong = scratch.table(texts.select("doc_id", "place").mapInArrow(passing, "doc_id long").join(trusted, "doc_id", "left_anti"), "wrong")
    if not wrong.isEmpty():
        suspects = docs.sparkSession.sparkContext.broadcast(id_bitmap(wrong, "doc_id"))

        def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                yield part.filter(pa.array(in_bitmap(suspects.value, part.column(2)) & flagged(part)))

        again = texts.mapInArrow(suspected, "doc_id long, text string, place long").join(trusted.select(F.col("doc_id").alias("own")), F.col("doc_id") == F.col("own"), "left_anti")
        counts = counts.unionByName(again.mapInArrow(counted(lambda part: np.ones(part.num_rows, bool), -1), sums))
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    scratch.drop("wrong")
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[rows["bucket"]], target[rows["bucket"]] = rows["raw"], rows["target"]
    if not target.any():
        return RatioModel(np.zeros(buckets, np.int64), n, threshold)
    ratios = np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * buckets)) - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * buckets))
    return RatioModel(np.rint(ratios / UNIT).astype(np.int64), n, threshold)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, log_ratio double"
_TYPES = (*[pa.int64()] * 5, pa.bool_(), pa.bool_(), pa.float64())


def verdict(text: bytes, model: RatioModel) -> tuple:
    rules = base_rules(text)
    score = model.score(text)
    return *rules, not rules[-1] and (score is None or score >= model.threshold), score


def quality_rules(spark: SparkSession, docs: DataFrame, model: RatioModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its counts, whether the base rules fail it, its mean log ratio, and the verdict.

    Null texts count as empty: no words, so the base rules fail them; their ratio is null.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [verdict((t or "").encode(), shared.value) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def keep_good(spark: SparkSession, docs: DataFrame, model: RatioModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns; nothing is shuffled.

    A row is judged by its text alone: null and empty texts go, null ids and repeated rows are judged like others.
    """
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(at).to_pylist()
            yield part.filter(pa.array([verdict((t or "").encode(), shared.value)[6] for t in texts], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
