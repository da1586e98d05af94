"""Periodic stretches of words: found by minimizers at several scales, and their repeats taken out.

A run is a stretch of words with a smallest period q, of at least ``LEAST_LENGTH`` and ``LEAST_TIMES`` * q words, that no neighbouring word
extends. Periods under ``DIRECT`` are found by comparing the words with themselves at each lag. A scale of width w finds the periods
from w to 2w - 1: of the grams of w / 2 words that start in a window of w / 2 words the one with the least hash is kept. What is kept in
a window depends on that window's words only, so inside a run the kept grams repeat at the period, and pairs of equal kept grams
that are w to 2w - 1 words apart are the seeds; each is extended word by word both ways.

Nothing is missed: grams that lie in a run of a period up to g / 4 (g their length), known from the lags or a scale before, are not
kept; in a run of period w or more some gram of each period isn't of that kind, else the whole run would have the short
period. Equal grams that are not of that kind start more than g / 4 = w / 8 words apart, so there are fewer than 16 of them
within 2w words, and comparing each with the 16 next finds the pair at the period.

Documents are read by themselves, in slices of some words; a long document is a slice of its own. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from zonalis.llm.common import slices, utf8

#: A run's least number of words, and of times that its period fits.
LEAST_LENGTH, LEAST_TIMES = 6, 4
#: Periods below this are found by lags.
DIRECT = 16
#: Equal kept grams that a gram is compared with: the bound of the docstring above.
NEXT = 16
#: Words of a slice of documents that are scanned at once.
SLICE_WORDS = 1 << 18

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


class _Found:
    """Runs found so far, by period."""

    def __init__(self) -> None:
        self.by_period: dict[int, list[tuple[int, int]]] = {}

    def add(self, starts: np.ndarray, ends: np.ndarray, q: int) -> None:
        """Stretches of period ``q``, unless a shorter period that divides it has them already."""
        keep = ends - starts >= max(LEAST_LENGTH, LEAST_TIMES * q)
        fresh = [(int(s), int(e)) for s, e in zip(starts[keep], ends[keep], strict=True)]
        shorter = [d for d in self.by_period if d < q and q % d == 0]
        if fresh and shorter:
            known = [r for d in shorter for r in self.by_period[d]]
            fresh = [(s, e) for s, e in fresh if not any(a <= s and e <= b for a, b in known)]
        if fresh:
            self.by_period.setdefault(q, []).extend(fresh)

    def inside(self, n: int, gram: int) -> np.ndarray:
        """For each start of a gram whether the gram lies in a run of a period up to a quarter of it."""
        marks = np.zeros(n + 1, np.int64)
        for q, runs in self.by_period.items():
            if 4 * q <= gram:
                for s, e in runs:
                    if e - s >= gram:
                        marks[s] += 1
                        marks[e - gram + 1] -= 1
        return np.cumsum(marks)[:n] > 0


def _forward(x: np.ndarray, a: int, b: int) -> int:
    """How many words from a and from b (> a) on are equal, pair by pair."""
    n, size, k = len(x), 64, 0
    while b + k < n:
        size = min(2 * size, n - b - k)
        differ = x[a + k : a + k + size] != x[b + k : b + k + size]
        if differ.any():
            return k + int(differ.argmax())
        k += size
    return k


def _backward(x: np.ndarray, a: int, b: int) -> int:
    """How many words before a and before b (> a) are equal, pair by pair."""
    size, k = 64, 0
    while k < a:
        size = min(2 * size, a - k)
        differ = (x[a - k - size : a - k] != x[b - k - size : b - k])[::-1]
        if differ.any():
            return k + int(differ.argmax())
        k += size
    return k


def _kept(values: np.ndarray, usable: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the first least value of some window; windows are doubled, so a scale takes log2(window) passes."""
    at = np.arange(len(values))
    width = 1
    while width < window:
        left, right = at[:-width], at[width:]
        at = np.where(values[left] <= values[right], left, right)
        width *= 2
    at = np.unique(at)
    return at[usable[at]]


def find_runs(x: np.ndarray, longest: int) -> dict[int, list[tuple[int, int]]]:
    """Runs of an array of word numbers as (start, end) by period; no text in it has more than ``longest`` words.

    Several texts may stand in one array, with a number of its own after each.
    """
    n, found = len(x), _Found()
    for q in range(1, min(DIRECT, longest // LEAST_TIMES + 1)):
        starts, ends = _stretches(x[q:] == x[:-q])
        found.add(starts, ends + q, q)
    with np.errstate(over="ignore"):
        odd, mixer = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
        spread = x.astype(np.uint64) * mixer
        spread = (spread ^ (spread >> np.uint64(32))) * mixer
        hashes, power, gram, scale = spread ^ (spread >> np.uint64(29)), odd, 1, DIRECT
        while LEAST_TIMES * scale <= longest:
            while gram < scale // 2:
                hashes = hashes[:-gram] * power + hashes[gram:]
                power, gram = power * power, 2 * gram
            usable = ~found.inside(n, gram)[: len(hashes)]
            order = (hashes ^ (hashes >> np.uint64(31))) * odd
            order = np.where(usable, order >> np.uint64(1), np.uint64(1) << np.uint64(63))
            at = _kept(order, usable, scale // 2)
            at = at[np.argsort(hashes[at], kind="stable")]
            pairs = []
            for k in range(1, NEXT + 1):
                if k >= len(at):
                    break
                a, b = at[:-k], at[k:]
                alike = (hashes[a] == hashes[b]) & (b - a < 2 * scale)
                if not alike.any():
                    break
                seed = alike & (b - a >= scale)
                pairs.append(np.stack([b[seed] - a[seed], a[seed]], axis=1))
            pairs = np.concatenate(pairs) if pairs else np.empty((0, 2), np.int64)
            last, done = 0, 0
            for q, a in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
                if q != last:
                    last, done = q, 0
                if a < done:
                    continue
                start, end = a - _backward(x, a, a + q), a + _forward(x, a, a + q)
                done = end
                found.add(np.array([start]), np.array([end + q]), q)
            scale *= 2
    return found.by_period


def plant(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's change of one document in ten: a tail of it repeats with a period that follows from the id."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    return words[:a] + words[a : a + p] * whole + words[a : a + rest]


def _row(doc_id, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """A row of the result from runs (start, period, length)."""
    runs.sort()
    listing = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    best = min(runs, key=lambda r: (-r[2], r[0], r[1]), default=None)
    if best:
        drop = np.zeros(len(words) + 1, np.int64)
        for s, q, length in runs:
            drop[s + q] += 1
            drop[s + length] -= 1
        words = [w for w, d in zip(words, (np.cumsum(drop)[:-1] > 0).tolist(), strict=True) if not d]
    start, period, length = best or (None, None, None)
    exponent = 1000 * length // period if best else None
    return doc_id, len(runs), start, length, period, exponent, sha256(listing.encode()).hexdigest(), sha256(b" ".join(words)).hexdigest()


def _scan(texts: list[tuple]) -> list[tuple]:
    """Rows of the result for (doc_id, words) of some documents."""
    number: dict[bytes, int] = {}
    ids: list[int] = []
    starts = []
    for k, (_, words) in enumerate(texts):
        starts.append(len(ids))
        ids.extend([number.setdefault(w, len(number)) for w in words])
        ids.append(-k - 1)
    longest = max((len(words) for _, words in texts), default=0)
    runs: list[list] = [[] for _ in texts]
    by_period = find_runs(np.array(ids, np.int64), longest)
    for q, spans in by_period.items():
        owner = np.searchsorted(starts, [s for s, _ in spans], side="right") - 1
        for k, (s, e) in zip(owner.tolist(), spans, strict=True):
            runs[k].append((s - starts[k], q, e - s))
    return [_row(doc_id, words, r) for (doc_id, words), r in zip(texts, runs, strict=True)]


def _batches(batches: Iterator[pa.RecordBatch], planted: bool) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in SCHEMA.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in slices(batches):
        held, size = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), utf8(batch, "text"), strict=True):
            words = (text or b"").split()
            held.append((doc_id, plant(words, doc_id) if planted else words))
            size += len(words)
            if size >= SLICE_WORDS:
                yield out(_scan(held))
                held, size = [], 0
        if held:
            yield out(_scan(held))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", planted: bool = False) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): one row for each row of ``docs``.

    Words are what ASCII blanks part. ``start`` to ``exponent_milli`` (floor of 1000 * length / period) tell the longest run
    (of equals the first, then of the shortest period), null if there is none. The digests are of all runs, as lines ``start,length,period`` in order,
    and of the words that stay, joined by blanks: a word goes if a run holds it after that run's first period.
    ``planted`` first rewrites one document in ten by its id (``plant``).

    Null and empty texts have no words; a null id is passed on and never rewritten; repeated rows and ids give a row each; an empty
    table gives none. Other columns are not read, so their names can't clash.
    """
    narrow = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return narrow.mapInArrow(lambda batches: _batches(batches, planted), SCHEMA)
