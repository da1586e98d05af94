"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may stand in a document with up to k = floor(rate * m) edits. It is split into k + 1 pieces: k
edits leave at least one piece as it is. An Aho-Corasick automaton over the pieces of all items finds exact piece hits in
one pass over a document, and Myers' bit-parallel distance verifies the item around each hit.

Texts are compared in normal form: A-Z lower-cased, words of ASCII letters, digits and all non-ASCII characters, joined by
single blanks.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from zonalis.llm.common import Scratch, WORD_TABLE, keyed_text, slices, small_batches, utf8, worker_cache

ERROR_RATE = 0.05
#: Characters of item text that one automaton holds; a larger benchmark is matched block by block.
BLOCK_CHARS = 4_000_000

SCHEMA = "doc_id long, item_id long, distance int, start long, length int"


def normal(text: bytes | None) -> str:
    return b" ".join((text or b"").lower().translate(WORD_TABLE).split()).decode("utf-8", "replace")


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any substring of ``text``, and the end of the first such substring.

    Myers' algorithm: a column of the distance table is two bit vectors of len(pattern) bits.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    top, full = 1 << (m - 1), (1 << m) - 1
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (full & ~(x | plus)), plus & x
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        y = eq | minus
        plus, minus = down | (full & ~(y | up)), up & y
        if score < best:
            best, end = score, j
    return best, end


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]  # noqa: B905


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(rate * len(t))) for i, t in items if t]
        self.pieces = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors):
                if piece:
                    at.setdefault(piece, []).append((n, offset))
        for piece, where in at.items():
            self.pieces.add_word(piece, (len(piece), where))
        if at:
            self.pieces.make_automaton()
        self.empty = not at

    def match(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, length) of the best place of each item in ``text``."""
        if self.empty or not text:
            return []
        places: dict[int, list[int]] = {}
        for end, (size, where) in self.pieces.iter(text):
            for n, offset in where:
                places.setdefault(n, []).append(end + 1 - size - offset)
        found = []
        for n, starts in places.items():
            item_id, item, errors = self.items[n]
            exact = text.find(item)
            if exact >= 0:
                found.append((item_id, 0, exact, len(item)))
                continue
            best: tuple[int, int, int] | None = None
            for a, b in _windows(starts, len(item), errors, len(text)):
                distance, end = best_match(item, text[a:b])
                if distance <= errors and (best is None or distance < best[0]):
                    best = (distance, a, a + end)
            if best:
                distance, a, end = best
                # the reversed match ends where the passage starts
                _, back = best_match(item[::-1], text[a:end][::-1])
                found.append((item_id, distance, end - back, back))
        return found


def _windows(starts: list[int], m: int, errors: int, size: int) -> list[tuple[int, int]]:
    """Stretches of text that hold every candidate place, overlapping ones merged."""
    out: list[tuple[int, int]] = []
    for s in sorted(set(starts)):
        a, b = max(0, s - errors), min(size, s + m + errors)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for item_id, text in keyed_text(items, id_col, text_col).distinct().toLocalIterator():
        text = normal(text.encode()) if text else ""
        if item_id is None or not text:
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


def _matcher(block, rate: float) -> Matcher:
    """One automaton a worker: that of the broadcast block it met last."""
    held = worker_cache("matchers")
    if block.bid not in held:
        held.clear()
        held[block.bid] = Matcher(block.value[1], rate)
    return held[block.bid]


class _Shared:
    """A broadcast with an id that workers can tell it by."""

    def __init__(self, broadcast, bid: str):
        self.broadcast, self.bid = broadcast, bid

    @property
    def value(self):
        return self.broadcast.value


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs`` and item that stands in it: the least distance, its first place in normal form.

    Items are broadcast in blocks of at most ``block_chars`` characters (a single longer item is a block), each matched
    against all documents in one map: nothing is shuffled and the result's size is that of the matches. Items without
    words or with a null id match nothing; an item's row given twice counts once, and equal items with different ids are all reported; documents with a null id
    are reported with it. The matches of a block are written before the next is broadcast, so one block is live at a time.
    """
    out, last, scratch = None, None, Scratch(spark)
    texts = keyed_text(docs, id_col, text_col)
    for k, block in enumerate(_blocks(items, item_id_col, item_text_col, block_chars)):
        if last is not None:
            written = scratch.table(found, f"matches-{k}")
            out = written if out is None else out.unionByName(written)
            last.unpersist()
        last = spark.sparkContext.broadcast((k, block))
        found = texts.mapInArrow(_runner(_Shared(last, f"{id(block)}-{k}-{hash(tuple(block))}"), rate), SCHEMA)
    if last is None:
        return spark.createDataFrame([], SCHEMA)
    return found if out is None else out.unionByName(found)


def _runner(block: _Shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(block, rate)
        for part in slices(batches, keep="matchers"):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), utf8(part, "text"), strict=True):
                rows += [(doc_id, *m) for m in matcher.match(normal(text))]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)],
                    names=["doc_id", "item_id", "distance", "start", "length"],
                )

    return run


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS, item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no item stands. Rows are judged where they lie: nothing is shuffled.

    Null and empty texts hold no item and stay; null ids and repeated rows are judged like others. Items without words or with a null id match
    nothing, items given twice count once. What is left after a block of items is written before the next is broadcast.
    """
    docs = small_batches(docs)
    scratch, last = Scratch(spark), None
    for k, block in enumerate(_blocks(items, item_id_col, item_text_col, block_chars)):
        if last is not None:
            docs = scratch.table(docs, "left-clean")
            last.unpersist()
        last = spark.sparkContext.broadcast((k, block))
        docs = docs.mapInArrow(_filter(_Shared(last, f"{id(block)}-{k}-{hash(tuple(block))}"), rate, docs.columns.index(text_col)), docs.schema)
    return docs


def _filter(block: _Shared, rate: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(block, rate)
        for part in slices(batches, keep="matchers"):
            values = part.column(text_at)
            texts = values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()
            yield part.filter(pa.array([not matcher.match(normal(t)) for t in texts], pa.bool_()))

    return run
