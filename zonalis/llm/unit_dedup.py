"""Substring deduplication by hashing units: lines, paragraphs, or lines cut at sentence ends.

A text is cut into units that together make up the whole text. A unit in normal form (A-Z lower-cased, words joined by
single blanks, the unit's end marks left out) is digested; equal digests anywhere in the corpus are one group. The
occurrence of lowest rank (document id, then offset) stays, all others are removed, and offsets are those of the original
text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.common import Scratch, keyed_text, slices

#: How each kind of unit ends; a unit is a run of other characters with all end marks that follow it.
ENDS = {"line": r"[^\n]*\n+|[^\n]+", "paragraph": r"(?:(?!\n\n).)*\n\n+|(?:(?!\n\n).)+", "sentence": r"[^.!?\n]*[.!?\n]+|[^.!?\n]+"}
MARKS = {"line": "\n", "paragraph": "\n", "sentence": ".!?\n"}
#: Units of fewer words are never removed: short ones recur by chance.
MIN_WORDS = 6

_UPPER = {c: c + 32 for c in range(65, 91)}
_WORDS = re.compile(r"[^ \t\n\x0b\x0c\r]+")
SCHEMA = "doc_id long, start long, n_chars long, n_words long, digest binary"


def units(text: str, kind: str = "sentence") -> list[tuple[int, str]]:
    """(offset in code points, unit) of each unit; the units together are the text."""
    return [(m.start(), m[0]) for m in re.finditer(ENDS[kind], text, re.DOTALL)]


def normal_words(unit: str, kind: str = "sentence") -> list[str]:
    return _WORDS.findall(unit.rstrip(MARKS[kind]).translate(_UPPER))


def unit_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """The units of at least ``min_words`` words, with their places and MD5 digests."""
    pattern, marks = re.compile(ENDS[kind], re.DOTALL), MARKS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        md5, words = hashlib.md5, _WORDS.findall
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                for m in pattern.finditer(text or ""):
                    unit = words(m[0].rstrip(marks).translate(_UPPER))
                    if len(unit) >= min_words:
                        rows.append((doc_id, m.start(), m.end() - m.start(), len(unit), md5(" ".join(unit).encode()).digest()))
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    texts = keyed_text(docs, id_col, text_col).filter("doc_id is not null")
    return texts.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "start", "n_chars", "n_words", "digest"])


def repeated_units(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kind: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """The spans to remove: (doc_id, start, n_chars, n_words, keep_doc_id, keep_start), offsets in code points.

    The first place of each digest is found by a pre-aggregated minimum, so a unit that a third of all rows hold is one
    row a task in the shuffle. Only digests that stand twice go into the join; it reads two written tables, so
    adaptive execution can split a hot digest. Null and empty texts have no units, rows with a null id
    take no part; of rows that repeat in full (same id, same text) the units tie and are reported once.
    """
    scratch = Scratch(spark)
    found = scratch.table(unit_digests(docs, id_col, text_col, kind, min_words), "units")
    first = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("keep"))
    first = scratch.table(first.filter("n > 1").select("digest", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start")), "firsts")
    again = found.join(first, "digest").filter("doc_id <> keep_doc_id or start <> keep_start")
    return again.select("doc_id", "start", "n_chars", "n_words", "keep_doc_id", "keep_start").distinct()


def kept_text(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, kept): texts without their spans, and ``kept`` the (start, n_chars) in the original of what is left.

    The spans of one document are gathered with it; their number is bounded by the length of its text. Null texts
    stay null and have no kept spans.
    """
    own = spans.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "n_chars"))).alias("cut"))
    joined = keyed_text(docs, id_col, text_col).join(own, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts, kept = [], []
            for text, cut in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                at, left = 0, []
                for s in [*(cut or []), {"start": len(text or ""), "n_chars": 0}]:
                    if s["start"] > at:
                        left.append({"start": at, "n_chars": s["start"] - at})
                    at = max(at, s["start"] + s["n_chars"])
                texts.append(None if text is None else "".join(text[x["start"] : x["start"] + x["n_chars"]] for x in left))
                kept.append(left)
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("n_chars", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(kept, spans_type)], names=["doc_id", "text", "kept"])

    return joined.mapInArrow(run, "doc_id long, text string, kept array<struct<start: long, n_chars: long>>")


#: What the words of a passage's unit are cut out of: end marks and blanks at its end don't count.
_TAIL = ".!?\n \t\x0b\x0c\r"
_CUTS = re.compile(ENDS["sentence"])
_BREAKS = {"line": re.compile(r"\n+"), "paragraph": re.compile(r"\n\n+")}
_SOLID = re.compile(r"[^ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r.!?][^ \t\n\x0b\x0c\r]*")
_BLANK = frozenset(" \t\n\x0b\x0c\r")


def passage_units(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, int, bytes]]:
    """(start, n_chars, n_words, digest) of each paragraph, line and run of sentences of at least ``min_words`` words.

    A run takes in as many sentences as make up ``min_words`` words: one starts at every sentence and one ends at every
    sentence, so all sentences of any stretch of so many words stand in a run inside it, short ones too. A sentence that
    is long enough is a run of its own. Units with the same words at the same place are one, the longest.
    """
    low = text.lower() if text.isascii() else text.translate(_UPPER)
    starts, sums, at, total = [], [0], 0, 0
    for m in _CUTS.finditer(low):
        at = m.start()
        n = len(_SOLID.findall(m[0]))
        if n and at and low[at - 1] not in _BLANK and low[at] not in _BLANK:
            n -= 1
        total += n
        starts.append(at)
        sums.append(total)
    starts.append(len(low))
    spans, i = set(), 0
    for e in range(1, len(starts)):
        # The shortest run that ends here, and those that start at the sentences left behind and could not end earlier.
        while sums[e] - sums[i] >= min_words:
            spans.add((starts[i], starts[e]))
            i += 1
        if i and sums[e] - sums[i - 1] >= min_words:
            spans.add((starts[i - 1], starts[e]))
    for ends in _BREAKS.values():
        at = 0
        for m in ends.finditer(low):
            spans.add((at, m.end()))
            at = m.end()
        if at < len(low):
            spans.add((at, len(low)))
    found: dict[tuple[int, bytes], tuple[int, int, int]] = {}
    for start, end in spans:
        piece = low[start:end].rstrip(_TAIL)
        words = _WORDS.findall(piece)
        if len(words) < min_words:
            continue
        first = start
        while low[first] in _BLANK:
            first += 1
        key = first, hashlib.md5(" ".join(words).encode()).digest()
        old = found.get(key)
        if old:
            left = min(start, old[0])
            found[key] = left, max(end, old[0] + old[1]) - left, len(words)
        else:
            found[key] = start, end - start, len(words)
    return sorted((*place, digest) for (_, digest), place in found.items())


def passage_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``passage_units`` of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                rows += [(doc_id, *unit) for unit in passage_units(text or "", min_words)]
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return keyed_text(docs, id_col, text_col).filter("doc_id is not null").mapInArrow(run, SCHEMA)


def repeated_passages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``repeated_units`` over paragraphs, lines and runs of sentences at once: the same columns, spans that may overlap.

    Equal words are one group at whatever level they stand, and the earliest place stays. A repeat that overlaps that place
    in the same text is not reported: it would cut into what stays. Every word of a span has a copy at an earlier
    place, so the first of its copies is never removed. Nulls, empty texts and repeated rows are as in ``repeated_units``.
    """
    scratch = Scratch(spark)
    found = scratch.table(passage_digests(docs, id_col, text_col, min_words), "passages")
    first = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start", "n_chars")).alias("keep")).filter("n > 1")
    first = scratch.table(first.select("digest", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), F.expr("keep.start + keep.n_chars").alias("keep_end")), "passage-firsts")
    again = found.join(first, "digest").filter("doc_id <> keep_doc_id or start >= keep_end")
    return again.select("doc_id", "start", "n_chars", "n_words", "keep_doc_id", "keep_start").distinct()


#: The same spans in DuckDB SQL, for units cut at sentence ends.
ORACLE_SQL = f"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]+|[^.!?\\n]+') AS u FROM documents WHERE doc_id IS NOT NULL
), each AS (
  SELECT doc_id, u, unnest(range(1, len(u) + 1)) AS k FROM cut
), placed AS (
  SELECT doc_id, k, u[k] AS unit, sum(length(u[k])) OVER (PARTITION BY doc_id ORDER BY k) - length(u[k]) AS start FROM each
), normal AS (
  SELECT doc_id, CAST(start AS BIGINT) AS start, length(unit) AS n_chars,
    regexp_extract_all(translate(rtrim(unit, '.!?' || chr(10)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0b\\x0c\\r]+') AS w
  FROM placed
), digests AS (
  SELECT DISTINCT doc_id, start, n_chars, len(w) AS n_words, md5(array_to_string(w, ' ')) AS digest FROM normal WHERE len(w) >= {MIN_WORDS}
), ranked AS (
  SELECT *, first_value(doc_id) OVER g AS keep_doc_id, first_value(start) OVER g AS keep_start FROM digests
  WINDOW g AS (PARTITION BY digest ORDER BY doc_id, start)
)
SELECT doc_id, start, n_chars, n_words, keep_doc_id, keep_start FROM ranked WHERE doc_id <> keep_doc_id OR start <> keep_start
"""
