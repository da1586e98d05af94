"""Helpers shared by the text operators: Arrow text access, labelled samples."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.sources.scratch import Scratch, new_path, remove_path, shared_folder

__all__ = ["Scratch", "fresh_names", "id_bitmap", "id_hash", "in_bitmap", "keyed_text", "labelled_sample", "new_path", "remainder", "remove_path", "shared_folder", "slices", "small_batches", "utf8", "worker_cache"]

#: Rows that a Python stage holds as Python objects at a time.
SLICE_ROWS = 256

ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: ASCII bytes that no word of the licence and benchmark operators holds, as blanks.
WORD_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


#: Bytes and rows of a batch of texts on its way to Python: a batch is held several times, by the JVM and by Python, and a task that
#: reads very long texts would else hold ten thousand of them.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after the session's limits on Arrow batches are lowered to the bounds above; lower ones stay."""
    conf = docs.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.match(r"-?\d+", conf.get(key))[0])
        if not 0 < now <= most:
            conf.set(key, str(most))
    return docs


_caches: dict[str, dict] = {}


def worker_cache(name: str) -> dict:
    """What a Python worker keeps under ``name`` for its later tasks. Call it from a function of a module: a task's own function would
    get a copy of a dictionary that it names, empty for each task."""
    return _caches.setdefault(name, {})


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, keep: str = "") -> Iterator[pa.RecordBatch]:
    """Parts of the batches; what Arrow has freed goes back after each, or else workers, idle ones too, keep it beside the memory of others.

    A worker serves one stage after another: what it has cached for others than ``keep`` is dropped first.
    """
    for name, held in _caches.items():
        if name != keep:
            held.clear()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
            pa.default_memory_pool().release_unused()


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    values = batch.column(batch.schema.get_field_index(column))
    return values.cast(pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()).to_pylist()


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, under names of this library: other columns of ``docs`` can't clash."""
    return small_batches(docs).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


#: Bits of an id bitmap, for each id, and at least and at most (64 MB on the driver and on each Python worker, whatever the number of ids).
BITS_PER_ID, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 29


def id_bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the hashes of ``column``: ids that are not in it are not among them, others may be.

    It has BITS_PER_ID bits for an id, up to MOST_BITS; past that more strangers pass, so whoever uses it still joins exactly
    what it lets through. Words of the bitmap are put together by a pre-aggregated group-by. Null ids are left out.
    """
    known = ids.filter(F.col(column).isNotNull())
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_ID * known.count()).bit_length()))
    place = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))
    rows = known.select(place.alias("place")).selectExpr("shiftright(place, 6) as word", "shiftleft(1L, cast(place & 63 as int)) as bits").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def id_hash(id_column):
    """What ``in_bitmap`` looks up; 0 for null ids."""
    return F.when(id_column.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(id_column.cast("long")))


def in_bitmap(bitmap: np.ndarray, hashes: pa.Array) -> np.ndarray:
    p = hashes.to_numpy(zero_copy_only=False).astype(np.int64) & (64 * len(bitmap) - 1)
    return (bitmap[p >> 6] >> (p & 63)) & 1 == 1


def fresh_names(taken: list[str], *names: str) -> list[str]:
    """``names``, with underscores before those that ``taken`` has already (in any case of letters)."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def remainder(id_col: str, modulus: int):
    """crc32 of the id's decimal text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(modulus)


def labelled_sample(labels: DataFrame, label: str, rows: dict[int, int], condition=None, id_col: str = "doc_id") -> DataFrame:
    """Bounded sample of labelled ids: at most ``rows[c]`` ids of class ``c``, those with the smallest hashes.

    Ids with several label rows count once, with their largest label; null ids and other labels are left out.
    """
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label].cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    if condition is not None:
        known = known.filter(condition)
    picks = [
        known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in sorted(rows.items())
    ]
    out = picks[0]
    for p in picks[1:]:
        out = out.unionByName(p)
    return out
