"""Token ids in binary shards of bit or byte planes.

A shard file holds the ids of a range of documents as one sequence, cut into blocks of a fixed number of ids. The ids of a
block are transposed into planes (one for each bit, or each byte, of an id), each plane is compressed with zstandard, and
an index at the end of the file says where each block lies and how long its planes are. A second index lists the
documents and their numbers of ids.

    file   := "ZTP1" block* index documents footer
    block  := plane*                      compressed, most significant last
    index  := (offset u64, ids u32, width u32, sizes u32[width])*      zstandard
    documents := doc ids i64[], id counts i64[], null flags u8[]       zstandard
    footer := blocks u32, documents u32, kind u32, index offset u64, documents offset u64, "ZTP1"
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.llm.common import keyed_text, new_path, slices, worker_cache

MAGIC = b"ZTP1"
FOOTER = struct.Struct("<IIIQQ4s")
BIT, BYTE = 1, 8
BLOCK_IDS = 1 << 16
#: Pieces that a worker's cache holds, about; of the older half only those that were met again stay.
CACHE_WORDS = 800_000
#: Bytes of the longest piece that is kept, and of the new pieces that are encoded at a time.
KEPT_BYTES, SPELLED_BYTES = 256, 1 << 16
#: Documents that are cut into words at a time.
CUT_ROWS = 2000
#: Words whose ids are put in their places at a time.
PLACED_WORDS = 1 << 17
def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


#: ASCII letters, and lead bytes of U+00C0 to U+023F: letters all but two, the signs of multiplication (C3 97) and division (C3 B7).
LETTERS, LATIN = _bytes((0x41, 0x5A), (0x61, 0x7A)), _bytes((0xC3, 0xC8))
#: ASCII marks, which are neither letters nor digits nor white space.
MARKS = _bytes((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
GRAPHIC = _bytes((0x21, 0x7E))
#: Bytes that no white space begins with. Leads C2 and E1 to E3 have some.
SOLID = _bytes((0x21, 0x7E), (0xC3, 0xE0), (0xE4, 0xF4))
SOLID_STARTS = {bytes([0x20, b]) for b in np.flatnonzero(SOLID).tolist()}


#: Ids (those of the document that passes the limit included) and documents of a shard file at most.
SHARD_IDS, SHARD_DOCS = 1 << 28, 1 << 20


def _signs(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Which two-byte characters, by the places of their lead bytes, are the signs among the letters of LATIN."""
    second = data[np.minimum(lead + 1, len(data) - 1)]
    return (data[lead] == 0xC3) & ((second == 0x97) | (second == 0xB7))


def piece_bounds(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bounds of pieces of the texts that end at ``ends`` in their bytes ``data``, where the byte-level pre-tokenizer cuts in any context.

    It cuts before a blank that stands before anything but white space, or behind an ASCII character that is none; between a
    letter and a mark behind it; between a mark and a letter behind it (not behind an apostrophe, which takes some letters with
    it); and between a line feed, behind a letter or mark, and a letter. Bounds of texts are bounds of pieces.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)

    def at(places: np.ndarray) -> np.ndarray:
        """Bytes there; past a text's bounds any will do: there is a cut anyway, and blanks that end a text are taken back."""
        return data[np.clip(places, 0, n - 1)]

    if n:
        blanks = np.flatnonzero(data == 0x20)
        after = at(blanks + 1)
        solid = SOLID[after]
        wide = np.flatnonzero((after == 0xE2) | (after == 0xE3))
        if len(wide):  # U+2010 to U+2027, from U+2080, from U+3040
            second, third = at(blanks[wide] + 2), at(blanks[wide] + 3)
            dashes = (second == 0x80) & (third >= 0x90) & (third <= 0xA7)
            solid[wide] = np.where(after[wide] == 0xE2, (second >= 0x82) | dashes, second >= 0x81)
        cut[blanks[solid]] = True
        last = ends[ends > 0] - 1
        cut[last[data[last] == 0x20]] = False
        cut[blanks[GRAPHIC[at(blanks - 1)]]] = True

        marks = np.flatnonzero(MARKS[data])
        before, lead = at(marks - 1), np.maximum(marks - 2, 0)  # all of C3 to C8 lead two bytes
        latin = (before >= 0x80) & (before < 0xC0) & LATIN[data[lead]] & ~_signs(data, lead)
        cut[marks[LETTERS[before] | latin]] = True

        feeds = np.flatnonzero(data == 0x0A)
        before = at(feeds - 1)
        fore = np.concatenate((marks[data[marks] != 0x27], feeds[MARKS[before] | LETTERS[before]])) + 1
        fore = fore[fore < n]
        cut[fore[LETTERS[data[fore]] | LATIN[data[fore]] & ~_signs(data, fore)]] = True
        cut[ends] = True
    cut[[0, n]] = True
    return np.flatnonzero(cut)


class WordCache:
    """Encodes texts with the tokenizers library, each distinct piece of a batch once.

    Texts are cut where the byte-level pre-tokenizer always cuts (``piece_bounds``), so the ids of the pieces, one after another,
    are the ids of the text. Arrow tells the distinct pieces; only these are looked up. New ones behind a blank are encoded
    together, as one text, whose ids are told apart by the bytes that they stand for. Texts that hold the string of an added
    token, which the library takes for that token, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)  # one character a byte
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts can't be cut: those with an added token."""
        odd = np.zeros(len(texts), bool)
        for token in self.added:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        return odd

    def _spelled(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces that all begin with a blank before no white space, encoded as one text."""
        text = b"".join(pieces).decode()
        if any(token in text for token in self.added):
            return self._apart(pieces)
        ids = self._ids(text)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        cuts = ((np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1) * 4).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _apart(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of any pieces, each a text of its own."""
        made = self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        return [np.array(m.ids, "<u4").tobytes() for m in made]

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of new pieces; short ones are kept."""
        blank = [p for p in pieces if p[:2] in SOLID_STARTS]
        rest = [p for p in pieces if p[:2] not in SOLID_STARTS]
        made, at, size = {}, 0, 0
        for k, piece in enumerate(blank, 1):
            size += len(piece)
            if size >= SPELLED_BYTES or k == len(blank):
                made.update(zip(blank[at:k], self._spelled(blank[at:k]), strict=True))
                at, size = k, 0
        if rest:
            made.update(zip(rest, self._apart(rest), strict=True))
        self.words.update((p, m) for p, m in made.items() if len(p) <= KEPT_BYTES)
        return made

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.words) > CACHE_WORDS // 2:
            self.words, self.older = {}, self.words
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()).fill_null("")
        odd = self._odd(texts)
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        whole = {k: self._ids(texts[k].as_py()).tobytes() for k in np.flatnonzero(odd).tolist()}
        cut = iter(self._joined(plain) if len(plain) else ())
        return [whole[k] if k in whole else next(cut) for k in range(len(texts))]

    def _joined(self, texts: pa.Array) -> list[bytes]:
        """The ids of texts without nulls and added tokens, joined from those of their pieces."""
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
        if offsets[0] == offsets[-1]:
            return [b""] * len(texts)
        data = data.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        bounds = piece_bounds(np.frombuffer(data, np.uint8), offsets[1:])
        told = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), data]).dictionary_encode()
        codes, pieces = told.indices.to_numpy(), told.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.words.get, pieces))
        missing = [k for k, f in enumerate(found) if f is None]
        if missing:
            again = {p: self.older[p] for k in missing if (p := pieces[k]) in self.older}
            self.words.update(again)
            again |= self._learn([p for k in missing if (p := pieces[k]) not in again])
            for k in missing:
                found[k] = again[pieces[k]]
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, lengths = np.cumsum(sizes) - sizes, sizes[codes]
        placed = []
        for at in range(0, len(codes), PLACED_WORDS):
            own = lengths[at : at + PLACED_WORDS]
            shift = np.repeat(starts[codes[at : at + PLACED_WORDS]] - (np.cumsum(own) - own), own)
            placed.append(pool[shift + np.arange(len(shift))].tobytes())
        data = b"".join(placed)
        cuts = (np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(bounds, offsets)] * 4).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def to_planes(ids: np.ndarray, kind: int) -> list[bytes]:
    """Bit or byte planes of a block, from the least significant up to the last that is not all zero."""
    width = max(1, int(ids.max(initial=0)).bit_length())
    if kind == BYTE:
        return [p.tobytes() for p in np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)[: (width + 7) // 8]]
    return [np.packbits((ids >> b) & 1, bitorder="little").tobytes() for b in range(width)]


def from_planes(planes: list[bytes], n: int, kind: int) -> np.ndarray:
    out = np.zeros(n, "<u4")
    for k, plane in enumerate(planes):
        values = np.frombuffer(plane, np.uint8)
        if kind == BIT:
            values = np.unpackbits(values, count=n, bitorder="little")
        out |= values.astype("<u4") << (k * kind)
    return out


def _open(path: str, mode: str):
    """A file of the shared folder: a plain path, file:, or any scheme that Arrow knows."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return open(url.path, mode)
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    return fs.open_output_stream(name) if mode == "wb" else fs.open_input_file(name)


def _commit(temporary: str, path: str) -> None:
    url = urlparse(path)
    if url.scheme in ("", "file"):
        os.replace(urlparse(temporary).path, url.path)
    else:
        fs, name = pyarrow.fs.FileSystem.from_uri(path)
        fs.move(pyarrow.fs.FileSystem.from_uri(temporary)[1], name)


class ShardWriter:
    """Writes under a name of its own and moves the file into place when it is whole: a task may run twice."""

    def __init__(self, path: str, attempt: str, kind: int, block_ids: int):
        url = urlparse(path)
        if url.scheme in ("", "file"):
            os.makedirs(os.path.dirname(url.path), exist_ok=True)
        self.path, self.temporary, self.kind, self.block = path, f"{path}.{attempt}", kind, block_ids * 4
        self.file, self.at = _open(self.temporary, "wb"), len(MAGIC)
        self.file.write(MAGIC)
        self.index, self.docs, self.rest = [], [], bytearray()
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, len(ids) // 4))
        self.rest += ids
        while len(self.rest) >= self.block:
            self._flush(self.block)

    def _flush(self, size: int) -> None:
        ids = np.frombuffer(bytes(self.rest[:size]), "<u4")
        del self.rest[:size]
        planes = [self.zstd.compress(p) for p in to_planes(ids, self.kind)]
        self.index.append(struct.pack(f"<QII{len(planes)}I", self.at, len(ids), len(planes), *map(len, planes)))
        for p in planes:
            self.file.write(p)
            self.at += len(p)

    def close(self) -> None:
        if self.rest:
            self._flush(len(self.rest))
        index = self.zstd.compress(b"".join(self.index))
        nulls = np.array([d is None for d, _ in self.docs], np.uint8)
        documents = self.zstd.compress(np.array([d or 0 for d, _ in self.docs], "<i8").tobytes() + np.array([n for _, n in self.docs], "<i8").tobytes() + nulls.tobytes())
        self.file.write(index + documents)
        self.file.write(FOOTER.pack(len(self.index), len(self.docs), self.kind, self.at, self.at + len(index), MAGIC))
        self.file.close()
        _commit(self.temporary, self.path)


class ShardReader:
    def __init__(self, path: str):
        self.file = _open(path, "rb")
        self.file.seek(0, 2)
        end = self.file.tell() - FOOTER.size
        self.file.seek(end)
        _, n, self.kind, index_at, docs_at, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard of token planes: {path}")
        unzip = zstandard.ZstdDecompressor().decompressobj
        self.file.seek(index_at)
        index, documents = unzip().decompress(self.file.read(docs_at - index_at)), unzip().decompress(self.file.read(end - docs_at))
        self.blocks, at = [], 0
        while at < len(index):
            offset, ids, width = struct.unpack_from("<QII", index, at)
            self.blocks.append((offset, ids, struct.unpack_from(f"<{width}I", index, at + 16)))
            at += 16 + 4 * width
        nulls = np.frombuffer(documents, np.uint8, n, 16 * n)
        self.docs = [(None if z else i, c) for i, c, z in zip(np.frombuffer(documents, "<i8", n).tolist(), np.frombuffer(documents, "<i8", n, 8 * n).tolist(), nulls, strict=True)]

    def block(self, k: int) -> np.ndarray:
        """Random access by the chunk index."""
        offset, n, sizes = self.blocks[k]
        self.file.seek(offset)
        unzip = zstandard.ZstdDecompressor()
        return from_planes([unzip.decompressobj().decompress(self.file.read(s)) for s in sizes], n, self.kind)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(document id, number of ids, crc32 of the ids), one block in memory at a time."""
        left, k = b"", 0
        for doc_id, n in self.docs:
            crc, need = 0, 4 * n
            while need:
                if not left:
                    left, k = memoryview(self.block(k).astype("<u4").tobytes()), k + 1
                crc, need, left = zlib.crc32(left[:need], crc), need - len(left[:need]), left[need:]
            yield doc_id, n, crc


def word_cache(path: str) -> WordCache:
    """The worker's own, kept for its later tasks."""
    held = worker_cache("words")
    if path not in held:
        held[path] = WordCache(path)
    return held[path]


def write_shards(spark: SparkSession, docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", planes: str = "byte", block_ids: int = BLOCK_IDS, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode ``docs`` in ascending id order into shard files under ``folder``; returns (shard, path, n_docs, n_ids).

    Rows are dealt out by range of id and sorted within the range (null ids first; equal ids by the hash of the text, so that many
    rows of one id are dealt out too), so shard numbers follow id order. Null texts count as empty; every document ends
    with ``end_id``. A range is written block by block, and a new file begins after ``shard_ids`` ids or SHARD_DOCS documents:
    neither writer nor reader holds the document entries of more. The returned manifest is one row a file.
    """
    kind = {"bit": BIT, "byte": BYTE}[planes]
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer)
        context, writer, files, total = TaskContext.get(), None, 0, 0

        def closed() -> pa.RecordBatch:
            writer.close()
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([writer.path]), pa.array([len(writer.docs)]), pa.array([total])], names=["shard", "path", "n_docs", "n_ids"])

        for part in slices(batches, CUT_ROWS, "words"):
            ids = cache.encode(part.column(1))
            for doc_id, own in zip(part.column(0).to_pylist(), ids, strict=True):
                if writer is None:
                    shard, total = context.partitionId() << 32 | files, 0
                    writer = ShardWriter(f"{folder}/shard-{context.partitionId():07d}-{files:05d}.ztp", f"{context.taskAttemptId()}", kind, block_ids)
                writer.add(doc_id, own + tail)
                total += len(own) // 4 + 1
                if total >= shard_ids or len(writer.docs) >= SHARD_DOCS:
                    yield closed()
                    writer, files = None, files + 1
        if writer is not None:
            yield closed()

    tie = F.xxhash64("text")
    ordered = keyed_text(docs, id_col, text_col).repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    rows = ordered.mapInArrow(run, "shard long, path string, n_docs long, n_ids long").collect()
    return spark.createDataFrame([tuple(r) for r in sorted(rows)], "shard long, path string, n_docs long, n_ids long")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files; ``start`` counts over all shards."""
    shards, start = [], 0
    for r in manifest.orderBy("shard").collect():  # one row a shard
        shards.append((r.path, start))
        start += r.n_ids
    if not shards:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(path)
                rows = []
                for doc_id, n, crc in reader.documents():
                    rows.append((doc_id, start, n, crc))
                    start += n
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    listed = spark.createDataFrame(shards, "path string, start long").repartition(len(shards))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_planes(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Write ``docs`` as shards of token planes under the shared folder and read the documents back from the files."""
    return read_shards(spark, write_shards(spark, docs, new_path(spark, "token-planes"), tokenizer, end_id, **options))
