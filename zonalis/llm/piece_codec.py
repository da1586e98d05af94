"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

An automaton over the pieces runs along a text once. At each position its output links give every piece that ends there,
and the best score of a segmentation up to there is relaxed over them (Viterbi). For a unigram model that is the whole
rule. For a model of merges (BPE) a piece may follow another only if merging the two pieces' characters gives back just
these two; one segmentation at most is left at each position, and it is that of the merges, so the ids are those of the
sentencepiece library in both cases.

Segmentations are independent on both sides of a cut that no piece crosses, so texts are cut before runs of blanks and
each distinct part is segmented once a worker.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from zonalis.llm.common import keyed_text, slices, worker_cache

BLANK = "▁"
#: Piece types and fields of the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Parts that each cache of a worker holds at most, and pairs of pieces. Workers outlive their stage, so what they hold stands beside the memory of later ones.
CACHE_PARTS, CACHE_JOINS = 240_000, 400_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


class PieceModel:
    """Pieces, scores and rules of a model file. Only the identity normaliser is known here; others are refused."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.dummy_prefix, self.byte_fallback, self.unknown = UNIGRAM, True, False, 0
        squeeze = True
        with open(path, "rb") as file:
            data = file.read()
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                self.scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.types.append(own.get(3, NORMAL))
            elif field == 2:
                own = dict(_fields(value))
                self.kind, self.byte_fallback, self.unknown = own.get(3, UNIGRAM), bool(own.get(35, 0)), own.get(40, 0)
            elif field == 3:
                own = dict(_fields(value))
                squeeze, self.dummy_prefix = bool(own.get(4, 1)), bool(own.get(3, 1))
                if own.get(2):
                    raise ValueError("the model normalises text; only the identity is supported")
        if squeeze or self.kind not in (UNIGRAM, BPE) or USER in self.types:
            raise ValueError("unsupported model: white space is squeezed, or it has other rules than unigram or merges")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        self.crossing = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        known = "".join(sorted(p for p in self.ids if len(p) == 1))
        self.foreign = re.compile(f"([^{re.escape(known)}])") if known else re.compile("(.)", re.DOTALL)
        self.joins: dict[tuple[int, int], bool] = {}
        self.unmerged = {i for p, i in self.ids.items() if self.kind == BPE and self._merge(p) != [p]}

    def _merge(self, text: str) -> list[str]:
        """Merges the pair of best score, leftmost first, until none is left."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        ok = self.joins.get((a, b))
        if ok is None:
            if len(self.joins) >= CACHE_JOINS:
                self.joins.clear()
            ok = self.joins[a, b] = self._merge(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        return ok

    def segment(self, part: str) -> list[int]:
        """Ids of a part that has only characters of the model."""
        n, bpe, scores, follow = len(part), self.kind == BPE, self.scores, self.joins
        best: list[float | None] = [None] * (n + 1)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for end, (size, i) in self.automaton.iter(part):
            end += 1
            start = end - size
            before = best[start]
            if before is None or (best[end] is not None and (bpe or before + scores[i] <= best[end])):
                continue
            if bpe:
                if i in self.unmerged:
                    continue
                if start:
                    ok = follow.get((last[start], i))
                    if not (self._may_follow(last[start], i) if ok is None else ok):
                        continue
            best[end], last[end], back[end] = before + scores[i], i, start
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def encode_part(self, part: str) -> list[int]:
        out: list[int] = []
        for k, piece in enumerate(self.foreign.split(part)):
            if k % 2 == 0:
                out += self.segment(piece) if piece else []
            elif self.byte_fallback:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return out


class Recent:
    """Parts and their ids in two halves: when the newer one is full it becomes the older one, of which only those parts stay that are met again."""

    def __init__(self):
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def put(self, key: str, ids: bytes) -> None:
        if len(self.newer) >= CACHE_PARTS // 2:
            self.newer, self.older = {}, self.newer
        self.newer[key] = ids


class Codec:
    """Encodes and decodes with caches that a worker keeps."""

    _parts = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.words, self.parts = Recent(), Recent()
        self.surface = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(BLANK, " ").encode()
            for p, t in zip(self.model.pieces, self.model.types, strict=True)
        ]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        model = self.model
        if model.crossing or not model.dummy_prefix or "  " in text or text[0] == " " or text[-1] == " " or BLANK in text:
            plain = (BLANK if model.dummy_prefix else "") + text.replace(" ", BLANK)
            return b"".join(self._part(p, p, self.parts) for p in ([plain] if model.crossing else self._parts.findall(plain)))
        words = text.split(" ")
        found = list(map(self.words.newer.get, words))
        if None in found:
            found = [f if f is not None else self._part(w, BLANK + w, self.words) for f, w in zip(found, words, strict=True)]
        return b"".join(found)

    def _part(self, key: str, part: str, cache: Recent) -> bytes:
        ids = cache.newer.get(key)
        if ids is None:
            ids = cache.older.get(key)
            if ids is None:
                ids = np.array(self.model.encode_part(part), "<u4").tobytes()
            if len(part) <= 64:  # long parts hardly recur
                cache.put(key, ids)
        return ids

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.surface[i] for i in ids])
        if self.model.dummy_prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", "replace")


def codec(path: str) -> Codec:
    held = worker_cache("pieces")
    if path not in held:
        held[path] = Codec(path)
    return held[path]


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``, whole texts; null and empty texts have no ids.

    ``model`` is the path of a model file that all executors have. One map, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for part in slices(batches, keep="pieces"):
            ids = [own.encode(t or "") for t in part.column(1).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for part in slices(batches, keep="pieces"):
            texts = [None if i is None else own.decode(i) for i in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text_crc32, decoded_crc32, same): digests of the ids and of the text decoded from them.

    Encodes and decodes every row in one pass over the texts. ``same`` says whether decoding gave the text
    back; only a text that holds the blank mark itself (U+2581), which decodes to a blank, does not. Null texts count as
    empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for part in slices(batches, keep="pieces"):
            rows = []
            for text in part.column(1).to_pylist():
                ids = own.encode(text or "")
                back = own.decode(np.frombuffer(ids, "<u4").tolist())
                rows.append((len(ids) // 4, zlib.crc32(ids), zlib.crc32((text or "").encode()), zlib.crc32(back.encode()), back == (text or "")))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=["doc_id", "n_ids", "ids_crc32", "text_crc32", "decoded_crc32", "same"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text_crc32 long, decoded_crc32 long, same boolean")
