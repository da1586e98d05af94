"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32. Two fingerprints that differ in at most three bits differ in at
most one bit of one of the segments. Each segment is indexed as it is and with each of its bits as a wildcard; an
equality join brings together segments that are equal, or that differ in just the wildcard bit, and the distance is
verified in the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonalis.llm.common import Scratch, fresh_names, id_bitmap, id_hash, in_bitmap, keyed_text, slices, small_batches, utf8
from zonalis.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Shingles whose bits are counted at a time: bounds the memory that a very long text takes.
BLOCK = 1 << 15


def fingerprint(text: bytes | None, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """SimHash of the ``width``-word shingles, repeats included; 0 without words. Signed, for a Spark long."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(ends), BLOCK):
        hashes = [digest(line[s:e], seed) for s, e in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])]  # noqa: B905
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) for every row; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = pa.array([fingerprint(t, width) for t in utf8(part, "text")], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), fps], names=["doc_id", "fp"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def _variants(fps: DataFrame, wild: bool) -> DataFrame:
    """Keys of one side of the join: both segments as they are, and on the ``wild`` side each also under a wildcard at each bit that is 1 in it.

    A wildcard reads as 0, so it meets the segment that has a 0 there and is equal elsewhere.
    """
    side = int(wild)
    own = [F.col(c).alias(f"{c}{side}") for c in fps.columns]
    segment = "if(half = 1, fp & 4294967295L, shiftrightunsigned(fp, 32))"
    each = fps.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("segment", F.expr(segment))
    if wild:
        masks = F.expr("concat(array(0L), transform(filter(sequence(0, 31), b -> shiftright(segment, b) & 1 = 1), b -> shiftleft(1L, b)))")
        each = each.withColumn("mask", F.explode(masks)).withColumn("segment", F.expr("segment & ~mask"))
    return each.select(F.shiftleft(F.col("half").cast("long"), 32).bitwiseOR(F.col("segment")).alias("key"), *own)


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, also: Callable[[str, str], Column] | None = None, name: Callable[[str], Column] = lambda side: F.col(f"rep{side}")) -> DataFrame:
    """Links (a, b, bits) between different fingerprints of ``fps`` (fp, rep) at ``max_bits`` (3 at most) or fewer bits.

    Each link comes once: by the upper segment, or by the lower one if the upper ones differ in two bits or more. For
    segments that are equal each pair stands once, and segments that differ in one bit meet once, under the wildcard of the
    one that has a 1 there, so a group of k fingerprints that share a segment is compared once, not once for every wildcard.
    Some 36 keys of a fingerprint are shuffled. Further columns c of ``fps`` stand as x.c0 and y.c1 in the join, and
    ``also("0", "1")``, given these suffixes, is a further condition of it; ``name("0")`` and ``name("1")`` are what a link
    calls its ends, ``rep`` of each if not given.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one wildcard find distances up to 3")
    apart = F.expr("bit_count(fp0 ^ fp1)")
    lower = "shiftrightunsigned(x.key, 32) = 1"
    # few keys of the plain side would be broadcast and more shuffled: merged at every size, so that small runs show what large ones take
    joined = _variants(fps, False).alias("x").hint("merge").join(
        _variants(fps, True).alias("y"),
        (F.col("x.key") == F.col("y.key"))
        & (F.expr("bit_count(x.fp0 ^ y.fp1)") <= max_bits)
        & F.expr(f"x.fp0 < y.fp1 or if({lower}, (x.fp0 ^ y.fp1) & 4294967295L, shiftrightunsigned(x.fp0 ^ y.fp1, 32)) <> 0")
        & F.expr(f"not ({lower}) or bit_count(shiftrightunsigned(x.fp0 ^ y.fp1, 32)) > 1")
        & (also("0", "1") if also else F.lit(True)),
    )
    return joined.select(name("0").alias("a"), name("1").alias("b"), apart.alias("bits"))


def simhash_components(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    Texts without words have fingerprint zero and are linked like any other. Equal fingerprints are first reduced to
    one representative (pre-aggregated, so a group of copies of any size is one row), and only representatives are
    joined. Rows with a null id keep their fingerprint; their component is that of the other rows with it, null if there
    are none. An empty table gives an empty result.
    """
    scratch = Scratch(spark)
    fps = scratch.table(fingerprints(docs, id_col, text_col, width), "fingerprints")
    reps = scratch.table(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    parts = connected_components(near_links(reps.filter("rep is not null"), max_bits).select("a", "b"), scratch)
    named = reps.join(parts, reps.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = scratch.table(named, "components")
    scratch.drop("representatives", "edges", "least")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The deduplication stage: similarity of five-word shingle sets from which texts are near copies.
SET_WORDS = 5
SIMILARITY = 0.8
#: Prints of parts of the shingle set: BANDS hashes, each of the least values of the set under BAND_ROWS hash functions. Sets of
#: similarity 0.8 share none of them in 1 of 2,800 cases.
BANDS = 20
BAND_ROWS = 5
_MIX = np.random.RandomState(SEED).randint(0, 2**63, (2, BANDS * BAND_ROWS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Bits of the sketch of a shingle set: bit k is the parity of the number of shingles hashed to k. Sketches of two sets differ in
#: no more bits than the sets have shingles that stand in one of them only, so far sketches prove that sets are not alike.
SKETCH_WORDS = 8
_SKETCH_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Pairs to verify (200 bytes each at most) and buckets (one long each) that are broadcast; more of them are joined by shuffles.
BROADCAST_PAIRS, BROADCAST_BUCKETS = 50_000, 200_000
#: In the first round each document of a bucket is compared with one other, and in each further round with so many times more.
GROWTH = 16


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shingle_set(text: bytes | list[bytes] | None, width: int = SET_WORDS) -> np.ndarray:
    """Distinct 32-bit hashes of the shingles of a text or its words; fewer words than ``width`` are one shingle, no words have none."""
    words = text if isinstance(text, list) else normal_words(text)
    if not words:
        return np.zeros(0, np.int32)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh32_intdigest
    hashes = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts, ends)), np.uint32, len(ends))  # noqa: B905
    return np.unique(hashes.view(np.int32))


def band_prints(shingles: np.ndarray) -> list[int]:
    """The BANDS prints of a shingle set; none of an empty one."""
    if not len(shingles):
        return []
    least = np.full(BANDS * BAND_ROWS, 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), BLOCK // 8):
        mixed = shingles[at : at + BLOCK // 8].view(np.uint32).astype(np.uint64) * _MIX[0] + _MIX[1]
        least = np.minimum(least, mixed.min(axis=1) >> np.uint64(32))
    rows = least.astype("<u4").reshape(BANDS, BAND_ROWS)
    return [int.from_bytes(xxhash.xxh64_digest(r.tobytes(), SEED), "little", signed=True) for r in rows]


def sketch(shingles: np.ndarray) -> list[int]:
    """Parity sketch of a shingle set, as SKETCH_WORDS longs."""
    bits = 64 * SKETCH_WORDS
    places = (shingles.view(np.uint32).astype(np.uint64) * _SKETCH_MIX >> np.uint64(40)).astype(np.int64) % bits
    return np.packbits(np.bincount(places, minlength=bits).astype(np.uint8) & 1, bitorder="little").view("<i8").tolist()


def word_print(words: list[bytes]) -> int:
    """SimHash of the words; a word that stands k times weighs 1 + log k, in whole sixteenths. 0 without words.

    By its count alone the commonest words of a language would set most bits of all its texts.
    """
    if not words:
        return 0
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    distinct, ones, total = list(counts), np.zeros(64), 0.0
    for at in range(0, len(distinct), BLOCK // 8):
        part = distinct[at : at + BLOCK // 8]
        hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in part], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        weights = np.rint(16 + 16 * np.log([counts[w] for w in part]))
        ones += weights @ bits
        total += weights.sum()
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def digest_of(words: list[bytes]) -> bytes:
    """Digest of the normal form: lower case, single blanks."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def word_prints(text: bytes | None) -> tuple[bytes, list[int]]:
    """Digest of the normal form, and the SimHashes of the words (one)."""
    words = normal_words(text)
    return digest_of(words), [word_print(words)]


def _may_be_alike(similarity: float, x: str, y: str, words: list[str]) -> Column:
    """False only for sets whose sketches prove a Jaccard similarity under ``similarity``; x and y stand for (prefix, suffix)."""
    apart = " + ".join(f"bit_count({x.format(w)} ^ {y.format(w)})" for w in words)
    return F.expr(f"{apart} <= ({x.format('size')} + {y.format('size')}) * {(1 - similarity) / (1 + similarity)!r}D + 1e-6D")


def _small(table: DataFrame, most: int) -> DataFrame:
    """``table``, marked for a broadcast if it has ``most`` rows or fewer."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def _released(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``rows``; what Arrow has freed goes back after each batch: workers, idle ones too, would keep it beside the memory of others."""
    for batch in rows:
        yield batch
        pa.default_memory_pool().release_unused()
    pa.default_memory_pool().release_unused()


class _NearCopies:
    """The search for near copies among the distinct normal forms of a table; its tables are in the shared folder."""

    def __init__(self, spark: SparkSession, docs: DataFrame, similarity: float, width: int, id_col: str, text_col: str):
        self.spark, self.similarity, self.width, self.scratch = spark, similarity, width, Scratch(spark)
        self.texts = keyed_text(docs, id_col, text_col).filter("doc_id is not null")
        self.sketch = [f"s{k}" for k in range(SKETCH_WORDS)]

    def prints(self) -> DataFrame:
        """(doc_id, digest, size, sketch, fp, bands) of every row."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                rows = []
                for text in utf8(part, "text"):
                    words = normal_words(text)
                    shingles = shingle_set(words, width)
                    rows.append((digest_of(words), len(shingles), *sketch(shingles), word_print(words), band_prints(shingles)))
                columns, kinds = zip(*rows, strict=True), [pa.binary(), pa.int32(), *[pa.int64()] * (SKETCH_WORDS + 1), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "digest", "size", *(f"s{k}" for k in range(SKETCH_WORDS)), "fp", "bands"])

        return self.texts.mapInArrow(lambda batches: _released(run(batches)), f"doc_id long, digest binary, size int, {', '.join(f'{s} long' for s in self.sketch)}, fp long, bands array<long>")

    def sets(self, ids: DataFrame) -> DataFrame:
        """(digest, shingles) of the rows of ``ids`` (doc_id), and of others that their bitmap lets pass."""
        wanted, width = self.spark.sparkContext.broadcast(id_bitmap(ids, "doc_id")), self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                part = part.filter(pa.array(in_bitmap(wanted.value, part.column(2))))
                words = [normal_words(t) for t in utf8(part, "text")]
                yield pa.RecordBatch.from_arrays([pa.array([digest_of(w) for w in words], pa.binary()), pa.array([shingle_set(w, width) for w in words], pa.list_(pa.int32()))], names=["digest", "shingles"])

        return self.texts.withColumn("place", id_hash(F.col("doc_id"))).mapInArrow(lambda batches: _released(run(batches)), "digest binary, shingles array<int>")

    def verified(self, pairs: DataFrame, held: DataFrame) -> DataFrame:
        """The rows of ``pairs`` (a, b, ...) whose shingle sets, counted in full, are alike."""
        wanted = _small(pairs, BROADCAST_PAIRS)
        # each side takes only the sets that pairs name: those alone are shuffled
        left = held.select(F.col("digest").alias("a"), F.col("shingles").alias("x")).join(wanted, "a").select(*pairs.columns, "x")
        right = held.select(F.col("digest").alias("b"), F.col("shingles").alias("y")).join(wanted, "b").select("a", "b", "y")
        both = F.size(F.array_intersect("x", "y"))
        alike = both + F.lit(1e-6) >= F.lit(self.similarity) * (F.size("x") + F.size("y") - both)
        return left.join(right, ["a", "b"]).filter(alike).select(*pairs.columns).distinct()

    def merged(self, parts: DataFrame | None, links: DataFrame) -> DataFrame:
        """``parts`` (node, part), after the parts that ``links`` (pa, pb) name are put together. Nodes not in it are parts of their own."""
        named = self.scratch.table(connected_components(links.select(F.col("pa").alias("a"), F.col("pb").alias("b")), self.scratch), "named")
        if parts is None:
            return self.scratch.table(named.select("node", F.col("component").alias("part")), "parts")
        old = parts.join(named.withColumnRenamed("node", "part"), "part", "left").select("node", F.coalesce("component", "part").alias("part"))
        new = named.join(parts, "node", "left_anti").select("node", F.col("component").alias("part"))
        return self.scratch.table(old.unionByName(new), "parts")

    def within_buckets(self, firsts: DataFrame) -> DataFrame | None:
        """Parts after all pairs that share a print are settled: alike, in one part already, or proved or found not to be alike."""
        prints = firsts.select("digest", F.posexplode(F.concat(F.array("fp"), "bands")).alias("slot", "value"))
        members = prints.select(F.xxhash64("slot", "value").alias("bucket"), F.xxhash64("digest").alias("hash"))
        # near copies share many prints: buckets of the same members, told by 128 bits of their ids' hashes, are settled once
        several = members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor("hash").alias("x"), F.bit_xor(F.xxhash64(F.lit(SEED), "hash")).alias("y")).filter("n > 1")
        shared = several.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "n")
        shared = _small(self.scratch.table(shared, "shared"), BROADCAST_BUCKETS)
        own = firsts.select(F.xxhash64("digest").alias("hash"), F.col("digest").alias("node"), F.col("digest").alias("part"), "size", *self.sketch)
        # a hash that two digests share puts both into the buckets of either: more candidates, none lost
        left = self.scratch.table(members.join(shared, "bucket").join(own, "hash").select("bucket", "n", "node", "part", "size", *self.sketch), "left")
        held, parts, before, few = None, None, 0, 1
        while not left.isEmpty():
            if held is None:
                ids = firsts.join(left.select(F.col("node").alias("digest")).distinct(), "digest", "left_semi")
                held = self.scratch.table(self.sets(ids.select("doc_id")), "sets")
            rank = F.row_number().over(Window.partitionBy("bucket").orderBy("node"))
            heads = left.withColumn("k", rank).filter((F.col("k") <= few) & (F.col("k") > before))
            open_pair = (F.col("x.node") < F.col("y.node")) & (F.col("x.part") != F.col("y.part")) & _may_be_alike(self.similarity, "x.{}", "y.{}", self.sketch)
            tried = heads.alias("x").join(left.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & open_pair)
            tried = tried.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.part").alias("pa"), F.col("y.part").alias("pb")).distinct()
            alike = self.scratch.table(self.verified(self.scratch.table(tried, "tried"), held), "alike")
            if not alike.isEmpty():
                parts = self.merged(parts, alike)
                left = left.join(parts.withColumnRenamed("part", "now"), "node", "left").withColumn("part", F.coalesce("now", "part")).drop("now")
            several = left.groupBy("bucket").agg(F.min("part").alias("l"), F.max("part").alias("m")).filter("l <> m").select("bucket")
            left = self.scratch.table(left.filter(F.col("n") > few).join(several, "bucket", "left_semi"), "left")
            before, few = few, few * GROWTH
        return parts

    def across_buckets(self, firsts: DataFrame, parts: DataFrame | None) -> DataFrame | None:
        """Parts after those with word fingerprints within three bits of each other are compared too."""
        words = ["s0", "s1"]
        folded = [F.expr(" ^ ".join(f"s{j}" for j in range(k, SKETCH_WORDS, 2))).alias(f"s{k}") for k in range(2)]
        # Some 36 keys of each row are shuffled, so a row holds only what the join's condition reads, and links call its ends by a hash
        # of that; a hash that two digests share only adds candidates.
        owned = firsts.select("digest", F.col("digest").alias("part"), "fp", "size", *folded)
        if parts is not None:
            owned = owned.drop("part").join(parts, owned.digest == parts.node, "left").withColumn("part", F.coalesce("part", "digest"))
        owned = owned.select("digest", "part", F.xxhash64("fp", "size", *words).alias("rep"), "fp", "size", *words)
        owned = self.scratch.table(owned, "owned")
        rows = owned.select("fp", F.xxhash64("part").alias("part"), "size", *words)
        owned = owned.select("digest", "part", "rep")

        def open_pair(x: str, y: str) -> Column:
            return (F.col(f"part{x}") != F.col(f"part{y}")) & _may_be_alike(self.similarity, f"{{}}{x}", f"{{}}{y}", words)

        def name(side: str) -> Column:
            return F.xxhash64(*(f"{c}{side}" for c in ("fp", "size", *words)))

        links = self.scratch.table(near_links(rows, also=open_pair, name=name).select("a", "b").distinct(), "links")
        if links.isEmpty():
            return parts
        named = firsts.join(owned, "digest")
        one, other = (named.select(F.col("rep").alias(c), F.col("digest").alias(f"digest_{c}"), F.col("part").alias(f"p{c}"), F.col("size").alias(f"size_{c}"), *(F.col(w).alias(f"{w}_{c}") for w in self.sketch)) for c in "ab")
        links = _small(links, BROADCAST_PAIRS)
        halves = one.join(links, "a"), other.join(links, "b")
        links = halves[0].join(halves[1], ["a", "b"]).filter(_may_be_alike(self.similarity, "{}_a", "{}_b", self.sketch))
        links = links.select(F.col("digest_a").alias("a"), F.col("digest_b").alias("b"), "pa", "pb")
        links = self.scratch.table(links, "links")
        nodes = links.select(F.explode(F.array("a", "b")).alias("digest")).distinct()
        held = self.scratch.table(self.sets(firsts.join(nodes, "digest", "left_semi").select("doc_id")), "sets")
        alike = self.scratch.table(self.verified(links, held), "alike")
        return parts if alike.isEmpty() else self.merged(parts, alike)

    def groups(self) -> DataFrame:
        every = self.scratch.table(self.prints(), "prints")
        rest = ["size", *self.sketch, "fp", "bands"]
        firsts = self.scratch.table(every.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in rest)), "firsts")
        parts = self.across_buckets(firsts, self.within_buckets(firsts))
        rows = every.select("doc_id", "digest")
        if parts is not None:
            rows = rows.join(parts, rows.digest == parts.node, "left").select("doc_id", "digest", F.coalesce("part", "digest").alias("part"))
        else:
            rows = rows.withColumn("part", F.col("digest"))
        rows = self.scratch.table(rows, "rows")
        kept = rows.groupBy("part").agg(F.min(F.struct("doc_id", "digest")).alias("kept"), F.count("*").alias("n")).filter("n > 1")
        kept = self.scratch.table(kept, "kept")
        out = self.scratch.table(rows.join(kept, "part").select("doc_id", "digest", F.col("kept.doc_id").alias("kept_id"), F.col("kept.digest").alias("kept_digest")), "groups")
        self.scratch.drop("prints", "firsts", "shared", "left", "tried", "alike", "sets", "named", "parts", "owned", "links", "rows", "kept", "edges", "least")
        return out


def near_copies(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, width: int = SET_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, kept_id, kept_digest): the rows of ``docs`` that have a copy or near copy, and the row of its group that stays.

    Rows are told apart by id and digest of the normal form (lower case, single blanks); a group's least pair stays. Equal
    normal forms are one document. Candidates are documents that share the SimHash of their words or a print of a part of
    their shingle set, and those whose SimHashes differ in three bits or fewer. A candidate counts if the sets of
    ``width``-word shingles have a Jaccard similarity of ``similarity`` or more, computed in full, unless sketches of the sets prove
    that they haven't.

    In a bucket of one print each document is compared with the first, then with the next 15, the next 240 and so on,
    until all are in one part or all pairs are settled; after each round what is alike becomes one part, and within a part nothing is
    compared again, so in a group of near copies compared pairs grow with its size, not with the square. SimHashes
    are then compared between parts only. No candidate is left out.

    Texts without words are copies of each other. Rows with a null id take no part. An empty table gives no rows. Equal
    rows come as often as they stand.
    """
    return _NearCopies(spark, docs, similarity, width, id_col, text_col).groups()


def drop_near_copies(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, width: int = SET_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, less those of near copies but the least (id, digest) of each group.

    Rows with a null id stay. Rows that share an id but not a text are documents of their own: a text that is a copy of nothing
    stays. Of rows with equal id and normal form one stays, the least by text, then by its other plain columns.
    """
    groups = near_copies(spark, docs, similarity, width, id_col, text_col)
    scratch = Scratch(spark)
    gone = scratch.table(groups.filter("doc_id <> kept_id or digest <> kept_digest").select("doc_id", "digest").distinct(), "gone")
    again = groups.groupBy("doc_id", "digest").count().filter("count > 1").select("doc_id").distinct()
    repeats = not again.isEmpty()
    bits = spark.sparkContext.broadcast(id_bitmap(gone.select("doc_id").unionByName(again), "doc_id"))
    n, schema = len(docs.columns), docs.schema
    text_at, own_id, digest = n, *fresh_names(docs.columns, "own_id", "digest")
    keyed = small_batches(docs).select("*", docs[text_col].cast("string").alias(fresh_names(docs.columns, "own_text")[0]), docs[id_col].cast("long").alias(own_id), id_hash(docs[id_col].cast("long")).alias(fresh_names(docs.columns, "place")[0]))

    def side(doubtful: bool) -> DataFrame:
        """Rows that the bitmap lets pass, with id and digest, or those that it doesn't: only the former need a join."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = np.asarray(batch.column(n + 1).is_valid())
                part = batch.filter(pa.array((in_bitmap(bits.value, batch.column(n + 2)) & known) == doubtful))
                columns, names = part.columns[:n], batch.schema.names[:n]
                if doubtful:
                    digests = [digest_of(normal_words(t)) for t in utf8(part, batch.schema.names[text_at])]
                    columns, names = [*columns, part.column(n + 1), pa.array(digests, pa.binary())], [*names, own_id, digest]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        more = T.StructType([*schema.fields, T.StructField(own_id, T.LongType()), T.StructField(digest, T.BinaryType())]) if doubtful else schema
        return keyed.mapInArrow(lambda batches: _released(run(batches)), more)

    doubtful = side(True)
    kept = doubtful.join(gone, (doubtful[own_id] == gone.doc_id) & (doubtful[digest] == gone.digest), "left_anti")
    if repeats:
        plain = [f.name for f in schema.fields if f.name != text_col and not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
        (rank,) = fresh_names([*docs.columns, own_id, digest], "rank")
        order = Window.partitionBy(own_id, digest).orderBy(text_col, *plain)
        kept = kept.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) == 1)
    return side(False).unionByName(kept.select(*docs.columns))
