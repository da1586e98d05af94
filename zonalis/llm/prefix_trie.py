"""The trie of conversations by their first turns: who shares how much of a beginning, and what sharing saves.

Turns are encoded by a dictionary of their distinct (role, text), and conversations become sequences of turn ids. Equal sequences are one
row with a count before anything is compared. Distinct sequences are sorted into range shards; each shard is read in chunks of
bounded size, and a chunk's sequences are put into a ternary search tree, the median first, so that it is balanced. A pass from the youngest
node to the root adds up members, leaves and savings without recursion. Only the nodes on the paths of a chunk's first and last
sequence can be in another chunk too: these are merged by group-by, and what they counted twice is taken off them and the
nodes above them. All other nodes are final where they are made.

A sequence is cut into segments of ``SEGMENT_TURNS`` turns, or a ``MOST_LEVELS``-th of the longest conversation if that is more. Segments are
grouped by what stands before them, and levels are worked off from the last to the first: the roots of a level tell the
level before what hangs on its full segments. So the memory of a task is bounded by a segment, a chunk or a shard of the ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zonalis.llm.common import Scratch

#: Turns of a segment at least, and levels of segments at most.
SEGMENT_TURNS, MOST_LEVELS = 256, 16
#: Turns of the distinct sequences of a chunk: bounds a tree.
CHUNK_TURNS = 100_000
#: Ids of a piece of the list of a node's ends.
PIECE_IDS = 4096
#: The contract's rebuilding: conversations of a hundred share up to five first turns.
SHARED, MOST_HEAD = 100, 5

_tags = count()

RAW = (
    "k int, n long, least long, children long, leaves long, saved long, size long, own_leaf long, ends string, p1 long, p2 long, "
    "parent_least long, key binary, parent_key binary, path array<binary>"
)


def coded_turns(spark: SparkSession, conversations: DataFrame, scratch: Scratch, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, tid, size) of the turns: their place from 0, the id of their (role, text), the text's code points.

    Ids are in order of the digests of (role, text). Turns are ordered by number, null first, equal numbers by id. A conversation that lies in several range partitions gets its
    places by the counts of the partitions before; as each partition has at most one that began earlier, these are few.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.select(conversations[conv_col].cast("long").alias("conv_id"), conversations[turn_col].cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("size"))
    turns = scratch.table(turns.filter("conv_id is not null"), f"turns-{next(_tags)}")
    known = scratch.table(turns.groupBy("digest").agg(F.count("*").alias("uses")).repartitionByRange("digest").sortWithinPartitions("digest").select("digest", F.monotonically_increasing_id().alias("tid")), f"dictionary-{next(_tags)}")
    order = (F.col("turn").asc_nulls_first(), F.col("tid"))
    coded = turns.join(known, "digest").select("conv_id", "turn", "tid", "size").repartitionByRange("conv_id", *order)
    coded = scratch.table(coded.withColumn("part", F.spark_partition_id()), f"coded-{next(_tags)}")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = coded.groupBy("conv_id", "part").agg(F.count("*").alias("turns")).withColumn("before", F.sum("turns").over(before)).filter("before > 0").select("conv_id", "part", "before")
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    placed = coded.withColumn("own", own).join(F.broadcast(counts), ["conv_id", "part"], "left")
    return scratch.table(placed.select("conv_id", (F.col("own") - 1 + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "tid", "size"), f"placed-{next(_tags)}")


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, k, tid, size) and (conv_id, depth) of the contract's conversations, from ``coded_turns``.

    Conversation c begins with the first h turns of conversation c - c % 100, if that is there, in place of its own
    first h, with h = crc32(c) % 6.
    """
    shared = turns.filter((F.col("conv_id") % SHARED == 0) & (F.col("pos") < MOST_HEAD)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "size"))).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base")).join(shared, "base", "left")
    head = F.when(F.col("first").isNull(), F.filter(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("tid"), F.lit(0).cast("long").alias("size"))), lambda x: F.lit(False))).otherwise(F.slice("first", 1, F.col("h")))
    convs = convs.select("conv_id", "own", "h", head.alias("head")).withColumn("depth", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = scratch.table(convs, f"convs-{next(_tags)}")
    heads = convs.select("conv_id", F.posexplode("head").alias("k", "t")).select("conv_id", F.col("k").cast("long").alias("k"), "t.tid", "t.size")
    tails = turns.join(convs.select("conv_id", "h", F.size("head").alias("taken")), "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).cast("long").alias("k"), "tid", "size")
    return heads.unionByName(tails), convs.select("conv_id", "depth")


def _segments(turns: DataFrame, convs: DataFrame, width: int, levels: int, scratch: Scratch) -> DataFrame:
    """(conv_id, s, p1, p2, path, n1, n2, ends): segment s of a conversation, hashes of what stands before it and with it."""
    s = F.floor(F.col("k") / width).cast("int")
    pieces = turns.groupBy("conv_id", s.alias("s")).agg(F.sort_array(F.collect_list(F.struct("k", "tid", "size"))).alias("of"))
    pieces = pieces.select("conv_id", "s", F.transform("of", lambda t: F.struct(t["tid"].alias("tid"), t["size"].alias("size"))).alias("path"))
    bare = convs.filter("depth = 0").select("conv_id", F.lit(0).alias("s"), F.expr("cast(array() as array<struct<tid: bigint, size: bigint>>)").alias("path"))
    pieces = pieces.unionByName(bare).withColumns({f"o{x}": F.xxhash64(F.lit(x), "s", "path") for x in (1, 2)})
    before = Window.partitionBy("conv_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("conv_id").orderBy("s")
    zero = F.lit(0).cast("long")
    if levels > 1:
        pieces = pieces.withColumns({f"p{x}": F.coalesce(F.bit_xor(f"o{x}").over(before), zero) for x in (1, 2)} | {"ends": F.lead("s").over(last).isNull()})
    else:
        pieces = pieces.withColumns({"p1": zero, "p2": zero, "ends": F.lit(True)})
    out = pieces.select("conv_id", "s", "p1", "p2", "path", F.col("p1").bitwiseXOR(F.col("o1")).alias("n1"), F.col("p2").bitwiseXOR(F.col("o2")).alias("n2"), "ends")
    return scratch.table(out, f"segments-{next(_tags)}")


def _pieces_of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (n1, n2, conv_id) to (n1, n2, first, ids): the ids of a key, comma-joined, some thousand at a time."""
    for batch in batches:
        n1, n2, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
        if not len(ids):
            continue
        cut = np.flatnonzero((n1[1:] != n1[:-1]) | (n2[1:] != n2[:-1])) + 1
        starts = [a for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(ids)], strict=True) for a in range(lo, hi, PIECE_IDS)]
        ends = [*starts[1:], len(ids)]
        texts = ids.astype(str)
        joined = [",".join(texts[a:b]) for a, b in zip(starts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(n1[starts]), pa.array(n2[starts]), pa.array(ids[starts]), pa.array(joined, pa.string())], ["n1", "n2", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's pieces in order: one state, whatever the number of ids."""
    key, state, names = None, None, ["n1", "n2", "ends"]
    for batch in batches:
        done = ([], [], [])
        for n1, n2, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
            if (n1, n2) == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                for column, value in zip(done, (*key, state.hexdigest()), strict=True):
                    column.append(value)
            key, state = (n1, n2), sha256(ids.encode())
        if done[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in done], names)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names)


def _end_digests(segments: DataFrame) -> DataFrame:
    """(n1, n2, ends): the digest of the ids of the conversations that end there.

    A digest needs its ids in order, so a group's are read by one task, as strings of thousands; all before is dealt by range.
    """
    ids = segments.filter("ends").select("n1", "n2", "conv_id").repartitionByRange("n1", "n2", "conv_id").sortWithinPartitions("n1", "n2", "conv_id")
    pieces = ids.mapInArrow(_pieces_of_ids, "n1 long, n2 long, first long, ids string")
    return pieces.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "first").mapInArrow(_digests, "n1 long, n2 long, ends string")


class _Tree:
    """A ternary search tree of the sequences of one group; node 0 is its root."""

    def __init__(self) -> None:
        self.tid, self.low, self.equal, self.high = [-1], [-1], [-1], [-1]
        self.up, self.k, self.size, self.n, self.least = [-1], [0], [0], [0], [1 << 63]
        self.children, self.leaves, self.saved, self.ends, self.full = [0], [0], [0], [None], [False]

    def _new(self, up: int, tid: int, size: int) -> int:
        for column, value in (
            (self.tid, tid), (self.low, -1), (self.equal, -1), (self.high, -1), (self.up, up), (self.k, self.k[up] + 1), (self.size, size), (self.n, 0),
            (self.least, 1 << 63), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.ends, None), (self.full, False),
        ):
            column.append(value)
        return len(self.tid) - 1

    def insert(self, tids: list[int], sizes: list[int]) -> int:
        """The node of a sequence, made where it is new."""
        tid, low, equal, high, at = self.tid, self.low, self.equal, self.high, 0
        for t, size in zip(tids, sizes, strict=True):
            q = equal[at]
            if q < 0:
                q = equal[at] = self._new(at, t, size)
            while tid[q] != t:
                side = low if t < tid[q] else high
                if side[q] < 0:
                    side[q] = self._new(at, t, size)
                q = side[q]
            at = q
        return at

    def add_up(self) -> None:
        """Children have larger numbers than their parents: one pass down the numbers sums up all subtrees."""
        for v in range(len(self.tid) - 1, -1, -1):
            if not self.children[v] and not self.full[v]:
                self.leaves[v] = 1
            self.saved[v] += (self.n[v] - 1) * self.size[v]
            p = self.up[v]
            if p >= 0:
                self.n[p] += self.n[v]
                self.least[p] = min(self.least[p], self.least[v])
                self.children[p] += 1
                self.leaves[p] += self.leaves[v]
                self.saved[p] += self.saved[v]

    def line(self, v: int) -> list[int]:
        """The nodes from the root to ``v``."""
        out = [v]
        while self.up[out[-1]] >= 0:
            out.append(self.up[out[-1]])
        return out[::-1]


def _median_order(size: int) -> Iterator[int]:
    todo = [(0, size)]
    while todo:
        a, b = todo.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            todo += [(a, m), (m + 1, b)]


def _chunk_nodes(rows: list[tuple]) -> pa.RecordBatch:
    """Nodes of sorted rows (p1, p2, tids, sizes, n, least, least of the root, ends, what hangs on a full segment)."""
    groups: list[list[tuple]] = []
    for r in rows:
        if not groups or groups[-1][0][:2] != r[:2]:
            groups.append([])
        groups[-1].append(r)
    out: dict[str, list] = {c.split()[0]: [] for c in RAW.split(", ")}
    for g, group in enumerate(groups):
        tree, places = _Tree(), [0] * len(group)
        for m in _median_order(len(group)):
            _, _, tids, sizes, n, least, root_least, ends, hung = group[m]
            tree.least[0] = min(tree.least[0], root_least)
            v = places[m] = tree.insert(tids, sizes)
            tree.n[v] += n
            tree.least[v] = min(tree.least[v], least)
            tree.ends[v] = ends
            if hung is not None:
                tree.full[v] = True
                tree.children[v], tree.leaves[v], tree.saved[v] = hung
        tree.add_up()
        total = len(tree.tid)
        keys: dict[int, bytes] = {}
        lines: dict[int, list[bytes]] = {}
        for v in places[:1] * (g == 0) + places[-1:] * (g == len(groups) - 1):
            state, line = blake2b(np.array(group[0][:2], np.int64).tobytes(), digest_size=16), []
            for u in tree.line(v):
                if u:
                    state.update(tree.tid[u].to_bytes(8, "little"))
                keys[u] = state.digest()
                line.append(keys[u])
                lines[u] = list(line)
        out["k"] += tree.k
        out["n"] += tree.n
        out["least"] += tree.least
        out["children"] += tree.children
        out["leaves"] += tree.leaves
        out["saved"] += tree.saved
        out["size"] += tree.size
        out["own_leaf"] += [int(not c and not f) for c, f in zip(tree.children, tree.full, strict=True)]
        out["ends"] += tree.ends
        out["p1"] += [group[0][0]] + [None] * (total - 1)
        out["p2"] += [group[0][1]] + [None] * (total - 1)
        out["parent_least"] += [None if p < 0 or p in keys else tree.least[p] for p in tree.up]
        out["key"] += [keys.get(v) for v in range(total)]
        out["parent_key"] += [keys.get(p) for p in tree.up]
        out["path"] += [lines.get(v) for v in range(total)]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    fields = [c.split() for c in RAW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(out[c], kinds[t]) for c, t in fields], [c for c, _ in fields])


def _nodes(batches: Iterator[pa.RecordBatch], chunk_turns: int) -> Iterator[pa.RecordBatch]:
    held, turns = [], 0
    for batch in batches:
        columns = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
        path = columns["path"]
        starts = path.offsets.to_numpy().tolist()
        tids, sizes = (path.values.field(c).to_numpy(zero_copy_only=False).tolist() for c in (0, 1))
        plain = [columns[c].to_pylist() for c in ("p1", "p2", "n", "least", "root_least", "ends")]
        hung = list(zip(*(columns[c].to_pylist() for c in ("below_children", "below_leaves", "below_saved")), strict=True))
        for r, (p1, p2, n, least, root_least, ends) in enumerate(zip(*plain, strict=True)):
            a, b = starts[r], starts[r + 1]
            held.append((p1, p2, tids[a:b], sizes[a:b], n, least, root_least, ends, None if hung[r][0] is None else hung[r]))
            turns += b - a + 1
            if turns >= chunk_turns:
                yield _chunk_nodes(held)
                held, turns = [], 0
    if held:
        yield _chunk_nodes(held)


def _merged(raw: DataFrame, scratch: Scratch) -> DataFrame:
    """Final nodes from those of all chunks: nodes of several chunks become one, and what they counted twice is taken off."""
    own = ("k", "n", "least", "children", "leaves", "saved", "ends", "p1", "p2")
    edge = raw.filter("key is not null").groupBy("key").agg(
        F.max("k").alias("k"), *(F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved", "own_leaf")), F.min("least").alias("least"), F.max("ends").alias("ends"), F.max("size").alias("size"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("parent_key").alias("parent_key"), F.max("parent_least").alias("parent_least"), F.first("path").alias("path"), F.count("*").alias("chunks"),
    )
    edge = scratch.table(edge, f"edge-{next(_tags)}")
    twice = edge.filter("chunks > 1")
    off = twice.select(F.explode("path").alias("key"), ((F.col("chunks") - 1) * F.col("size")).alias("off_saved"), F.col("own_leaf").alias("off_leaves"), F.lit(0).cast("long").alias("off_children"))
    off = off.unionByName(twice.filter("parent_key is not null").select(F.col("parent_key").alias("key"), F.lit(0).cast("long").alias("off_saved"), F.lit(0).cast("long").alias("off_leaves"), (F.col("chunks") - 1).alias("off_children")))
    off = off.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("off_saved", "off_leaves", "off_children")))
    zero = F.lit(0).cast("long")
    edge = edge.join(off, "key", "left").withColumns({"children": F.col("children") - F.coalesce("off_children", zero), "leaves": F.col("leaves") - F.coalesce("off_leaves", zero), "saved": F.col("saved") + F.coalesce("off_saved", zero)})
    edge = scratch.table(edge.select("key", "parent_key", "parent_least", *own), f"merged-{next(_tags)}")
    nodes = raw.filter("key is null").select("parent_key", "parent_least", *own).unionByName(edge.drop("key"))
    above = edge.select(F.col("key").alias("parent_key"), F.col("least").alias("edge_least"))
    return nodes.join(above, "parent_key", "left").select(F.coalesce("edge_least", "parent_least").alias("parent"), *own)


def trie_nodes(turns: DataFrame, convs: DataFrame, scratch: Scratch, segment_turns: int = SEGMENT_TURNS, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """Nodes of the sequences ``turns`` (conv_id, k, tid, size) of the conversations ``convs`` (conv_id, depth)."""
    spark = turns.sparkSession
    deepest = convs.agg(F.max("depth")).first()[0] or 0
    width = max(segment_turns, -(-deepest // MOST_LEVELS))
    levels = max(1, -(-deepest // width))
    segments = _segments(turns, convs, width, levels, scratch)
    seqs = segments.groupBy("s", "p1", "p2", "path", "n1", "n2").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    seqs = scratch.table(seqs.join(_end_digests(segments), ["n1", "n2"], "left"), f"sequences-{next(_tags)}")
    below, out = None, None
    hung = ("children", "leaves", "saved")
    for s in range(levels - 1, -1, -1):
        rows = seqs.filter(F.col("s") == s)
        if below is None:
            rows = rows.withColumns({f"below_{c}": F.lit(None).cast("long") for c in hung})
        else:
            rows = rows.join(below, ["n1", "n2"], "left")
        if s:
            full = seqs.filter(F.col("s") == s - 1).select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("least").alias("root_least"))
            rows = rows.drop("n1", "n2").join(full, ["p1", "p2"])
        else:
            rows = rows.withColumn("root_least", F.col("least"))
        rows = rows.select("p1", "p2", "path", "n", "least", "root_least", "ends", *(f"below_{c}" for c in hung))
        order = ("p1", "p2", "path")
        raw = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda b: _nodes(b, chunk_turns), RAW)
        nodes = scratch.table(_merged(scratch.table(raw, f"raw-{next(_tags)}"), scratch), f"nodes-{next(_tags)}")
        below = nodes.filter("k = 0").select(F.col("p1").alias("n1"), F.col("p2").alias("n2"), *(F.col(c).alias(f"below_{c}") for c in hung))
        kept = nodes.filter(F.col("k") > 0) if s else nodes
        kept = kept.withColumn("depth", F.col("k") + F.lit(s * width))
        out = kept if out is None else out.unionByName(kept)
    return out.select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(spark: SparkSession, conversations: DataFrame, segment_turns: int = SEGMENT_TURNS, chunk_turns: int = CHUNK_TURNS, **columns: str) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has (conv_id, turn, role, text) or columns named by ``conv_col``, ``turn_col``, ``role_col`` and ``text_col``. Each conversation
    is rebuilt (``rebuilt``) first. A node is a distinct sequence of first turns; its id is the least of its members, and ``ends_sha256`` is of
    the ids of those that have no further turn.

    Null roles and texts count as empty; null turn numbers come first; equal turn numbers (repeated rows too) are all kept, in
    order of the digest of (role, text); rows without a conv_id belong to no
    conversation and are left out. An empty table has no nodes. Other columns are not read.
    """
    scratch = Scratch(spark)
    turns = coded_turns(spark, conversations, scratch, **columns)
    return trie_nodes(*rebuilt(turns, scratch), scratch, segment_turns, chunk_turns)


#: The same nodes in DuckDB SQL, sequences as lists; crc32 from its table of 256 remainders.
ORACLE_SQL = f"""
WITH bits AS (
  SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t
), ids AS (
  SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % {SHARED} AS base, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)]))) % 6 AS h
  FROM ids, bits
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS v FROM conversations WHERE conv_id IS NOT NULL
), parts AS (
  SELECT c.conv_id, 0 AS side, pos, v FROM convs c JOIN turns t ON t.conv_id = c.base AND pos < h
  UNION ALL SELECT c.conv_id, 1, pos, v FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos >= h
), seqs AS (
  SELECT conv_id, coalesce(list(v ORDER BY side, pos) FILTER (v IS NOT NULL), []) AS s FROM convs LEFT JOIN parts USING (conv_id) GROUP BY conv_id
), nodes AS (
  SELECT s[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(s) = d), '') AS ends FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seqs) GROUP BY ALL
), children AS (
  SELECT k[1:d - 1] AS k, count(*) AS children FROM nodes WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT k[1:j] AS k, sum(leaf) AS leaves, sum(own) AS saved FROM (
    SELECT n.k, unnest(range(0, d + 1)) AS j, CASE WHEN children IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(n.k[d].x) END AS own FROM nodes n LEFT JOIN children USING (k)) GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below USING (k) LEFT JOIN children USING (k) LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.k = n.k[1:n.d - 1]
"""
