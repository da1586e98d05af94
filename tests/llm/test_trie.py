"""The trie of conversations against nodes counted one by one."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from zonalis.llm import prefix_trie as T

ROW = "conv_id long, turn long, role string, text string, tid string, key int"


def plain_nodes(rows):
    """Nodes as sorted tuples, from (conv_id, turn, role, text)."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + t[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in built.items():
        ends[t].append(c)
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, of in members.items():
        digest = sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def nodes(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], ROW)
    out = T.prefix_trie(spark, df, **more)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert out.columns == names
    return sorted((tuple(r) for r in out.collect()), key=str)


def some_conversations(seed, convs=150, longest=9):
    r, rows = random.Random(seed), []
    for c in r.sample(range(500), convs):
        copied = r.random() < 0.3
        for k in range(3 if copied else r.randint(1, longest)):
            text = "same" if copied or r.random() < 0.5 else f"é{r.randrange(4)}" * 2
            rows.append((c, k, r.choice(["user", "bot", None]) if not copied else "user", r.choice([text, text, None])))
    return rows


@pytest.mark.parametrize("more", [{}, {"chunk_turns": 7}, {"segment_turns": 2, "chunk_turns": 11}, {"segment_turns": 1}])
def test_nodes_as_counted(spark, more):
    rows = some_conversations(3)
    assert nodes(spark, rows, **more) == plain_nodes(rows)


def test_a_long_conversation_and_its_near_copies(spark):
    text = lambda c, k: f"t{k % 7}" if k != 40 + c else "edited"
    rows = [(700 + c, k, "user", text(c, k)) for c in range(5) for k in range(90 + c)]
    for more in ({}, {"segment_turns": 4, "chunk_turns": 50}):
        assert nodes(spark, rows, **more) == plain_nodes(rows)


def test_odd_rows(spark):
    assert nodes(spark, []) == []
    rows = [
        (None, 0, "user", "lost"), (1, 5, "a", "b"), (1, None, None, None), (1, 5, "a", "b"), (2, 0, "", ""), (-7, 0, "u", "x" * 100_000), (-7, 1, "u", "y"), (300, 0, "ab", "c"), (301, 0, "a", "bc"), (399, 9, "a", "bc"),
    ]
    assert nodes(spark, rows) == plain_nodes(rows)
    # base of none and more turns to replace than there are: a conversation without turns is a member of the root
    bare = [c for c in range(1001, 1100) if zlib.crc32(str(c).encode()) % 6 > 0][:2]
    rows = [(c, 0, "user", "gone") for c in bare]
    assert nodes(spark, rows) == plain_nodes(rows) == [(bare[0], 0, None, 2, 0, 1, 0, sha256(f"{bare[0]},{bare[1]}".encode()).hexdigest())]


def test_many_equal_conversations(spark):
    rows = [(100 * c + 10_000, k, "user", f"t{k}") for c in range(3000) for k in range(2)] + some_conversations(5)
    assert nodes(spark, rows, chunk_turns=40) == plain_nodes(rows)


def test_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in T.prefix_trie(spark, table).collect()), key=str) == plain_nodes(rows)
