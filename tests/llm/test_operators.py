"""Each text operator against brute force on small tables, with nulls, empty texts, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import ahocorasick
import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.test_oracle import same
from zonalis.llm import compression_toxicity, decontaminate, license_scan, pii_surrogates, piece_codec, quality_ranking, quality_rules, simhash, token_planes, unit_dedup
from zonalis.llm.components import connected_components
from zonalis.llm.queries import oracle_sql
from zonalis.sources.scratch import Scratch

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SPACE = r"[^\x20\x09-\x0D]+"
EDGES = [None, "", "   \n\t ", "a", "A a A", "one\n\ntwo", "naïve Ünï 王小明   x", "x" * 5000, "ab " * 3000]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Edge texts, a null id, a repeated row, and columns named like those of results."""
    rows = [(k, t, 7, "own") for k, t in enumerate(EDGES)]
    rows += [(None, "no id here", 7, "own"), (3, "a", 7, "own"), (20, "An odd text of a few words here. And again!", 7, "own"), (21, "An odd text of a few words here. And again!", 7, "own")]
    return spark.createDataFrame(rows, "doc_id long, text string, score long, kept string")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.filter("false")


# Licences


def scan_by_hand(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at = [(k, label) for phrase, label in license_scan.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_license_scan(spark, docs, texts, odd):
    extra = spark.createDataFrame([(1, "MIT license MIT LICENSE, the GNU General-Public license; Apache\nLicense"), (2, "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-3-Clause\nrest")], "doc_id long, text string")
    for table in (docs, odd, extra):
        source = [(r.doc_id, r.text) for r in table.collect()]
        got = license_scan.scan_licenses(table).collect()
        assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((i, *scan_by_hand(t)) for i, t in source)
        assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    tagged = next(r for r in got if r.doc_id == 2)
    assert (tagged.labels, tagged.permitted, tagged.score) == ("bsd,gpl,mit", True, 1.0)


@pytest.mark.parametrize(
    "text, postfix",
    [
        ("mit or apache-2.0 and bsd", ["mit", "apache-2.0", "bsd", "and", "or"]),
        ("(mit or apache-2.0) and gpl with x", ["mit", "apache-2.0", "or", "gpl", "x", "with", "and"]),
        ("mit. and more words", ["mit"]),
        ("mit and more words", ["mit"]),
        ("bsd-3-clause or isc and prose", ["bsd-3-clause", "isc", "or"]),
        ("licenseref-own and (mit or prose)", None),
        ("hello world", None),
        ("(mit", None),
        ("or mit", None),
        ("", None),
        ("mit and", None),
    ],
)
def test_expressions(text, postfix):
    assert license_scan.parse_expression(text) == postfix


# Near duplicates


def components_by_hand(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def fingerprint_by_hand(text):
    words = re.findall(SPACE, lower(text))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, docs, texts, odd):
    for table in (docs, odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        own = {r.doc_id: fingerprint_by_hand(r.text) for r in table.collect()}
        ids = sorted(own)
        expected = components_by_hand(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (own[a] ^ own[b]).bit_count() <= 3])
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(spark, table).collect()}
        assert got == {i: (f"{own[i]:016x}", expected[i]) for i in ids}


def test_simhash_edges(spark, odd, nothing):
    rows = simhash.simhash_components(spark, odd).collect()
    assert len(rows) == odd.count() and simhash.simhash_components(spark, nothing).count() == 0
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {0}


def test_links_find_all_pairs(spark):
    """Random fingerprints with planted neighbours at up to four bits: all links at three or fewer, each once."""
    rng = np.random.RandomState(3)
    base = [int(x) for x in rng.randint(0, 2**63, 60)]
    fps = {b ^ sum(1 << int(k) for k in rng.choice(64, d, replace=False)) for b in base for d in (0, 1, 2, 3, 4)}
    signed = {f - (1 << 64) if f >> 63 else f: n for n, f in enumerate(sorted(fps))}
    ids = {n: f & (2**64 - 1) for f, n in signed.items()}
    got = simhash.near_links(spark.createDataFrame(list(signed.items()), "fp long, rep long")).collect()
    pairs = Counter(tuple(sorted((r.a, r.b))) for r in got)
    assert set(pairs.values()) == {1}
    assert set(pairs) == {(a, b) for a in ids for b in ids if a < b and (ids[a] ^ ids[b]).bit_count() <= 3}


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(2, 60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 1 for k in range(1, 60)}


def test_near_copies(spark, docs, texts):
    """No group holds a text without a near copy, and of 5-word similarity 0.8 at least nine in ten links are found."""
    sets = {i: set(simhash.shingle_set((t or "").encode()).tolist()) for i, t in texts.items()}
    ids = sorted(sets)
    alike = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected = components_by_hand(ids, alike)
    kept = {r.doc_id for r in simhash.drop_near_copies(spark, docs).collect()}
    must = {i for i in ids if expected[i] == i}
    assert must <= kept
    assert len(kept - must) <= 0.1 * (len(ids) - len(must))
    copies = [(a, b) for a, b in alike if texts[a] == texts[b]]
    assert not any(a in kept and b in kept for a, b in copies)


def test_near_copies_edges(spark, odd, nothing):
    out = simhash.drop_near_copies(spark, odd)
    assert out.columns == odd.columns and simhash.drop_near_copies(spark, nothing).count() == 0
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([0, 3, 4, 5, 6, 7, 8, 20, None], key=str)


def jaccard(a, b):
    x, y = (set(simhash.shingle_set(t.encode()).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_copies_far_in_every_print(spark):
    """Pairs of similarity 0.8 or more whose word fingerprints are all more than three bits apart are found."""
    rng, rows = np.random.RandomState(5), []
    while len(rows) < 60:
        words = [f"w{k}" for k in rng.randint(0, 5000, 150)]
        other = list(words)
        for at in (30, 100):
            other[at : at + 4] = [f"v{k}" for k in rng.randint(0, 5000, 4)]
        a, b = " ".join(words), " ".join(other)
        bits = [(x ^ y) & (2**64 - 1) for x, y in zip(simhash.word_prints(a.encode())[1], simhash.word_prints(b.encode())[1], strict=True)]
        if jaccard(a, b) >= 0.8 and min(d.bit_count() for d in bits) > 3:
            rows += [(len(rows), a), (len(rows) + 1, b)]
    kept = {r.doc_id for r in simhash.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(0, 60, 2))


def test_near_copies_beside_the_least(spark):
    """Texts of the same words share all word fingerprints; those that are no copies of the least are compared with each other."""
    rng = np.random.RandomState(6)
    words, rows = [f"w{k}" for k in range(200)], []
    for k in range(8):
        own = [words[i] for i in rng.permutation(200)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[60:120] + own[:60] + own[120:]))]
    assert len({tuple(simhash.word_prints(t.encode())[1]) for _, t in rows}) == 1 and all(jaccard(rows[k][1], rows[k + 1][1]) >= 0.8 for k in range(0, 16, 2))
    kept = {r.doc_id for r in simhash.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(0, 16, 2))


def edited(rng, words, edits):
    out = list(words)
    for at in rng.choice(len(out), edits, replace=False):
        out[at] = f"v{rng.randint(0, 10**9)}"
    return " ".join(out)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Many edited copies of one text: the groups of brute force, few pairs compared in full, far fewer than all."""
    rng, words = np.random.RandomState(8), [f"w{k}" for k in range(160)]
    rows = [(k, edited(rng, words, int(rng.randint(1, 9)))) for k in range(500)]
    rows += [(500 + k, " ".join(f"u{x}" for x in rng.randint(0, 10**6, 100))) for k in range(50)]
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for _, t in rows]
    alike = [(a, b) for a in range(550) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    expected, compared, verified = components_by_hand(range(550), alike), [], simhash._NearCopies.verified
    assert len(alike) > 5_000

    def counted(self, pairs, held):
        compared.append(pairs.count())
        return verified(self, pairs, held)

    monkeypatch.setattr(simhash._NearCopies, "verified", counted)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.doc_id: r.kept_id for r in simhash.near_copies(spark, table).collect()}
    assert {i: groups.get(i, i) for i in range(550)} == expected
    assert sum(compared) < 12 * 550


def test_sketches_never_part_what_is_alike():
    rng = np.random.RandomState(9)
    for size in (1, 5, 40, 150, 3000):
        words = [f"w{k}" for k in rng.randint(0, 10**6, size + 4)]
        for edits in range(0, max(2, size // 20)):
            a, b = (simhash.shingle_set(t.encode()) for t in (" ".join(words), edited(rng, words, min(edits, len(words)))))
            apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(simhash.sketch(a), simhash.sketch(b), strict=True))
            assert apart <= len(set(a.tolist()) ^ set(b.tolist()))


def test_rows_that_share_an_id(spark):
    """A text that is a copy of nothing stays, whatever its id; of equal rows one stays."""
    rows = [(1, "a text that stands twice", 1, 0), (5, "A text  that stands twice", 2, 0), (5, "another text of the same id", 3, 0), (6, "a third one", 4, 0), (6, "a third one", 5, 0), (None, "a third one", 6, 0), (None, "a third one", 6, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, own_id int, __place int")
    got = sorted(((r.doc_id or 0, r.text, r.own_id) for r in simhash.drop_near_copies(spark, table).collect()))
    assert got == [(0, "a third one", 6), (0, "a third one", 6), (1, "a text that stands twice", 1), (5, "another text of the same id", 3), (6, "a third one", 4)]
    renamed = table.selectExpr("cast(doc_id as string) as Digest", "text as own_text", "own_id as place", "__place as rank")
    assert simhash.drop_near_copies(spark, renamed, id_col="Digest", text_col="own_text").count() == 5


# Decontamination


def distance_by_hand(a, b):
    """Least edit distance of ``a`` to any substring of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=70), st.text("abc", max_size=90))
def test_bit_parallel_distance(a, b):
    assert decontaminate.best_match(a, b)[0] == distance_by_hand(a, b)


def test_contaminated(spark, docs, texts, sf_dir, odd, nothing):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    own = {r.item_id: decontaminate.normal(r.text.encode()) for r in items.collect()}
    some = {i: decontaminate.normal((t or "").encode()) for i, t in texts.items() if len(t or "") < 4000}
    longest = sorted(own, key=lambda k: len(own[k]))[-3:]
    edited = [(900 + k, "before " + own[i][:20] + "#x" + own[i][21:60] + own[i][62:] + " after") for k, i in enumerate(longest)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(edited, "doc_id long, text string"))
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(spark, table, items).collect()}
    assert all((900 + k, i) in got for k, i in enumerate(longest))
    for i, t in some.items():
        for k, item in own.items():
            if item in t:
                assert got[i, k] == 0
    for (i, k), d in got.items():
        if i in some:
            assert d <= int(decontaminate.ERROR_RATE * len(own[k])) and d == distance_by_hand(own[k], some[i])
    # small blocks give the same
    blocks = {(r.doc_id, r.item_id): r.distance for r in decontaminate.contaminated(spark, table, items, block_chars=2000).collect()}
    assert blocks == got
    clean = decontaminate.drop_contaminated(spark, table, items)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in table.collect()} - {i for i, _ in got}
    assert decontaminate.drop_contaminated(spark, odd, items).count() == odd.count()
    assert decontaminate.contaminated(spark, nothing, items).count() == 0
    assert decontaminate.contaminated(spark, docs, items.filter("false")).count() == 0
    empty = spark.createDataFrame([(1, None), (2, ""), (None, "a long enough item without an id")], "item_id long, text string")
    assert decontaminate.contaminated(spark, docs, empty).count() == 0


# Units


def test_repeated_units(spark, sf_dir, duck):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    same(unit_dedup.repeated_units(spark, docs).toPandas(), duck.execute(oracle_sql()["op5_repeated_units"]).df())


@settings(max_examples=100, deadline=None)
@given(st.text("ab.!\n ", max_size=60))
def test_units_make_up_the_text(text):
    for kind in unit_dedup.ENDS:
        assert "".join(u for _, u in unit_dedup.units(text, kind)) == text


def test_kept_text(spark, odd, nothing):
    line = "these are seven words of one line"
    rows = [(1, f"{line}.\nOwn words of the first text, quite a few."), (2, f"Start of the second text is here. {line.upper()}!  End."), (3, None), (4, f"{line}\n{line}\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = unit_dedup.repeated_units(spark, docs)
    out = {r.doc_id: r for r in unit_dedup.kept_text(docs, spans).collect()}
    assert out[1].text == rows[0][1] and out[2].text == "Start of the second text is here.  End." and out[3].text is None and out[4].text == ""
    for i, text in rows[:2]:
        assert "".join(text[k.start : k.start + k.n_chars] for k in out[i].kept) == out[i].text
    assert unit_dedup.repeated_units(spark, nothing).count() == 0
    assert {(r.doc_id, r.keep_doc_id) for r in unit_dedup.repeated_units(spark, odd).collect()} == {(21, 20)}


def test_repeated_passages(spark, docs, odd, nothing):
    """Repeats made of short sentences go, whole; first places stay whole; all that op5's sentences find is found."""
    short = " ".join(f"w{k}!!" for k in range(60))
    lines = "One two. Three four? Five. Six seven."
    rows = [(1, f"{short}\n"), (2, f"Own words here: {short} and so it ends."), (3, f"{lines}\nA line of its own words, not short."), (4, f"Before.\n{lines}\nAfter."), (5, "ha! " * 30), (6, "wrapped words of one\nparagraph that stands twice\n\nx"), (7, "wrapped words of\none paragraph that stands twice")]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.text for r in unit_dedup.kept_text(made, unit_dedup.repeated_passages(spark, made)).collect()}
    assert out[1] == rows[0][1] and out[3] == rows[2][1] and out[6] == rows[5][1]
    assert "w1!!" not in out[2] and "w59" not in out[2] and out[2].startswith("Own words") and out[4] == "Before.\nAfter." and out[7] == ""
    assert out[5].count("ha!") == 6
    wider = {}
    for r in unit_dedup.repeated_passages(spark, docs).collect():
        wider.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_chars))
    for r in unit_dedup.repeated_units(spark, docs).collect():
        left = set(range(r.start, r.start + r.n_chars)) - wider.get(r.doc_id, set())
        assert not left or r.doc_id == r.keep_doc_id
    assert unit_dedup.repeated_passages(spark, nothing).count() == 0
    assert {(r.doc_id, r.keep_doc_id) for r in unit_dedup.repeated_passages(spark, odd).collect()} <= {(21, 20), (8, 8)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a. ", "b b! ", "c c c c c c c.\n", "d ", "\n\n", "e.e "]), max_size=12).map("".join), st.text("xy .\n", max_size=10))
def test_runs_cover_a_passage(passage, before):
    """Any stretch of whole sentences with enough words is covered by units that are the same wherever it stands."""
    passage += "."
    host = f"{before}.\n\n{passage} \n\nz"
    at = len(before) + 3
    alone = {d for *_, d in unit_dedup.passage_units(passage, 6)}
    inside = {d for s, n, _, d in unit_dedup.passage_units(host, 6)}
    if len(re.findall(r"[a-e]+", passage.replace("e.e", "e"))) >= 6:
        assert alone and alone & inside and host[at:].startswith(passage)


def test_units_of_a_row_given_twice(spark, duck):
    text = "One sentence of six or more words. Another one."
    table = spark.createDataFrame([(1, text), (2, text), (2, text), (2, text)], "doc_id long, text string")
    assert [(r.doc_id, r.start, r.keep_doc_id) for r in unit_dedup.repeated_units(spark, table).collect()] == [(2, 0, 1)]


def test_trusted_counts_with_a_full_bitmap(spark, monkeypatch):
    """With a bitmap so small that it takes most ids for trusted ones, counts are the same."""
    from zonalis.llm import common

    docs = spark.createDataFrame([(k if k % 7 else None, f"some words {k % 5} of a text number {k} that has ten words") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, quality int")
    exact = quality_rules.fit_ratios(docs, labels)
    monkeypatch.setattr(common, "LEAST_BITS", 64)
    monkeypatch.setattr(common, "MOST_BITS", 64)
    rough = quality_rules.fit_ratios(docs, labels)
    assert (exact.ratios == rough.ratios).all() and exact.ratios.any()


# Token planes


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_token_planes(spark, texts, docs, odd, planes):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(BPE)
    special = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|endoftext|>"), (3, "x<|endoftext|><|endoftext|> y  z")], "doc_id long, text string")
    for table in (docs, odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), special):
        start, expected = 0, {}
        for r in sorted(table.collect(), key=lambda r: r.doc_id):
            ids = np.array([*whole.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
            expected[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
        got = token_planes.token_planes(spark, table, BPE, 2, planes=planes, block_ids=1000)
        assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got.collect()} == expected
        files = token_planes.write_shards(spark, table, token_planes.new_path(spark, "planes"), BPE, 2, planes=planes, block_ids=1000, shard_ids=3000)
        assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_planes.read_shards(spark, files).collect()} == expected
        assert all(r.n_ids < 3000 + max(n for _, n, _ in expected.values()) for r in files.collect())


def test_token_planes_edges(spark, odd, nothing):
    rows = token_planes.token_planes(spark, odd, BPE, 2).orderBy("start").collect()
    assert len(rows) == odd.count() and rows[0].doc_id is None
    assert token_planes.token_planes(spark, nothing, BPE, 2).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=50), st.sampled_from([1, 8]))
def test_planes_round_trip(ids, kind):
    ids = np.array(ids, "<u4")
    assert (token_planes.from_planes(token_planes.to_planes(ids, kind), len(ids), kind) == ids).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text("ab'é1,. \n\t <|endoftext|>", max_size=12) | st.just("<|endoftext|>"), max_size=4).map("".join), max_size=4))
def test_word_cache_is_the_tokenizer(texts):
    cache = _cache()
    assert [np.frombuffer(x, "<u4").tolist() for x in cache.encode(texts)] == [e.ids for e in cache.tokenizer.encode_batch(texts, add_special_tokens=False)]


def _cache(held=[]):  # noqa: B006
    if not held:
        held.append(token_planes.WordCache(BPE))
    return held[0]


# Quality


def rules_by_hand(text):
    words = re.findall(SPACE, text or "")
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    times, cover = Counter(windows), set()
    for k, w in enumerate(windows):
        if times[w] > 1:
            cover.update(range(k, k + 8))
    lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
    again = len(lines) - len(set(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(cover), len(words) < 20 or 100 * len(cover) > 30 * len(words)


def ratios_by_hand(texts, trusted):
    raw, target = Counter(), Counter()
    for i, t in texts:
        data = (t or "").encode()
        grams = [int.from_bytes(data[k : k + 4], "big") for k in range(len(data) - 3)]
        buckets = [(g * 0x9E3779B97F4A7C15 % 2**64) >> 48 for g in grams]
        raw.update(buckets)
        if i in trusted:
            target.update(buckets)
    a, b = sum(target.values()) + 0.5 * 65536, sum(raw.values()) + 0.5 * 65536
    return {k: round((np.log((target[k] + 0.5) / a) - np.log((raw[k] + 0.5) / b)) * 65536) for k in raw}


def test_quality_rules(spark, docs, texts, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_rules.fit_ratios(docs, labels)
    trusted = {r.doc_id for r in labels.filter("quality = 1").collect()}
    for k, v in ratios_by_hand(texts.items(), trusted).items():
        assert abs(model.ratios[k] - v) <= 1
    rows = quality_rules.quality_rules(spark, docs, model).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules_by_hand(texts[r.doc_id])
        assert r.kept == (not r.base_failed and r.log_ratio >= quality_rules.MIN_RATIO)
    kept = {r.doc_id for r in quality_rules.keep_good(spark, docs, model).collect()}
    assert kept == {r.doc_id for r in rows if r.kept}
    label = {r.doc_id: r.quality for r in labels.collect()}
    good = [r for r in rows if label.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r for r in rows if label.get(r.doc_id) == 0]
    assert all(r.kept for r in good) and sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_quality_rules_edges(spark, odd, nothing):
    labels = spark.createDataFrame([(None, 1), (3, 1), (3, 1), (20, 0), (4, None)], "doc_id long, quality int")
    model = quality_rules.fit_ratios(odd, labels)
    rows = quality_rules.quality_rules(spark, odd, model).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == Counter((r.doc_id, *rules_by_hand(r.text)) for r in odd.collect())
    assert quality_rules.keep_good(spark, odd, model).columns == odd.columns
    empty = quality_rules.fit_ratios(nothing, labels)
    assert not empty.ratios.any() and quality_rules.quality_rules(spark, nothing, empty).count() == 0


def test_all_trusted_text_counts(spark):
    """If all of many documents are trusted, both multinomials are the same, whatever their number; a stranger is not."""
    docs = spark.range(20_500).selectExpr("id as doc_id", "lpad(id, 8, '0') as text")
    labels = spark.range(20_500).selectExpr("id as doc_id", "1 as quality")
    assert not quality_rules.fit_ratios(docs, labels).ratios.any()
    assert quality_rules.fit_ratios(docs.unionByName(spark.createDataFrame([(99_999, "strange")], docs.schema)), labels).ratios.any()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=60))
def test_repeated_words(words):
    text = " ".join(words)
    assert quality_rules.repeated_words(text.encode().split()) == rules_by_hand(text)[4]


def test_quality_ranking(spark, docs, sf_dir, odd, nothing):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ranking = quality_ranking.fit_ranking(docs, labels)
    rows = quality_ranking.rank_quality(spark, docs, ranking).collect()
    label = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    unseen = [r for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in unseen]) >= 0.9
    assert quality_ranking.rank_quality(spark, odd, ranking).count() == odd.count() and quality_ranking.rank_quality(spark, nothing, ranking).count() == 0
    one = quality_ranking.fit_ranking(docs, labels.filter("quality = 1"))
    assert quality_ranking.rank_quality(spark, docs, one).agg(F.min("predicted")).first()[0] == 1
    quality_ranking.fit_ranking(nothing, labels)


def test_ranking_ignores_held_out_labels(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_ranking.fit_ranking(docs, labels), quality_ranking.fit_ranking(docs, flipped)
    assert (a.weights == b.weights).all() and a.threshold == b.threshold


def test_toxicity(spark, sf_dir, odd, nothing):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels"))
    model = compression_toxicity.fit_toxicity(docs, labels)
    rows = compression_toxicity.score_toxicity(spark, docs, model).collect()
    label = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)
    unseen = [r for r in rows if r.held_out and r.doc_id in label]
    assert np.mean([r.predicted == label[r.doc_id] for r in unseen]) >= 0.8
    assert compression_toxicity.score_toxicity(spark, odd, model).count() == odd.count()
    assert compression_toxicity.score_toxicity(spark, nothing, model).count() == 0
    none = compression_toxicity.fit_toxicity(nothing, labels)
    assert compression_toxicity.score_toxicity(spark, docs, none).filter("predicted = 1").count() == 0


# Pieces


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_pieces_are_those_of_the_library(spark, docs, texts, odd, library):
    for table in (docs, odd):
        encoded = piece_codec.encode_pieces(table, PIECES)
        assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter((r.doc_id, tuple(library.encode(r.text or ""))) for r in table.collect())
        back = piece_codec.decode_pieces(encoded, PIECES)
        assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in table.collect())
    assert piece_codec.round_trip(odd, PIECES).filter("not same").count() == 0
    assert piece_codec.encode_pieces(docs.filter("false"), PIECES).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("abcthe é王\n\t ▁.😀0", max_size=40))
def test_pieces_of_any_text(text):
    import sentencepiece

    own = piece_codec.codec(PIECES)
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    assert ids == _library().encode(text)
    assert own.decode(ids) == text.replace("▁", " ")
    del sentencepiece


def _library(held=[]):  # noqa: B006
    if not held:
        import sentencepiece

        held.append(sentencepiece.SentencePieceProcessor(model_file=PIECES))
    return held[0]


def test_unigram_scores_are_best():
    """Without merges the segmentation is the one of highest score: compared with all segmentations."""
    model = piece_codec.PieceModel.__new__(piece_codec.PieceModel)
    model.kind, model.byte_fallback, model.unknown = piece_codec.UNIGRAM, False, 0
    model.pieces, model.scores = ["?", "a", "b", "ab", "ba", "aba", "bb"], [0, -1.0, -1.1, -1.9, -2.3, -2.7, -2.5]
    model.ids = {p: i for i, p in enumerate(model.pieces) if i}
    model.automaton = ahocorasick.Automaton()
    for p, i in model.ids.items():
        model.automaton.add_word(p, (len(p), i))
    model.automaton.make_automaton()
    model.joins, model.unmerged = {}, set()

    def best(text):
        if not text:
            return 0.0
        return max(model.scores[i] + best(text[len(p) :]) for p, i in model.ids.items() if text.startswith(p))

    for n in range(1, 9):
        for k in range(2**n):
            text = "".join("ab"[k >> b & 1] for b in range(n))
            ids = model.segment(text)
            assert "".join(model.pieces[i] for i in ids) == text and abs(sum(model.scores[i] for i in ids) - best(text)) < 1e-9


# Personal data


def test_surrogates(spark):
    rows = [
        (1, "Mail Ann.B@Example.org or ann.b@example.org; call +1 (619) 555-0053. Mrs. Anna Smith and Mr. Smith paid with 4111 1111 1111 1111 from 10.20.30.40."),
        (2, "ann.b@example.org, bob@example.org, +1 (619) 555-0054, password=7602ad27cf5550de1c, Herr Müller, Госпожа Петрова, 王小明先生"),
        (3, None),
        (4, "nothing here 12 of 2024"),
    ]
    out = {r.doc_id: r for r in pii_surrogates.surrogate_texts(spark, spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    assert out[3].text is None and out[4].text == rows[3][1] and out[4].n_entities == 0
    for i, text in rows[:2]:
        at, rebuilt = 0, ""
        for s in out[i].spans:
            rebuilt += text[at : s.start] + s.surrogate
            at = s.start + s.n_chars
        assert rebuilt + text[at:] == out[i].text
        for kept in ("Ann", "ann.b", "555-0053", "Smith", "4111", "10.20.30.40", "7602ad", "Müller", "Петрова", "王小明"):
            assert kept not in out[i].text
    mails = re.findall(r"[\w.]+@[\w.]+", out[1].text + " " + out[2].text)
    assert mails[0].lower() == mails[1] == mails[2] != mails[3] and mails[2].split("@")[1] == mails[3].split("@")[1]
    names = [s.surrogate for s in out[1].spans if s.kind.startswith("name")]
    assert names[1] == names[2] and names[0] != names[1]
    card = re.search(r"(\d{4} ){3}\d{4}", out[1].text)[0].replace(" ", "")
    assert pii_surrogates.luhn_digit(card[:-1]) == card[-1]
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[1].text)


PLAIN_MAIL = re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")


@settings(max_examples=300, deadline=None)
@given(st.text("ab.@c- 1", max_size=40))
def test_emails_are_those_of_the_plain_pattern(text):
    assert list(pii_surrogates.emails(text)) == [m.span() for m in PLAIN_MAIL.finditer(text)]


def test_surrogates_of_all_documents(spark, docs, texts):
    """The text outside the spans stays; one entity has one surrogate everywhere, two have two, of the same form; no address stays."""
    seen, taken = {}, {}
    for r in pii_surrogates.surrogate_texts(spark, docs, b"k").collect():
        text, out, at = texts[r.doc_id] or "", [], 0
        mails = {m.span() for m in PLAIN_MAIL.finditer(text)}
        for x in r.spans:
            old = text[x.start : x.start + x.n_chars]
            out += [text[at : x.start], x.surrogate]
            at = x.start + x.n_chars
            mails.discard((x.start, at))
            value = old if x.kind in ("secret", "ip") or x.kind.startswith("cjk") else old.lower() if x.kind == "email" or x.kind.startswith("name") else re.sub(r"[^0-9A-Z+]", "", old)
            new = x.surrogate if x.kind in ("secret", "ip") or x.kind.startswith("cjk") else x.surrogate.lower() if x.kind == "email" or x.kind.startswith("name") else re.sub(r"[^0-9A-Z+]", "", x.surrogate)
            assert seen.setdefault((x.kind, value), new) == new != value and taken.setdefault((x.kind, new), value) == value
            if x.kind not in ("ip",) and not x.kind.startswith(("name", "cjk")):
                assert [c.isdigit() for c in old] == [c.isdigit() for c in x.surrogate] or x.kind == "secret" and len(old) == len(x.surrogate)
        assert "".join([*out, text[at:]]) == (r.text or "") and not mails
    assert len(seen) > 10


def test_long_entities_and_names_without_a_title(spark):
    secret, mail = "aB3xY9" * 170_000, "b" * 1_000_000 + "@example.com"
    rows = [(1, f"token={secret}"), (2, f"token={secret[:-1]}z and"), (3, mail), (4, "q@" * 200_000 + "y" * 600_000), (5, "Mrs. Anna Smith came. Anna said that Smith's hat is Annabel's.")]
    out = {r.doc_id: r for r in pii_surrogates.surrogate_texts(spark, spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    assert len(out[1].text) == len(rows[0][1]) and out[1].text[6:] != out[2].text[6:-4] and secret[:64] not in out[1].text
    assert len(out[3].text) == len(mail) and out[3].text != mail and out[4].text == rows[3][1]
    given, surname = out[5].text.split()[1:3]
    assert out[5].text == f"Mrs. {given} {surname} came. {given} said that {surname}'s hat is Annabel's." and given != "Anna" and surname != "Smith"


def test_surrogates_stay_distinct(spark, odd, nothing):
    """Many names share few first surrogates: all are distinct in the end, by the broadcast and by the join."""
    names = [f"Mr. N{a}{b}" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]
    docs = spark.createDataFrame([(k, f"{n} and {names[0]}") for k, n in enumerate(names)], "doc_id long, text string")
    few = {r.doc_id: r.text for r in pii_surrogates.surrogate_texts(spark, docs, b"k").collect()}
    assert len(set(few.values())) == len(names)
    many = {r.doc_id: r.text for r in pii_surrogates.surrogate_texts(spark, docs, b"k", moved_rows=3).collect()}
    assert many == few
    assert {r.doc_id: r.text for r in pii_surrogates.surrogate_documents(spark, docs, b"k", moved_rows=3).collect()} == few
    other = {r.doc_id: r.text for r in pii_surrogates.surrogate_texts(spark, docs, b"other").collect()}
    assert other != few
    kept = pii_surrogates.surrogate_documents(spark, odd, b"k")
    assert kept.columns == odd.columns and Counter(map(tuple, kept.collect())) == Counter(map(tuple, odd.collect()))
    assert pii_surrogates.surrogate_texts(spark, nothing, b"k").count() == 0


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 300))
def test_permutation(size):
    make = pii_surrogates.Surrogates(b"k")
    assert sorted(make.permute(k, size, "t") for k in range(size)) == list(range(size))


def test_digest_is_md5():
    assert hashlib.md5(b"a b").hexdigest() == hashlib.md5(" ".join(unit_dedup.normal_words("A b.\n")).encode()).hexdigest()


def test_bitmap_holds_all_ids(spark):
    from zonalis.llm import common

    ids = spark.range(5000).select((F.col("id") * 7919 - 10_000_000).alias("doc_id"))
    bitmap = common.id_bitmap(ids, "doc_id")
    places = ids.select(common.id_hash(F.col("doc_id")).alias("p")).toPandas()["p"].to_numpy()
    import pyarrow as pa

    assert common.in_bitmap(bitmap, pa.array(places)).all()
    strangers = spark.range(5000).select((F.col("id") + 10**12).alias("doc_id")).select(common.id_hash(F.col("doc_id")).alias("p")).toPandas()["p"].to_numpy()
    assert common.in_bitmap(bitmap, pa.array(strangers)).mean() < 0.01
    assert not common.id_bitmap(ids.filter("false"), "doc_id").any()
