"""Texts of a megabyte through every operator: as short ones, and in bounded time."""

import random
import time

import pytest

from zonalis.llm import compression_toxicity, decontaminate, license_scan, periodic_runs, piece_codec, quality_ranking, quality_rules, simhash, token_planes, unit_dedup


@pytest.fixture(scope="module")
def long_docs(spark):
    r = random.Random(8)
    words = ["river", "stone", "letter", "morning", "village", "über", "señor"]
    prose = " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(110_000))
    rows = [(1, prose), (2, prose + " end"), (3, "z" * 1_000_000), (4, "word " * 200_000), (5, "a short text of some words. And one more."), (6, ("line of so many words here.\n") * 40_000), (7, "é" * 500_000)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.fixture(autouse=True)
def bounded():
    began = time.perf_counter()
    yield
    assert time.perf_counter() - began < 240


def test_fingerprints(spark, long_docs):
    rows = {r.doc_id: r for r in simhash.simhash_components(spark, long_docs).collect()}
    assert len(rows) == 7 and rows[1].component_id == rows[2].component_id == 1


def test_licences_and_benchmark(spark, long_docs):
    assert {r.doc_id: r.n_words for r in license_scan.scan_licenses(long_docs).collect()}[4] == 200_000
    item = "line of so many words here line of so many words here"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.contaminated(spark, long_docs, items).collect()} == {6}


def test_repeats(spark, long_docs):
    for find in (unit_dedup.repeated_units, unit_dedup.repeated_passages):
        rows = find(spark, long_docs).collect()
        assert sum(r.doc_id == 6 for r in rows) >= 39_998 and all(r.doc_id in (1, 2, 4, 6) for r in rows)


def test_tokens_and_pieces(spark, long_docs):
    import public_tokenizers
    import tokenizers

    rows = {r.doc_id: r.n_tokens for r in token_planes.token_planes(spark, long_docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2).collect()}
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in long_docs.collect()}
    assert all(rows[k] == len(library.encode(texts[k], add_special_tokens=False).ids) + 1 for k in (1, 4, 5, 6))
    back = piece_codec.round_trip(long_docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert back.count() == 7


def test_quality_and_toxicity(spark, long_docs):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 8)], "doc_id long, quality int, toxic int")
    model = quality_rules.fit_ratios(long_docs, labels)
    rows = {r.doc_id: r for r in quality_rules.quality_rules(spark, long_docs, model).collect()}
    assert rows[6].n_dup_lines == 39_999 and rows[4].base_failed
    assert quality_ranking.rank_quality(spark, long_docs, quality_ranking.fit_ranking(long_docs, labels)).count() == 7
    assert compression_toxicity.score_toxicity(spark, long_docs, compression_toxicity.fit_toxicity(long_docs, labels)).count() == 7


def test_runs(long_docs):
    rows = {r.doc_id: r for r in periodic_runs.periodic_runs(long_docs).collect()}
    assert (rows[4].length, rows[4].period) == (200_000, 1) and rows[6].period == 6 and rows[1].n_runs == 0
