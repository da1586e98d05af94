"""The stages of the corpus pipeline, each against what its operator says of the stage's own input."""

import re

import pytest

import corpus_pipeline
from zonalis.llm import decontaminate, pii_surrogates, quality_rules, simhash
from zonalis.llm.pii_surrogates import Surrogates


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Inputs and outputs of all stages, as rows."""
    frames = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, frames[-1], sf_dir)
        frames.append(spark.createDataFrame(rows.collect(), rows.schema))
    return frames


def by_id(frame):
    rows = {r.doc_id: r for r in frame.collect()}
    assert len(rows) == frame.count()
    return rows


def test_names_and_columns(stages):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "PII", "SentencePiece encoding and decoding"]
    assert all(f.columns == stages[0].columns for f in stages[:-1]) and stages[-1].columns == ["doc_id", "ids"]


def test_quality(spark, sf_dir, stages):
    model = quality_rules.fit_ratios(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {i: r for i, r in by_id(stages[0]).items() if quality_rules.verdict((r.text or "").encode(), model)[6]}
    assert by_id(stages[1]) == good


def test_near_dedup(stages):
    """What is gone has a chain of near copies to a document that stays; exact copies are never both kept."""
    before, after = by_id(stages[1]), by_id(stages[2])
    assert after.items() <= before.items()
    sets = {i: set(simhash.shingle_set(r.text.encode()).tolist()) for i, r in before.items()}
    for i in set(before) - set(after):
        assert any(j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in before) or any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in before if j != i)
    assert len({r.text for r in after.values()}) == len(after)


def test_decontamination(spark, sf_dir, stages):
    matcher = decontaminate.Matcher([(r.item_id, decontaminate.normal(r.text.encode())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()], decontaminate.ERROR_RATE)
    clean = {i: r for i, r in by_id(stages[2]).items() if not matcher.match(decontaminate.normal(r.text.encode()))}
    assert by_id(stages[3]) == clean


def test_pii(stages):
    before, after = by_id(stages[3]), by_id(stages[4])
    assert before.keys() == after.keys()
    make = Surrogates(corpus_pipeline.SURROGATE_KEY)
    for i, r in before.items():
        assert after[i].text == pii_surrogates.replace(r.text, make, {})[0] and after[i].n_chars == len(after[i].text)
        for mail in re.findall(r"\S+@\S+", r.text):
            assert mail not in after[i].text


def test_pieces(stages):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = by_id(stages[5])
    for i, r in by_id(stages[4]).items():
        assert list(got[i].ids) == library.encode(r.text)


def test_run_is_the_stages(spark, sf_dir, stages):
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf_dir).collect()} == {r.doc_id: r.ids for r in stages[5].collect()}


# Odd tables: nulls, empty and very long texts, repeated rows, ids given twice, clashing columns


def _prose(seed, words):
    import random

    r = random.Random(seed)
    return " ".join(r.choice(["time", "river", "stone", "garden", "letter", "music", "winter", "morning", "village", "window"]) + r.choice(["", "s", "ed", "ly"]) for _ in range(words)) + "."


ODD = "doc_id long, text string, lang string, source string, n_chars long, digest string, own_id long, moved string, place long, label int, kept boolean, ids array<int>, text_ string"


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("odd"))
    item = _prose(99, 30)
    texts = [
        (1, _prose(1, 60)), (2, _prose(1, 60)), (2, _prose(1, 60)), (2, _prose(2, 60)), (3, None), (4, ""), (5, " \n\t "), (None, _prose(3, 60)), (None, _prose(3, 60)), (6, _prose(4, 150_000)), (7, "x" * 1_000_000), (8, f"{_prose(5, 30)} {item} {_prose(6, 30)}"),
        (9, "Mr. John Smith wrote to john.smith@mail.org, card 4123456789012345677. " + _prose(7, 50)), (10, "é" * 50 + " " + _prose(8, 40)), (11, "one word"), (-12, _prose(9, 40)),
    ]
    rows = [(i, t, None, "s", None if t is None else len(t), "d", 5, "m", 1, 0, True, [1], "t") for i, t in texts]
    spark.createDataFrame(rows, ODD).write.parquet(f"{base}/documents.parquet")
    labels = [(1, 1, 0), (1, None, None), (None, 1, 1), (4, 0, 0), (777, 1, 0), (10, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    items = [(1, item), (1, item), (2, None), (3, ""), (None, _prose(98, 20)), (4, item.upper())]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def some_rows(frame):
    return sorted((tuple(map(str, r)) for r in frame.collect()), key=str)


def test_stages_on_odd_rows(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    model = quality_rules.fit_ratios(docs, spark.read.parquet(f"{odd_dir}/labels.parquet"))
    good = [r for r in docs.collect() if quality_rules.verdict((r.text or "").encode(), model)[6]]
    assert some_rows(corpus_pipeline.quality_rules(spark, docs, odd_dir)) == sorted((tuple(map(str, r)) for r in good), key=str)

    left = corpus_pipeline.near_dedup(spark, docs, odd_dir)
    ids = [r.doc_id for r in left.collect()]
    assert left.columns == docs.columns and ids.count(None) == 2 and 1 in ids and ids.count(2) == 1  # of id 2 the text of its own stays
    assert {6, 7, 8, 9, 10, 11, -12} <= set(ids) and len({3, 4, 5} & set(ids)) >= 1

    clean = corpus_pipeline.decontamination(spark, docs, odd_dir)
    assert some_rows(clean) == some_rows(docs.filter("doc_id is null or doc_id <> 8"))

    out = corpus_pipeline.pii(spark, docs, odd_dir)
    before, after = docs.collect(), out.collect()
    assert out.columns == docs.columns and len(before) == len(after)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    changed = [r for r in after if r.doc_id == 9]
    assert "Smith" not in changed[0].text and "john.smith" not in changed[0].text and "4123456789012345677" not in changed[0].text
    assert some_rows(out.filter("doc_id is null or doc_id <> 9")) == some_rows(docs.filter("doc_id is null or doc_id <> 9"))

    pieces = corpus_pipeline.pieces(spark, docs, odd_dir).collect()
    assert len(pieces) == len(before) and all(len(r.ids) == 0 for r in pieces if r.doc_id in (3, 4))


def test_stages_and_run_on_an_empty_table(spark, odd_dir, tmp_path):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet").filter("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, odd_dir)
        assert out.count() == 0 and (k == 4 or out.columns == docs.columns)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_on_odd_rows(spark, odd_dir, tmp_path):
    """All stages one after the other, with labels that call every text good."""
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{odd_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, left, str(tmp_path))
        left = spark.createDataFrame(rows.collect(), rows.schema)
    ids = {r.doc_id for r in left.collect()}
    assert some_rows(corpus_pipeline.run(spark, str(tmp_path))) == some_rows(left)
    assert {1, 9, -12, None} <= ids and not {3, 4, 5, 8, 11} & ids
