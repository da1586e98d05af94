"""Token planes: a batch is cut by Arrow, and its words, not its texts, are looked up."""

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from zonalis.llm import token_planes

BPE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["\x1c", "\x85", "\xa0", "᠎", " ", "　", "\x0b", "<|endoftext|>", "<|endoftext|"]
held = []


def cache():
    if not held:
        held.append(token_planes.WordCache(BPE))
    return held[0]


def plain(texts):
    return [e.ids for e in cache().tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from([*"ab'é1,. \n\t_²ĀɐЖ", "don't", "it's.\nOne", "x\n\n y", *ODD]), max_size=9).map("".join), max_size=5))
def test_arrow_batches_are_the_tokenizer(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in cache().encode(pa.array(texts, pa.string()))] == plain(texts)


def test_slices_and_long_texts(monkeypatch):
    monkeypatch.setattr(token_planes, "PLACED_WORDS", 7)
    texts = ["skipped text", "one two's three.\nFour " * 40 + "end", None, "", "one", " two", "tail "]
    whole = pa.array(texts, pa.string())
    assert [np.frombuffer(x, "<u4").tolist() for x in cache().encode(whole.slice(1))] == plain(texts[1:])


def test_words_that_differ_in_marks_are_learnt_once():
    own, asked = token_planes.WordCache(BPE), []
    own._ids = lambda text, ask=own._ids: asked.append(text) or ask(text)
    own.encode(["a", *(f"a quillomber{mark}" for mark in (".", ",", "!", ".\nSo", ""))])
    assert " ".join(asked).count("quillomber") <= 2


def test_a_worker_keeps_its_cache(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(4)], "doc_id long, text string")
    seen = "pid long, words long"

    def learn(batches):
        for _ in batches:
            cache = token_planes.word_cache(BPE)
            cache.encode([f"some words {os.getpid()}"])
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([id(cache)])], names=["pid", "words"])

    rows = [r for _ in range(3) for r in docs.repartition(4).mapInArrow(learn, seen).collect()]
    assert len({tuple(r) for r in rows}) == len({r.pid for r in rows}) < len(rows)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_planes, "CACHE_WORDS", 3)
    own = token_planes.WordCache(BPE)
    for texts in (["a few words, here"], ["and others. there", ""], ["a few words, here"]):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == plain(texts)
