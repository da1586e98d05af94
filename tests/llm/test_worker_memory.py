"""What a Python worker keeps between tasks: its own stage's caches, within bounds, and no other stage's."""

import os
import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from zonalis.llm import common, piece_codec

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_later_stages_hold_no_codec(spark):
    """The codec that a worker has made is there for its next encoding task, and gone once it works for another stage."""

    def stage(keep):
        def run(batches):
            first = len(common.worker_cache("pieces"))
            for part in common.slices(batches, keep=keep):
                now = len(common.worker_cache("pieces"))
                if keep:
                    piece_codec.codec(PIECES)
                yield pa.RecordBatch.from_arrays([pa.array([os.getpid()] * part.num_rows), pa.array([first] * part.num_rows), pa.array([now] * part.num_rows)], names=["pid", "first", "now"])

        return spark.range(0, 4, 1, 4).mapInArrow(run, "pid long, first long, now long").collect()

    own = [r for _ in range(3) for r in stage("pieces")]
    assert any(r.first == 1 for r in own)
    assert all(r.now == 0 for r in stage(""))


def test_small_caches_change_no_ids(monkeypatch):
    r = random.Random(4)
    texts = [" ".join("".join(r.choices("abcdeéß1,.", k=r.randrange(1, 7))) for _ in range(40)) + r.choice(["", " ", "  x"]) for _ in range(30)]
    wide = piece_codec.Codec(PIECES)
    expected = [wide.encode(t) for t in texts]
    monkeypatch.setattr(piece_codec, "CACHE_PARTS", 8)
    monkeypatch.setattr(piece_codec, "CACHE_JOINS", 5)
    small = piece_codec.Codec(PIECES)
    assert [small.encode(t) for t in texts * 2] == expected * 2
    assert all(len(d) <= 4 for c in (small.words, small.parts) for d in (c.newer, c.older)) and len(small.model.joins) <= 5
    assert np.frombuffer(expected[0], "<u4").size > 0
