"""Token planes: texts are cut at marks and line feeds too, and what is known of them isn't encoded again."""

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from zonalis.llm import token_planes

BPE = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["×", "÷", "ü", "ɏ", "é", "²", "“", "—", "€", "あ", "\x85", "\xa0", "\u1680", "\u2003", "\u2009", "\u2028", "\u202f", "\u205f", "\u3000", "\u180e", "\u200b"]
held = []


def cache():
    if not held:
        held.append(token_planes.WordCache(BPE))
    return held[0]


def ids(own, texts):
    return [np.frombuffer(x, "<u4").tolist() for x in own.encode(pa.array(texts, pa.string()))]


def plain(texts):
    return [e.ids for e in cache().tokenizer.encode_batch(texts, add_special_tokens=False)]


class Counted:
    """A tokenizer that notes what it is asked."""

    def __init__(self, inner):
        self.inner, self.asked = inner, []

    def encode_batch_fast(self, texts, **options):
        self.asked += texts
        return self.inner.encode_batch_fast(texts, **options)


def test_known_pieces_are_not_encoded_again():
    own = token_planes.WordCache(BPE)
    own.tokenizer = Counted(own.tokenizer)
    own.encode(["The quill, and über.\nThe end", " "])
    own.tokenizer.asked.clear()
    texts = ["The end.\nThe über, and  quill", "The über.\nThe quill,", "The  end "]
    assert ids(own, texts) == plain(texts)
    assert own.tokenizer.asked == []


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab's.,1 \n\t", "  ", "\n\n", "'ll", ".\nA", *SIGNS]), max_size=10).map("".join), max_size=5))
def test_pieces_are_the_tokenizer(texts):
    assert ids(cache(), texts) == plain(texts)


def test_bounds():
    def pieces(*texts):
        data = [t.encode() for t in texts]
        bounds = token_planes.piece_bounds(np.frombuffer(b"".join(data), np.uint8), np.cumsum([len(d) for d in data]))
        return [b"".join(data)[a:b].decode() for a, b in zip(bounds, bounds[1:], strict=False)]

    assert pieces("It's so.\nWe  “go” ", "", " on (über)") == ["It", "'s", " so", ".\n", "We", " ", " “go” ", " on", " (", "über", ")"]
    assert pieces("a×.b", "a\n\nb  c  d  e é ") == ["a×.", "b", "a\n\nb", " ", " c", "  d ", " e", " é "]
    assert pieces() == pieces("") == []


def test_long_pieces_are_not_kept():
    own = token_planes.WordCache(BPE)
    texts = ["x" * 5000, "y " + "あ" * 2000, "z"]
    assert ids(own, texts) == plain(texts)
    assert max(map(len, own.words)) <= token_planes.KEPT_BYTES


def test_added_token_across_pieces(monkeypatch):
    own = token_planes.WordCache(BPE)
    monkeypatch.setattr(own, "added", ["y z"])
    whole, asked = own.tokenizer, Counted(own.tokenizer)
    own.tokenizer = asked
    own.encode(["a xy", "a z"])
    assert not any("y z" in t for t in asked.asked) and ids(own, ["a xy", "a z"]) == [e.ids for e in whole.encode_batch(["a xy", "a z"])]
