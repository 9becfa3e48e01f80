"""The transducer against the published tokenizer, the merge procedure and an exact round trip."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import tokenizer as t


@pytest.fixture(scope="module")
def own():
    with open(f"{t.TOKENIZERS}/{t.VOCABULARY}", "rb") as f:
        return t.encoder(f.read())


@pytest.fixture(scope="module")
def published():
    tokenizers = pytest.importorskip("tokenizers")
    k = tokenizers.Tokenizer.from_file(f"{t.TOKENIZERS}/byte_bpe_50k.json")
    k.encode_special_tokens = True
    return k


SAMPLES = ["", " ", "\n\n  x", "<|endoftext|>", "it's 12,345 元 — naïve", "年度報告\t\t  s", "🙂🙃 ﷽", "a" * 5000, " " * 300, "\x00\x01", "１２３ ％", "ＡＢＣ", "don'T're", "ĠĊ", " x　y"]


@pytest.mark.parametrize("text", SAMPLES)
def test_samples(own, published, text):
    assert own.ids(text).tolist() == published.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(own, published, text):
    assert own.ids(text).tolist() == published.encode(text, add_special_tokens=False).ids
    assert "".join(t.decode(own.ids(text).tolist(), own.transducer.words)) == text


def test_transducer_is_the_merge_procedure(own):
    rng = random.Random(0)
    words = list(own.transducer.ranks)
    for _ in range(500):
        w = b"".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))[:40]
        ids = own.transducer.merged(w)
        assert own.transducer.word(w) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_memo_limits_change_nothing(own, monkeypatch):
    monkeypatch.setattr(t, "MEMO_STATES", 20)
    monkeypatch.setattr(t, "MEMO_WORDS", 5)
    small = t.Encoder(t.Transducer(own.transducer.ranks))
    text = "Consolidated statements of 翊岫光學 for 2019, restated."
    assert small.ids(text).tolist() == own.ids(text).tolist()


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40), st.integers(1, 5))
def test_stream_decoding(data, step):
    stream = t.Utf8Stream()
    got = "".join(stream.feed(data[i : i + step]) for i in range(0, len(data), step)) + stream.close()
    assert got == data.decode("utf-8", "replace")


def test_corpus(spark, make):
    df = make([(1, None, "a"), (2, "", "b"), (3, "x y", "c"), (3, "x y", "c"), (None, "z", "d")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id or 0, r.ids) for r in t.encode_corpus(df).collect())
    assert [g[1] for g in got if g[0] in (1, 2)] == [[], []] and len(got) == 5 and got[3] == got[4]
    back = {r.doc_id: r.text for r in t.decode_corpus(t.encode_corpus(df)).collect()}
    assert back[1] == "" and back[3] == "x y" and back[None] == "z"
    assert t.encode_corpus(df.limit(0)).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert {r.doc_id: r.n_tokens for r in t.count_tokens(df).collect()}[3] == 2
