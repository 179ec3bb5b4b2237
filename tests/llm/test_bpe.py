import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notelake.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary here")


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.read_vocabulary())


@pytest.fixture(scope="module")
def judge():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(bpe.VOCABULARY, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(max_size=60), st.text(alphabet="aehtin \n'sß1ก!", max_size=80)))
def test_equals_the_merges(enc, judge, text):
    ids = enc.encode(text)
    assert ids == judge.encode_ordinary(text)
    assert enc.decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000, "ก" * 9_000, "\r\n" * 9_000, "<|endoftext|>", "\x00\x1f", "é", "🔥👩‍💻"])
def test_long_and_odd(enc, judge, text):
    assert enc.encode(text) == judge.encode_ordinary(text)


def test_memory_is_bounded(enc, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    enc.known.clear()
    for k in range(50):
        enc.encode(f"word{k}x")
        assert len(enc.known) <= 10


def test_frames(spark):
    ddl = "doc_id bigint, text string, ids string, id string, _text_ string"
    docs = spark.createDataFrame([(1, "Hello world", "x", "y", "z"), (2, "", "x", "y", "z"), (3, None, None, None, None), (1, "Hello world", "x", "y", "z"), (None, " \n", "x", "y", "z")], ddl)
    out = bpe.encode(docs)
    assert out.schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    got = [(r["doc_id"], r["ids"]) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(1, [15496, 995]), (2, []), (3, []), (1, [15496, 995]), (None, [220, 198])], key=repr)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(out).collect()}
    assert back == {1: "Hello world", 2: "", 3: "", None: " \n"}
    counted = bpe.count_tokens(docs, ["doc_id", "ids"])
    assert sorted((r["n_tokens"] for r in counted.collect())) == [0, 0, 2, 2, 2]
    assert bpe.encode(docs.limit(0)).count() == 0
