import base64
import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from fleetlens.llm import bpe, queries
from nasty import documents, ordered, pairs
from hypothesis import given, settings, strategies as st

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return bpe.tokenizer(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_rank_queue_gives_least_rank_and_place():
    q, had = bpe.RankQueue(50_000), []
    for rank, place in ((40_000, 3), (7, 9), (7, 2), (49_999, 1), (0, 5), (40_000, 1)):
        q.push(rank, place)
    while q.top:
        had.append(q.pop())
    assert had == sorted(had) and len(had) == 6 and not any(q.low) and set(q.buckets) == {None}


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aabbcdé1 =\n\t　日́'’ts", max_size=80) | st.text(max_size=40))
def test_equals_library(own, library, text):
    assert ids(own.encode(text)) == library.encode_ordinary(text)
    assert own.decode(own.encode(text)).decode() == text


def test_long_pre_tokens(own, library):
    began = time.time()
    for text in ("a" * 300_000, "ab" * 60_000, "é" * 50_000, "=" * 100_001, " " * 100_000 + "x", "日本語" * 20_000, "word " * 200_000):
        assert ids(own.encode(text)) == library.encode_ordinary(text)
    assert time.time() - began < 30


def test_nulls_clashes_and_equal_rows(spark, library):
    docs = documents(spark).withColumnRenamed("found", "c.d").withColumnRenamed("items", "IDS")
    out = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert out.columns == [c for c in docs.columns if c != "IDS"] + ["ids", "decoded"]
    rows = out.collect()
    assert ordered((r["doc_id"], r["text"]) for r in rows) == ordered(pairs(docs))
    for r in rows:
        assert ids(r["ids"]) == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]).decode() == (r["text"] or "")
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN, keep=["doc_id"]).columns == ["doc_id", "ids"]
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    raw = spark.sql("SELECT X'61FF62' AS text, CAST(NULL AS BINARY) AS ids")
    assert bytes(bpe.decode(bpe.encode(raw, PATH, public_tokenizers.PATTERN), PATH).first()["decoded"]).decode() == "a�b"
    assert bpe.decode(raw, PATH).first()["decoded"] is None


def test_registered_query(spark, sf, library):
    want = []
    for doc_id, text in sf("documents", "doc_id", "text"):
        x = library.encode_ordinary(text or "")
        want.append((doc_id, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert ordered(tuple(r) for r in queries.op11_bpe(spark, sf.dir).collect()) == ordered(want)
