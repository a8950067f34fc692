import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docmill.llm import encode as m

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")
PATH = m.vocabulary_path()


@pytest.fixture(scope="module")
def whole():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=m.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ids(encoder, text):
    import numpy as np

    return np.frombuffer(encoder.encode(text), "<i4").tolist()


SMALL = m.Encoder(PATH, leaf=5)


@given(st.text(st.sampled_from("abs 가나\n\t'1é　!\U0001f4c4<|endoftext|>"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_tree_equals_whole(whole, text):
    assert ids(SMALL, text) == whole(text)
    assert SMALL.decode(ids(SMALL, text)).decode() == text


def test_long_texts(whole):
    for text in ("가나다 abc " * 9000, "x" * 20_000, " " * 9001 + "a", "\n" * 7000):
        assert ids(m.encoder(PATH), text) == whole(text)


def test_columns(spark, whole):
    rows = [(1, None, 5), (2, "", 5), (3, "공고 abc", 5), (3, "공고 abc", 5), (4, " \n", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = m.encoded(df, "doc_id", "text")
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = sorted((r.doc_id, r.ids) for r in out.collect())
    assert got == [(1, []), (2, []), (3, whole("공고 abc")), (3, whole("공고 abc")), (4, whole(" \n"))]
    back = out.select("doc_id", m.token_text("ids").alias("t")).collect()
    assert sorted((r.doc_id, r.t) for r in back) == [(1, ""), (2, ""), (3, "공고 abc"), (3, "공고 abc"), (4, " \n")]
    assert m.encoded(df.limit(0), "doc_id", "text").count() == 0


def test_given_vocabulary_is_sent(spark, whole, tmp_path):
    import shutil

    own = f"{tmp_path}/own.tiktoken"
    shutil.copy(PATH, own)
    df = spark.createDataFrame([("공고 abc",)], "text string")
    assert df.select(m.token_ids("text", own).alias("ids")).first().ids == whole("공고 abc")
    elsewhere = lambda: m.encoder("/nowhere/on/this/machine/own.tiktoken").encode("공고 abc")
    assert spark.range(1).rdd.map(lambda _: elsewhere()).first() == m.encoder(PATH).encode("공고 abc")


def test_query_equals_library(spark, data):
    import public_tokenizers as P

    from docmill.llm.queries import p5_ids

    other = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    for r in p5_ids(spark, data).collect():
        assert r.ids == (other.encode(texts[r.doc_id], add_special_tokens=False).ids if texts[r.doc_id] else [])
