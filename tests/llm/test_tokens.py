from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.tokens import DEFAULT_FOLDER, PATTERN, BytePairEncoder, Tokenizer, merge, read_ranks

FILE = Path(DEFAULT_FOLDER) / "byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not FILE.exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def pair():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = read_ranks(str(FILE))
    return BytePairEncoder(ranks), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", ["", " ", "Hello, world!", "<|endoftext|>", "naïve  Ünïcode\n\n\tx", "日本語のテキスト。", "👩‍💻🇺🇳", "a" * 5000, "x\u0000y​", "don't we'll", "   12345 "])
def test_same_as_the_library(pair, text):
    own, library = pair
    assert own.encode(text) == library.encode_ordinary(text) and own.decode(own.encode(text)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(pair, text):
    own, library = pair
    assert own.encode(text) == library.encode_ordinary(text) and own.decode(own.encode(text)) == text


def test_merge_takes_the_leftmost_of_equal_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 300}
    assert merge(b"aaa", ranks) == [300, 97] and merge(b"aaaa", ranks) == [300, 300]


def test_columns(spark):
    rows = [(1, "Hello", 5), (2, None, None), (3, "", 0), (1, "Hello", 5), (None, " \n", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids bigint")
    t = Tokenizer(spark)
    got = df.select("doc_id", t.ids(F.col("text")).alias("x"), t.count(F.col("text")).alias("n"), t.text(t.ids(F.col("text"))).alias("back")).collect()
    assert [(r["doc_id"], len(r["x"]), r["n"], r["back"]) for r in got] == [(1, 1, 1, "Hello"), (2, 0, 0, ""), (3, 0, 0, ""), (1, 1, 1, "Hello"), (None, 2, 2, " \n")]
    assert df.limit(0).select(t.ids(F.col("text"))).count() == 0
    assert df.select(t.text(F.lit(None).cast("array<int>")).alias("x")).first()["x"] is None
