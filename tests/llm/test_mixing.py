from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.mixing import mix, pack, packed_blocks, permuted, quotas, shares
from tidemark.llm.tokens import Tokenizer

DOCS = "doc_id bigint, text string, source string, weight double, ids string"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 64, 1000])
def test_permutation(n):
    for seed in (0, 1, 99):
        assert sorted(permuted(np.arange(n), np.full(n, n), np.full(n, seed))) == list(range(n))


def test_quotas():
    targets = [("a", 0.5, 1), ("b", 0.5, 3), ("none", 0.5, 1), ("zero", 0.0, 1), ("nul", None, 1)]
    held = {"a": (100, 1000), "b": (40, 400), "zero": (1, 10), "other": (10, 99)}
    assert quotas(targets, held) == {"a": (100, 100), "b": (100, 40)}
    assert quotas([("a", 1.0, 1)], {}) == {} and quotas([("a", 1.0, 2)], {"a": (10, 100)}, total=50) == {"a": (5, 10)}


def test_a_total_that_cannot_be_met_is_an_error_that_names_what_is_lacking():
    targets, held = [("many", 0.8, 1), ("few", 0.2, 1)], {"many": (4_000_000, 10**9), "few": (4, 1000)}
    assert quotas(targets, held) == {"many": (16, 4_000_000), "few": (4, 4)}
    with pytest.raises(ValueError, match="5000 can; tokens that sources lack: {'few': 199000}"):
        quotas(targets, held, total=1_000_000)


def test_pack():
    rows = [(0, "a", 1, [1, 2, 3]), (0, "a", 2, [4] * 5), (0, "b", 3, [5]), (1, "a", 4, []), (1, "a", 5, [6, 7])]
    want = [(0, "a", 0, [1, 2], [1, 2, 3, 4]), (0, "a", 1, [2], [4] * 4), (0, "b", 0, [3], [5]), (1, "a", 0, [5], [6, 7])]
    assert list(pack(iter(rows), 4)) == want and list(pack(iter([]), 4)) == []


def docs(spark, n=300):
    rows = [(i, None if i % 17 == 0 else "" if i % 19 == 0 else f"text number {i} of words " * (1 + i % 7), ["big", "big", "small", None, "unnamed"][i % 5], 1.0, "clash") for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


def targets(spark):
    return spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 2), ("absent", 0.3, 1), (None, 0.1, 1)], "source string, weight double, max_repeat int")


def test_packing_keeps_every_token_in_order(spark):
    t = Tokenizer(spark)
    texts = docs(spark).where("source = 'big' AND length(text) > 0").select("source", "doc_id", "text")
    blocks = sorted(packed_blocks(texts, t, 16, run=20).collect(), key=lambda b: (b["_run"], b["_at"]))
    last = {b["_run"]: b["_at"] for b in blocks}
    assert all(len(b["ids"]) == 16 for b in blocks if b["_at"] < last[b["_run"]]) and len(last) > 3
    ids = {r["doc_id"]: r["ids"] for r in texts.select("doc_id", t.ids(F.col("text")).alias("ids")).collect()}
    stream = [x for b in blocks for x in b["ids"]]
    order = list(dict.fromkeys(d for b in blocks for d in b["doc_ids"]))
    assert stream == [x for d in order for x in ids[d]] and sorted(order) == sorted(ids)


def test_shares_caps_and_shards(spark):
    out = mix(docs(spark), targets(spark), Tokenizer(spark), block=16, shard=8)
    rows = out.collect()
    used = Counter((r["source"], r["block_no"]) for r in rows)
    assert {s for s, _ in used} == {"big", "small"}
    assert max(n for (s, _), n in used.items() if s == "big") <= 1 and max(n for (s, _), n in used.items() if s == "small") <= 2
    places = {(r["shard"], r["place"]) for r in rows}
    assert len(places) == len(rows) and max(p for _, p in places) < 8
    whole = sum(r["n_tokens"] for r in rows)
    by = defaultdict(int)
    for r in rows:
        by[r["source"]] += r["n_tokens"]
    assert abs(by["big"] / whole - 0.6) < 0.02
    report = {r["source"]: r for r in shares(out, targets(spark)).collect()}
    assert report["absent"]["n_tokens"] == 0 and abs(report["small"]["actual_share"] - 0.4) < 0.02 and report["small"]["most_turns"] <= 2


def test_same_seed_same_mixture(spark):
    one, two = (sorted((r["shard"], r["place"], r["source"], r["block_no"]) for r in mix(docs(spark), targets(spark), Tokenizer(spark), 16, 8).collect()) for _ in range(2))
    assert one == two


def test_nothing_to_mix(spark):
    t = Tokenizer(spark)
    assert mix(docs(spark).limit(0), targets(spark), t).count() == 0
    assert mix(docs(spark), targets(spark).limit(0), t).count() == 0
    assert shares(mix(docs(spark).limit(0), targets(spark), t), targets(spark)).count() == 4


def test_long_text_and_hot_source(spark):
    rows = [(i, "word " * (20_000 if i == 0 else 3), "big", 1.0, "x") for i in range(200)]
    out = mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("big", 1.0, 1)], "source string, weight double, max_repeat int"), Tokenizer(spark), 64, 8)
    assert out.agg(F.sum("n_tokens")).first()[0] == sum(20_001 if i == 0 else 4 for i in range(200))
