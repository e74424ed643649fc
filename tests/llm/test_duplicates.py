from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.duplicates import canonical, copy_counts, duplicate_pairs, keyed_records

SCHEMA = "event_id bigint, source string, kind string, properties map<string,array<string>>, first_id bigint, _key string"


def plain(text):
    return "".join(c for c in text.casefold() if c.isalnum())


def brute(rows):
    groups = defaultdict(set)
    for i, source, kind, properties, *_ in rows:
        if i is not None and source is not None and kind is not None:
            kept = {k: frozenset(plain(v) for v in vs if v is not None) for k, vs in (properties or {}).items() if vs and any(v is not None for v in vs)}
            groups[source, plain(kind), frozenset(kept.items())].add(i)
    return sorted((min(g), x) for g in groups.values() for x in g if x != min(g))


def canon():
    return canonical(F.col("source"), F.col("kind"), F.col("properties"))


def pairs(spark, rows, hot=200):
    df = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    return sorted(map(tuple, duplicate_pairs(df, "event_id", canon(), hot).collect()))


ROWS = [
    (5, "s", "Crane.Lift", {"a": ["X 1", "y"], "b": []}), (3, "s", "crane_lift", {"a": ["Y!", "x-1"]}), (5, "s", "Crane.Lift", {"a": ["X 1", "y"], "b": []}),
    (7, "s", "cranelift", {"a": ["x1", "y", "Y"], "c": None}), (8, "t", "cranelift", {"a": ["x1", "y"]}), (9, None, "k", {}), (10, None, "k", {}), (11, "s", None, {}), (12, "s", None, {}),
    (13, "s", "k", None), (14, "s", "K", {}), (15, "s", "k", {"a": [""]}), (None, "s", "k", None), (16, "s", "ΣΑΣ", {"q": ["straße"]}), (17, "s", "σας", {"q": ["STRASSE"]}), (18, "s", "k", {"a": ["z" * 200_000]}),
]


@pytest.mark.parametrize("hot", [1, 3, 200])
def test_pairs_are_those_of_brute_force(spark, hot):
    assert pairs(spark, ROWS, hot) == brute(ROWS) and (3, 7) in brute(ROWS) and (16, 17) in brute(ROWS)


def test_hot_group(spark):
    rows = [(i, "s", "k" if i % 3 else f"k{i}", {"a": ["v"]}) for i in range(600)]
    assert pairs(spark, rows) == brute(rows)


def test_empty(spark):
    assert pairs(spark, []) == []


def test_counts(spark):
    df = spark.createDataFrame([(*r, None, None) for r in ROWS], SCHEMA)
    got = {r["first_id"]: (r["n_records"], r["n_rows"], r["n_collisions"]) for r in copy_counts(keyed_records(df.where("event_id IS NOT NULL"), "event_id", canon())).collect()}
    assert got[3] == (3, 4, 0) and got[9] == (1, 1, 0) and got[10] == (1, 1, 0) and sum(n for n, _, _ in got.values()) == 14


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 30), st.sampled_from(["s", "t"]), st.text("aB -ы", max_size=3), st.dictionaries(st.sampled_from("pq"), st.lists(st.text("aA-1", max_size=2), max_size=3))), max_size=25, unique_by=lambda r: r[0]))
def test_random(spark, rows):
    assert pairs(spark, rows) == brute(rows)
