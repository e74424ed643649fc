from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import frequency
from tidemark.llm.frequency import letters_and_digits, mark_terms, term_frequencies

SCHEMA = "id bigint, a string, b string, term string, n bigint"


def brute(rows):
    count, held = defaultdict(int), defaultdict(set)
    for i, a, b, *_ in rows:
        for field, value in (("a", a), ("b", b)):
            if value is not None:
                count[field, value] += 1
                held[field, value] |= {i} - {None}
    return {k: (count[k], len(held[k])) for k in count}


def run(spark, rows, slots=4):
    df = spark.createDataFrame(rows, SCHEMA)
    out = term_frequencies(df, "id", {"a": F.col("a"), "b": F.col("b")}, slots)
    return {(r["field_name"], r["term"]): (r["n_rows"], r["n_records"]) for r in out.collect()}, out


@pytest.mark.parametrize("slots", [1, 4, 16])
def test_counts_are_exact_whatever_is_heavy(spark, slots):
    rows = [(i % 700, "hot" if i % 3 == 0 else f"t{i % 97}", None if i % 5 == 0 else f"u{i % 3}", "x", 1) for i in range(3000)]
    assert run(spark, rows, slots)[0] == brute(rows)


@pytest.mark.parametrize("bound", [0, 10**6])
def test_repeated_records_count_once_however_they_meet(spark, monkeypatch, bound):
    monkeypatch.setattr(frequency, "BROADCAST_IDS", bound)
    # one id has a third of all rows, other ids come twice with other terms
    rows = [(7 if i % 3 == 0 else i // 2, f"t{i % 5}", None if i % 4 else "x", "c", i) for i in range(900)]
    got, out = run(spark, rows, 2)
    assert got == brute(rows) and {r["total_records"] for r in out.collect()} == {len({r[0] for r in rows})}


def test_nulls_empty_repeated_and_long(spark):
    rows = [(1, "", None, None, None), (1, "", None, None, None), (None, "", "x", None, None), (2, "y" * 100_000, "x", "c", 1), (3, None, None, None, None)]
    got, out = run(spark, rows)
    assert got == brute(rows)
    assert {r["total_records"] for r in out.collect()} == {3}


def test_empty_table(spark):
    assert run(spark, [])[0] == {}


def test_one_record_with_two_values(spark):
    assert run(spark, [(1, "x", None, None, None), (1, "y", None, None, None)])[0] == {("a", "x"): (1, 1), ("a", "y"): (1, 1)}


def test_marks(spark):
    rows = [(i, "common" if i < 10 else "mid" if i < 19 else "rare" if i < 22 else f"r{i}", None, None, None) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["term"]: r["mark"] for r in mark_terms(term_frequencies(df, "id", {"a": F.col("a")})).collect()}
    assert got["common"] == "common" and got["mid"] is None and got["rare"] == "rare" and got["r50"] == "rare"


def test_names(spark):
    df = spark.createDataFrame([("Crane_Lift.",), ("краН 7",), (None,)], "s string")
    assert [r[0] for r in df.select(letters_and_digits(F.col("s"))).collect()] == ["cranelift", "кран7", None]
