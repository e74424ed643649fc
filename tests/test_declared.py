"""Queries over all events against counts by hand."""

import re
from collections import Counter

import pytest

from tidemark.operators import render, stats
from tidemark.plans import catalog
from tidemark.plans.declared import UNDECLARED, all_events, declared_ontology

from tidemark.plans.schemas import CONCEPTS

READABLE = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z")


def letters(name):
    return "".join(c for c in name.lower() if c.isalnum())


@pytest.fixture(scope="module")
def events(spark, data):
    rows = spark.read.parquet(f"{data}/parsed_event.parquet").where("event_id IS NOT NULL").dropDuplicates(["event_id"]).collect()
    return [(r["event_id"], r["event_type_name"], {k: {x for x in v or () if x is not None} for k, v in (r["properties"] or {}).items()}) for r in rows]


def run(spark, data, name):
    return catalog.queries()[name](spark, data)


def test_every_declared_type_is_known(spark, data):
    known = {letters(n) for n in declared_ontology(spark, data).event_types}
    for name, column in (("event_type", "name"), ("event_property", "event_type_name")):
        declared = spark.read.parquet(f"{data}/{name}.parquet").where(f"{column} IS NOT NULL").select(column).distinct().collect()
        assert {letters(r[0]) for r in declared} <= known


def test_every_event_is_counted_under_its_type(spark, data, events):
    known = {letters(n): n for n in declared_ontology(spark, data).event_types if n != UNDECLARED}
    want = Counter(n if n is None else known.get(letters(n), n) for _, n, _ in events)
    got = {r["event_type"]: r["n_events"] for r in run(spark, data, "all_event_types").collect() if r["n_events"]}
    assert got == want
    assert sum(got.values()) == len(events)


def test_every_value_is_profiled(spark, data, events):
    kinds = {p.name: p.object_type for p in declared_ontology(spark, data).event_types[UNDECLARED].properties}
    assert {n for _, _, p in events for n, v in p.items() if v} <= set(kinds)
    declared = {letters(n): t for n, t in declared_ontology(spark, data).event_types.items()}
    want, vessels, nodes = Counter(), Counter(), 0
    for _, name, properties in events:
        own = declared.get(letters(name or ""), declared[UNDECLARED]).by_name
        for p, values in properties.items():
            want[own[p].object_type if p in own else kinds[p]] += len(values)
            nodes += len(values) * (p in CONCEPTS)
            vessels.update(values if p == "vessel" else ())
    assert {r["object_type"]: r["n_values"] for r in run(spark, data, "all_object_types").collect()} == want
    assert {r["value"]: r["n_values"] for r in run(spark, data, "all_object_values").collect()} == vessels
    assert run(spark, data, "all_concept_nodes").count() == nodes


def test_no_event_is_left_out_of_times(spark, data, events):
    starts = [min(p["time-start"]) for _, _, p in events if p.get("time-start")]
    ends = [x for _, _, p in events for n in ("time-start", "time-end") for x in p.get(n, ())]
    (total,) = run(spark, data, "all_covered_times").where("event_type IS NULL").collect()
    assert (total["first_start"], total["last_end"]) == (min(starts), max(ends))
    assert all_events(spark, data, stand_in=True).df.where("event_type IS NULL").count() == 0
    assert run(spark, data, "all_replay_delays").count() == sum(bool(READABLE.fullmatch(s)) for s in starts)


def test_repair_reads_every_event(spark, data, events):
    repaired = run(spark, data, "repair_events").agg({"n_events": "sum"}).first()[0]
    assert repaired == len(events)


def test_merge_keeps_every_event_of_every_type(spark, data, events):
    merged = run(spark, data, "all_merged").collect()
    assert sum(r["n_events"] for r in merged) == len(events)
    frame = all_events(spark, data)
    assert {r["event_type"] for r in merged} == {r[0] for r in frame.df.select("event_type").distinct().collect()}


def test_all_reasons_of_all_types_come_out(spark, data, events):
    own = declared_ontology(spark, data)
    types = {letters(n): t for n, t in own.event_types.items() if n != UNDECLARED}
    want = Counter()
    for _, name, properties in events:
        t = types.get(letters(name or ""))
        if t is None:
            want[name, "", "unknown event type"] += 1
            continue
        for p in t.mandatory_properties:
            want[t.name, p, "missing mandatory property"] += not properties.get(p)
        for p, values in properties.items():
            if values and p not in t.by_name:
                want[t.name, p, "unknown property"] += 1
            elif len(values) > 1 and p in t.singular_properties:
                want[t.name, p, "several values of a single-valued property"] += 1
    got = {(r["event_type"], r["property"], r["reason"]): r["n_events"] for r in run(spark, data, "all_issues").collect()}
    assert {k: n for k, n in got.items() if k in want or k[2] in {r for _, _, r in want}} == +want
    assert {"invalid value"} < {r for _, _, r in got}
    assert len({p for _, p, r in got if r == "invalid value"}) > 2


def test_property_counts_and_lines_of_every_type(spark, data, events):
    frame = all_events(spark, data, stand_in=True)
    rows = run(spark, data, "all_properties").collect()
    assert sum(r["n_values"] for r in rows) == sum(len(v) for _, _, p in events for v in p.values())
    for name in ("crane.lift", "yard.reshuffle"):
        want = {(r["property"], r["n_values"], r["n_distinct"], r["n_without"]) for r in stats.property_stats(frame, name).collect()}
        assert {(r["property"], r["n_values"], r["n_distinct"], r["n_without"]) for r in rows if r["event_type"] == name} == want
    lines = run(spark, data, "all_delimited").collect()
    assert {r["event_id"] for r in lines} == {e for e, _, _ in events}
    for name in ("crane.lift", "yard.reshuffle"):
        want = Counter(map(tuple, render.delimited(frame, name).collect()))
        assert Counter((r["event_id"], r["line"]) for r in lines if r["event_type"] == name) == want
    said = run(spark, data, "all_summaries").collect()
    assert len(said) == len(events) and all(r["text"] is not None for r in said)
