"""Nested bodies and drifting files: shapes, empty and broken input, repeated rows, links by intervals."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift, nested


def rows_of(body):
    return [tuple(r[:4]) for r in nested.parse_body(body)]


FLAT = {"event-type": "a", "properties": {"p": ["1", None, "", "2"], "q": "x"}, "attachments": {"f": "t"}, "parents": "h1, ,h2"}
NAMED = {
    "event-type": "a",
    "properties": [{"name": "p", "objects": [{"value": "1"}, {"value": None}, {"value": ""}, {"value": "2"}]}, {"name": "q", "objects": [{"value": "x"}]}],
    "attachments": [{"name": "f", "values": [{"id": "1", "text": "t"}]}],
    "parents": [{"hash": "h1"}, {"hash": ""}, {"hash": "h2"}],
}
CELLS = {"event-type": "a", "properties": {"p": [{"value": "1"}, {"value": "2", "confidence": 3}], "q": {"value": "x"}}, "attachments": {"f": {"id1": "t"}}, "parents": ["h1", None, "h2"]}
WANT = [("0", "event", "a", 0), ("0", "object", "p", 0), ("0", "object", "p", 1), ("0", "object", "q", 0), ("0", "attachment", "f", 0), ("0", "parent", "h1", 0), ("0", "parent", "h2", 1)]


@pytest.mark.parametrize("event", [FLAT, NAMED, CELLS])
@pytest.mark.parametrize("wrap", [lambda e: e, lambda e: {"event": e, "seen": 3}, lambda e: json.dumps(e), lambda e: [e], lambda e: {"event": json.dumps(e)}])
def test_shapes_and_wrappers(event, wrap):
    assert rows_of(json.dumps(wrap(event))) == WANT


@pytest.mark.parametrize("body", [None, "", " ", "null", "[]", "{}", "7", '"x"', "{broken", '{"event": null}', '{"a": 1}'])
def test_unreadable(body):
    assert nested.parse_body(body) == []


def test_children_paths_and_intervals():
    child = {"event-type": "c", "children": {"event-type": "d", "properties": {"p": "1"}}}
    got = nested.parse_body(json.dumps({"event-type": "a", "children": [None, child, {}, {"event-type": "e"}]}))
    assert [(r[0], r[2], r[3]) for r in got if r[1] == "event"] == [("0", "a", 0), ("0.0", "c", 0), ("0.0.0", "d", 0), ("0.1", "e", 1)]
    spans = {r[0]: (r[6], r[7]) for r in got if r[1] == "event"}
    inside = {(a, b) for a in spans for b in spans if spans[a][0] < spans[b][0] <= spans[a][1]}
    assert inside == {("0", "0.0"), ("0", "0.0.0"), ("0", "0.1"), ("0.0", "0.0.0")}


def test_deep_body_does_not_crash():
    deep = '{"event-type":"a","children":[' * 300 + '{"event-type":"z"}' + "]}" * 300
    assert len(nested.parse_body(deep)) == 301
    nested.parse_body("[" * 100_000 + "]" * 100_000)


def test_any_depth_and_wrapping():
    text = "[" * 9000 + "7" + "]" * 9000
    last = '{"event-type":"z", "properties":{"p":[1.5,"\\u00e9",true,{"value":' + text + "}]}}"
    deep = '{"event-type":"a","children": [ ' * 6000 + last + "]}" * 6000
    got = nested.parse_body(deep)
    assert sum(r[1] == "event" for r in got) == 6001
    assert [r[4] for r in got if r[1] == "object"][-4:] == ["1.5", "\u00e9", "true", text]
    body = {"event-type": "a"}
    for _ in range(40):
        body = {"event": [body]}
    assert rows_of(json.dumps(body)) == [("0", "event", "a", 0)]
    for broken in ("[" * 9000 + "1 2" + "]" * 9000, "[" * 9000, '{"a":' * 9000 + "}" * 9000, "[" * 9000 + "1," + "]" * 9000):
        assert nested.parse_body(broken) == []


@pytest.mark.parametrize("value", [[], {}, [[], {}], {"a": [1, -2.5e3, None, True, "x\n\u00e9"], "b": {"c": {}}}, "x", 7])
def test_deep_reader_and_writer_agree_with_json(value):
    for text in (json.dumps(value), json.dumps(value, indent=2)):
        assert nested._read_deep(text) == value


def test_tables(spark):
    body = json.dumps({"event-type": "a", "node": "x", "children": [{"event-type": "b", "properties": {"p": "1"}}]})
    df = spark.createDataFrame([(1, body, "extra"), (1, body, "extra"), (2, None, None), (None, body, "x")], "id bigint, body string, node string")
    nodes = nested.flatten_bodies(df, "id", "body")
    assert nodes.count() == 9
    one = nested.flatten_bodies(df.where("id = 1").limit(1), "id", "body")
    assert [tuple(r) for r in nested.contained(one, "id", 0).collect()] == [(1, "0", 1), (1, "0", 2)]
    events = nested.nodes_of_kind(one, "event", "id").orderBy("enter").collect()
    assert [(r["node"], r["parent_node"], r["event_type"]) for r in events] == [("0", None, "a"), ("0.0", "0", "b")]
    assert nested.flatten_bodies(df.limit(0), "id", "body").count() == 0


def test_several_events_and_containment(spark):
    body = json.dumps({"data": [{"event-type": "a", "children": [{"event-type": "b", "properties": {"p": ["1", "2"]}}]}, {"note": 1}, {"event-type": "c"}]})
    df = spark.createDataFrame([(1, body)], "id bigint, body string")
    nodes = nested.flatten_bodies(df, "id", "body")
    assert [(r["node"], r["name"], r["pos"]) for r in nodes.where("kind = 'event'").orderBy("enter").collect()] == [("0", "a", 0), ("0.0", "b", 0), ("1", "c", 1)]
    rows = nodes.collect()
    for depth in (0, 1):
        outer = [r for r in rows if r["kind"] == "event" and r["depth"] == depth]
        want = sorted((1, o["node"], r["enter"]) for o in outer for r in rows if o["enter"] < r["enter"] <= o["leave"])
        assert sorted(map(tuple, nested.contained(nodes, "id", depth).collect())) == want


def test_a_value_without_a_text_is_kept_as_json():
    assert [r[4] for r in nested.parse_body('{"event-type": "a", "properties": {"p": [{"odd": 1}, {}, {"value": null}]}}')] == [None, '{"odd": 1}']


def test_columns_of_events(spark):
    schema = "id bigint, kind string, properties map<string,array<string>>, attachments map<string,map<string,string>>, parents array<string>"
    rows = [(1, "a", {"p": ["x", None, "", "y"], "q": []}, {"f": {"i": "t", "j": ""}}, ["h", None]), (2, None, None, None, None)]
    got = nested.flatten_events(spark.createDataFrame(rows, schema), "id", F.col("kind"), F.col("properties"), F.col("attachments"), F.col("parents"))
    assert sorted((r["kind"], r["name"] or "", r["pos"]) for r in got.where("id = 1").collect()) == [("attachment", "f", 0), ("event", "a", 0), ("object", "p", 0), ("object", "p", 1), ("parent", "h", 0)]
    assert got.where("id = 2").count() == 1
    assert got.where("id = 1 AND kind = 'event'").first()["leave"] == 4


# -- drift

FILES = "file_id bigint, producer bigint, no int, content string, name string"


def report(spark, contents, stretch=drift.STRETCH):
    rows = [(i, 1, i, c, "clash") for i, c in enumerate(contents)]
    df = drift.drift_report(spark.createDataFrame(rows, FILES), ["producer"], "no", "file_id", "content", F.lit("k"), stretch)
    return sorted(map(tuple, df.collect()))


def js(*records):
    return json.dumps(list(records))


def test_every_kind_of_change(spark):
    a = js({"k": "1", "gone": 5, "old": "v", "t": 1, "b": True}, {"k": "2", "gone": 6, "old": "w", "t": None, "b": False})
    b = "\n".join(json.dumps(x) for x in ({"new": "w", "k": "2", "t": "1", "added": 1, "b": 0}, {"k": "1", "new": "v", "b": 1}))
    assert report(spark, [a, b]) == [(1, "added", "added", ""), (1, "removed", "", "gone"), (1, "renamed", "new", "old"), (1, "retyped", "b", "b"), (1, "retyped", "t", "t")]


def test_rename_and_retype_at_once_and_likeness(spark):
    a = js({"k": "1", "version": 3, "multi": True, "x": True})
    assert report(spark, [a, js({"k": "1", "ver": "3", "multi-valued": True})]) == [(1, "removed", "", "x"), (1, "renamed", "multi-valued", "multi"), (1, "renamed", "ver", "version"), (1, "retyped", "ver", "version")]


@pytest.mark.parametrize("one,other", [(1, 1.0), (1, "1"), (1, [1]), (1, {"n": 1}), (True, 1), ("a", None)])
def test_types(spark, one, other):
    got = report(spark, [js({"k": "1", "f": one}), js({"k": "1", "f": other})])
    assert got == ([] if other is None else [(1, "retyped", "f", "f")])


def test_broken_files_and_stretches(spark):
    same = js({"k": "1", "a": 1})
    assert report(spark, [same, None, "", "{broken", same]) == [(1, "removed", "", "a"), (1, "removed", "", "k"), (4, "added", "a", ""), (4, "added", "k", "")]
    files = [js({"k": "1", f"f{i}": 1}) for i in range(9)]
    assert report(spark, files, stretch=2) == report(spark, files) and len(report(spark, files)) == 8


def test_copies_nulls_and_empty(spark):
    a, b = js({"k": "1"}), js({"k": "1", "n": 1})
    rows = [(5, 1, 1, a, "x"), (7, 1, 2, b, "x"), (9, 1, 2, a, "x"), (9, 1, 2, a, "x"), (None, 1, 3, a, "x"), (11, None, 1, a, "x"), (12, 1, None, a, "x")]
    df = spark.createDataFrame(rows, FILES)
    assert [tuple(r) for r in drift.drift_report(df, ["producer"], "no", "file_id", "content", F.lit("k")).collect()] == [(7, "added", "n", "")]
    assert drift.drift_report(df.limit(0), ["producer"], "no", "file_id", "content", F.lit("k")).count() == 0


def test_consistent_table(spark):
    big = 9007199254740993
    rows = [(1, 1, 1, js({"k": "a", "v": big, "w": 1, "Rev": 10**22 + 7, "far": 10**40}), "x"), (2, 1, 2, js({"k": "a", "v": 1.25, "w": [1], "rev-": 1, "far": 1, "t": True}), "x")]
    got = drift.consistent_table(spark.createDataFrame(rows, FILES), ["producer"], "no", "file_id", "content", "k")
    kinds = dict(got.dtypes)
    assert kinds["field_v"] == "decimal(18,2)" and kinds["field_w"] == "string" and kinds["field_Rev"] == "decimal(23,0)" and kinds["field_far"] == "string" and kinds["field_t"] == "boolean"
    assert sorted((r["file_id"], str(r["field_v"]), r["field_w"], str(r["field_Rev"]), r["field_far"]) for r in got.collect()) == [
        (1, f"{big}.00", "1", "10000000000000000000007", str(10**40)), (2, "1.25", "[1]", "1", "1")]


def test_two_names_in_one_record_stay_apart(spark):
    rows = [(1, 1, 1, js({"k": "a", "ver": 1, "version": 2}), "x"), (2, 1, 2, js({"k": "a", "version": 2, "Ver": 1}), "x")]
    got = drift.consistent_table(spark.createDataFrame(rows, FILES), ["producer"], "no", "file_id", "content", "k")
    names = {c for c in got.columns if c.startswith("field_")}
    assert len(names) == 3 and sorted((r["field_Ver"], r["field_version"]) for r in got.collect()) == [(1, 2), (1, 2)]


def test_many_files_meet_by_a_shuffled_join(spark, monkeypatch):
    files = [js({"k": "1", f"f{i}": 7, "x": i}) for i in range(6)]
    want = report(spark, files)
    monkeypatch.setattr(drift, "BROADCAST_FILES", 0)
    assert report(spark, files) == want and len(want) == 5


def test_consistent_table_learns_names(spark):
    """Names on no list: a chain of renames in one feed holds for another one; a field beside the new name stays apart."""
    files = [js({"k": "a", "v": 1, "x": True}, {"k": "b", "v": 2, "x": True}), js({"k": "a", "revno": 1, "x": True}, {"k": "b", "revno": 2, "x": True}), js({"k": "a", "revno": 3}), js({"k": "a", "release": "3"})]
    rows = [(i, 1, i, c, "") for i, c in enumerate(files)] + [(9, 2, 1, js({"k": "z", "release": 7, "y": True}), ""), (10, 2, 2, js({"k": "z", "release": 8}), "")]
    got = drift.consistent_table(spark.createDataFrame(rows, FILES), ["producer"], "no", "file_id", "content", "k")
    assert {c for c in got.columns if c.startswith("field_")} == {"field_k", "field_release", "field_x", "field_y"}
    assert sorted((r["file_id"], r["field_release"]) for r in got.collect()) == [(0, "1"), (0, "2"), (1, "1"), (1, "2"), (2, "3"), (3, "3"), (9, "7"), (10, "8")]


def test_united_names():
    fields = {n: drift.Field(["text"], 0, 0, files) for n, files in (("a", 1), ("b", 5), ("c", 2), ("d", 1), ("C-", 1))}
    got = drift.united_names(fields, {("a", "c"), ("c", "a")}, {("a", "b"): 3, ("b", "c"): 1, ("d", "c"): 1})
    assert got == {"a": "b", "b": "b", "c": "c", "d": "c", "C-": "c"}


def test_lattice():
    assert drift.promote("integer", "decimal") == "decimal" and drift.promote(None, "list") == "list" and drift.promote("list", "integer") == "text"


def test_files_are_read_as_streams(spark, data, tmp_path):
    # what tasks can open by its path isn't loaded whole, whatever the folder's name
    from tidemark.plans.schemas import user_events
    from tidemark.sources import event_xml

    frame = user_events(spark, data)
    few = frame.with_df(frame.df.where("event_id < 50"))
    path = f"file://{tmp_path}/a b%20é"
    event_xml.write_events(few, path)
    back = event_xml.read_events(spark, f"{path}/part-*")
    assert "content:binary" not in back.df._jdf.queryExecution().executedPlan().toString()
    assert sorted(r[0] for r in back.df.select(back.df.properties["version"][0].cast("int")).collect()) == list(range(50))
