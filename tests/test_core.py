"""Events end to end: XML in and out, hashing, merging, filters, comparison, validation, templates, transcoding."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from tidemark.frame import EventFrame
from tidemark.functions.datatypes import DataType
from tidemark.functions.template import Template, collapsed, errors
from tidemark.ontology.check import brick_errors, ontology_errors
from tidemark.ontology.model import (
    Attachment, Bricks, Concept, EventProperty, EventSource, EventType, ObjectType, Ontology, OntologyError, generalizations, share_branch, specializations,
)
from tidemark.ontology.upgrade import Outcome, UpgradeError, bump, compare, compare_ontologies, merge_ontologies
from tidemark.ontology.xml import brick_text, ontology_text, parse_ontology
from tidemark.operators import compare as sets
from tidemark.operators import edits, filters, links, merge, render, replay, stats, validation
from tidemark.sources import event_xml
from tidemark.transcode import harness
from tidemark.transcode.records import DISCARD, Mediator, Transcoder, several
from tidemark.transcode.xml import XmlMediator

EVENT = "event_id bigint, event_type string, source_uri string, properties map<string,array<string>>, parents array<string>, attachments map<string,map<string,string>>"


def ontology():
    text, number, time, seq = ("text", "string:0:mc:u"), ("number", "number:int:signed"), ("time", "datetime"), ("seq", "sequence")
    merges = {"k": ("text", "match"), "a": ("text", "add"), "s": ("text", "set"), "r": ("text", "replace"), "n": ("number", "min"), "x": ("number", "max"), "y": ("text", "any"), "v": ("seq", "max")}
    own = EventType("ea", "event", "events", "an event", "[[k]]", "[[k]]", event_version="v")
    for name, (kind, strategy) in merges.items():
        own = own.with_property(EventProperty(name, kind, name).with_merge(strategy))
    own = own.with_attachment(Attachment("doc", description="a text"))
    return Ontology().create(*[ObjectType(n, n, f"{n}s", n, t) for n, t in (text, number, time, seq)], Concept("c", "c", "cs", "c"), EventSource("/a/"), own)


def frame(spark, rows, own=None):
    full = [(*r, *[None] * (6 - len(r))) for r in rows]
    return EventFrame.from_events(spark.createDataFrame(full, EVENT), own or ontology())


def event(i, version, **p):
    return (i, "ea", "/a/", {"k": ["key"], "n": [str(10 - i)], "x": [str(i)], "v": [str(version)], **p})


def merged_properties(f):
    return [r["properties"] for r in merge.merge(f).df.collect()]


def test_strategies_and_order(spark):
    rows = [event(1, 2, a=["p"], s=["s2"], r=["new"], y=["b"]), event(2, 1, a=["q", "p"], r=["old"], y=["a"]), event(3, 3, a=[], r=[])]
    want = {"k": ["key"], "a": ["p", "q"], "s": ["s2"], "n": ["7"], "x": ["3"], "y": ["a"], "v": ["3"]}
    for order in itertools.permutations(rows):
        assert merged_properties(frame(spark, order)) == [want]


def test_merge_is_idempotent_and_keeps_the_hash(spark):
    f = frame(spark, [event(1, 1, a=["p"]), event(2, 2, a=["q"])])
    once = merge.merge(f)
    assert merged_properties(once) == merged_properties(f)
    hashes = {r[0] for r in f.hashed().select("sticky_hash").collect()}
    assert {r[0] for r in once.hashed().select("sticky_hash").collect()} == hashes


def test_buffers(spark):
    f = frame(spark, [event(i, i) for i in range(1, 8)])
    assert merge.merge_in_buffers(f, 4).df.count() == 2 and merge.merge(f).df.count() == 1


def test_conflict(spark):
    f = frame(spark, [event(1, 1, y=["a"]), event(2, 1, y=["b"])])
    assert merge.conflicts(f).count() == 1
    with pytest.raises(ValueError):
        merge.checked_merge(f)


def test_hash_is_that_of_hashlib(spark):
    f = frame(spark, [(1, "ea", "/a/", {"k": ["ü", "b"]}), (2, "ea", "/a/", {}), (3, "other", "/a/", {"k": ["b"]})])
    joined = b"\xff\xff\xff\xff".join(sorted(["k:ü".encode(), b"k:b"]))
    want = [hashlib.sha1(x).hexdigest() for x in (b"/a/\nea\n" + joined, b"/a/\nea\n", b"/a/\nother\n")]
    assert [r["sticky_hash"] for r in f.hashed().orderBy("event_id").collect()] == want


def test_edits(spark):
    f = frame(spark, [(1, "ea", "/a/", {"k": ["x"], "a": ["y"]})])
    p = F.col("properties")
    row = f.df.select(
        edits.copy_properties(p, {"k": ["a", "s"]}).alias("copied"), edits.move_properties(p, {"k": ["a"]}).alias("moved"),
        edits.any_value(p, "none", "d").alias("any"), edits.delete_property(p, "k").alias("less"), edits.set_property(p, "k", F.array(F.lit("z"))).alias("set"),
        edits.set_attachment(F.col("attachments"), "doc", F.lit("t")).alias("att"), edits.add_parents(F.col("parents"), F.array(F.lit("h"))).alias("par"),
    ).first()
    assert row["copied"] == {"k": ["x"], "a": ["x", "y"], "s": ["x"]} and row["moved"] == {"a": ["x", "y"]}
    assert row["any"] == "d" and row["less"] == {"a": ["y"]} and row["set"] == {"a": ["y"], "k": ["z"]}
    assert row["att"] == {"doc": {hashlib.sha1(b"t").hexdigest(): "t"}} and row["par"] == ["h"]


def test_filter_keeps_parents(spark):
    own = ontology()
    child = EventType("eb").with_property(EventProperty("k", "text", multivalued=False, merge="match")).child_of(own.event_types["ea"])
    f = frame(spark, [(1, "ea", "/a/", {"k": ["1"]}), (2, "eb", "/a/", {"k": ["1"]}), (3, "ec", "/a/", {})], own.create(child, EventType("ec")))
    kept = filters.filter_events(f, "eb")
    assert set(kept.ontology.event_types) == {"ea", "eb"} and kept.df.count() == 2
    assert links.parents_by_properties(f, "eb").collect()[0].asDict() == {"event_id": 2, "parent_id": 1}
    seen = {}
    filters.route(f.df, {"ea": lambda d: seen.update(a=d.count())}, {"/a": lambda d: seen.update(s=d.count())}, lambda d: seen.update(d=d.count()))
    assert seen == {"a": 1, "s": 3, "d": 0}


def test_difference_and_union(spark):
    a = frame(spark, [event(1, 1, y=["a"]), (5, "ea", "/a/", {"k": ["only"], "n": ["1"], "x": ["1"], "v": ["1"]})])
    b = frame(spark, [event(1, 1, y=["z"]), (6, "ea", "/a/", {"k": ["new"], "n": ["1"], "x": ["1"], "v": ["1"]})])
    assert sorted(r["status"] for r in sets.difference(a, b).collect()) == ["changed", "only in a", "only in b"]
    assert sets.equivalent(a, a) and not sets.equivalent(a, b)
    assert sets.text_difference(sets.difference(a, b))
    assert sets.concatenate(a, b).df.count() == 4


@pytest.mark.parametrize(
    "kind,value,want",
    [
        ("datetime", "2024-03-05 06:07:08", "2024-03-05T06:07:08.000000Z"), ("datetime", "05 Mar 2024", "2024-03-05T00:00:00.000000Z"), ("datetime", "high tide", None),
        ("number:smallint", "+0042", "42"), ("number:int", "4 lifts", None), ("number:double", "2500", "2.500000E+03"), ("number:float", ".125", "1.250000E-01"),
        ("number:decimal:12:2", "007.5", "7.50"), ("number:decimal:5:1", "+12", "12.0"), ("number:currency", "19", "19.0000"), ("hex:2", "0FfE", "0ffe"), ("uri:/", "/dock/%2Fa", "/dock/%2Fa"),
        ("ip:v4", " 10.0.200.9", "10.0.200.9"), ("ip:v4", "fe80::1", None), ("ip:v6", "FE80::1:0:2", "fe80:0000:0000:0000:0000:0001:0000:0002"),
        ("ip:v6", "64:ff9b::192.0.2.33", "0064:ff9b:0000:0000:0000:0000:c000:0221"), ("ip:v6", "8.8.8.8", None), ("geo:point", "51.9,4.05", "51.900000,4.050000"),
        ("geo:point", "51.9", None), ("geo:point", "north,4", None), ("string:0:lc", "Quay SIDE", "quay side"), ("string:9:uc", "tug", "TUG"), ("string:3:mc", "quay", None),
        ("base64:0", "aGFyYm91cg", "aGFyYm91cg=="), ("base64:0", "harb?", None), ("boolean", "True", "true"), ("boolean", "moored", "false"), ("sequence", "0007", "7"),
    ],
)
def test_normalize(spark, kind, value, want):
    t = DataType(kind)
    row = spark.createDataFrame([(value,)], "v string").select(t.normalize(F.col("v")).alias("n")).select("n", t.valid(F.col("n")).alias("ok")).first()
    assert row["n"] == want and row["ok"] == (want is not None)


@pytest.mark.parametrize(
    "kind,good,bad",
    [
        ("datetime", "1583-01-01T23:00:00.000000Z", "1582-01-01T00:00:00.000000Z"), ("sequence", "18446744073709551615", "18446744073709551616"), ("boolean", "true", "True"),
        ("number:tinyint", "255", "256"), ("number:tinyint:signed", "-128", "128"), ("number:mediumint", "16777215", "16777216"), ("number:bigint", "18446744073709551615", "-1"),
        ("number:int", "0", "01"), ("number:int", "1", "1\n"), ("number:decimal:4:2:signed", "-12.34", "123.45"), ("number:decimal:4:2", "12.34", "-1.00"),
        ("number:double:signed", "-1.000000E+00", "1.0"), ("hex:2", "aabb", "aab"), ("hex:4:2::", "aabb:ccdd", "aabbccdd"), ("uuid", "12345678-1234-1234-1234-1234567890ab", "x"),
        ("geo:point", "90.000000,180.000000", "91.000000,0.000000"), ("string:2:lc", "ab", "Ab"), ("string:0:mc", "é", "ж"), ("string:0:mc:u", "ж", ""),
        ("base64:2", "YWI=", "YWJj"), ("enum:a:b", "a", "c"), ("ip:v4", "1.2.3.4", "01.2.3.4"), ("uri:/", "x", ""),
    ],
)
def test_valid(spark, kind, good, bad):
    t = DataType(kind)
    assert t.definition_errors() == []
    rows = spark.createDataFrame([(0, good), (1, bad), (2, None)], "i int, v string").select("i", t.valid(F.col("v")).alias("ok")).orderBy("i").collect()
    assert [r["ok"] for r in rows] == [True, False, False]


@pytest.mark.parametrize("kind", ["", "number", "number:decimal:39:1", "number:decimal:2:2", "hex:0", "hex:3:2::", "string:x:mc", "enum", "uri:", "ip:v5", "geo:line"])
def test_bad_definitions(kind):
    assert DataType(kind).definition_errors()


def test_validation_and_repair(spark):
    f = frame(spark, [event(1, 1), event(2, "x", n=["bad", "1"], zz=["q"]), (3, "ea", "/b/", {"k": ["1"], "n": ["+07"], "x": ["1"], "v": ["1"]}), (4, "no", "/a/", {})])
    found = {r["event_id"]: {(i["property"], i["reason"]) for i in r["issues"]} for r in validation.validate(f).collect()}
    assert found[1] == set() and ("zz", "unknown property") in found[2] and ("n", "several values of a single-valued property") in found[2]
    assert ("", "unknown source") in found[3] and ("n", "invalid value") in found[3] and found[4] == {("", "unknown event type")}
    fixed = {r["event_id"]: r for r in validation.repair(f, drop={"ea": ["n", "v"]}).collect()}
    assert fixed[3]["properties"]["n"] == ["7"] and fixed[3]["repaired"] and not fixed[1]["repaired"]
    assert fixed[2]["properties"]["n"] == ["1"] and "v" not in fixed[2]["properties"]


def template_type():
    """A call of a ship at a berth."""
    kinds = {"vessel": "string:0:mc", "cargo": "string:0:mc", "draught": "number:float", "moored": "datetime", "left": "datetime", "chart": "uri:/", "laden": "boolean", "spot": "geo:point"}
    own = EventType("call").with_attachment(Attachment("log", description="the log"))
    for name, kind in kinds.items():
        own = own.with_property(EventProperty(name, kind, multivalued=name == "cargo"))
    return own, {n: DataType(k) for n, k in kinds.items()}


STAY = {"moored": ["2031-02-03T04:05:06.700800Z"], "left": ["2031-02-03T09:06:36.700800Z"]}
LONG_STAY = {"moored": STAY["moored"], "left": ["2033-05-07T09:11:13.700800Z"]}


def shown(spark, text, values):
    own, kinds = template_type()
    assert list(errors(text, own, kinds)) == []
    df = spark.createDataFrame([(values,)], "p map<string,array<string>>")
    column = Template(text, kinds).column(lambda n: F.col("p")[n], lambda n: F.array(F.lit("two tugs")) if n == "log" else F.array().cast("array<string>"))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,values,want",
    [
        ("[[vessel]] is in", {"vessel": ["Osprey"]}, "Osprey is in"), ("[[vessel]] is in", {}, ""), ("a ship{ named [[vessel]]} came", {}, "A ship came"),
        ("a ship{ named [[vessel]]{ with [[cargo]]}} came", {"vessel": ["Osprey"]}, "A ship named Osprey came"),
        ("a ship{ named [[vessel]]{ with [[cargo]]}} came", {"cargo": ["rye"]}, "A ship came"),
        ("with [[cargo]]", {"cargo": ["rye"]}, "With rye"), ("with [[cargo]]", {"cargo": ["coal", "rye"]}, "With coal and rye"), ("with [[cargo]]", {"cargo": ["ash", "coal", "oats", "rye"]}, "With ash, coal, oats and rye"),
        ("draws [[draught]] m", {"draught": ["7.250000E+00"]}, "Draws 7.250000 m"), ("at [[spot]]", {"spot": ["59.250000,18.500000"]}, "At 59°15′0 N″ 18°30′0 E″"),
        ("see [[url:chart,the chart]]", {"chart": ["/c/9"]}, "See the chart (/c/9)"), ("[[merge:vessel,cargo]] seen", {"vessel": ["Osprey"], "cargo": ["rye"]}, "Osprey and rye seen"),
        ("it is [[boolean_string_choice:laden,full,light]]", {"laden": ["false"]}, "It is light"), ("pump [[boolean_on_off:laden]]", {"laden": ["true"]}, "Pump on"),
        ("it [[boolean_is_is_not:laden]] laden", {"laden": ["false"]}, "It is not laden"), ("no [[empty:vessel,name given]]", {}, "No name given"), ("no [[empty:vessel,name given]]", {"vessel": ["Osprey"]}, ""),
        ("{[[unless_empty:vessel,cargo,known]]: {[[vessel]]}{, [[cargo]]}}", {"cargo": ["rye"]}, "Known: , rye"), ("log: [[attachment:log]]", {}, "Log: \n\ntwo tugs\n\n"),
    ],
)
def test_templates(spark, text, values, want):
    assert shown(spark, text, values) == want


@pytest.mark.parametrize(
    "accuracy,want",
    [("year", "2031"), ("month", "February 2031"), ("date", "Monday, February 03 2031"), ("hour", "Monday, February 03 2031 at 04h"), ("minute", "Monday, February 03 2031 at 04:05h"),
     ("second", "Monday, February 03 2031 at 04:05:06h"), ("microsecond", "Monday, February 03 2031 at 04:05:06.700800h")],
)
def test_times_in_templates(spark, accuracy, want):
    assert shown(spark, f"moored [[date_time:moored,{accuracy}]]", STAY) == f"Moored {want}"


def test_spans_in_templates(spark):
    assert shown(spark, "stayed [[duration:moored,left]]", STAY) == "Stayed 5 hours, 1 minutes and 30 seconds"
    assert shown(spark, "stayed [[duration:moored,left]]", LONG_STAY) == "Stayed 2 years, 3 months, 4 days, 5 hours, 6 minutes and 7 seconds"
    assert shown(spark, "was in [[time_span:moored,left]]", STAY) == "Was in between 2031-02-03 04:05:06.700800+00:00 and 2031-02-03 09:06:36.700800+00:00"
    assert shown(spark, "was in [[time_span:moored,left]]", {"left": STAY["left"]}) == ""


def test_template_errors():
    """Every placeholder that works is broken in each way: a property that isn't there, one of a wrong type, too few and
    too many arguments, a formatter that isn't there; and scopes that don't match."""
    own, kinds = template_type()
    good = {
        "vessel": [], "time_span": ["moored", "left"], "duration": ["moored", "left"], "date_time": ["moored", "hour"], "url": ["chart", "x"], "boolean_string_choice": ["laden", "x", "y"],
        "boolean_on_off": ["laden"], "boolean_is_is_not": ["laden"], "attachment": ["log"], "empty": ["vessel", "x"], "merge": ["vessel", "cargo"], "unless_empty": ["vessel", "x"],
    }

    def broken(name, arguments):
        return bool(list(errors(f"[[{name}:{','.join(arguments)}]]", own, kinds)))

    for name, arguments in good.items():
        if not arguments:
            assert not list(errors(f"[[{name}]]", own, kinds)) and list(errors(f"[[{name}s]]", own, kinds))
            continue
        assert not broken(name, arguments), name
        assert broken(name, ["nowhere", *arguments[1:]]), name
        assert broken(name, []) and broken(f"{name}x", arguments), name
        if name not in ("merge", "unless_empty", "attachment", "empty"):
            assert broken(name, [*arguments, "x", "y"]), name
        if name in ("time_span", "duration", "date_time") or name.startswith("boolean"):
            assert broken(name, ["vessel", *arguments[1:]]), name
    assert broken("date_time", ["moored", "fortnight"]) and broken("unless_empty", ["vessel"])
    for text in ("{[[vessel]]", "[[vessel]]}", "}{"):
        assert list(errors(text, own, kinds))


def test_collapsed(spark):
    own, kinds = template_type()
    got = collapsed(spark, "{[[vessel]]{ near [[chart]]}}", own, kinds, {"string:0:mc": ("name", "names"), "uri:/": ("link", "links")})
    assert got == [(set(), set(), "Some name near some link"), ({"chart"}, set(), "Some name"), ({"vessel"}, set(), "")]


def test_render(spark):
    f = frame(spark, [(1, "ea", "/a/", {"k": ["a\tb", "c"], "a": ["1", "2"]}), (2, "ea", "/a/", {})])
    lines = [r["line"] for r in render.delimited(f, "ea", ["k", "a", "zz"], []).orderBy("event_id", "line").collect()]
    assert lines == ["a\\\tb\t1", "a\\\tb\t2", "c\t1", "c\t2", "\t"]
    assert render.texts(f).orderBy("event_id").first()["text"] == "A\tb and c"


def test_ontology_xml_and_rules():
    own = ontology()
    again = parse_ontology(ontology_text(own))
    assert compare_ontologies(own, again) is Outcome.EQUAL and ontology_errors(own) == []
    broken = own.put(own.event_types["ea"].with_property(EventProperty("q", "nope", confidence=11)))
    assert len(ontology_errors(broken)) == 2
    with pytest.raises(OntologyError):
        own.create(EventSource("/a/"))
    assert "k" not in own.drop(ObjectType, "text").event_types["ea"].by_name
    assert Bricks(ObjectType("nope")).complete(broken).object_types["nope"].data_type == "string:0:mc:u"


def test_upgrades():
    old = ontology()
    ea = old.event_types["ea"]
    new = ea.with_property(EventProperty("more", "text")).with_(version=2)
    merged = merge_ontologies(old, old.put(new))
    assert "more" in merged.event_types["ea"].by_name and merge_ontologies(merged, old) is merged
    assert compare_ontologies(old, merged) is Outcome.UPGRADE
    for bad in (ea.with_(description="x"), ea.without_property("y").with_(version=2), ea.with_property(EventProperty("m", "text", optional=False)).with_(version=2),
                ea.with_property(EventProperty("when", "time")).with_(version=2), ea.with_(event_version=None, version=2)):
        with pytest.raises(UpgradeError):
            merge_ontologies(old, old.put(bad))
    assert compare(ObjectType("e", data_type="enum:a"), ObjectType("e", data_type="enum:a:b", version=2))[0] is Outcome.UPGRADE
    with pytest.raises(UpgradeError):
        compare(ObjectType("e", data_type="enum:a:b"), ObjectType("e", data_type="enum:a", version=2))
    assert compare(ObjectType("e", regex_hard="a"), ObjectType("e", regex_hard="a|b", version=2))[0] is Outcome.UPGRADE
    assert bump(Concept("c"), Concept("c", description="new")).version == 2 and bump(Concept("c"), Concept("c")).version == 1


def test_concept_names():
    assert generalizations("a.b.c") == ["a.b", "a"] and specializations(["a.b", "a", "ab"], "a") == ["a.b"] and share_branch("c1", "c12")


def test_xml_round_trip(spark, tmp_path):
    rows = [(1, "ea", "/a/", {"k": ["a<&>\"", "b"], "n": ["1"]}, ["f" * 40], {"doc": {"1": "text"}}), (2, "ea", "/a/", {"k": ["c"]})]
    f = frame(spark, rows)
    event_xml.write_events(EventFrame(f.df.coalesce(1), f.ontology), str(tmp_path / "out"), namespace="urn:x", foreign=["<other>1</other>"])
    back = event_xml.read_events(spark, f"{tmp_path}/out/part-*")
    assert sets.equivalent(f, back) and compare_ontologies(f.ontology, back.ontology) is Outcome.EQUAL
    name = next((tmp_path / "out").glob("part-*"))
    assert len(event_xml.foreign_elements(str(name), ["other"])) == 1
    fast = event_xml.scan(spark, str(name), f.ontology)
    assert sorted(map(str, (r["properties"] for r in fast.collect()))) == sorted(map(str, (r["properties"] for r in f.df.collect())))
    reader, text, got = event_xml.PushReader(), name.read_text(), []
    for ch in text:
        got += reader.feed(ch)
    reader.close()
    assert len(got) == 2 and reader.counts == {"ea": 2} and len(reader.foreign) == 1
    parsed = event_xml.parse_events(f.df.select(event_xml.event_text().alias("value")))
    assert parsed.where("event_type = 'ea'").count() == 2


def test_transcoding(spark):
    own = EventType("t", "t", "ts", "t", "[[p]]", "[[p]]").with_property(EventProperty("p", "text")).with_property(EventProperty("i", "number"))
    base = ontology()
    records = [{"kind": "x", "a": {"b": ["v1", "v2", ""]}, "n": 7, "f": True}, {"kind": "x", "a": {"b": []}, "n": None, "f": False}, {"kind": "gone", "a": None, "n": 1, "f": None}, {"kind": "other", "a": None, "n": 1, "f": None}]
    schema = "kind string, a struct<b:array<string>>, n int, f boolean"
    upper = {"p": several(lambda v: F.array(F.upper(v), v))}
    m = Mediator(base, "/a/", "kind").register("x", Transcoder(own, {"a.b": "p", "n": "i", "f": "p", "no.such": "p", "a.b.0": ["p"]}, post=upper)).register("gone", DISCARD)
    got = [r["properties"] for r in m.transcode(spark.createDataFrame(records, schema)).df.collect()]
    assert got == [{"p": ["TRUE", "V1", "V2", "true", "v1", "v2"], "i": ["7"]}, {"p": ["FALSE", "false"]}]
    assert m.unknown(spark.createDataFrame(records, schema)).count() == 1
    with pytest.raises(ValueError):
        m.register("x", DISCARD)
    with pytest.raises(OntologyError):
        Transcoder(own, {"a": "zz"}).check()
    assert harness.run(spark, m, records[:1], schema).df.count() == 1
    assert "t" in harness.describe(m.specs["x"])


def test_guard_updates_and_closing(spark):
    own = EventType("t").with_property(EventProperty("p", "text")).with_property(EventProperty("q", "text"))
    df = spark.createDataFrame([("x", "y")], "a string, b string")

    def broken(value):
        raise ValueError("no such thing")

    m = Mediator(ontology(), "/a/").register(None, Transcoder(own, {"a": "p", "b": "q"}, post={"q": broken}))
    with pytest.raises(ValueError, match="no such thing"):
        m.transcode(df)
    m.guard = True
    with pytest.warns(UserWarning, match="property q is left out"):
        assert [r["properties"] for r in m.transcode(df).df.collect()] == [{"p": ["x"]}]
    assert m.ontology_update() is m.ontology and m.ontology_update() is None
    m.register("other", Transcoder(own.with_(name="u"), {"a": "p"}))
    assert "u" in m.close().event_types and m.close() is None
    with pytest.raises(ValueError, match="closed"):
        m.transcode(df)


def test_harness_of_documents(spark):
    (spec,) = lifts("lift")
    m = XmlMediator(ontology(), "/a/").register("/port/night/lift", spec)
    assert [r["properties"]["q"] for r in harness.run_xml(spark, m, [DOCUMENT]).df.collect()] == [["c3"]]
    broken = spec.event_type.with_(summary="[[nothing]]")
    with pytest.raises(OntologyError):
        harness.run_xml(spark, XmlMediator(ontology(), "/a/").register("/port/night/lift", Transcoder(broken, spec.properties)), [DOCUMENT])


def test_shared_definitions():
    good, bad = Concept("c", "c", "cs", "a thing"), ObjectType("Bad name", data_type="none")
    assert brick_errors(Bricks(good)) == [] and len(brick_errors(Bricks(good, bad))) >= 2
    assert parse_ontology(brick_text(Bricks(good, ObjectType("text", "t", "ts", "x")))).concepts["c"] == good


DOCUMENT = """<port xmlns="urn:x"><day no="3"><lift id="c1"><box>B1</box><box>B2</box><by><name>Ann</name></by></lift>
<!-- <lift id="no"/> --><lift id="c2"><box><![CDATA[<B3>]]></box><lift id="inner"><box>B4</box></lift></lift></day>
<night><lift id="c3"><box>B5</box></lift></night></port>"""


def lifts(*names):
    own = EventType("t").with_property(EventProperty("p", "text")).with_property(EventProperty("q", "text"))
    return [Transcoder(own.with_(name=n), {"box": "p", "@id": "q"}) for n in names]


def made(spark, mediator, *texts):
    rows = mediator.transcode(spark.createDataFrame([(t,) for t in texts], "x string"), "x").df.collect()
    return sorted((r["event_type"], r["properties"].get("q", [None])[0], tuple(r["properties"].get("p", []))) for r in rows)


def test_each_xml_element_goes_to_the_first_transcoder_that_selects_it(spark):
    day, any_lift = lifts("day.lift", "other.lift")
    m = XmlMediator(ontology(), "/a/").register("/port/day/lift", day).register("lift", any_lift)
    want = [("day.lift", "c1", ("B1", "B2")), ("day.lift", "c2", ("<B3>",)), ("other.lift", "c3", ("B5",)), ("other.lift", "inner", ("B4",))]
    assert made(spark, m, DOCUMENT, None) == want
    df = spark.createDataFrame([(DOCUMENT,)], "x string")
    assert [tuple(r) for r in m.unknown(df, "x", ["name", "night", "lift"]).orderBy("tag").collect()] == [("name", 1), ("night", 1)]
    with pytest.raises(ValueError):
        m.register("lift", any_lift)


def test_discarded_xml_elements_take_what_is_in_them_along(spark):
    (any_lift,) = lifts("lift")
    m = XmlMediator(ontology(), "/a/").register("/port/day/lift", DISCARD).register("//lift", any_lift)
    assert made(spark, m, DOCUMENT) == [("lift", "c3", ("B5",))]
    m = XmlMediator(ontology(), "/a/").register("//lift", any_lift).register("/port/day/lift", DISCARD)
    assert len(made(spark, m, DOCUMENT)) == 4


def test_xml_parts_paths_and_edits(spark):
    own = EventType("t").with_property(EventProperty("p", "text")).with_property(EventProperty("q", "text"))
    parts = Transcoder(own.with_(name="box"), {".": "p", "/port/day/@no": "q"}, explode="box")
    edited = Transcoder(own.with_(name="by"), {"name/text()": "p"}, edit=lambda df: df.unionByName(df))
    m = XmlMediator(ontology(), "/a/").register("/port/*/lift", parts).register("by", edited)
    assert made(spark, m, DOCUMENT) == [("box", "3", ("<B3>",)), ("box", "3", ("B1",)), ("box", "3", ("B2",)), ("box", "3", ("B5",)), ("by", None, ("Ann",)), ("by", None, ("Ann",))]


def test_broken_xml(spark):
    (spec,) = lifts("lift")
    with pytest.raises(Exception, match="no XML document"):
        made(spark, XmlMediator(ontology(), "/a/").register("lift", spec), "<port>")
    assert made(spark, XmlMediator(ontology(), "/a/", ignore_invalid=True).register("lift", spec), "<port>", DOCUMENT)[0][1] == "c1"


def test_many_files_have_ids_of_their_own_and_bad_ones_are_errors(spark, tmp_path):
    f = frame(spark, [event(i, i) for i in range(6)])
    event_xml.write_events(EventFrame(f.df.repartition(6), f.ontology), str(tmp_path / "out"))
    back = event_xml.read_events(spark, f"{tmp_path}/out/part-*")
    assert back.df.select("event_id").distinct().count() == 6 and compare_ontologies(f.ontology, back.ontology) is Outcome.EQUAL
    text = next(p for p in (tmp_path / "out").glob("part-*") if "<event " in p.read_text()).read_text()

    def read(name, changed, **how):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.xml").write_text(changed)
        return event_xml.read_events(spark, str(tmp_path / name / "a.xml"), **how).df.count()

    strange = text.replace('event event-type="ea"', 'event event-type="zz"', 1)
    assert read("keep", strange, unknown="keep") - read("drop", strange, unknown="drop") == 1
    for name, changed in (("type", strange), ("nested", text.replace("<properties><", "<ontology/><properties><", 1) if "<event " in text else ""), ("version", text.replace('version="3.0.0"', 'version="4.0.0"', 1))):
        with pytest.raises(Exception):
            read(name, changed)
    reader = event_xml.PushReader()
    with pytest.raises(OntologyError, match="misplaced"):
        reader.feed(text.replace("<event ", "<event><event ", 1))


def test_streamed_files(spark, tmp_path):
    f = frame(spark, [event(i, i) for i in range(5)])
    event_xml.write_events(EventFrame(f.df.repartition(3), f.ontology), str(tmp_path / "in"))
    own = event_xml.stream_events(spark, f"{tmp_path}/in/part-*", f.ontology)
    got = []
    own.df.writeStream.foreachBatch(lambda df, n: got.extend(r["event_id"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(set(got)) == len(got) == 5


def test_checked_writing(spark, tmp_path):
    rows = [event(1, 1), (2, "ea", "/a/", {"k": ["b"], "n": ["+07"], "x": ["1"], "v": ["1"]}), (3, "ea", "/a/", {"k": ["c"], "n": ["x"], "x": ["1"], "v": ["1"]})]
    f = frame(spark, rows)
    with pytest.raises(ValueError, match="event 3"):
        event_xml.write_checked(f, str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()
    with pytest.warns(UserWarning, match="1 of 2"):
        assert event_xml.write_checked(f, str(tmp_path / "out"), ignore_invalid=True) == {"written": 2, "repaired": 1, "left_out": 1}
    back = event_xml.read_events(spark, f"{tmp_path}/out/part-*").df.collect()
    assert sorted(r["properties"]["n"][0] for r in back) == ["7", "9"]


def test_stats_and_replay(spark):
    f = frame(spark, [event(1, 1, a=["p", "q"]), event(2, 2, a=["p"])])
    row = {r["property"]: r.asDict() for r in stats.property_stats(f, "ea").collect()}["a"]
    assert row == {"property": "a", "n_events": 2, "n_values": 3, "n_distinct": 2, "n_without": 0, "n_single": 1, "n_several": 1}
    made = replay.dummy_events(spark, 200, 0.5, 10)
    assert merge.merge(made).df.count() < 200 and ontology_errors(made.ontology) == []
    time = Ontology().create(ObjectType("time", data_type="datetime"), EventSource("/a/"), EventType("e", timespan_start="t").with_property(EventProperty("t", "time")))
    g = frame(spark, [(1, "e", "/a/", {"t": ["2020-01-01T00:00:00.000000Z"]}), (2, "e", "/a/", {"t": ["2020-01-02T00:00:10.000000Z"]})], time)
    rows = replay.delays(g, 2.0).orderBy("event_id").collect()
    assert [r["gap_seconds"] for r in rows] == [0.0, 43205.0] and rows[1]["offset_seconds"] == 43205.0
    moved = replay.shifted(g, F.to_timestamp(F.lit("2030-01-01 00:00:00")), 2.0).df.orderBy("event_id").collect()
    assert [r["properties"]["t"] for r in moved] == [["2030-01-01T00:00:00.000000Z"], ["2030-01-01T12:00:05.000000Z"]]


def test_empty_frames(spark):
    f = frame(spark, [])
    assert merge.merge(f).df.count() == 0 and validation.validate(f).count() == 0 and stats.event_type_counts(f).collect()[0]["n_events"] == 0
