"""Queries over schemas: each rule with a definition that keeps it and ones that break it, each kind of upgrade, edits of
schemas, and what they are written as. The results are tables of cases; the SQL lists what each case has to give."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import template
from tidemark.functions.datatypes import DataType
from tidemark.ontology import check, describe, upgrade
from tidemark.ontology.factory import EventTypes
from tidemark.ontology.model import (
    Attachment, Bricks, Concept, EventProperty, EventSource, EventType, ObjectType, Ontology, OntologyError, Parent, PropertyConcept, Relation,
    generalizations, is_specialization, share_branch, specializations,
)
from tidemark.ontology.xml import ontology_text, parse_ontology
from tidemark.plans.schemas import harbour_ontology
from tidemark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


def cases(expected: str) -> Callable:
    """Registers a query from a function that gives cases with their outcomes; ``expected`` has one word for each case."""

    def add(f: Callable[[], Iterable[tuple[str, object]]]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return spark.createDataFrame([(name, str(outcome)) for name, outcome in f()], "c string, outcome string").select(F.col("c").alias("rule"), "outcome")

        QUERIES[f.__name__] = run
        pairs = [line.strip().split(" = ") for line in expected.strip().splitlines()]
        SQL[f.__name__] = "SELECT * FROM (VALUES " + ", ".join("('{}', '{}')".format(*(p.replace("'", "''") for p in pair)) for pair in pairs) + ") t(rule, outcome)"
        return f

    return add


def _ok(errors: Iterable[str]) -> str:
    return "broken" if list(errors) else "kept"


TEXT = dict(display_name_singular="a", display_name_plural="as", description="about a")
LONG = "x" * 300


@cases(
    """plain = kept
    name with capitals = broken
    long name = broken
    long description = broken
    unknown data type = broken
    unit of a number = kept
    unit of a text = broken
    radix without unit = broken
    fuzzy text = kept
    fuzzy number = broken
    unknown fuzzy = broken
    pattern = kept
    pattern of a number = broken
    invalid pattern = broken
    soft pattern = kept"""
)
def rules_object_type() -> Iterable[tuple[str, object]]:
    plain = ObjectType("cargo.weight", **TEXT)
    number = plain.with_(data_type="number:int")
    made = {
        "plain": plain, "name with capitals": plain.with_(name="Cargo"), "long name": plain.with_(name="c" * 65), "long description": plain.with_(description=LONG), "unknown data type": plain.with_(data_type="number:huge"),
        "unit of a number": number.with_(unit_name="tonne", unit_symbol="t"), "unit of a text": plain.with_(unit_name="tonne", unit_symbol="t"), "radix without unit": number.with_(prefix_radix=10),
        "fuzzy text": plain.with_(fuzzy_matching="[:3]"), "fuzzy number": number.with_(fuzzy_matching="[:3]"), "unknown fuzzy": plain.with_(fuzzy_matching="roughly"), "pattern": plain.with_(regex_hard="[a-z]+"),
        "pattern of a number": number.with_(regex_hard="[0-9]+"), "invalid pattern": plain.with_(regex_hard="[a-"), "soft pattern": plain.with_(regex_soft="[a-z]*"),
    }
    return [(n, _ok(check.object_type_errors(o))) for n, o in made.items()]


@cases(
    """concept = kept
    concept with a bad name = broken
    concept with a long text = broken
    source = kept
    source with a date = kept
    source with a bad date = broken
    source without slashes = broken
    source without description = broken"""
)
def rules_concept_and_source() -> Iterable[tuple[str, object]]:
    c, s = Concept("ship", **TEXT), EventSource("/port/quay/", "the quay")
    return [
        ("concept", _ok(check.concept_errors(c))), ("concept with a bad name", _ok(check.concept_errors(c.with_(name="ship!")))), ("concept with a long text", _ok(check.concept_errors(c.with_(description=LONG)))),
        ("source", _ok(check.source_errors(s))), ("source with a date", _ok(check.source_errors(s.with_(date_acquired="20310203")))), ("source with a bad date", _ok(check.source_errors(s.with_(date_acquired="3 Feb")))),
        ("source without slashes", _ok(check.source_errors(s.with_(uri="port")))), ("source without description", _ok(check.source_errors(s.with_(description="")))),
    ]


@cases(
    """property = kept
    reserved name = broken
    confidence 0 = broken
    confidence 11 = broken
    unknown strategy = broken
    optional minimum = broken
    mandatory minimum = kept
    minimum of a text = broken
    minimum of several values = broken
    match of a float = broken
    association = kept
    association of confidence 11 = broken
    naming priority 256 = broken
    names without extension = broken
    names with extension = kept"""
)
def rules_property() -> Iterable[tuple[str, object]]:
    p = EventProperty("depth", "water.depth", "how deep")
    number, text, real = DataType("number:int"), DataType("string:0:mc"), DataType("number:float")
    least = p.with_merge("min")
    about = p.identifies("ship", 5, 100)
    made = [
        ("property", p, number), ("reserved name", p.with_(name="xml-depth"), number), ("confidence 0", p.with_(confidence=0), number), ("confidence 11", p.with_(confidence=11), number), ("unknown strategy", p.with_(merge="mean"), number),
        ("optional minimum", least.with_(optional=True), number), ("mandatory minimum", least, number), ("minimum of a text", least, text), ("minimum of several values", least.with_(multivalued=True), number),
        ("match of a float", p.with_merge("match"), real), ("association", about, number), ("association of confidence 11", p.identifies("ship", 11), number), ("naming priority 256", p.identifies("ship", 5, 256), number),
        ("names without extension", p.identifies("ship", 5, 100, display_name_singular="depth"), number), ("names with extension", p.identifies("ship", 5, 100, extension="deep", display_name_singular="depth"), number),
    ]
    return [(n, _ok(check.property_errors(x, "type", kind))) for n, x, kind in made]


def _lift() -> EventType:
    return EventType(
        "crane.lift", **TEXT, summary="[[crane]]", story="[[crane]] at [[begin]]", properties=(
            EventProperty("crane", "code", "crane", multivalued=False, merge="match").identifies("machine"), EventProperty("box", "code", "box").identifies("box"),
            EventProperty("begin", "time", "begin", multivalued=False), EventProperty("number", "count", "number").with_merge("max"), EventProperty("note", "text", "note"),
        ),
    )


KINDS = {"code": "string:0:mc", "time": "datetime", "count": "sequence", "text": "string:0:mc"}


def _whole(*types: EventType) -> Ontology:
    kinds = [ObjectType(n, n, f"{n}s", n, k) for n, k in KINDS.items()]
    return Ontology().create(*kinds, Concept("machine", **TEXT), Concept("box", **TEXT), EventSource("/port/", "port"), *types)


def _type_errors(own: EventType) -> str:
    return _ok(check.event_type_errors(own, {p.name: DataType(KINDS[p.object_type]) for p in own.properties if p.object_type in KINDS}))


@cases(
    """inter = kept
    unknown property = broken
    confidence 11 = broken
    no concept = broken
    wrong concept = broken
    other with a concept = broken
    other = kept
    name = kept
    name with a predicate = broken
    name of several values = broken
    original of several values = broken
    bad description = broken"""
)
def rules_relation() -> Iterable[tuple[str, object]]:
    own = _lift()
    inter = own.relate("inter", "crane", "box", "lifts").relations[0]
    name = Relation("name", "crane", "note")
    made = {
        "inter": inter, "unknown property": inter.with_(target="barge"), "confidence 11": inter.with_(confidence=11), "no concept": inter.with_(source_concept=None), "wrong concept": inter.with_(source_concept="box"),
        "other with a concept": inter.with_(type="other"), "other": inter.with_(type="other", source_concept=None, target_concept=None), "name": name, "name with a predicate": name.with_(predicate="named"),
        "name of several values": name.with_(source="note", target="crane"), "original of several values": name.with_(type="original"), "bad description": inter.with_(description="[[barge]]"),
    }
    kinds = {p.name: DataType(KINDS[p.object_type]) for p in own.properties}
    return [(n, _ok(check.relation_errors(r, own, kinds))) for n, r in made.items()]


@cases(
    """attachment = kept
    attachment with a dot = broken
    attachment without description = broken
    attachment in hex = broken
    parent = kept
    parent without map = broken
    parent without description = broken"""
)
def rules_attachment_and_parent() -> Iterable[tuple[str, object]]:
    a, p = Attachment("log", **TEXT), Parent("crane.lift", (("crane", "crane"),))
    made = [("attachment", a), ("attachment with a dot", a.with_(name="log.txt")), ("attachment without description", a.with_(description="")), ("attachment in hex", a.with_(encoding="hex"))]
    return [(n, _ok(check.attachment_errors(x, "type"))) for n, x in made] + [
        (n, _ok(check.parent_errors(x, "type"))) for n, x in (("parent", p), ("parent without map", p.with_(property_map=())), ("parent without description", p.with_(parent_description="")))
    ]


@cases(
    """plain = kept
    bad name = broken
    bad summary = broken
    bad story = broken
    start = kept
    start that is no time = broken
    start that is no property = broken
    end = kept
    version = kept
    version that is a time = broken
    version that adds up = broken
    optional version = broken
    sequence = kept
    sequence that is a text = broken
    replace without version = broken
    replace with version = kept"""
)
def rules_event_type() -> Iterable[tuple[str, object]]:
    own = _lift()
    versioned = own.with_(event_version="number")
    newest = own["note"].with_merge("replace")
    made = {
        "plain": own, "bad name": own.with_(name="Crane Lift"), "bad summary": own.with_(summary="[[barge]]"), "bad story": own.with_(story="{[[crane]]"), "start": own.with_(timespan_start="begin"),
        "start that is no time": own.with_(timespan_start="crane"), "start that is no property": own.with_(timespan_start="start"), "end": own.with_(timespan_end="begin"), "version": versioned, "version that is a time": own.with_(event_version="begin"),
        "version that adds up": versioned.with_property(own["number"].with_(merge="add")), "optional version": versioned.with_property(own["number"].with_(optional=True)), "sequence": own.with_(sequence="number"),
        "sequence that is a text": own.with_(sequence="crane"), "replace without version": own.with_property(newest), "replace with version": versioned.with_property(newest),
    }
    return [(n, _type_errors(t)) for n, t in made.items()]


@cases(
    """whole = kept
    missing object type = broken
    missing concept = broken
    child = kept
    child of an unknown type = broken
    child without a mapped property = broken
    child mapped to an unhashed property = broken
    child that adds up = broken
    checked = raised"""
)
def rules_ontology() -> Iterable[tuple[str, object]]:
    parent = _lift()
    child = EventType("lift.note", **TEXT, summary="[[crane]]", story="[[crane]]", properties=(EventProperty("crane", "code", "crane", merge="match"), EventProperty("note", "text", "note"))).child_of(parent)
    both = _whole(parent, child)
    stray = both.put(parent.with_property(EventProperty("depth", "water.depth", "depth")))
    made = {
        "whole": _whole(parent), "missing object type": stray, "missing concept": both.put(parent.with_property(parent["note"].identifies("story"))), "child": both,
        "child of an unknown type": _whole(child), "child without a mapped property": both.put(child.without_property("crane")), "child mapped to an unhashed property": both.put(child.with_(parent=child.parent.map("note", "note"))),
        "child that adds up": both.put(child.with_property(child["crane"].with_(merge="add"))),
    }
    out: list[tuple[str, object]] = [(n, _ok(check.ontology_errors(o))) for n, o in made.items()]
    try:
        check.checked(stray)
    except OntologyError:
        out.append(("checked", "raised"))
    return out


def _outcome(old: object, new: object, times: set[str] = frozenset()) -> str:
    try:
        return upgrade.compare(old, new, times)[0].name.lower()
    except upgrade.UpgradeError:
        return "error"


@cases(
    """same = equal
    new description = upgrade
    new description without version = error
    older one second = upgrade
    more choices = upgrade
    fewer choices = error
    other choices = error
    other data type = error
    other unit = error
    wider pattern = upgrade
    narrower pattern = error
    no pattern = upgrade
    first pattern = error
    newer version = upgrade"""
)
def upgrades_object_type() -> Iterable[tuple[str, object]]:
    a = ObjectType("state", **TEXT, data_type="enum:in:out")
    p = ObjectType("code", **TEXT, regex_hard="[a-z]")
    b, q = a.with_(version=2), p.with_(version=2)
    return [
        ("same", _outcome(a, a)), ("new description", _outcome(a, b.with_(description="new"))), ("new description without version", _outcome(a, a.with_(description="new"))), ("older one second", _outcome(b.with_(description="new"), a)),
        ("more choices", _outcome(a, b.with_(data_type="enum:in:out:far"))), ("fewer choices", _outcome(a, b.with_(data_type="enum:in"))), ("other choices", _outcome(a, b.with_(data_type="enum:out:in"))), ("other data type", _outcome(a, b.with_(data_type="datetime"))),
        ("other unit", _outcome(a, b.with_(unit_name="m"))), ("wider pattern", _outcome(p, q.with_(regex_hard="[a-z]|[0-9]"))), ("narrower pattern", _outcome(p, q.with_(regex_hard="a"))), ("no pattern", _outcome(p, q.with_(regex_hard=None))),
        ("first pattern", _outcome(a, b.with_(regex_hard="x"))), ("newer version", _outcome(a, b)),
    ]


@cases(
    """concept = equal
    concept with a new text = upgrade
    concept without a new version = error
    source = upgrade
    source of another uri = error
    next version = 2
    same version = 1"""
)
def upgrades_concept_and_source() -> Iterable[tuple[str, object]]:
    c, s = Concept("ship", **TEXT), EventSource("/port/", "port")
    new = c.with_(description="a vessel")
    return [
        ("concept", _outcome(c, c)), ("concept with a new text", _outcome(c, new.with_(version=2))), ("concept without a new version", _outcome(c, new)), ("source", _outcome(s, s.with_(description="all", version=2))),
        ("source of another uri", _outcome(s, s.with_(uri="/quay/", version=2))), ("next version", upgrade.bump(c, new).version), ("same version", upgrade.bump(c, c).version),
    ]


@cases(
    """property = equal
    property with a text = upgrade
    property with several values = upgrade
    property with one value = error
    optional property = upgrade
    mandatory property = error
    other strategy = error
    other object type = error
    new association = upgrade
    lost association = error
    association with another confidence = upgrade
    association with another extension = error
    relation with a text = upgrade
    relation of another source = error
    attachment with a text = upgrade
    attachment of another encoding = error
    parent with a text = upgrade
    parent with another map = error"""
)
def upgrades_parts() -> Iterable[tuple[str, object]]:
    p = EventProperty("crane", "code", "crane", multivalued=False, optional=False)
    many, known = p.with_(multivalued=True), p.identifies("machine", 5)
    a = PropertyConcept("machine", 5)
    r, f, o = Relation("other", "crane", "box", description="x"), Attachment("log", **TEXT), Parent("crane.lift", (("crane", "crane"),))
    return [
        ("property", _outcome(p, p)), ("property with a text", _outcome(p, p.with_(description="new"))), ("property with several values", _outcome(p, many)), ("property with one value", _outcome(many, p)), ("optional property", _outcome(p, p.with_(optional=True))),
        ("mandatory property", _outcome(p.with_(optional=True), p)), ("other strategy", _outcome(p, p.with_(merge="add"))), ("other object type", _outcome(p, p.with_(object_type="text"))), ("new association", _outcome(p, known)), ("lost association", _outcome(known, p)),
        ("association with another confidence", _outcome(a, a.with_(confidence=6))), ("association with another extension", _outcome(a, a.with_(extension="x"))), ("relation with a text", _outcome(r, r.with_(description="y"))), ("relation of another source", _outcome(r, r.with_(source="note"))),
        ("attachment with a text", _outcome(f, f.with_(description="new"))), ("attachment of another encoding", _outcome(f, f.with_(encoding="base64"))), ("parent with a text", _outcome(o, o.with_(siblings_description="new"))), ("parent with another map", _outcome(o, o.map("box", "box"))),
    ]


@cases(
    """same = equal
    story = upgrade
    story without version = error
    optional property = upgrade
    mandatory property = error
    lost property = error
    relation = upgrade
    lost relation = error
    attachment = upgrade
    lost attachment = error
    parent = upgrade
    lost parent = error
    time for a type with times = upgrade
    time for a type without times = error
    other timespan = error"""
)
def upgrades_event_type() -> Iterable[tuple[str, object]]:
    old = _lift()
    new, timeless = old.with_(version=2), old.without_property("begin")
    related, filed, child = new.relate("inter", "crane", "box"), new.with_attachment(Attachment("log", **TEXT)), new.with_(parent=Parent("day", (("crane", "crane"),)))
    later = EventProperty("end", "time", "end")

    def less(t: EventType) -> EventType:
        return old.with_(version=3, relations=(), attachments=(), parent=None) if t else old

    return [
        ("same", _outcome(old, old)), ("story", _outcome(old, new.with_(story="new"))), ("story without version", _outcome(old, old.with_(story="new"))), ("optional property", _outcome(old, new.with_property(EventProperty("more", "text")))),
        ("mandatory property", _outcome(old, new.with_property(EventProperty("more", "text", optional=False)))), ("lost property", _outcome(old, new.without_property("note"))), ("relation", _outcome(old, related)), ("lost relation", _outcome(related, less(related))),
        ("attachment", _outcome(old, filed)), ("lost attachment", _outcome(filed, less(filed))), ("parent", _outcome(old, child)), ("lost parent", _outcome(child, less(child))), ("time for a type with times", _outcome(old, new.with_property(later), {"time"})),
        ("time for a type without times", _outcome(timeless, timeless.with_(version=2).with_property(later), {"time"})), ("other timespan", _outcome(old, new.with_(timespan_start="begin"))),
    ]


@cases(
    """same = equal
    merged = upgrade
    merged has the new type = True
    merged has the new property = True
    merged with the old one = same object
    conflict = error
    created twice = error
    version after changes = True"""
)
def upgrades_ontology() -> Iterable[tuple[str, object]]:
    old = _whole(_lift())
    more = old.put(_lift().with_(version=2).with_property(EventProperty("more", "text", "more")), EventType("day", **TEXT))
    merged = upgrade.merge_ontologies(old, more)

    def fails(f: Callable[[], object]) -> str:
        try:
            f()
        except OntologyError:
            return "error"
        return "none"

    return [
        ("same", upgrade.compare_ontologies(old, old).name.lower()), ("merged", upgrade.compare_ontologies(old, merged).name.lower()), ("merged has the new type", "day" in merged.event_types), ("merged has the new property", "more" in merged.event_types["crane.lift"].by_name),
        ("merged with the old one", "same object" if upgrade.merge_ontologies(merged, old) is merged else "another"), ("conflict", fails(lambda: upgrade.merge_ontologies(old, old.put(_lift().with_(version=2).without_property("note"))))),
        ("created twice", fails(lambda: old.create(EventSource("/port/")))), ("version after changes", more.modified_since(old.version)),
    ]


@cases(
    """dropped object type takes properties = box,crane
    dropped object type takes relations = 0
    dropped concept takes associations = 0
    dropped event type takes links = None
    dropped nothing = same object
    bricks = cargo
    concepts of relations = inter:machine,box:crane,box
    relations by type = 1
    relations from = 1
    relations to = 0
    reversed = box>crane
    hashed = crane
    single = begin,crane,number
    mandatory = number
    mapped child = crane:crane
    edited map = crane:crane,note:box
    implied by max = False,False
    timeless = False
    lost property of a relation = error"""
)
def ontology_edits() -> Iterable[tuple[str, object]]:
    own = _lift().relate("inter", "crane", "box", "lifts")
    child = EventType("lift.note", **TEXT, properties=(EventProperty("crane", "code"), EventProperty("note", "text"))).child_of(own)
    whole = _whole(own, child)
    bare = whole.drop(ObjectType, "code").event_types["crane.lift"]
    known = whole.put(own.with_property(EventProperty("goods", "cargo", "goods")))
    added = Bricks(ObjectType("cargo", **TEXT), ObjectType("unused", **TEXT)).complete(known)
    r = own.relations[0]
    number = own["note"].with_merge("max")
    try:
        own.relate("other", "crane", "barge")
        lost = "none"
    except OntologyError:
        lost = "error"
    return [
        ("dropped object type takes properties", ",".join(sorted(set(own.by_name) - set(bare.by_name)))), ("dropped object type takes relations", len(bare.relations)),
        ("dropped concept takes associations", sum(len(p.concepts) for p in whole.drop(Concept, "machine").event_types["crane.lift"].properties if p.name == "crane")),
        ("dropped event type takes links", whole.drop(EventType, "crane.lift").event_types["lift.note"].parent), ("dropped nothing", "same object" if whole.drop(Concept, "none") is whole else "another"),
        ("bricks", ",".join(sorted(set(added.object_types) - set(whole.object_types)))), ("concepts of relations", r.id), ("relations by type", len(own.related("inter"))), ("relations from", len(own.related(source="crane"))), ("relations to", len(own.related(target="crane"))),
        ("reversed", f"{r.reversed().source}>{r.reversed().target}"), ("hashed", ",".join(own.hashed_properties)), ("single", ",".join(sorted(own.singular_properties))), ("mandatory", ",".join(own.mandatory_properties)),
        ("mapped child", ",".join(":".join(x) for x in child.parent.property_map)), ("edited map", ",".join(":".join(x) for x in child.parent.map("note", "box").property_map)), ("implied by max", f"{number.optional},{number.multivalued}"),
        ("timeless", whole.is_timeless("crane.lift")), ("lost property of a relation", lost),
    ]


@cases(
    """generalizations = ship.tanker,ship
    specializations = ship.tanker,ship.tanker.gas
    one branch = True
    one branch by letters = True
    two branches = False
    special = True
    not special = False
    attribute = code:
    attribute with extension = code:hull"""
)
def concept_branches() -> Iterable[tuple[str, object]]:
    p = EventProperty("crane", "code").identifies("machine").identifies("ship", extension="hull")
    return [
        ("generalizations", ",".join(generalizations("ship.tanker.gas"))), ("specializations", ",".join(specializations(["ship", "ship.tanker", "ship.tanker.gas", "shipyard"], "ship"))), ("one branch", share_branch("ship.tanker", "ship")),
        ("one branch by letters", share_branch("ship", "shipyard")), ("two branches", share_branch("ship.tanker", "ship.tug")), ("special", is_specialization("ship", "ship.tug")), ("not special", is_specialization("ship", "ship")),
        ("attribute", p.attribute_name("machine")), ("attribute with extension", p.attribute_name("ship")),
    ]


@cases(
    """properties of a template = cargo,vessel
    unbalanced = broken
    unknown property = broken
    unknown formatter = broken
    too few arguments = broken
    wrong type = broken
    good = kept
    definition of a data type = kept
    definition without digits = broken
    definition of an empty choice = broken"""
)
def template_rules() -> Iterable[tuple[str, object]]:
    own = EventType("call", properties=(EventProperty("vessel", "text"), EventProperty("cargo", "text"), EventProperty("begin", "time")))
    kinds = {p.name: DataType(KINDS[p.object_type]) for p in own.properties}
    texts = {"unbalanced": "{[[vessel]]", "unknown property": "[[barge]]", "unknown formatter": "[[loud:vessel]]", "too few arguments": "[[duration:begin]]", "wrong type": "[[date_time:vessel,year]]", "good": "{[[vessel]]{ of [[date_time:begin,year]]}}"}
    kinds_of = {"definition of a data type": "number:decimal:9:2", "definition without digits": "number:decimal", "definition of an empty choice": "enum"}
    return [
        ("properties of a template", ",".join(sorted(template.property_names("[[vessel]]{ with [[merge:cargo,vessel]]}")))), *[(n, _ok(template.errors(t, own, kinds))) for n, t in texts.items()],
        *[(n, _ok(DataType(t).definition_errors())) for n, t in kinds_of.items()],
    ]


@cases(
    """nothing is lost = equal
    event types = 17
    roots = 1
    describes its types = True
    describes its relations = True
    paths of concepts = True
    hierarchy = True"""
)
def ontology_texts() -> Iterable[tuple[str, object]]:
    own = harbour_ontology().put(EventSource("/port/", "the port"))
    child = EventType("lift.note", **TEXT, properties=(EventProperty("serial", "record.serial"),)).child_of(own.event_types["crane.lift"])
    whole = own.put(child)
    text, told = ontology_text(whole), describe.describe(whole, "port")
    return [
        ("nothing is lost", upgrade.compare_ontologies(whole, parse_ontology(text)).name.lower()), ("event types", text.count("<event-type ")), ("roots", text.count("<ontology>")), ("describes its types", "crane.lifts" in told),
        ("describes its relations", "ship to company" in told), ("paths of concepts", "--" in describe.concept_paths(whole)), ("hierarchy", '"crane.lift" -> "lift.note"' in describe.hierarchy(whole)),
    ]


class _Declared(EventTypes):
    TYPES = ("stay", "lift")
    PROPERTIES = {"stay": {"ship": "text", "since": "time"}, "lift": {"ship": "text", "box": "code"}}
    MERGE = {"stay": {"ship": "match", "since": "min"}, "lift": {"ship": "match"}}
    SUMMARIES = {"stay": "[[ship]]", "lift": "[[box]]"}
    SINGLE = {"stay": ("ship",), "lift": ("ship",)}
    PARENTS = {"lift": ("stay", "during", "beside")}
    ATTACHMENTS = {"lift": ("log",)}
    TIMESPANS = {"stay": ("since", None)}


@cases(
    """types = lift,stay
    minimum is mandatory = True
    hashed = ship
    parent = stay
    attachments = log
    timespan = since
    undeclared = 2"""
)
def declared_types() -> Iterable[tuple[str, object]]:
    made = _Declared.ontology(*[ObjectType(n, n, f"{n}s", n, k) for n, k in KINDS.items()], EventSource("/port/", "port"))
    stay, lift = made.event_types["stay"], made.event_types["lift"]
    wrong = type("Wrong", (_Declared,), {"MERGE": {"stay": {"gone": "add"}, "none": {}}})
    return [
        ("types", ",".join(sorted(made.event_types))), ("minimum is mandatory", not stay["since"].optional), ("hashed", ",".join(stay.hashed_properties)), ("parent", lift.parent.event_type), ("attachments", ",".join(a.name for a in lift.attachments)),
        ("timespan", stay.timespan_start), ("undeclared", len(wrong.problems())),
    ]


# -- over the tables


def object_type_versions(spark: SparkSession, folder: str) -> DataFrame:
    """What each stored definition of an object type says of the next version of it. A fixed field that differs is an error, as
    is another data type that doesn't only add choices."""
    rows = table(spark, folder, "object_type").where("name IS NOT NULL AND version IS NOT NULL").dropDuplicates(["name", "version"]).collect()
    made = {(r["name"], r["version"]): ObjectType(r["name"], r["display_name_singular"] or "", r["display_name_plural"] or "", r["description"] or "", version=r["version"], compress=bool(r["compress"])) for r in rows}
    pairs = [((n, v), (n, min(w for m, w in made if m == n and w > v))) for n, v in made if any(m == n and w > v for m, w in made)]
    out = [(a[0], a[1], b[1], _outcome(made[a], made[b])) for a, b in pairs]
    return spark.createDataFrame(out, "name string, version int, next int, outcome string")


QUERIES["object_type_versions"] = object_type_versions
SQL["object_type_versions"] = """WITH v AS (SELECT DISTINCT name, version FROM object_type WHERE name IS NOT NULL AND version IS NOT NULL),
    n AS (SELECT name, version, lead(version) OVER (PARTITION BY name ORDER BY version) AS next FROM v)
    SELECT name, version, next, 'upgrade' AS outcome FROM n WHERE next IS NOT NULL"""
