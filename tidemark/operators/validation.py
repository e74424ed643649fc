"""Whether events keep the rules of their schema, and repair of those that don't; compiled to column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.frame import COLUMNS, EventFrame
from tidemark.functions.binding import let
from tidemark.functions.datatypes import DataType
from tidemark.ontology.model import ObjectType, Ontology

ISSUE = "array<struct<property:string,reason:string>>"


def valid_value(object_type: ObjectType, value: Column) -> Column:
    """Of the data type and, for strings, wholly matched by the hard pattern."""
    kind = DataType(object_type.data_type)
    good = kind.valid(value)
    if object_type.regex_hard is not None and kind.family == "string":
        good = good & value.rlike(rf"^(?:{object_type.regex_hard})\z")
    return good


def _issue(name: Column, reason: str) -> Column:
    return F.struct(name.alias("property"), F.lit(reason).alias("reason"))


def _texts(names: Iterable[str]) -> Column:
    return F.array(*[F.lit(n) for n in sorted(names)]).cast("array<string>")


def _pairs(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(pairs.items()) for x in pair]).cast("map<string,string>")


def _rules(ontology: Ontology, normalize: Mapping[str, Iterable[str]] | None, drop: Mapping[str, Iterable[str]]) -> Column:
    """What the row's event type demands, as one struct; null for unknown types. It is looked up once for each row, so
    the expressions that use it grow with the object types, not with event types times properties."""
    out = F.lit(None)
    for name, own in sorted(ontology.event_types.items()):
        named = {p.name for p in own.properties}
        mine = F.struct(
            _pairs({p.name: p.object_type for p in own.properties}).alias("objects"),
            _texts(own.singular_properties).alias("singles"),
            _texts(own.mandatory_properties).alias("mandatory"),
            _pairs({a.name: a.encoding for a in own.attachments}).alias("files"),
            _texts(named if normalize is None else named & set(normalize.get(name, ()))).alias("normalize"),
            _texts(named & set(drop.get(name, ()))).alias("drop"),
        )
        out = F.when(F.col("event_type") == name, mine).otherwise(out)
    return out


def _by_object_type(ontology: Ontology, object_type: Column, each: Callable[[ObjectType], Column], default: Column) -> Column:
    used = sorted({p.object_type for t in ontology.event_types.values() for p in t.properties} & set(ontology.object_types))
    out = default
    for name in used:
        out = F.when(object_type == name, each(ontology.object_types[name])).otherwise(out)
    return out


def _valid(ontology: Ontology, object_type: Column, value: Column) -> Column:
    return _by_object_type(ontology, object_type, lambda o: valid_value(o, value), F.lit(False))


def _property_issues(ontology: Ontology, rules: Column, entry: Column) -> Column:
    name, values, none = entry["key"], entry["value"], F.array().cast(ISSUE)
    object_type = F.try_element_at(rules["objects"], name)
    several = F.when((F.size(values) > 1) & F.array_contains(rules["singles"], name), F.array(_issue(name, "several values of a single-valued property"))).otherwise(none)
    good = let(object_type, lambda o: F.forall(values, lambda v: _valid(ontology, o, v)))
    invalid = F.when(good, none).otherwise(F.array(_issue(name, "invalid value")))
    return F.when(object_type.isNull(), F.array(_issue(name, "unknown property"))).otherwise(F.concat(several, invalid))


def _attachment_issues(rules: Column, entry: Column) -> Column:
    name, texts, none = entry["key"], F.map_values(entry["value"]), F.array().cast(ISSUE)
    encoding = F.try_element_at(rules["files"], name)
    empty = F.when(F.exists(texts, lambda t: t == ""), F.array(_issue(name, "empty attachment"))).otherwise(none)
    binary = F.forall(texts, lambda t: F.try_to_binary(t, F.lit("base64")).isNotNull())
    broken = F.when((encoding == "base64") & ~binary, F.array(_issue(name, "attachment is no base64"))).otherwise(none)
    return F.when(encoding.isNull(), F.array(_issue(name, "unknown attachment"))).otherwise(F.concat(empty, broken))


def issues(ontology: Ontology, rules: Column) -> Column:
    """Everything that is wrong with an event, as an array of property and reason."""
    properties, attachments = F.col("properties"), F.col("attachments")
    missing = F.transform(F.array_except(rules["mandatory"], F.map_keys(properties)), lambda k: _issue(k, "missing mandatory property"))
    parents = F.when(F.forall("parents", lambda h: h.rlike(r"^[0-9a-f]{40}\z")), F.array().cast(ISSUE)).otherwise(F.array(_issue(F.lit(""), "invalid parent hash")))
    found = F.concat(
        missing,
        F.flatten(F.transform(F.map_entries(properties), lambda e: _property_issues(ontology, rules, e))),
        F.flatten(F.transform(F.map_entries(attachments), lambda e: _attachment_issues(rules, e))),
        parents,
    )
    return F.when(rules.isNull(), F.array(_issue(F.lit(""), "unknown event type"))).otherwise(found)


def validate(frame: EventFrame) -> DataFrame:
    """The events with ``issues`` (empty for valid ones), those of unknown type or source included."""
    ontology = frame.ontology
    if not ontology.event_types:
        return frame.df.withColumn("issues", F.array(_issue(F.lit(""), "unknown event type")))
    out = let(_rules(ontology, {}, {}), lambda r: issues(ontology, r))
    if ontology.sources:
        stray = ~F.coalesce(F.col("source_uri").isin(*sorted(ontology.sources)), F.lit(False))
        out = F.concat(out, F.when(stray, F.array(_issue(F.lit(""), "unknown source"))).otherwise(F.array().cast(ISSUE)))
    return frame.df.withColumn("issues", out)


def _repaired(ontology: Ontology, rules: Column) -> Column:
    """The properties with values normalized and then invalid ones dropped, as the rules allow; in one pass."""

    def one(name: Column, values: Column) -> Column:
        def of(object_type: Column) -> Column:
            normal = F.transform(values, lambda v: F.coalesce(_by_object_type(ontology, object_type, lambda o: DataType(o.data_type).normalize(v), v), v))
            new = F.when(F.array_contains(rules["normalize"], name), F.array_sort(F.array_distinct(normal))).otherwise(values)
            return let(new, lambda n: F.when(F.array_contains(rules["drop"], name), F.filter(n, lambda v: _valid(ontology, object_type, v))).otherwise(n))

        return let(F.try_element_at(rules["objects"], name), of)

    return F.map_filter(F.transform_values("properties", one), lambda _, v: F.size(v) > 0)


def repair(
    frame: EventFrame, normalize: Mapping[str, Iterable[str]] | None = None, drop: Mapping[str, Iterable[str]] | None = None
) -> DataFrame:
    """Events repaired where they are invalid: values normalized, then what is still invalid dropped, as far as
    ``normalize`` and ``drop`` name properties by event type (``normalize=None``: all). Adds ``repaired`` and ``issues``,
    what is wrong still. Valid events are not touched."""
    ontology = frame.ontology
    before = validate(frame).withColumn("_bad", F.size("issues") > 0)
    fixed = F.col("properties")
    if ontology.event_types:
        fixed = let(_rules(ontology, normalize, drop or {}), lambda r: F.when(r.isNull(), F.col("properties")).otherwise(_repaired(ontology, r)))
    new = before.withColumn("_new", F.when(F.col("_bad"), fixed).otherwise(F.col("properties")))
    changed = new.withColumn("repaired", F.col("_bad") & (F.array_sort(F.map_entries("_new")) != F.array_sort(F.map_entries("properties"))))
    again = changed.withColumn("properties", F.col("_new")).select(*COLUMNS, "repaired")
    return validate(EventFrame(again, ontology))


def reason_counts(checked: DataFrame) -> DataFrame:
    """How many events have which reason in which property."""
    return checked.select("event_type", F.explode("issues").alias("i")).groupBy("event_type", "i.property", "i.reason").agg(F.count(F.lit(1)).alias("n_events"))


def repair_rate(repaired: DataFrame) -> Column:
    """The aggregate share of events that had to be repaired; above 0.1 the data deserve a look."""
    return F.avg(F.col("repaired").cast("double"))


def is_valid(frame: EventFrame) -> DataFrame:
    return validate(frame).withColumn("is_valid", F.size("issues") == 0).drop("issues")

