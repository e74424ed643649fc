"""Queries over all distinct events, under the schema that the tables declare.

The queries of ``plans.events`` and ``plans.knowledge`` that have SQL keep to the common types which that SQL names; these
here do the same for every event. They have no SQL and are tested against counts by hand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import EventFrame
from tidemark.mining import graph
from tidemark.ontology.model import EventProperty, EventType, ObjectType, Ontology
from tidemark.operators import links, merge, render, replay, stats, validation
from tidemark.plans.schemas import CONCEPTS, harbour_ontology
from tidemark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: The type that stands for all undeclared ones where an event's own type doesn't matter; it has all properties.
UNDECLARED = "undeclared"
STRATEGIES = ("match", "any", "add", "set", "replace", "min", "max")
INTER = (("vessel", "operator", "served by", 6), ("crane", "container", "moved", 7))


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return {}


def spelling(name: Column) -> Column:
    """What the spellings of one type name have in common: letters and digits, without case."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def _flag(value: Column) -> Column:
    text = F.lower(F.trim(value))
    return F.when(text.isin("true", "yes", "y", "1"), True).when(text.isin("false", "no", "n", "0"), False)


def declared_ontology(spark: SparkSession, folder: str) -> Ontology:
    """The harbour's schema with every event type, property and object type that the tables declare.

    Of what several declarations say of one thing the most frequent counts, of equally frequent ones the least. Object
    types that ``object_type`` doesn't have are slips. There is one row for each property of a type on the driver.
    """
    out = harbour_ontology()
    versions = table(spark, folder, "object_type").where("name IS NOT NULL AND data_type IS NOT NULL")
    for r in versions.groupBy("name").agg(F.max_by("data_type", F.struct("version", "data_type")).alias("kind")).collect():
        out = out.put(ObjectType(r["name"], r["name"].replace(".", " "), r["name"].replace(".", " ") + "s", r["name"], r["kind"]))
    known = sorted(out.object_types)
    declared = table(spark, folder, "event_property").where("decl_id IS NOT NULL").dropDuplicates(["decl_id"])
    merge_name = F.lower(F.trim("merge_strategy"))
    found = declared.where("event_type_name IS NOT NULL AND name IS NOT NULL").groupBy(spelling(F.col("event_type_name")).alias("type"), "name").agg(
        F.mode(F.when(F.col("object_type").isin(known), F.col("object_type")), True).alias("kind"),
        F.mode(F.when(merge_name.isin(*STRATEGIES), merge_name), True).alias("merge"),
        F.mode(_flag(F.col("optional")), True).alias("optional"),
        F.mode(_flag(F.col("multivalued")), True).alias("multivalued"),
        F.mode("event_type_name", True).alias("type_name"),
    ).collect()
    types = table(spark, folder, "event_type").where("decl_id IS NOT NULL AND name IS NOT NULL").dropDuplicates(["decl_id"])
    named = types.groupBy(spelling(F.col("name")).alias("type")).agg(
        F.mode("name", True).alias("type_name"), F.mode("timespan_start", True).alias("start"), F.mode("timespan_end", True).alias("end")
    ).collect()
    kinds: dict[str, str] = {p.name: p.object_type for t in out.event_types.values() for p in t.properties}
    made: dict[str, EventType] = {"".join(c for c in n.lower() if c.isalnum()): t for n, t in out.event_types.items()}
    for r in named:
        made.setdefault(r["type"], EventType(r["type_name"], r["type_name"], f"{r['type_name']}s", r["type_name"]))
        made[r["type"]] = made[r["type"]].with_(timespan_start=r["start"] or made[r["type"]].timespan_start)
    for r in sorted(found, key=lambda r: (r["type"], r["name"])):
        own = made.setdefault(r["type"], EventType(r["type_name"], r["type_name"], f"{r['type_name']}s", r["type_name"]))
        old = own.by_name.get(r["name"])
        kind = r["kind"] or (old.object_type if old else kinds.get(r["name"]))
        if kind is None:
            continue
        kinds.setdefault(r["name"], kind)
        p = EventProperty(
            r["name"], kind, r["name"], optional=old.optional if old else r["optional"] is not False,
            multivalued=old.multivalued if old else r["multivalued"] is not False, merge=(old.merge if old else r["merge"]) or "any", concepts=old.concepts if old else (),
        )
        if p.name in CONCEPTS and not p.concepts:
            concept, confidence = CONCEPTS[p.name]
            p = p.identifies(concept, confidence, 100 + confidence)
        made[r["type"]] = own.with_property(p)
    for own in made.values():
        out = out.put(_completed(own))
    every = EventType(UNDECLARED, UNDECLARED, UNDECLARED, UNDECLARED, timespan_start="time-start")
    for name, kind in sorted(kinds.items()):
        p = EventProperty(name, kind, name)
        every = every.with_property(p.identifies(CONCEPTS[name][0], CONCEPTS[name][1], 100 + CONCEPTS[name][1]) if name in CONCEPTS else p)
    return out.put(_completed(every))


def _completed(own: EventType) -> EventType:
    """With templates and the harbour's relations, where it has none; times that it doesn't have bound nothing."""
    names = [n for n in own.by_name if n not in ("serial", "time-start", "time-end")]
    own = own.with_(timespan_start=own.timespan_start if own.timespan_start in own.by_name else None, timespan_end=None)
    if not own.summary:
        serial = " [[serial]]" if "serial" in own.by_name else ""
        own = own.with_(summary=own.name + serial + (f"{{ of [[{names[-1]}]]}}" if names else ""))
    if not own.story:
        own = own.with_(story=own.name + "".join(f"{{, {n} [[{n}]]}}" for n in own.by_name) + ".")
    for source, target, predicate, confidence in INTER:
        if {source, target} <= set(own.by_name) and not own.related("inter", source, target):
            own = own.relate("inter", source, target, predicate, confidence=confidence)
    return own


def all_events(spark: SparkSession, folder: str, stand_in: bool = False) -> EventFrame:
    """Every distinct event, with the declared spelling of its type's name. Undeclared types keep their own names.

    With ``stand_in`` no value is without a schema: undeclared types have the name of the type that stands for them, and
    types have the properties too that only other types declare.
    """
    ontology = declared_ontology(spark, folder)
    declared = {n: t for n, t in ontology.event_types.items() if n != UNDECLARED}
    names = F.create_map(*[F.lit(x) for n in sorted(declared) for x in ("".join(c for c in n.lower() if c.isalnum()), n)])
    stored = F.col("event_type_name")
    name = F.coalesce(F.try_element_at(names, spelling(stored)), F.lit(UNDECLARED) if stand_in else stored)
    if stand_in:
        every = ontology.event_types[UNDECLARED].properties
        for own in declared.values():
            whole = own.with_(properties=(*own.properties, *[p for p in every if p.name not in own.by_name]), timespan_start=own.timespan_start or "time-start")
            ontology = ontology.put(_completed(whole))
    else:
        ontology = ontology.drop(EventType, UNDECLARED)
    rows = table(spark, folder, "parsed_event").where(F.col("event_id").isNotNull()).dropDuplicates(["event_id"])
    return EventFrame.from_events(rows.withColumn("event_type_name", name), ontology, event_type="event_type_name")


# -- what the queries of the common types do


@query
def all_event_types(spark: SparkSession, folder: str) -> DataFrame:
    return stats.event_type_counts(all_events(spark, folder))


@query
def all_filter_types(spark: SparkSession, folder: str) -> DataFrame:
    """By the stored name, in whatever spelling, of declared and undeclared types."""
    frame = all_events(spark, folder)
    wanted = spelling(F.col("event_type")).rlike("^(?:crane|reefer)")
    return frame.df.where(wanted).select("event_id", "event_type", "source_uri")


@query
def all_object_types(spark: SparkSession, folder: str) -> DataFrame:
    return stats.object_type_counts(all_events(spark, folder, stand_in=True))


@query
def all_object_values(spark: SparkSession, folder: str) -> DataFrame:
    return stats.value_histogram(all_events(spark, folder, stand_in=True), "vessel.name")


@query
def all_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.concept_counts(all_events(spark, folder, stand_in=True))


@query
def all_covered_times(spark: SparkSession, folder: str) -> DataFrame:
    return stats.covered_times(all_events(spark, folder, stand_in=True))


@query
def all_related_values(spark: SparkSession, folder: str) -> DataFrame:
    return links.related_values(all_events(spark, folder, stand_in=True)).select("event_id", "source_value", "target_value")


@query
def all_replay_delays(spark: SparkSession, folder: str) -> DataFrame:
    frame = all_events(spark, folder, stand_in=True)
    # only times that can be read
    good = F.array_min(F.col("properties")["time-start"]).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z\z")
    out = replay.delays(frame.transform(lambda df: df.where(good)), speed=2.0)
    return out.select("event_id", "offset_micros", "gap_micros")


@query
def all_concept_nodes(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.nodes(all_events(spark, folder, stand_in=True))
    return found.select("node", "event_id", "property", "concept", "object_type", "attribute", "value", "confidence", "identifies")


@query
def all_concept_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.relation_edges(all_events(spark, folder, stand_in=True), "inter")


@query
def all_value_hubs(spark: SparkSession, folder: str) -> DataFrame:
    """Values that several events share, each with the node that stands for all."""
    found = graph.nodes(all_events(spark, folder, stand_in=True)).groupBy("object_type", "value").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n_nodes"))
    return found.where("n_nodes > 1")


@query
def all_components(spark: SparkSession, folder: str) -> DataFrame:
    frame = all_events(spark, folder, stand_in=True)
    return graph.components(graph.nodes(frame), graph.relation_edges(frame, "intra"))


# -- what the queries of one type do


@query
def all_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Events of all types merged by all strategies. Undeclared types have no rules, so their events stay as they are."""
    frame = all_events(spark, folder)
    lone = frame.df.where(~F.coalesce(F.col("event_type").isin(*sorted(frame.ontology.event_types)), F.lit(False)))
    merged = merge.merge_all(frame).drop("sticky_hash")
    return merged.unionByName(lone.withColumn("n_events", F.lit(1).cast("bigint")))


@query
def all_issues(spark: SparkSession, folder: str) -> DataFrame:
    """How many events of which type have which reason in which property, all reasons."""
    return validation.reason_counts(validation.validate(all_events(spark, folder)))


@query
def all_properties(spark: SparkSession, folder: str) -> DataFrame:
    return stats.all_property_stats(all_events(spark, folder, stand_in=True))


@query
def all_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return render.texts(all_events(spark, folder, stand_in=True), short=True)


@query
def all_delimited(spark: SparkSession, folder: str) -> DataFrame:
    return render.all_delimited(all_events(spark, folder, stand_in=True))
