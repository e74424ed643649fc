"""Colliding events merged by the strategies of their properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.frame import COLUMNS, EventFrame, no_texts
from tidemark.functions.datatypes import DataType
from tidemark.ontology.model import EventType, Ontology


def united(values: Column) -> Column:
    """The aggregate of all values of all sets. Sets of one value, which most are, are collected as values, so that a
    group holds no more than its distinct values; larger sets are collected as sets."""
    single = F.collect_set(F.when(F.size(values) == 1, F.get(values, F.lit(0))))
    several = F.flatten(F.collect_set(F.when(F.size(values) > 1, values)))
    return F.array_sort(F.array_distinct(F.concat(single, several)))


def strategy(name: str, kind: DataType, values: Column, order: Column) -> Column:
    """The aggregate that a property's strategy is. ``values`` is the set of one event, ``order`` its place among the
    events of its group: its version, then its id.

    Every one is computed in parts before the shuffle. Sets of values that occur often are sent once.
    """
    single = F.get(values, F.lit(0))
    if name in ("min", "max"):
        pick = F.min_by if name == "min" else F.max_by
        return F.array_compact(F.array(pick(single, F.struct(kind.order(single).alias("t"), single.alias("v")))))
    if name == "add":
        return united(values)
    if name == "replace":
        return F.max_by(values, order)
    if name == "set":
        return F.coalesce(F.min_by(F.when(F.size(values) > 0, values), F.when(F.size(values) > 0, order)), no_texts())
    if name == "match":
        return F.max(values)  # the same set in all events of the group
    return F.array_compact(F.array(F.min(F.array_min(values))))  # any: the least, whatever the order


def merge_all(frame: EventFrame, function: str = "sha1", within: Column | None = None) -> DataFrame:
    """The events of all types of the ontology with one row for each hash; one scan and one shuffle, on the hash.

    Events come in the order of their version, then of their id. Type, source and attachments are those of the
    first event, parents the union of all. The hash stays the key: values of a match property are a set and all of
    it stays, also where it has several values. Types that treat a property alike share its aggregate. With ``within``
    only events that are equal in it are merged, so that a hash may come out several times.
    """
    types = frame.ontology.event_types
    known = frame.df.where(F.col("event_type").isin(*sorted(types))) if types else frame.df.limit(0)
    version = F.lit(0).cast("decimal(20,0)")
    alike: dict[str, dict[tuple[str, str], list[str]]] = {}
    for name, own in sorted(types.items()):
        if own.event_version is not None:
            version = F.when(F.col("event_type") == name, version_of(own, F.col("properties"))).otherwise(version)
        for p in own.properties:
            treated = (p.merge, frame.ontology.data_type(name, p.name) if p.merge in ("min", "max") else "")
            alike.setdefault(p.name, {}).setdefault(treated, []).append(name)
    hashed = known.withColumn("sticky_hash", frame.hash_column(function)).withColumn("_order", F.struct(version.alias("version"), F.col("event_id").alias("id")))
    order = F.col("_order")
    aggregates, pairs = [], []
    for name, ways in sorted(alike.items()):
        chosen = no_texts()
        for (strategy_name, kind), of_types in sorted(ways.items()):
            values = F.coalesce(F.col("properties")[name], no_texts())
            if len(ways) > 1:
                values = F.when(F.col("event_type").isin(*of_types), values).otherwise(no_texts())
            column = f"p{len(aggregates)}"
            aggregates.append(strategy(strategy_name, DataType(kind), values, order).alias(column))
            chosen = F.when(F.col("event_type").isin(*of_types), F.col(column)).otherwise(chosen)
        pairs += [F.lit(name), chosen]
    # events without a hash, which lack a source, are never equal
    lone = F.when(F.col("sticky_hash").isNull(), F.col("event_id"))
    merged = hashed.groupBy("sticky_hash", "event_type", lone.alias("_lone"), *([] if within is None else [within.alias("_within")])).agg(
        F.min("event_id").alias("event_id"),
        F.min_by("source_uri", order).alias("source_uri"),
        F.min_by("attachments", order).alias("attachments"),
        united(F.col("parents")).alias("parents"),
        F.min_by("foreign_attribs", order).alias("foreign_attribs"),
        F.count(F.lit(1)).alias("n_events"),
        *aggregates,
    )
    properties = F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0) if pairs else F.create_map().cast(COLUMNS["properties"])
    return merged.select(
        "event_id", "event_type", "source_uri", properties.alias("properties"), "attachments", "parents", "foreign_attribs", "sticky_hash", "n_events"
    )


def merge_type(frame: EventFrame, event_type: str, function: str = "sha1") -> DataFrame:
    """As ``merge_all``, for the events of one type; the filter on the type reaches the scan."""
    only = Ontology(frame.ontology.object_types, frame.ontology.concepts, {event_type: frame.ontology.event_types[event_type]}, frame.ontology.sources)
    return merge_all(EventFrame(frame.of_type(event_type).df, only), function)


def version_of(own: EventType, properties: Column) -> Column:
    """The number of an event's version; 0 for types without versions and events that lack it."""
    if own.event_version is None:
        return F.lit(0).cast("decimal(20,0)")
    return F.coalesce(F.get(properties[own.event_version], F.lit(0)).try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))


def merge_in_buffers(frame: EventFrame, size: int) -> EventFrame:
    """Events merged within buffers of ``size`` consecutive event ids, each handed on when it is full, the last one too."""
    return frame.with_df(merge_all(frame, within=F.floor(F.col("event_id") / size)).select(*COLUMNS))


def merge(frame: EventFrame, function: str = "sha1") -> EventFrame:
    """All events merged, each type by its own strategies. Events of types that the ontology doesn't know are not among
    them; ``filters.unknown_events`` has those."""
    return frame.with_df(merge_all(frame, function).select(*COLUMNS))


def conflicts(frame: EventFrame) -> DataFrame:
    """``sticky_hash`` and ``version`` of events with one hash and one version but different properties."""
    versions = F.lit(0).cast("decimal(20,0)")
    for name, own in sorted(frame.ontology.event_types.items()):
        if own.event_version is not None:
            versions = F.when(F.col("event_type") == name, version_of(own, F.col("properties"))).otherwise(versions)
    content = F.xxhash64(F.array_sort(F.map_entries("properties")))
    return (
        frame.hashed()
        .select("sticky_hash", versions.alias("version"), content.alias("_c"))
        .groupBy("sticky_hash", "version")
        .agg(F.min("_c").alias("_a"), F.max("_c").alias("_b"), F.count(F.lit(1)).alias("n_events"))
        .where("_a <> _b")
        .select("sticky_hash", "version", "n_events")
    )


def checked_merge(frame: EventFrame) -> EventFrame:
    """As ``merge``; an error if there are conflicts, which is found out first."""
    if found := conflicts(frame).limit(1).collect():
        raise ValueError(f"events with hash {found[0]['sticky_hash']} and one version have different properties")
    return merge(frame)
