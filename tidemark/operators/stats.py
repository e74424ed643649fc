"""Profiles of events: counts by type, source, property, object type, value and concept, and the time they cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.frame import EventFrame, no_texts


def _catalog(frame: EventFrame, names: list[str], column: str) -> DataFrame:
    return frame.df.sparkSession.createDataFrame([(n,) for n in sorted(names)], f"{column} string")


def event_type_counts(frame: EventFrame) -> DataFrame:
    """Events of each type; types of the ontology without events have 0."""
    counted = frame.df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))
    names = _catalog(frame, list(frame.ontology.event_types), "event_type")
    return names.join(counted, "event_type", "full_outer").select("event_type", F.coalesce("n_events", F.lit(0)).alias("n_events"))


def source_counts(frame: EventFrame) -> DataFrame:
    """Events of each source; null for sources of the ontology without events."""
    counted = frame.df.groupBy("source_uri").agg(F.count(F.lit(1)).alias("n_events"))
    return _catalog(frame, list(frame.ontology.sources), "source_uri").join(counted, "source_uri", "full_outer")


def property_stats(frame: EventFrame, event_type: str) -> DataFrame:
    """For each property of a type: events, values, distinct values, and events with no, one and several values.

    The cardinalities come from one pass without a shuffle of values; only distinct values are shuffled.
    """
    names = [p.name for p in frame.ontology.event_types[event_type].properties]
    own = frame.of_type(event_type).df
    sized = own.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("property"), F.coalesce(F.col("properties")[n], no_texts()).alias("v")) for n in names]))
    )
    counts = sized.groupBy("property").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.size("v").cast("long")).alias("n_values"),
        F.count_if(F.size("v") == 0).alias("n_without"),
        F.count_if(F.size("v") == 1).alias("n_single"),
        F.count_if(F.size("v") > 1).alias("n_several"),
    )
    distinct = sized.select("property", F.explode("v").alias("value")).distinct().groupBy("property").agg(F.count(F.lit(1)).alias("n_distinct"))
    return counts.join(distinct, "property", "left").select(
        "property", "n_events", "n_values", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "n_without", "n_single", "n_several"
    )


def all_property_stats(frame: EventFrame) -> DataFrame:
    """As ``property_stats``, with ``event_type``, for all types that have events; one scan."""
    names = F.lit(None).cast("array<string>")
    for name, own in sorted(frame.ontology.event_types.items()):
        names = F.when(F.col("event_type") == name, F.array(*[F.lit(p.name) for p in own.properties]).cast("array<string>")).otherwise(names)
    each = frame.df.select("event_type", "properties", F.explode(names).alias("property"))
    sized = each.select("event_type", "property", F.coalesce(F.try_element_at("properties", F.col("property")), no_texts()).alias("v"))
    counts = sized.groupBy("event_type", "property").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.size("v").cast("long")).alias("n_values"),
        F.count_if(F.size("v") == 0).alias("n_without"),
        F.count_if(F.size("v") == 1).alias("n_single"),
        F.count_if(F.size("v") > 1).alias("n_several"),
    )
    values = sized.select("event_type", "property", F.explode("v").alias("value")).distinct()
    distinct = values.groupBy("event_type", "property").agg(F.count(F.lit(1)).alias("n_distinct"))
    return counts.join(distinct, ["event_type", "property"], "left").select(
        "event_type", "property", "n_events", "n_values", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "n_without", "n_single", "n_several"
    )


def object_type_counts(frame: EventFrame) -> DataFrame:
    """Values and distinct values of each object type. Values are counted by value first, so that common ones are
    combined before the shuffle."""
    values = frame.objects().where(F.col("object_type").isNotNull()).groupBy("object_type", "value").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("object_type").agg(F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_distinct"))


def value_histogram(frame: EventFrame, object_type: str) -> DataFrame:
    """How often each value of an object type occurs."""
    return frame.objects().where(F.col("object_type") == object_type).groupBy("value").agg(F.count(F.lit(1)).alias("n_values"))


def concept_counts(frame: EventFrame) -> DataFrame:
    """Distinct values that may be of each concept: the seeds of mining."""
    objects = frame.objects()
    concepts = F.split(frame.lookup(lambda t: {p.name: ",".join(sorted(c.concept for c in p.concepts)) for p in t.properties if p.concepts}), ",")
    return (
        objects.select(F.explode(concepts).alias("concept"), "object_type", "value")
        .distinct()
        .groupBy("concept")
        .agg(F.count(F.lit(1)).alias("n_seeds"))
    )


def event_times(frame: EventFrame) -> tuple[Column, Column]:
    """The start and end of each event: the declared properties, else the least and greatest of all its times."""
    start: Column = F.lit(None).cast("string")
    end: Column = F.lit(None).cast("string")
    for name, own in sorted(frame.ontology.event_types.items()):
        times = [p.name for p in own.properties if frame.ontology.data_type(name, p.name) == "datetime"]
        every = F.concat(*[F.coalesce(F.col("properties")[n], no_texts()) for n in times]) if times else no_texts()
        first = F.array_min(F.col("properties")[own.timespan_start]) if own.timespan_start else F.array_min(every)
        last = F.array_max(F.col("properties")[own.timespan_end]) if own.timespan_end else F.array_max(every)
        mine = F.col("event_type") == name
        start, end = F.when(mine, first).otherwise(start), F.when(mine, last).otherwise(end)
    return start, end


def covered_times(frame: EventFrame) -> DataFrame:
    """The earliest start and latest end of each type, and of all with a null type, from one aggregate."""
    start, end = event_times(frame)
    timed = frame.df.select("event_type", start.alias("s"), F.coalesce(end, start).alias("e")).where(F.col("event_type").isNotNull())
    return timed.rollup("event_type").agg(F.min("s").alias("first_start"), F.max("e").alias("last_end"))
