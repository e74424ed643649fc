"""Events moved in time, and made-up events."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import EventFrame
from tidemark.functions.datatypes import format_time
from tidemark.ontology.model import Attachment, Concept, EventProperty, EventSource, EventType, ObjectType, Ontology
from tidemark.operators.stats import event_times


def delays(frame: EventFrame, speed: float = 1.0) -> DataFrame:
    """``event_id``, ``start``, the microseconds since the first event and since the event before, and the seconds to
    wait for these at a ``speed``. The offset needs no order: it is the time since the least start. The gap looks back inside a day; the
    first event of a day looks at the last one of the day before, by a window over days."""
    start, _ = event_times(frame)
    timed = frame.df.select("event_id", F.try_to_timestamp(start).alias("start")).where("start IS NOT NULL")
    origin = timed.agg(F.min("start")).scalar()
    day = F.to_date("start")
    days = timed.groupBy(day.alias("day")).agg(F.max("start").alias("last"))
    days = days.selectExpr("day", "lag(last) OVER (ORDER BY day) AS earlier")
    inside = timed.withColumn("day", day).selectExpr(
        "event_id", "start", "day", "lag(start) OVER (PARTITION BY day ORDER BY start, event_id) AS before"
    )
    micros = inside.join(days, "day", "left").select(
        "event_id",
        "start",
        (F.unix_micros("start") - F.unix_micros(origin)).alias("offset_micros"),
        F.coalesce(F.unix_micros("start") - F.unix_micros(F.coalesce("before", "earlier")), F.lit(0)).alias("gap_micros"),
    )
    waits = {n: (F.col(f"{n}_micros") / (1e6 * speed)).alias(f"{n}_seconds") for n in ("offset", "gap")}
    return micros.select("*", *waits.values())


Item = TypeVar("Item")


def paced(items: Iterable[tuple[float, Item]], clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Iterator[Item]:
    """Items, each handed on when its time (in seconds from the first) has come. What is late is handed on at once, so that
    a slow receiver doesn't make the whole late."""
    began = clock()
    for at, item in items:
        if (wait := began + at - clock()) > 0:
            sleep(wait)
        yield item


def at_rate(items: Iterable[Item], rate: float) -> Iterator[tuple[float, Item]]:
    """Items with their times for ``paced`` at so many a second; all at once for a rate of 0."""
    return ((n / rate if rate > 0 else 0.0, item) for n, item in enumerate(items))


def shifted(frame: EventFrame, now: Column, speed: float = 1.0) -> EventFrame:
    """Events with all their times moved so that the first starts at ``now`` and the gaps are divided by ``speed``."""
    start, _ = event_times(frame)
    origin = F.col("_origin")
    first = frame.df.agg(F.unix_micros(F.min(F.try_to_timestamp(start)))).scalar()

    def moved(value: Column) -> Column:
        return F.coalesce(format_time(F.timestamp_micros((F.unix_micros(now) + (F.unix_micros(F.try_to_timestamp(value)) - origin) / speed).cast("long"))), value)

    def shift_of(times: list[str]) -> Callable[[Column, Column], Column]:
        return lambda k, v: F.when(k.isin(*times), F.transform(v, moved)).otherwise(v)

    out = F.col("properties")
    for name, own in sorted(frame.ontology.event_types.items()):
        times = [p.name for p in own.properties if frame.ontology.data_type(name, p.name) == "datetime"]
        if times:
            mine = F.transform_values("properties", shift_of(times))
            out = F.when(F.col("event_type") == name, mine).otherwise(out)
    return frame.with_df(frame.df.withColumn("_origin", first).withColumn("properties", out).drop("_origin"))


def dummy_ontology(collide: bool = True, event_type: str = "event-type.a", object_type: str = "object-type.a") -> Ontology:
    """A schema for made-up events; with collisions, one property of each strategy that merges."""
    merges = {"property-a": "match" if collide else "any", "property-c": "match" if collide else "any", "property-g": "match" if collide else "any"}
    if collide:
        merges |= {"property-b": "any", "property-d": "add", "property-e": "min", "property-f": "max", "property-h": "add", "version": "max"}
    else:
        merges |= {f"property-{x}": "any" for x in "bdefh"}
    numbers = {"property-e", "property-f"}
    properties = [
        EventProperty(
            n,
            "sequence.a" if n == "version" else "number.a" if n in numbers else object_type,
            description=n,
            multivalued=m == "add",
            optional=m not in ("min", "max"),
            merge=m,
            concepts=(),
        )
        for n, m in sorted(merges.items())
    ]
    made = EventType(
        event_type, "dummy event", "dummy events", "made-up events", "Dummy event", "Dummy event", properties=tuple(properties), event_version="version" if collide else None
    )
    return Ontology().create(
        ObjectType(object_type, "text", "texts", "made-up texts", "string:0:mc:u"),
        ObjectType("number.a", "number", "numbers", "made-up numbers", "number:bigint:signed"),
        ObjectType("sequence.a", "version", "versions", "versions of events", "sequence"),
        Concept("concept.a", "concept", "concepts", "made-up concept"),
        EventSource("/dummy/", "made-up events"),
        made,
    )


def dummy_events(
    spark: SparkSession, n: int, collisions: float = 0.3, diversity: int = 1000, seed: int = 1, ontology: Ontology | None = None, size: int = 12,
    content_size: int = 0, random_objects: bool = True, random_content: bool = False,
) -> EventFrame:
    """``n`` made-up events from a range, the same for the same seed; a share of ``collisions`` has one of
    ``diversity`` hashes. Texts have ``size`` characters, and are all alike unless ``random_objects``; with a
    ``content_size`` each event has an attachment of that length."""
    ontology = ontology or dummy_ontology()
    own = next(iter(ontology.event_types.values()))
    clash = F.rand(seed) < collisions
    key = F.when(clash, F.floor(F.rand(seed + 1) * diversity)).otherwise(F.col("id") + diversity)

    def word(tag: str, by: Column) -> Column:
        return F.substring(F.sha2(F.concat(F.lit(tag), by.cast("string")), 256), 1, size)

    pairs = []
    for p in own.properties:
        if p.object_type == "sequence.a":
            value = F.col("id").cast("string")
        elif p.object_type == "number.a":
            value = F.floor(F.rand(seed + 2) * 1000).cast("string")
        else:
            value = word(p.name, F.col("_key") if p.merge == "match" else F.col("id") if random_objects else F.lit(0))
        pairs += [F.lit(p.name), F.array(value)]
    rows = spark.range(n).withColumn("_key", key).select(
        F.col("id").alias("event_id"), F.lit(own.name).alias("event_type"), F.lit("/dummy/").alias("source_uri"), F.create_map(*pairs).alias("properties")
    )
    if content_size:
        filled = F.repeat(F.sha2(F.concat(F.lit("content"), F.col("event_id").cast("string")), 256) if random_content else F.lit("10"), -(-content_size // (64 if random_content else 2)))
        text = F.substring(filled, 1, content_size)
        rows = rows.withColumn("attachments", F.create_map(F.lit("content"), F.create_map(F.sha1(text.cast("binary")), text)))
        ontology = ontology.put(own.with_attachment(Attachment("content", display_name_singular="content", display_name_plural="contents", description="made-up content")))
    return EventFrame.from_events(rows, ontology)
