"""Schemas of the supplied tables, and the tables as events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import EventFrame
from tidemark.ontology.model import Concept, EventProperty, EventSource, EventType, ObjectType, Ontology
from tidemark.session import table

# The properties of the harbour's events with their object types and merge strategies.
PROPERTIES = {
    "serial": ("record.serial", "match"), "time-start": ("time.instant", "min"), "time-end": ("time.instant", "max"),
    "berth": ("berth.label", "any"), "channel": ("radio.channel", "set"), "container": ("container.code", "add"),
    "crane": ("crane.code", "any"), "depth": ("water.depth", "set"), "gate": ("gate.label", "any"), "goods": ("goods.label", "add"),
    "heading": ("nav.heading", "set"), "operator": ("operator.name", "any"), "permit": ("permit.number", "any"),
    "plate": ("vehicle.plate", "any"), "remark": ("text.remark", "add"), "speed": ("nav.speed", "set"), "status": ("record.status", "set"),
    "temperature": ("weather.temperature", "set"), "vessel": ("vessel.name", "any"), "weight": ("cargo.weight", "any"), "wind": ("weather.wind", "set"),
}
# Data types that are not string:64:mc:u.
DATA_TYPES = {
    "time.instant": "datetime", "cargo.weight": "number:decimal:12:2", "nav.heading": "number:smallint", "nav.speed": "number:decimal:5:1",
    "record.serial": "string:16:lc", "record.status": "enum:open:closed:failed:passed", "text.remark": "string:0:mc:u",
    "water.depth": "number:decimal:5:1", "weather.temperature": "number:decimal:5:1:signed", "weather.wind": "number:decimal:5:1",
}
# Event types with their properties besides serial, time-start and time-end.
TYPES = {
    "crane.lift": "berth container crane operator weight", "gate.passage": "container gate operator permit plate",
    "vessel.position": "depth heading speed vessel", "radio.call": "channel operator remark vessel", "berth.arrival": "berth depth operator vessel",
    "berth.departure": "berth operator vessel", "weather.reading": "berth temperature wind", "cargo.inspection": "container goods operator remark status",
    "cargo.weighing": "container goods weight", "yard.stacking": "container crane status", "reefer.reading": "container temperature",
    "permit.issued": "goods operator permit", "tug.assistance": "operator speed vessel", "reefer.alarm": "container status temperature",
    "pilot.boarding": "depth operator vessel", "lock.transit": "depth status vessel",
}
CONCEPTS = {"vessel": ("ship", 9), "operator": ("company", 8), "container": ("box", 10), "plate": ("vehicle", 10), "crane": ("machine", 9), "permit": ("permit", 10)}


def harbour_ontology() -> Ontology:
    """The schema of the harbour's event stream, as far as its common types go."""
    names = sorted({o for o, _ in PROPERTIES.values()})
    out = Ontology().create(
        *[ObjectType(n, n.replace(".", " "), n.replace(".", " ") + "s", n, DATA_TYPES.get(n, "string:64:mc:u")) for n in names],
        *[Concept(c, c, f"{c}s", c) for c, _ in sorted(set(CONCEPTS.values()))],
    )
    for name, own in TYPES.items():
        properties = []
        for p in ["serial", "time-start", "time-end", *own.split()]:
            kind, merge = PROPERTIES[p]
            several = merge in ("add", "set", "any", "match")
            made = EventProperty(p, kind, p, optional=merge not in ("min", "max") or p == "time-end", multivalued=several, merge=merge if p != "time-end" else "any")
            if p in CONCEPTS:
                concept, confidence = CONCEPTS[p]
                made = made.identifies(concept, confidence, 100 + confidence)
            properties.append(made)
        event_type = EventType(
            name, name, f"{name}s", name, f"{name} [[serial]]{{ of [[{own.split()[-1]}]]}}",
            "On [[date_time:time-start,minute]], [[serial]]" + "".join(f"{{, {p} [[{p}]]}}" for p in own.split()) + ".",
            timespan_start="time-start", properties=tuple(properties),
        )
        if {"vessel", "operator"} <= set(own.split()):
            event_type = event_type.relate("inter", "vessel", "operator", "served by", confidence=6)
        if {"crane", "container"} <= set(own.split()):
            event_type = event_type.relate("inter", "crane", "container", "moved", confidence=7)
        out = out.create(event_type)
    return out


def harbour_events(spark: SparkSession, folder: str, *types: str) -> EventFrame:
    """The distinct events of ``parsed_event`` under the harbour's schema; one row for each event_id. With ``types`` only
    these are read: repeated rows are equal, so the filter comes first and reaches the scan."""
    rows = table(spark, folder, "parsed_event").where(F.col("event_id").isNotNull())
    if types:
        rows = rows.where(F.col("event_type_name").isin(*types))
    return EventFrame.from_events(rows.dropDuplicates(["event_id"]), harbour_ontology(), event_type="event_type_name")


#: The type that stands for all that the harbour's schema doesn't name.
UNDECLARED = "undeclared"


def whole_ontology() -> Ontology:
    """The harbour's schema in which every type has every property, and a type that stands for all undeclared ones, so that
    no event and no value is without a schema."""
    out = harbour_ontology()
    every: dict[str, EventProperty] = {p.name: p for t in out.event_types.values() for p in t.properties}
    names = [*TYPES, UNDECLARED]
    for name in names:
        own = out.event_types.get(name) or EventType(name, name, name, name, name, name, timespan_start="time-start")
        for p in every.values():
            if p.name not in own.by_name:
                own = own.with_property(p.with_(optional=True))
        for source, target, predicate, confidence in (("vessel", "operator", "served by", 6), ("crane", "container", "moved", 7)):
            if not own.related("inter", source, target):
                own = own.relate("inter", source, target, predicate, confidence=confidence)
        out = out.put(own)
    return out


def whole_events(spark: SparkSession, folder: str) -> EventFrame:
    """Every distinct event of ``parsed_event``, those of types that the schema doesn't name under the type that stands for
    them."""
    rows = table(spark, folder, "parsed_event").where(F.col("event_id").isNotNull()).dropDuplicates(["event_id"])
    named = F.when(F.col("event_type_name").isin(*TYPES), F.col("event_type_name")).otherwise(UNDECLARED)
    return EventFrame.from_events(rows.withColumn("event_type_name", named), whole_ontology(), event_type="event_type_name")


def with_sources(frame: EventFrame, uris: list[str]) -> EventFrame:
    return EventFrame(frame.df, frame.ontology.put(*[EventSource(u, u.strip("/") or "all") for u in uris]))


def user_ontology() -> Ontology:
    kinds = {"user.id": "number:bigint", "event.name": "string:0:mc:u", "time": "datetime", "amount": "number:decimal:12:2:signed", "payload": "string:0:mc:u", "event.number": "sequence"}
    own = EventType(
        "user.event", "user event", "user events", "what users did", "[[name]] by user [[user-id]]", "[[name]] by user [[user-id]] on [[date_time:time-start,date]]",
        timespan_start="time-start", timespan_end="time-end", event_version="version",
        properties=(
            EventProperty("user-id", "user.id", multivalued=False, optional=False, merge="match"),
            EventProperty("name", "event.name", multivalued=False, optional=False, merge="match"),
            EventProperty("time-start", "time").with_merge("min"),
            EventProperty("time-end", "time").with_merge("max"),
            EventProperty("amount", "amount").with_merge("max"),
            EventProperty("payload", "payload").with_merge("replace"),
            EventProperty("version", "event.number").with_merge("max"),
        ),
    )
    return Ontology().create(*[ObjectType(n, data_type=t) for n, t in kinds.items()], EventSource("/events/", "user events"), own)


def user_events(spark: SparkSession, folder: str) -> EventFrame:
    """The table ``events`` as events of users."""
    rows = table(spark, folder, "events")
    amount = F.format_string("%.2f", F.col("value"))
    properties = {"user-id": "user_id", "name": "event_type", "time-start": "ts", "time-end": "ts", "amount": amount, "payload": "props", "version": "event_id"}
    return EventFrame.from_columns(rows, user_ontology(), "user.event", "/events/", F.col("event_id"), properties)


def order_ontology() -> Ontology:
    kinds = {
        "order.key": "number:bigint", "part.key": "number:bigint", "line.number": "number:int", "day": "datetime", "flag": "enum:A:N:R", "status": "enum:F:O:P",
        "customer.key": "number:bigint", "priority": "string:0:mc:u",
    }
    order = EventType(
        "order", properties=(
            EventProperty("order-key", "order.key", multivalued=False, optional=False, merge="match"),
            EventProperty("customer", "customer.key", multivalued=False), EventProperty("status", "status", multivalued=False),
            EventProperty("priority", "priority", multivalued=False), EventProperty("day", "day", multivalued=False),
        ),
    ).relate("container", "customer", "priority")
    line = EventType(
        "order.line", properties=(
            EventProperty("order-key", "order.key", multivalued=False, optional=False, merge="match"),
            EventProperty("line", "line.number", merge="add"), EventProperty("part", "part.key", merge="add"),
            EventProperty("flag", "flag", merge="any"), EventProperty("first-shipped", "day").with_merge("min"), EventProperty("last-shipped", "day").with_merge("max"),
        ),
    ).child_of(order)
    return Ontology().create(*[ObjectType(n, data_type=t) for n, t in kinds.items()], EventSource("/orders/", "orders"), order, line)


def order_lines(spark: SparkSession, folder: str) -> EventFrame:
    rows = table(spark, folder, "lineitem")
    properties = {"order-key": "l_orderkey", "line": "l_linenumber", "part": "l_partkey", "flag": "l_returnflag", "first-shipped": "l_shipdate", "last-shipped": "l_shipdate"}
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return EventFrame.from_columns(rows, order_ontology(), "order.line", "/orders/", number, properties)


def orders(spark: SparkSession, folder: str) -> EventFrame:
    rows = table(spark, folder, "orders")
    properties = {"order-key": "o_orderkey", "customer": "o_custkey", "status": "o_orderstatus", "priority": "o_orderpriority", "day": "o_orderdate"}
    return EventFrame.from_columns(rows, order_ontology(), "order", "/orders/", F.col("o_orderkey"), properties)


def texts(frame_df: DataFrame, *keep: str) -> DataFrame:
    """All array columns as their values joined by a bar, for results that other engines compare."""
    columns = []
    for f in frame_df.schema:
        if f.name in keep:
            columns.append(F.col(f"`{f.name}`"))
        elif f.dataType.typeName() == "array":
            columns.append(F.array_join(F.array_sort(F.transform(F.col(f"`{f.name}`"), lambda v: v.cast("string"))), "|").alias(f.name))
        else:
            columns.append(F.col(f"`{f.name}`"))
    return frame_df.select(*columns)
