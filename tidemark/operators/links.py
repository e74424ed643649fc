"""Events linked to their parents, and properties linked by relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.frame import EventFrame


def parents_by_hash(frame: EventFrame) -> DataFrame:
    """``event_id``, ``parent_hash`` and ``parent_id`` (null for parents that never came) of every explicit link.

    The links are an equi-join on the hash. Parents are reduced to one row a hash first.
    """
    known = frame.hashed().groupBy("sticky_hash").agg(F.min("event_id").alias("parent_id"))
    links = frame.df.select("event_id", F.explode("parents").alias("parent_hash"))
    return links.join(known, links["parent_hash"] == known["sticky_hash"], "left").select("event_id", "parent_hash", "parent_id")


def parents_by_properties(frame: EventFrame, child_type: str) -> DataFrame:
    """``event_id`` and ``parent_id`` of the events of a type and their parents by the declared property map.

    A hash of 128 bits over the source and the values of the mapped properties, sorted, is the key of one equi-join, so
    that only ids and hashes are shuffled. Events that lack all mapped values have no parent.
    """
    child = frame.ontology.event_types[child_type]
    pairs = sorted(child.parent.columns.items(), key=lambda x: x[1])

    def values(name: str) -> Column:
        return F.coalesce(F.array_join(F.array_sort(F.col("properties")[name]), "\u0001"), F.lit(""))

    sides = []
    for name, columns, alias in ((child_type, [c for c, _ in pairs], "event_id"), (child.parent.event_type, [p for _, p in pairs], "parent_id")):
        every = F.concat_ws("\u0002", *[values(c) for c in columns])
        own = frame.of_type(name).df.select(F.col("event_id").alias(alias), "source_uri", every.alias("_every"))
        present = own.where((F.col("_every") != "\u0002" * (len(columns) - 1)) & F.col("source_uri").isNotNull())
        sides.append(present.select(alias, F.unhex(F.md5(F.concat_ws("\u0003", "source_uri", "_every"))).alias("_key")))
    return sides[0].join(sides[1], "_key").select("event_id", "parent_id")


def related_values(frame: EventFrame) -> DataFrame:
    """Every pair of values that a relation links in an event: ``event_id``, ``event_type``, ``relation``, ``type``,
    ``source_property``, ``source_value``, ``target_property``, ``target_value``. One scan; pairs are made inside rows."""
    rows = [
        F.struct(
            F.lit(name).alias("event_type"), F.lit(r.id).alias("relation"), F.lit(r.type).alias("type"),
            F.lit(r.source).alias("source_property"), F.lit(r.target).alias("target_property"),
        )
        for name, own in sorted(frame.ontology.event_types.items())
        for r in own.relations
    ]
    if not rows:
        raise ValueError("the ontology has no relations")
    mine = F.filter(F.array(*rows), lambda r: r["event_type"] == F.col("event_type"))
    linked = frame.df.select("event_id", "properties", F.explode(mine).alias("r")).select("event_id", "properties", "r.*")
    pairs = linked.withColumn("source_value", F.explode(F.col("properties")[F.col("source_property")]))
    return pairs.withColumn("target_value", F.explode(F.col("properties")[F.col("target_property")])).drop("properties")


def universals(frame: EventFrame) -> DataFrame:
    """``kind`` (name, description, container), the value described, and the distinct values that describe it."""
    pairs = related_values(frame).where(F.col("type").isin("name", "description", "container"))

    return (
        pairs.select(
            F.col("type").alias("kind"),
            _object_type(frame, "target_property").alias("object_type"),
            F.col("target_value").alias("value"),
            _object_type(frame, "source_property").alias("by_object_type"),
            F.col("source_value").alias("by_value"),
        )
        .distinct()
    )


def _object_type(frame: EventFrame, column: str) -> Column:
    pairs = [F.lit(x) for n, t in sorted(frame.ontology.event_types.items()) for p in t.properties for x in (f"{n}\n{p.name}", p.object_type)]
    return F.try_element_at(F.create_map(*pairs), F.concat(F.col("event_type"), F.lit("\n"), F.col(column)))
