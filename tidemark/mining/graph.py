"""The graph of concepts in events: values as nodes, relations and shared values as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.frame import EventFrame
from tidemark.operators.stats import event_times
from tidemark.session import cut_lineage


def node_id(event: Column, name: Column, concept: Column, value: Column) -> Column:
    return F.concat_ws(":", F.lit("obj"), event.cast("string"), name, concept, value)


def nodes(frame: EventFrame) -> DataFrame:
    """One row for each value of each property in each concept it is associated with, by one generator in each row."""
    start, end = event_times(frame)
    rows = []
    for name, own in sorted(frame.ontology.event_types.items()):
        for p in own.properties:
            for c in p.concepts:
                rows.append(
                    F.struct(
                        F.lit(name).alias("event_type"), F.lit(p.name).alias("property"), F.lit(c.concept).alias("concept"),
                        F.lit(p.object_type).alias("object_type"), F.lit(p.attribute_name(c.concept)).alias("attribute"),
                        F.lit(p.confidence / 10).alias("confidence"), F.lit(c.confidence / 10).alias("identifies"), F.lit(c.cnp).alias("cnp"),
                    )
                )
    if not rows:
        raise ValueError("no property of the ontology is associated with a concept")
    mine = F.filter(F.array(*rows), lambda r: r["event_type"] == F.col("event_type"))
    each = frame.df.select("event_id", "properties", start.alias("start"), end.alias("end"), F.explode(mine).alias("r"))
    values = each.select("event_id", "start", "end", "r.*", F.explode(F.col("properties")[F.col("r.property")]).alias("value"))
    return values.drop("event_type").withColumn("node", node_id(F.col("event_id"), F.col("property"), F.col("concept"), F.col("value")))


def relation_edges(frame: EventFrame, kind: str) -> DataFrame:
    """Edges of one kind of concept relation (inter or intra) in both directions: ``source``, ``target``, ``weight``.
    A node isn't linked with itself; of several edges between two nodes the strongest counts."""
    rows = []
    for name, own in sorted(frame.ontology.event_types.items()):
        for r in own.related(kind):
            rows.append(
                F.struct(
                    F.lit(name).alias("event_type"), F.lit(r.source).alias("s"), F.lit(r.source_concept).alias("sc"), F.lit(r.target).alias("t"),
                    F.lit(r.target_concept).alias("tc"), F.lit((r.confidence or 10) / 10).alias("weight"),
                )
            )
    if not rows:
        return frame.df.select(F.lit("").alias("source"), F.lit("").alias("target"), F.lit(0.0).alias("weight")).limit(0)
    mine = F.filter(F.array(*rows), lambda r: r["event_type"] == F.col("event_type"))
    each = frame.df.select("event_id", "properties", F.explode(mine).alias("r"))
    pairs = each.withColumn("sv", F.explode(F.col("properties")[F.col("r.s")])).withColumn("tv", F.explode(F.col("properties")[F.col("r.t")]))
    made = pairs.select(
        node_id(F.col("event_id"), F.col("r.s"), F.col("r.sc"), F.col("sv")).alias("source"),
        node_id(F.col("event_id"), F.col("r.t"), F.col("r.tc"), F.col("tv")).alias("target"),
        F.col("r.weight").alias("weight"),
    ).where("source <> target")
    both = made.unionByName(made.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    return both.groupBy("source", "target").agg(F.max("weight").alias("weight"))


def components(points: DataFrame, intra: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the least node in it), linked by intra relations and shared values.

    Each value is a star around its least node, so k equal values are k links. Only values that some relation touches
    take part in the rounds; all others are components of their own. Labels sink by alternating steps (large star,
    small star) until nothing changes, which takes about as many rounds as the logarithm of the longest chain. Each
    round is written, so that its plan stays small and survives the loss of executors.
    """
    hubs = points.groupBy("object_type", "value").agg(F.min("node").alias("hub"))
    stars = points.join(hubs, ["object_type", "value"]).select("node", "hub")
    if not intra.limit(1).collect():
        # nothing links different values: each is a component
        return stars.withColumnRenamed("hub", "component")
    stars = cut_lineage(stars)
    ends = intra.select("source", "target").where("source <> target")
    # relations between hubs, each of which stands for its value
    of = [stars.select(F.col("node").alias(end), F.col("hub").alias(f"{end}_hub")) for end in ("source", "target")]
    links = ends.join(of[0], "source").join(of[1], "target").select(F.col("source_hub").alias("a"), F.col("target_hub").alias("b")).where("a <> b").distinct()
    links, before = cut_lineage(links), None
    while True:
        # large star: every larger neighbour is linked to the least of the neighbourhood
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: every smaller neighbour, and the node itself, is linked to the least
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        links = cut_lineage(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    labels = links.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("component"))
    return stars.join(labels, "hub", "left").select("node", F.coalesce("component", "hub").alias("component"))
