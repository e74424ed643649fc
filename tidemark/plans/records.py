"""Queries over nested bodies and drifting files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import drift, nested
from tidemark.session import table

FEED = ["producer_id", "element_kind"]
#: What a record of each kind is known by.
KEYS = {"object-type": "name", "source": "uri", "property": "property"}

def _nodes(spark: SparkSession, folder: str) -> DataFrame:
    bodies = table(spark, folder, "raw_event").where(F.col("raw_id").isNotNull())  # raw_id is unique
    return nested.flatten_bodies(bodies, "raw_id", "body")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark, folder).select("raw_id", "node", "kind", "name", "pos")


def p4_raw_events(spark: SparkSession, folder: str) -> DataFrame:
    return nested.nodes_of_kind(_nodes(spark, folder), "event", "raw_id")


def p4_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Each node in the event right below the outermost one that it lies in."""
    return nested.contained(_nodes(spark, folder), "raw_id", 1)


def _event_nodes(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "parsed_event").where(F.col("event_id").isNotNull()).dropDuplicates(["event_id"])
    return nested.flatten_events(
        events, "event_id", F.col("event_type_name"), F.col("properties"), F.col("attachments"), F.col("parents")
    )


def p4_objects(spark: SparkSession, folder: str) -> DataFrame:
    return nested.nodes_of_kind(_event_nodes(spark, folder), "object", "event_id").select("event_id", "name", "pos", "value")


def p4_attachments(spark: SparkSession, folder: str) -> DataFrame:
    return nested.nodes_of_kind(_event_nodes(spark, folder), "attachment", "event_id").select("event_id", "name", "pos", "item_id", "value")


def p4_parents(spark: SparkSession, folder: str) -> DataFrame:
    return nested.nodes_of_kind(_event_nodes(spark, folder), "parent", "event_id").select("event_id", "name", "pos")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    key = F.create_map(*[F.lit(x) for pair in KEYS.items() for x in pair])[F.col("element_kind")]
    files = table(spark, folder, "ontology_drop").where(F.col("element_kind").isin(*KEYS))
    return drift.drift_report(files, FEED, "file_no", "file_id", "content", key)


def _consistent(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        files = table(spark, folder, "ontology_drop").where(F.col("element_kind") == kind)
        return drift.consistent_table(files, FEED, "file_no", "file_id", "content", KEYS[kind])

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p4_found": p4_found,
        "p4_raw_events": p4_raw_events,
        "p4_containment": p4_containment,
        "p4_objects": p4_objects,
        "p4_attachments": p4_attachments,
        "p4_parents": p4_parents,
        "p5_found": p5_found,
        "p5_object_types": _consistent("object-type"),
        "p5_sources": _consistent("source"),
        "p5_properties": _consistent("property"),
    }


_EVENTS = "WITH e AS (SELECT event_id, any_value(properties) AS properties, any_value(attachments) AS attachments, any_value(parents) AS parents FROM parsed_event GROUP BY event_id)"


def oracle_sql() -> dict[str, str]:
    return {
        "p4_objects": _EVENTS
        + """, x AS (SELECT event_id, unnest(map_entries(properties)) AS p FROM e),
        y AS (SELECT event_id, p.key AS name, list_filter(p.value, lambda v: v IS NOT NULL AND v <> '') AS v FROM x)
        SELECT event_id, name, unnest(generate_series(0, len(v) - 1))::INT AS pos, unnest(v) AS value FROM y WHERE len(v) > 0""",
        "p4_parents": _EVENTS
        + """, y AS (SELECT event_id, list_filter(parents, lambda v: v IS NOT NULL AND v <> '') AS v FROM e)
        SELECT event_id, unnest(v) AS name, unnest(generate_series(0, len(v) - 1))::INT AS pos FROM y WHERE len(v) > 0""",
        "p4_attachments": _EVENTS
        + """, x AS (SELECT event_id, unnest(map_entries(attachments)) AS a FROM e),
        y AS (SELECT event_id, a.key AS name, unnest(map_entries(a.value)) AS t FROM x)
        SELECT event_id, name, (row_number() OVER (PARTITION BY event_id, name ORDER BY t.key) - 1)::INT AS pos, t.key AS item_id, t.value AS value
        FROM y WHERE t.value <> ''""",
    }
