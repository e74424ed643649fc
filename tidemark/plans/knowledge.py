"""Queries over the concept graph, transcoded records, XML and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import EventFrame
from tidemark.functions.scalars import fuzzy_key, noisy_or
from tidemark.mining import graph
from tidemark.mining.results import Knowledge
from tidemark.ontology.model import EventProperty, EventType
from tidemark.plans import events as base
from tidemark.plans.events import TIME, _object_case
from tidemark.plans.declared import all_events
from tidemark.plans.schemas import CONCEPTS, user_events, user_ontology, whole_events
from tidemark.session import shared_folder, table
from tidemark.sources.event_xml import event_text
from tidemark.streaming import merge as streams
from tidemark.transcode.records import Mediator, Transcoder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL


_CONCEPT = "CASE property " + " ".join(f"WHEN '{p}' THEN '{c}'" for p, (c, _) in CONCEPTS.items()) + " END"
_IDENTIFIES = "CASE property " + " ".join(f"WHEN '{p}' THEN {n / 10}" for p, (_, n) in CONCEPTS.items()) + " END"
_NODES = (
    _object_case()
    + f""", n AS (SELECT event_id, property, object_type, {_CONCEPT} AS concept, ({_IDENTIFIES})::DOUBLE AS identifies, value,
      concat_ws(':', 'obj', event_id, property, {_CONCEPT}, value) AS node FROM o WHERE {_CONCEPT} IS NOT NULL) """
)


def _known(spark: SparkSession, folder: str) -> EventFrame:
    return whole_events(spark, folder)


@query(_NODES + "SELECT node, event_id, property, concept, object_type, object_type || ':' AS attribute, value, 1.0::DOUBLE AS confidence, identifies FROM n")
def concept_nodes(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.nodes(_known(spark, folder))
    return found.select("node", "event_id", "property", "concept", "object_type", "attribute", "value", "confidence", "identifies")


@query(
    _NODES
    + """, p AS (SELECT a.node AS source, b.node AS target, CASE a.property WHEN 'vessel' THEN 0.6 ELSE 0.7 END::DOUBLE AS weight FROM n a JOIN n b ON a.event_id = b.event_id
      WHERE (a.property = 'vessel' AND b.property = 'operator') OR (a.property = 'crane' AND b.property = 'container'))
    SELECT * FROM p UNION ALL SELECT target, source, weight FROM p"""
)
def concept_edges(spark: SparkSession, folder: str) -> DataFrame:
    return graph.relation_edges(_known(spark, folder), "inter")


@query(_NODES + "SELECT node, min(node) OVER (PARTITION BY object_type, value) AS component FROM n")
def concept_components(spark: SparkSession, folder: str) -> DataFrame:
    """Without intra relations a component is a shared value."""
    frame = _known(spark, folder)
    return graph.components(graph.nodes(frame), graph.relation_edges(frame, "intra"))


@query()
def mined_instances(spark: SparkSession, folder: str) -> DataFrame:
    return Knowledge.mine(all_events(spark, folder, stand_in=True)).instances()


@query()
def mined_relations(spark: SparkSession, folder: str) -> DataFrame:
    found = Knowledge.mine(all_events(spark, folder, stand_in=True)).related()
    return found.select("seed", "related_seed", F.round("confidence", 6).alias("confidence"))


@query("SELECT user_id, round(1 - product(1 - (round(value, 2)::DECIMAL(12,2) % 10)::DOUBLE / 10), 6) AS confidence FROM events GROUP BY user_id")
def noisy_or_confidence(spark: SparkSession, folder: str) -> DataFrame:
    doubt = F.expr("cast(cast(round(value, 2) as decimal(12,2)) % 10 as double) / 10")
    return table(spark, folder, "events").groupBy("user_id").agg(F.round(noisy_or(doubt), 6).alias("confidence"))


@query(
    f"""SELECT event_id, user_id::DECIMAL(38,0)::BIGINT AS "user-id", event_type AS name, round(value, 2)::DECIMAL(12,2)::DOUBLE AS amount, props AS payload FROM events"""
)
def wide_form(spark: SparkSession, folder: str) -> DataFrame:
    """Events of one type with a typed column for each property."""
    wide = user_events(spark, folder).wide("user.event")
    return wide.select("event_id", F.col("user-id").cast("bigint").alias("user-id"), "name", F.col("amount").cast("double").alias("amount"), "payload")


@query(
    f"""SELECT event_id, '<event event-type="user.event" source-uri="/events/"><properties><amount>' || round(value, 2)::DECIMAL(12,2)::VARCHAR || '</amount><name>' || event_type ||
    '</name><payload>' || replace(props, '"', '&quot;') || '</payload><time-end>' || {TIME.format("ts")} || '</time-end><time-start>' || {TIME.format("ts")} ||
    '</time-start><user-id>' || user_id || '</user-id><version>' || event_id || '</version></properties></event>' AS text FROM events"""
)
def xml_events(spark: SparkSession, folder: str) -> DataFrame:
    return user_events(spark, folder).df.select("event_id", event_text().alias("text"))


@query("""SELECT event_id, event_type AS name, (json_extract_string(props, '$.k')) AS k FROM events""")
def transcode_records(spark: SparkSession, folder: str) -> DataFrame:
    """Flat rows with JSON inside turned into events by a declared map."""
    own = EventType("made").with_property(EventProperty("name", "event.name")).with_property(EventProperty("k", "payload"))
    spec = Transcoder(own, {"event_type": "name", "p.k": "k"})
    rows = table(spark, folder, "events").select("event_id", "event_type", F.parse_json("props").alias("p"))
    made = Mediator(user_ontology(), "/made/").register(None, spec).transcode(rows)
    return made.df.select("event_id", F.col("properties")["name"][0].alias("name"), F.col("properties")["k"][0].alias("k"))


@query("SELECT p_partkey, p_name[:3] AS head, p_name[4:] AS tail, regexp_extract(p_name, '[0-9]+') AS number FROM part")
def fuzzy_keys(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("p_name")
    keys = {"head": "[:3]", "tail": "[3:]", "number": "substring:[0-9]+"}
    return table(spark, folder, "part").select("p_partkey", *[fuzzy_key(name, m).alias(n) for n, m in keys.items()])


# -- streams and windows


@query("SELECT event_type, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_events FROM events GROUP BY 1, 2")
def window_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = streams.type_counts(table(spark, folder, "events"), F.col("ts"), "6 hours", "1 hour")
    return counted.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_events")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS n_events FROM s GROUP BY user_id, n"""
)
def session_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = streams.sessions(table(spark, folder, "events"), "user_id", F.col("ts"), "2 hours", "1 hour")
    return found.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n_events")


@query(base.SQL["merge_latest_per_key"])
def stream_merge(spark: SparkSession, folder: str) -> DataFrame:
    """The merge of the table read as a stream; its last state is what the batch gives."""
    schema = table(spark, folder, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*")
    amount = F.format_string("%.2f", F.col("value"))
    names = {"user-id": "user_id", "name": "event_type", "time-start": "ts", "time-end": "ts", "amount": amount, "payload": "props", "version": "event_id"}
    frame = EventFrame.from_columns(rows, user_ontology(), "user.event", "/events/", F.col("event_id"), names)
    merged = streams.continuous_merge(frame, "user.event")
    path = f"{shared_folder(spark)}/merged-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")

    merged.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{path}/*").withColumn("_batch", F.regexp_extract(F.input_file_name(), r"/(\d+)/[^/]*$", 1).cast("int"))
    state = last.where(F.col("_batch") == last.agg(F.max("_batch")).scalar())
    p = F.col("properties")
    one = {n: F.get(p[n], F.lit(0)) for n in names}
    return state.select(
        "sticky_hash", one["user-id"].cast("bigint").alias("user-id"), one["name"].alias("name"), one["time-start"].alias("time_start"),
        one["time-end"].alias("time_end"), one["amount"].alias("amount"), one["payload"].alias("payload"), one["version"].alias("version"), "n_events",
    )


