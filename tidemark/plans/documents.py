"""Queries over event XML, transcoded documents and streams."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.frame import EventFrame
from tidemark.functions.datatypes import DataType
from tidemark.ontology.model import EventProperty, EventSource, EventType, ObjectType, Ontology
from tidemark.operators import edits
from tidemark.plans.schemas import orders, user_events, user_ontology
from tidemark.session import shared_folder, table
from tidemark.sources import event_xml
from tidemark.streaming import merge as streams
from tidemark.transcode.records import DISCARD, Mediator, Transcoder, several
from tidemark.transcode.xml import XmlMediator

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


def _new_path(spark: SparkSession) -> str:
    """A folder of its own in the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


_USER = "user_id AS user_id, event_type AS name, round(value, 2)::DECIMAL(12,2)::VARCHAR AS amount, props AS payload"


def _flat(df: DataFrame) -> DataFrame:
    p = F.col("properties")
    return df.select(p["version"][0].cast("bigint").alias("event_id"), p["user-id"][0].cast("bigint").alias("user_id"), p["name"][0].alias("name"), p["amount"][0].alias("amount"), p["payload"][0].alias("payload"))


# -- event XML


@query(f"SELECT event_id, {_USER} FROM events")
def xml_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Events as elements and back."""
    return _flat(event_xml.parse_events(user_events(spark, folder).df.select(event_xml.event_text().alias("value"))))


@query(f"SELECT event_id, {_USER}, 'doc' AS attachment, sha1(event_type) AS parent FROM events")
def xml_files(spark: SparkSession, folder: str) -> DataFrame:
    """Written to files with their ontology and read back, attachments, parents and foreign attributes included."""
    frame, path = user_events(spark, folder), _new_path(spark)
    own = frame.ontology.event_types["user.event"]
    df = frame.df.withColumn("attachments", edits.set_attachment(F.col("attachments"), "doc", F.lit("<doc> & \"more\"")))
    df = df.withColumn("parents", F.array(F.sha1(F.col("properties")["name"][0].cast("binary"))))
    event_xml.write_events(EventFrame(df, frame.ontology.put(own)), path, namespace="urn:events", foreign=["<note>passed by</note>"])
    back = event_xml.read_events(spark, f"{path}/part-*")
    kept = back.df.where(F.map_values(F.col("attachments")["doc"])[0] == "<doc> & \"more\"")
    flat = _flat(kept)
    return flat.join(kept.select(F.col("properties")["version"][0].cast("bigint").alias("event_id"), F.lit("doc").alias("attachment"), F.col("parents")[0].alias("parent")), "event_id")


@query(f"SELECT event_id, {_USER} FROM events")
def xml_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Read by the splittable reader."""
    frame, path = user_events(spark, folder), _new_path(spark)
    event_xml.write_events(frame, path)
    return _flat(event_xml.scan(spark, path, frame.ontology))


@query("SELECT count(*) AS n_events, count(*) AS n_ids FROM events")
def xml_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of events from many files are all different."""
    frame, path = user_events(spark, folder), _new_path(spark)
    event_xml.write_events(EventFrame(frame.df.repartition(12), frame.ontology), path)
    back = event_xml.read_events(spark, f"{path}/part-*").df
    return back.agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("event_id").alias("n_ids"))


@query(
    """SELECT count(*) FILTER (WHERE event_id % 7 <> 0)::BIGINT AS written, count(*) FILTER (WHERE event_id % 7 <> 0 AND event_id % 5 = 0)::BIGINT AS repaired, count(*) FILTER (WHERE event_id % 7 = 0)::BIGINT AS left_out,
    count(*) FILTER (WHERE event_id % 7 <> 0)::BIGINT AS n_valid FROM events"""
)
def write_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth event has a number to be normalized, every seventh one that can't be; what was written is valid."""
    import warnings

    from tidemark.operators import validation

    frame, path = user_events(spark, folder), _new_path(spark)
    number, p = F.col("event_id"), F.col("properties")
    user = F.when(number % 7 == 0, F.array(F.lit("nobody"))).when(number % 5 == 0, F.transform(p["user-id"], lambda v: F.concat(F.lit("+00"), v))).otherwise(p["user-id"])
    dirty = frame.df.withColumn("properties", edits.set_property(p, "user-id", user))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        n = event_xml.write_checked(frame.with_df(dirty), path, ignore_invalid=True)
    back = validation.is_valid(event_xml.read_events(spark, f"{path}/part-*"))
    return back.agg(F.lit(n["written"]).cast("bigint").alias("written"), F.lit(n["repaired"]).cast("bigint").alias("repaired"), F.lit(n["left_out"]).cast("bigint").alias("left_out"), F.count_if("is_valid").alias("n_valid"))


@query("SELECT 'n_events' AS what, 30::BIGINT AS n UNION ALL SELECT 'n_foreign', 1 UNION ALL SELECT 'n_types', 1 UNION ALL SELECT 'n_pieces', 0")
def pushed_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """A document of thirty events fed in pieces of seven characters to the push reader."""
    frame = user_events(spark, folder)
    text = event_xml.document(frame.with_df(frame.df.orderBy("event_id").limit(30)), namespace="urn:events").replace("<event ", "<note/><event ", 1)
    reader, got = event_xml.PushReader(), []
    for at in range(0, len(text), 7):
        got += reader.feed(text[at : at + 7])
    reader.close()
    rows = [("n_events", reader.counts["user.event"]), ("n_foreign", len(reader.foreign)), ("n_types", len(reader.ontology.event_types)), ("n_pieces", len(got) - 30)]
    return spark.createDataFrame(rows, "what string, n long")


# -- documents of other kinds


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """One XML document for each customer, with open and done orders and a summary."""
    rows = table(spark, folder, "orders")
    tag = F.when(F.col("o_orderstatus") == "F", "done").otherwise("open")
    order = F.concat(F.lit("<order key=\""), F.col("o_orderkey").cast("string"), F.lit("\"><state>"), "o_orderstatus", F.lit("</state><rank><![CDATA["), "o_orderpriority", F.lit("]]></rank></order>"))
    own = rows.select("o_custkey", F.concat(F.lit("<"), tag, F.lit(">"), order, F.lit("</"), tag, F.lit(">")).alias("x"))
    inside = own.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("x")), "").alias("x"))
    head = F.concat(F.lit("<trade xmlns=\"urn:t\" customer=\""), F.col("o_custkey").cast("string"), F.lit("\"><!-- <order key=\"0\"/> -->"))
    return inside.select(F.concat(head, "x", F.lit("<sum><state>all</state></sum></trade>")).alias("doc"))


def _order_type(name: str) -> EventType:
    own = EventType(name, properties=(EventProperty("key", "key"), EventProperty("state", "state"), EventProperty("rank", "rank"), EventProperty("customer", "key")))
    return own


def _documents_ontology() -> Ontology:
    kinds = {"key": "number:bigint", "state": "string:0:mc", "rank": "string:0:mc"}
    return Ontology().create(*[ObjectType(n, n, f"{n}s", n, k) for n, k in kinds.items()], EventSource("/docs/"))


_PATHS = {"@key": "key", "state": "state", "rank/text()": "rank", "/trade/@customer": "customer"}


def _transcoded(frame: EventFrame) -> DataFrame:
    p = F.col("properties")
    return frame.df.select("event_type", p["key"][0].cast("bigint").alias("order_key"), p["state"][0].alias("state"), p["rank"][0].alias("rank"), p["customer"][0].cast("bigint").alias("customer"))


@query("SELECT 'order' AS event_type, o_orderkey AS order_key, o_orderstatus AS state, o_orderpriority AS rank, o_custkey AS customer FROM orders")
def transcode_xml(spark: SparkSession, folder: str) -> DataFrame:
    """One kind of element of each document; comments, CDATA and namespaces are read as such."""
    m = XmlMediator(_documents_ontology(), "/docs/").register("//order", Transcoder(_order_type("order"), _PATHS))
    return _transcoded(m.transcode(_documents(spark, folder), "doc"))


@query("SELECT CASE o_orderstatus WHEN 'O' THEN 'open.order' ELSE 'order' END AS event_type, o_orderkey AS order_key, o_orderstatus AS state, o_orderpriority AS rank, o_custkey AS customer FROM orders WHERE o_orderstatus IN ('O', 'P')"
       .replace("CASE o_orderstatus WHEN 'O' THEN 'open.order' ELSE 'order' END", "'open.order'"))
def transcode_xml_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    """The first transcoder that selects an element takes it: open orders by their path, done ones are discarded with all that
    is in them, and none is left for the last one."""
    m = XmlMediator(_documents_ontology(), "/docs/")
    m.register("/trade/open/order", Transcoder(_order_type("open.order"), _PATHS)).register("/trade/done", DISCARD).register("order", Transcoder(_order_type("order"), _PATHS))
    return _transcoded(m.transcode(_documents(spark, folder), "doc"))


@query("SELECT 'order' AS tag, count(*) FILTER (WHERE o_orderstatus = 'F') AS n FROM orders UNION ALL SELECT 'sum', count(DISTINCT o_custkey) FROM orders")
def transcode_xml_unknown(spark: SparkSession, folder: str) -> DataFrame:
    m = XmlMediator(_documents_ontology(), "/docs/").register("/trade/open/order", Transcoder(_order_type("open.order"), _PATHS))
    return m.unknown(_documents(spark, folder), "doc", ["order", "sum"])


@query("SELECT o_custkey AS customer, o_orderkey AS order_key FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def transcode_xml_parts(spark: SparkSession, folder: str) -> DataFrame:
    """One element that becomes several events, each of which an edit gives twice."""
    spec = Transcoder(_order_type("order"), {"@key": "key", "/trade/@customer": "customer"}, explode="order", edit=lambda df: df.unionByName(df))
    made = XmlMediator(_documents_ontology(), "/docs/").register("/trade/done", spec).transcode(_documents(spark, folder), "doc")
    p = F.col("properties")
    return made.df.select(p["customer"][0].cast("bigint").alias("customer"), p["key"][0].cast("bigint").alias("order_key"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'clicked' ELSE 'other' END AS kind, upper(event_type) || '|' || event_type AS names, user_id::VARCHAR AS first, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS even
    FROM events WHERE event_type <> 'view' AND user_id <> 3"""
)
def transcode_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Records by their kind: lists, places in lists, truth values, values that count as none, functions applied to values, a
    last edit, and a kind that is discarded."""
    kinds = {"key": "string:0:mc", "flag": "boolean"}
    ontology = Ontology().create(*[ObjectType(n, n, f"{n}s", n, k) for n, k in kinds.items()], EventSource("/lists/"))
    names = {"names": "key", "first": "key", "even": "flag"}
    own = EventType("clicked", properties=tuple(EventProperty(n, k) for n, k in names.items()))
    paths = {"type": "names", "list.0": "first", "even": "even", "nowhere.x": "first"}
    post = {"names": several(lambda v: F.array(F.upper(v), v))}
    spec = Transcoder(own, paths, empty={"list.0": ["3"]}, post=post, edit=lambda df: df.where(F.col("properties")["first"].isNotNull()))
    other = Transcoder(own.with_(name="other"), paths, empty=spec.empty, post=post, edit=spec.edit)
    rows = table(spark, folder, "events").select("event_id", F.col("event_type").alias("type"), F.array("user_id").alias("list"), (F.col("event_id") % 2 == 0).alias("even"))
    made = Mediator(ontology, "/lists/", "type").register("click", spec).register("view", DISCARD).register(None, other).transcode(rows)
    p = F.col("properties")
    return made.df.select("event_id", F.col("event_type").alias("kind"), F.array_join(p["names"], "|").alias("names"), p["first"][0].alias("first"), p["even"][0].alias("even"))


@query("SELECT event_id, user_id::VARCHAR AS number FROM events WHERE event_id % 3 <> 0")
def transcode_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Events normalized where they are invalid, and left out where that doesn't help."""
    ontology = Ontology().create(ObjectType("n", data_type="number:bigint"), EventSource("/n/"))
    spec = Transcoder(EventType("n").with_property(EventProperty("n", "n")), {"n": "n"})
    rows = table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, "none").otherwise(F.concat(F.lit("+0"), F.col("user_id").cast("string"))).alias("n"))
    mediator = Mediator(ontology, "/n/").register(None, spec)
    mediator.ignore_invalid, mediator.normalize = True, None
    return mediator.transcode(rows).df.select("event_id", F.col("properties")["n"][0].alias("number"))


# -- streams


def _streamed(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """What a streaming query has given when its input is used up, from the files it wrote."""
    path = _new_path(spark)
    out = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    out.start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _as_stream(spark: SparkSession, folder: str, name: str, files: int) -> DataFrame:
    """A table as a stream of files in the order of time, one after the other."""
    path = _new_path(spark)
    rows = table(spark, folder, name).withColumn("ts", F.col("ts").cast("timestamp"))
    part = F.ntile(files).over(Window.orderBy("ts"))
    numbered = rows.withColumn("_part", part)
    for n in range(1, files + 1):
        numbered.where(F.col("_part") == n).drop("_part").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in the order of their times, which are in seconds
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("""WITH w AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS s, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT event_type, strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, n AS n_events FROM w WHERE s + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Counts by windows of a stream in order, given out once the watermark has passed a window."""
    counted = streams.type_counts(_as_stream(spark, folder, "events", 4), F.col("ts"), "6 hours", "1 hour")
    done = _streamed(spark, counted, "append")
    return done.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_events")


@query("SELECT 1::BIGINT AS n_in_time, 0::BIGINT AS n_late")
def stream_late(spark: SparkSession, folder: str) -> DataFrame:
    """A row whose window is behind the watermark when it comes is left out."""
    path = _new_path(spark)
    for n, hour in enumerate(("00", "12", "12", "00")):  # the last file comes when the watermark has been at eleven o'clock for a batch
        rows = spark.createDataFrame([(f"2031-02-03 {hour}:10:00", "in time" if n < 3 else "late")], "ts string, event_type string")
        rows.select(F.to_timestamp("ts").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    rows = spark.readStream.schema("ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(path)
    done = _streamed(spark, streams.type_counts(rows, F.col("ts"), "1 hour", "1 hour"), "append")
    return done.agg(F.count_if(F.col("event_type") == "in time").alias("n_in_time"), F.count_if(F.col("event_type") == "late").alias("n_late"))


@query("SELECT event_id, event_type AS name FROM events")
def stream_transcode(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a stream transcoded as they come."""
    own = EventType("seen", properties=(EventProperty("n", "key"), EventProperty("name", "state")))
    m = XmlMediator(_documents_ontology(), "/docs/").register("/e", Transcoder(own, {"@n": "n", "name": "name"}))
    rows = _as_stream(spark, folder, "events", 3)
    docs = rows.select(F.concat(F.lit("<e n=\""), F.col("event_id").cast("string"), F.lit("\"><name>"), "event_type", F.lit("</name></e>")).alias("doc"))
    done = _streamed(spark, m.transcode(docs, "doc").df, "append")
    return done.select(F.col("properties")["n"][0].cast("bigint").alias("event_id"), F.col("properties")["name"][0].alias("name"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click'")
def stream_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A filter over a stream of event files."""
    frame, path = user_events(spark, folder), _new_path(spark)
    event_xml.write_events(EventFrame(frame.df.repartition(3), frame.ontology), path)
    own = event_xml.stream_events(spark, f"{path}/part-*", frame.ontology, files_per_batch=2)
    clicks = own.transform(lambda df: df.where(F.col("properties")["name"][0] == "click"))
    p = F.col("properties")
    return _streamed(spark, clicks.df, "append").select(p["version"][0].cast("bigint").alias("event_id"), p["user-id"][0].cast("bigint").alias("user_id"))


@query("SELECT user_id, event_type AS name, count(*) AS n_events, max(event_id)::VARCHAR AS version FROM events GROUP BY 1, 2")
def stream_merge_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Each batch of a stream merged and handed to a sink, which counts; the sink's parts merged again give the whole."""
    from tidemark.operators.merge import merge_all

    rows = _as_stream(spark, folder, "events", 3)
    amount = F.format_string("%.2f", F.col("value"))
    names = {"user-id": "user_id", "name": "event_type", "time-start": "ts", "time-end": "ts", "amount": amount, "payload": "props", "version": "event_id"}
    frame = EventFrame.from_columns(rows, user_ontology(), "user.event", "/events/", F.col("event_id"), names)
    path = _new_path(spark)

    def sink(batch: EventFrame, number: int) -> None:
        batch.df.write.parquet(f"{path}/batch={number}")

    streams.buffered_merge(frame, sink, "0 seconds").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    parts = EventFrame(spark.read.parquet(path).drop("batch"), user_ontology())
    p = F.col("properties")
    whole = merge_all(parts).select(p["user-id"][0].cast("bigint").alias("user_id"), p["name"][0].alias("name"), p["version"][0].alias("version"))
    n = table(spark, folder, "events").groupBy("user_id", F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n_events"))
    return whole.join(n, ["user_id", "name"])


@query("SELECT o_orderkey AS event_id, o_orderkey::DECIMAL(38,0)::BIGINT AS key, o_orderpriority AS priority FROM orders")
def typed_orders(spark: SparkSession, folder: str) -> DataFrame:
    """A typed column for each property."""
    wide = orders(spark, folder).wide("order")
    return wide.select("event_id", F.col("order-key").cast("bigint").alias("key"), "priority")


@query("SELECT event_id, user_id AS typed FROM events")
def typed_values(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("user_id").cast("string")
    return table(spark, folder, "events").select("event_id", DataType("number:bigint").typed(text).cast("bigint").alias("typed"))
