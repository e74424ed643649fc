"""Queries over events: hashing, merging, filtering, comparing, profiling, rendering, validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import EventFrame
from tidemark.functions import scalars
from tidemark.functions.datatypes import DataType
from tidemark.operators import compare, edits, filters, links, merge, render, replay, stats, validation
from tidemark.plans.declared import all_events
from tidemark.plans.schemas import (
    PROPERTIES, TYPES, harbour_events, order_lines, orders, texts, user_events, whole_events,
)
from tidemark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query and the SQL that gives the same result."""

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


#: The distinct events with their properties, for SQL; only present values, as sets.
EVENTS = """WITH e AS (SELECT event_id, any_value(event_type_name) AS event_type, any_value(source_uri) AS source_uri, any_value(properties) AS properties,
    any_value(parents) AS parents, any_value(attachments) AS attachments FROM parsed_event WHERE event_id IS NOT NULL GROUP BY event_id),
  x AS (SELECT event_id, event_type, source_uri, unnest(map_entries(properties)) AS m FROM e),
  v AS (SELECT DISTINCT event_id, event_type, source_uri, m.key AS property, unnest(m.value) AS value FROM x) """
#: The same with the type under which ``whole_events`` has each event.
WHOLE = EVENTS.replace("any_value(event_type_name) AS event_type", "any_value(CASE WHEN event_type_name IN ({}) THEN event_type_name ELSE 'undeclared' END) AS event_type".format(", ".join(f"'{t}'" for t in TYPES)))
KNOWN = "(" + ", ".join(f"'{t}'" for t in TYPES) + ")"
HASH = r"sha1('/events/'::BLOB || '\x0Auser.event\x0A'::BLOB || encode('name:' || event_type) || '\xFF\xFF\xFF\xFF'::BLOB || encode('user-id:' || user_id))"
TIME = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ')"


# -- hashing and merging


@query(f"SELECT event_id, {HASH} AS sticky_hash FROM events")
def sticky_hash_events(spark: SparkSession, folder: str) -> DataFrame:
    return user_events(spark, folder).hashed().select("event_id", "sticky_hash")


@query(
    r"""SELECT event_id, sha256('/events/'::BLOB || '\x0Auser.event\x0A'::BLOB || encode('name:' || event_type) || '\xFF\xFF\xFF\xFF'::BLOB
    || encode('user-id:' || user_id)) AS sticky_hash FROM events"""
)
def sticky_hash_sha256(spark: SparkSession, folder: str) -> DataFrame:
    return user_events(spark, folder).hashed("sha256").select("event_id", "sticky_hash")


@query(
    f"""SELECT {HASH} AS sticky_hash, user_id AS "user-id", event_type AS name, {TIME.format("min(ts)")} AS time_start, {TIME.format("max(ts)")} AS time_end,
    max(round(value, 2))::DECIMAL(12,2)::VARCHAR AS amount, arg_max(props, event_id) AS payload, max(event_id)::VARCHAR AS version, count(*) AS n_events
    FROM events GROUP BY user_id, event_type"""
)
def merge_latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    """Events of one user and name merged: earliest start, latest end, greatest amount, newest payload."""
    merged = merge.merge_type(user_events(spark, folder), "user.event")
    one = {n: F.get(F.col("properties")[n], F.lit(0)) for n in ("user-id", "name", "time-start", "time-end", "amount", "payload", "version")}
    return merged.select(
        "sticky_hash", one["user-id"].cast("bigint").alias("user-id"), one["name"].alias("name"), one["time-start"].alias("time_start"),
        one["time-end"].alias("time_end"), one["amount"].alias("amount"), one["payload"].alias("payload"), one["version"].alias("version"), "n_events",
    )


@query(
    f"""SELECT l_orderkey AS order_key, string_agg(DISTINCT l_linenumber::VARCHAR, '|' ORDER BY l_linenumber::VARCHAR) AS lines,
    string_agg(DISTINCT l_partkey::VARCHAR, '|' ORDER BY l_partkey::VARCHAR) AS parts, min(l_returnflag) AS flag,
    {TIME.format("min(l_shipdate)")} AS first_shipped, {TIME.format("max(l_shipdate)")} AS last_shipped FROM lineitem GROUP BY l_orderkey"""
)
def merge_add_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    merged = merge.merge_type(order_lines(spark, folder), "order.line")
    p = F.col("properties")
    return merged.select(
        p["order-key"][0].cast("bigint").alias("order_key"), F.array_join(p["line"], "|").alias("lines"), F.array_join(p["part"], "|").alias("parts"),
        p["flag"][0].alias("flag"), p["first-shipped"][0].alias("first_shipped"), p["last-shipped"][0].alias("last_shipped"),
    )


@query(
    EVENTS
    + """, t AS (SELECT * FROM v WHERE event_type = 'crane.lift'),
    s AS (SELECT event_id, string_agg(value, '|' ORDER BY value) AS serials FROM t WHERE property = 'serial' GROUP BY event_id),
    k AS (SELECT e.event_id, source_uri, coalesce(serials, '') AS serials FROM e LEFT JOIN s USING (event_id) WHERE event_type = 'crane.lift'),
    g AS (SELECT source_uri, serials, min(event_id) AS event_id, count(*) AS n_events FROM k WHERE source_uri IS NOT NULL GROUP BY 1, 2),
    c AS (SELECT k.source_uri, serials, min(value) FILTER (WHERE property = 'time-start') AS time_start,
      min(value) FILTER (WHERE property = 'crane') AS crane, min(value) FILTER (WHERE property = 'operator') AS operator,
      string_agg(DISTINCT value, '|' ORDER BY value) FILTER (WHERE property = 'container') AS containers FROM k JOIN t USING (event_id) GROUP BY 1, 2)
    SELECT g.event_id, g.source_uri, g.n_events, c.time_start, c.crane, c.operator, coalesce(c.containers, '') AS containers
    FROM g LEFT JOIN c ON g.source_uri = c.source_uri AND g.serials = c.serials"""
)
def merge_crane_lifts(spark: SparkSession, folder: str) -> DataFrame:
    merged = merge.merge_type(harbour_events(spark, folder, "crane.lift"), "crane.lift").where("source_uri IS NOT NULL")
    p = F.col("properties")
    first = {n: F.get(p[n], F.lit(0)) for n in ("crane", "operator")}
    return merged.select(
        "event_id", "source_uri", "n_events", F.array_min(p["time-start"]).alias("time_start"), first["crane"].alias("crane"), first["operator"].alias("operator"),
        F.coalesce(F.array_join(p["container"], "|"), F.lit("")).alias("containers"),
    )


@query(
    """WITH k AS (SELECT user_id, event_type, count(DISTINCT (ts, value, props)) AS d, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT count(*) AS n_conflicts, coalesce(sum(n), 0)::BIGINT AS n_events FROM k WHERE d > 1"""
)
def merge_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    """Events that would collide if they had no versions."""
    frame = user_events(spark, folder)
    own = frame.ontology.event_types["user.event"]
    bare = EventFrame(frame.df.withColumn("properties", edits.delete_property(F.col("properties"), "version")), frame.ontology.put(own.with_(event_version=None)))
    return merge.conflicts(bare).agg(F.count(F.lit(1)).alias("n_conflicts"), F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"))


# -- filters, unions, differences


@query(EVENTS + "SELECT event_id, event_type, source_uri FROM e WHERE regexp_matches(event_type, '^(?:crane|reefer)') AND event_type IN " + KNOWN)
def filter_types(spark: SparkSession, folder: str) -> DataFrame:
    wanted = [t for t in TYPES if t.startswith(("crane", "reefer"))]
    return filters.filter_events(harbour_events(spark, folder, *wanted), "crane|reefer").df.select("event_id", "event_type", "source_uri")


@query("SELECT event_type, count(*) AS n_events FROM (SELECT 'order' AS event_type FROM orders UNION ALL SELECT 'order.line' FROM lineitem) GROUP BY 1")
def cat_union(spark: SparkSession, folder: str) -> DataFrame:
    both = compare.concatenate(orders(spark, folder), order_lines(spark, folder))
    return both.df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))


@query(
    """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'),
    b AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN 'P' ELSE o_orderstatus END AS s FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01')
    SELECT coalesce(a.k, b.k) AS order_key, CASE WHEN b.k IS NULL THEN 'only in a' WHEN a.k IS NULL THEN 'only in b' ELSE 'changed' END AS status
    FROM a FULL OUTER JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.s <> b.s"""
)
def diff_orders(spark: SparkSession, folder: str) -> DataFrame:
    """What two overlapping sets of orders differ in, where one has other states."""
    frame = orders(spark, folder)
    p = F.col("properties")
    a = frame.transform(lambda df: df.where(p["day"][0] < "1997"))
    late = frame.df.where(p["day"][0] >= "1994")
    urgent = F.when(p["priority"][0] == "1-URGENT", edits.set_property(p, "status", F.array(F.lit("P")))).otherwise(p)
    b = frame.with_df(late.withColumn("properties", urgent))
    found = compare.difference(a, b)
    key = F.coalesce(F.get_json_object("a", "$.properties.order-key[0]"), F.get_json_object("b", "$.properties.order-key[0]"))
    return found.select(key.cast("bigint").alias("order_key"), "status")


@query(EVENTS + "SELECT event_id, coalesce(string_agg(DISTINCT value, '|' ORDER BY value), '') AS people, 0::BIGINT AS n_left FROM e LEFT JOIN v USING (event_id) WHERE property IN ('operator', 'vessel') GROUP BY event_id")
def move_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Operators and vessels moved to one new property."""
    frame = harbour_events(spark, folder)
    moved = edits.move_properties(F.col("properties"), {"operator": ["who"], "vessel": ["who"]})
    out = frame.df.select("event_id", moved.alias("p")).where(F.col("p")["who"].isNotNull())
    left = F.size(edits.values_of(F.col("p"), "operator")) + F.size(edits.values_of(F.col("p"), "vessel"))
    return out.select("event_id", F.array_join(F.col("p")["who"], "|").alias("people"), left.cast("bigint").alias("n_left"))


# -- profiles


@query(WHOLE + f", t AS (SELECT unnest([{', '.join(repr(t) for t in [*TYPES, 'undeclared'])}]) AS event_type), c AS (SELECT event_type, count(*) AS n FROM e GROUP BY 1) SELECT event_type, coalesce(n, 0) AS n_events FROM t LEFT JOIN c USING (event_type)")
def stats_event_types(spark: SparkSession, folder: str) -> DataFrame:
    return stats.event_type_counts(whole_events(spark, folder))


@query(EVENTS + "SELECT source_uri, count(*) AS n_events FROM e GROUP BY 1")
def stats_sources(spark: SparkSession, folder: str) -> DataFrame:
    return stats.source_counts(harbour_events(spark, folder))


_NAMES = "[" + ", ".join(f"'{p}'" for p in PROPERTIES) + "]"


@query(
    WHOLE
    + f""", n AS (SELECT event_id, event_type, property, count(*) AS k FROM v GROUP BY 1, 2, 3),
    t AS (SELECT event_type, count(*) AS total FROM e GROUP BY 1), p AS (SELECT unnest({_NAMES}) AS property),
    d AS (SELECT event_type, property, count(DISTINCT value) AS n_distinct FROM v GROUP BY 1, 2)
    SELECT event_type, property, total AS n_events, coalesce(sum(k), 0)::BIGINT AS n_values, coalesce(any_value(n_distinct), 0) AS n_distinct, total - count(k) AS n_without,
      count(*) FILTER (WHERE k = 1) AS n_single, count(*) FILTER (WHERE k > 1) AS n_several
    FROM p CROSS JOIN t LEFT JOIN n USING (event_type, property) LEFT JOIN d USING (event_type, property) GROUP BY event_type, property, total"""
)
def stats_properties(spark: SparkSession, folder: str) -> DataFrame:
    return stats.all_property_stats(whole_events(spark, folder))


def _object_case() -> str:
    """Every value of every event with its object type."""
    parts = " ".join(f"WHEN '{p}' THEN '{o}'" for p, (o, _) in PROPERTIES.items())
    return WHOLE + f", o AS (SELECT *, CASE property {parts} END AS object_type FROM v WHERE property IN (SELECT unnest({_NAMES}))) "


@query(_object_case() + "SELECT object_type, count(*) AS n_values, count(DISTINCT value) AS n_distinct FROM o GROUP BY 1")
def stats_object_types(spark: SparkSession, folder: str) -> DataFrame:
    return stats.object_type_counts(whole_events(spark, folder))


@query(_object_case() + "SELECT value, count(*) AS n_values FROM o WHERE object_type = 'vessel.name' GROUP BY 1")
def stats_object_values(spark: SparkSession, folder: str) -> DataFrame:
    return stats.value_histogram(whole_events(spark, folder), "vessel.name")


@query(
    _object_case()
    + """, k AS (SELECT DISTINCT CASE property WHEN 'vessel' THEN 'ship' WHEN 'operator' THEN 'company' WHEN 'container' THEN 'box' WHEN 'plate' THEN 'vehicle'
      WHEN 'crane' THEN 'machine' WHEN 'permit' THEN 'permit' END AS concept, value FROM o)
    SELECT concept, count(*) AS n_seeds FROM k WHERE concept IS NOT NULL GROUP BY 1"""
)
def stats_concepts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.concept_counts(whole_events(spark, folder))


@query(
    WHOLE
    + """, s AS (SELECT e.event_id, e.event_type, min(value) FILTER (WHERE property = 'time-start') AS s,
      max(value) FILTER (WHERE property IN ('time-start', 'time-end')) AS m FROM e LEFT JOIN v USING (event_id) GROUP BY 1, 2)
    SELECT event_type, min(s) AS first_start, max(m) AS last_end FROM s GROUP BY ROLLUP (event_type)"""
)
def covered_times(spark: SparkSession, folder: str) -> DataFrame:
    return stats.covered_times(whole_events(spark, folder))


# -- links


@query("SELECT l_orderkey * 8 + l_linenumber AS event_id, o_orderkey AS parent_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def parents_by_properties(spark: SparkSession, folder: str) -> DataFrame:
    return links.parents_by_properties(compare.concatenate(orders(spark, folder), order_lines(spark, folder)), "order.line")


@query("SELECT DISTINCT 'container' AS kind, 'priority' AS object_type, o_orderpriority AS value, 'customer.key' AS by_object_type, o_custkey::VARCHAR AS by_value FROM orders")
def universals_containers(spark: SparkSession, folder: str) -> DataFrame:
    return links.universals(orders(spark, folder))


@query(
    _object_case()
    + """, a AS (SELECT event_id, event_type, property, value FROM o)
    SELECT s.event_id, s.value AS source_value, t.value AS target_value FROM a s JOIN a t ON s.event_id = t.event_id
    WHERE (s.property = 'vessel' AND t.property = 'operator') OR (s.property = 'crane' AND t.property = 'container')"""
)
def related_values(spark: SparkSession, folder: str) -> DataFrame:
    return links.related_values(whole_events(spark, folder)).select("event_id", "source_value", "target_value")


# -- rendering


@query(
    _object_case()
    + r""", a AS (SELECT event_id, property, replace(replace(replace(value, chr(9), chr(92) || chr(9)), chr(10), '\n'), chr(13), '\r') AS value FROM o WHERE event_type = 'crane.lift'),
    b AS (SELECT event_id FROM e WHERE event_type = 'crane.lift'),
    c AS (SELECT b.event_id, x.value AS crane, y.value AS container FROM b LEFT JOIN a x ON x.event_id = b.event_id AND x.property = 'crane'
      LEFT JOIN a y ON y.event_id = b.event_id AND y.property = 'container')
    SELECT event_id, coalesce(crane, '') || chr(9) || coalesce(container, '') AS line FROM c"""
)
def delimited_product(spark: SparkSession, folder: str) -> DataFrame:
    return render.delimited(harbour_events(spark, folder, "crane.lift"), "crane.lift", ["crane", "container", "no-such"])


@query(
    """SELECT event_id, event_type || ' by user ' || user_id AS raw, upper(event_type[1]) || event_type[2:] || ' by user ' || user_id || ' on ' ||
    strftime(ts, '%A, %B %d %Y') AS text FROM events"""
)
def render_stories(spark: SparkSession, folder: str) -> DataFrame:
    frame = user_events(spark, folder)
    story = render.texts(frame).select("event_id", "text")
    p = F.col("properties")
    raw = frame.df.select("event_id", F.concat(p["name"][0], F.lit(" by user "), p["user-id"][0]).alias("raw"))
    return raw.join(story, "event_id")


@query(
    _object_case()
    + """, n AS (SELECT event_id, property, row_number() OVER (PARTITION BY event_id, property ORDER BY value) AS i, count(*) OVER (PARTITION BY event_id, property) AS k, value FROM o
      WHERE event_type = 'radio.call'),
    j AS (SELECT event_id, property, string_agg(CASE WHEN i = 1 THEN value WHEN i = k THEN ' and ' || value ELSE ', ' || value END, '' ORDER BY i) AS text FROM n GROUP BY 1, 2),
    w AS (SELECT b.event_id, s.text AS serial, q.text AS vessel FROM (SELECT event_id FROM e WHERE event_type = 'radio.call') b
      LEFT JOIN j s ON s.event_id = b.event_id AND s.property = 'serial' LEFT JOIN j q ON q.event_id = b.event_id AND q.property = 'vessel')
    SELECT event_id, CASE WHEN serial IS NULL THEN '' ELSE 'Radio.call ' || serial || coalesce(' of ' || vessel, '') END AS text FROM w"""
)
def render_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return render.texts(harbour_events(spark, folder, "radio.call"), short=True).select("event_id", "text")


# -- values


@query(
    """SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE round(value, 2)::DECIMAL(12,2)::DECIMAL(12,4)::VARCHAR END AS currency,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS time, user_id::VARCHAR AS number FROM events"""
)
def normalize_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    amount = F.format_string("%.2f", "value")
    return rows.select(
        "event_id",
        DataType("number:currency").normalize(amount).alias("currency"),
        DataType("datetime").normalize(F.col("ts").cast("string")).alias("time"),
        DataType("number:bigint").normalize(F.concat(F.lit("+0"), F.col("user_id").cast("string"))).alias("number"),
    )


@query(
    EVENTS
    + """SELECT property, count(*) AS n_values, count(*) FILTER (WHERE
      CASE property WHEN 'weight' THEN regexp_full_match(value, '(0|[1-9][0-9]{0,9})\\.[0-9]{2}')
      WHEN 'depth' THEN regexp_full_match(value, '(0|[1-9][0-9]{0,3})\\.[0-9]')
      WHEN 'serial' THEN length(value) <= 16 AND lower(value) = value AND value <> '' AND regexp_full_match(value, '[\\x00-\\x7F]*')
      WHEN 'status' THEN value IN ('open', 'closed', 'failed', 'passed') END) AS n_valid
    FROM v WHERE property IN ('weight', 'depth', 'serial', 'status') GROUP BY 1""".replace("\\\\", "\\")
)
def valid_values(spark: SparkSession, folder: str) -> DataFrame:
    """Values of four properties and how many are valid for their types."""
    frame = harbour_events(spark, folder)
    kinds = {"weight": "number:decimal:12:2", "depth": "number:decimal:5:1", "serial": "string:16:lc", "status": "enum:open:closed:failed:passed"}
    each = frame.df.select(F.explode("properties").alias("property", "_v")).where(F.col("property").isin(*kinds)).select("property", F.explode("_v").alias("value"))
    good = F.lit(False)
    for name, kind in kinds.items():
        good = F.when(F.col("property") == name, DataType(kind).valid(F.col("value"))).otherwise(good)
    return each.groupBy("property").agg(F.count(F.lit(1)).alias("n_values"), F.count_if(good).alias("n_valid"))


@query(
    WHOLE
    + r""", n AS (SELECT event_id, count(*) AS k FROM v WHERE property = 'time-start' GROUP BY 1)
    SELECT event_type, 'time-start' AS property, 'missing mandatory property' AS reason, count(*) AS n_events FROM e LEFT JOIN n USING (event_id) WHERE k IS NULL AND event_type <> 'undeclared' GROUP BY 1
    UNION ALL SELECT event_type, 'time-start', 'several values of a single-valued property', count(*) FROM e JOIN n USING (event_id) WHERE k > 1 GROUP BY 1
    UNION ALL SELECT event_type, 'time-start', 'invalid value', count(DISTINCT event_id) FROM v WHERE property = 'time-start'
      AND NOT (regexp_full_match(value, '\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):\d{2}:\d{2}\.\d{6}Z') AND value >= '1583') GROUP BY 1
    UNION ALL SELECT event_type, 'status', 'invalid value', count(DISTINCT event_id) FROM v WHERE property = 'status' AND value NOT IN ('open', 'closed', 'failed', 'passed') GROUP BY 1"""
)
def validate_events(spark: SparkSession, folder: str) -> DataFrame:
    """Broken rules of times and states in every event."""
    counts = validation.reason_counts(validation.validate(whole_events(spark, folder)))
    return counts.where(F.col("property").isin("time-start", "status"))


@query()
def repair_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events normalized and rid of invalid states, with what is wrong still."""
    frame = all_events(spark, folder)
    drop = {name: ["status", "serial", "weight"] for name in frame.ontology.event_types}
    out = validation.repair(frame, drop=drop)
    return out.groupBy("event_type", "repaired").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.size("issues") > 0).alias("n_invalid"))


@query(
    r"""SELECT doc_id, CASE WHEN length(title) > 20 THEN title[:17] || '...' ELSE title END AS head, CASE WHEN length(title) > 20 THEN '...' || title[-17:] ELSE title END AS tail,
    trim(regexp_replace(title, '\s+', ' ', 'g')) AS blanks, array_to_string(regexp_extract_all(title, '[0-9]+'), '|') AS numbers FROM documents WHERE title IS NOT NULL"""
)
def text_functions(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("title")
    return table(spark, folder, "documents").where("title IS NOT NULL").select(
        "doc_id", scalars.truncate(t, 20).alias("head"), scalars.truncate(t, 20, head=False).alias("tail"), scalars.single_blanks(t).alias("blanks"),
        F.array_join(scalars.find_all(t, "[0-9]+"), "|").alias("numbers"),
    )


# -- time


@query(
    EVENTS
    + rf""", m AS (SELECT v.event_id, min(value) AS m FROM v JOIN e USING (event_id) WHERE property = 'time-start' GROUP BY 1),
    s AS (SELECT event_id, try_cast(m AS TIMESTAMP) AS t FROM m WHERE regexp_full_match(m, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}\.\d{{6}}Z')
      AND try_cast(m AS TIMESTAMP) IS NOT NULL)
    SELECT event_id, epoch_us(t) - (SELECT min(epoch_us(t)) FROM s) AS offset_micros,
      coalesce(epoch_us(t) - lag(epoch_us(t)) OVER (ORDER BY t, event_id), 0) AS gap_micros FROM s"""
)
def replay_delays(spark: SparkSession, folder: str) -> DataFrame:
    frame = whole_events(spark, folder)
    # only times that can be read
    good = F.array_min(F.col("properties")["time-start"]).rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z\z")
    out = replay.delays(frame.transform(lambda df: df.where(good)), speed=2.0)
    return out.select("event_id", "offset_micros", "gap_micros")


@query()
def dummy_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Made-up events, as many as the table of events has, merged."""
    n = table(spark, folder, "events").count()
    merged = merge.merge_type(replay.dummy_events(spark, n), "event-type.a")
    return texts(merged.select("sticky_hash", "n_events", F.map_values(F.col("properties")).cast("string").alias("properties")))
