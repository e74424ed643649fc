"""Queries over what mining finds in orders, whose components are small enough to be worked out in SQL.

Every order names its customer; a customer's orders are one component, linked by the shared customer and by a relation
between order and customer in each event. The first order's customer is the seed: it is sure, the customers of the other
orders are reached by their equal value, and orders by the relation, from the seed's own event or from another one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import EventFrame
from tidemark.functions.datatypes import DataType
from tidemark.mining import graph
from tidemark.mining.results import Knowledge, concepts_from_json
from tidemark.ontology.model import Concept, EventProperty, EventSource, EventType, ObjectType, Ontology
from tidemark.operators import filters, links, merge, replay, stats
from tidemark.plans.schemas import orders, texts, user_events
from tidemark.session import table

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


#: Tenths of how well the customer identifies a buyer, of the confidence in the relation and of that in an order's number.
IDENTIFIES, RELATED, SURE = 9, 6, 8


def trade_ontology() -> Ontology:
    kinds = {"order.key": "number:bigint", "customer.key": "number:bigint", "priority": "string:0:mc", "status": "enum:F:O:P", "day": "datetime"}
    own = EventType(
        "trade", timespan_start="day",
        properties=(
            EventProperty("customer", "customer.key", multivalued=False).identifies("buyer", IDENTIFIES, 200),
            EventProperty("order", "order.key", multivalued=False, confidence=SURE).identifies("buyer.deal", 5, 90),
            EventProperty("priority", "priority", multivalued=False).identifies("rank", 7, 50),
            EventProperty("status", "status", multivalued=False), EventProperty("day", "day", multivalued=False),
        ),
    ).relate("intra", "order", "customer", confidence=RELATED).relate("inter", "customer", "priority", confidence=4)
    own = own.relate("name", "order", "status").relate("description", "priority", "status").relate("container", "customer", "order")
    names = (Concept("buyer"), Concept("buyer.deal"), Concept("rank"))
    return Ontology().create(*[ObjectType(n, data_type=t) for n, t in kinds.items()], *names, EventSource("/trade/"), own)


def trades(spark: SparkSession, folder: str) -> EventFrame:
    rows = table(spark, folder, "orders")
    parts = {"customer": "o_custkey", "order": "o_orderkey", "priority": "o_orderpriority", "status": "o_orderstatus", "day": "o_orderdate"}
    return EventFrame.from_columns(rows, trade_ontology(), "trade", "/trade/", F.col("o_orderkey"), parts)


def knowledge(spark: SparkSession, folder: str, **how: object) -> Knowledge:
    return Knowledge.mine(trades(spark, folder), **how)


# What is reached: the customer of the first order is sure, the others have 0.9; an order has 0.6 x 0.8 of what its customer has.
_NODES = f"""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, o_orderstatus AS s, o_orderdate AS d, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f,
    min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS pf FROM orders),
  n AS (SELECT 'obj:' || f || ':customer:buyer:' || c AS seed, 'obj:' || k || ':customer:buyer:' || c AS node, 'customer.key:' AS attribute, c::VARCHAR AS value, 'buyer' AS concept,
      CASE WHEN k = f THEN 1.0 ELSE {IDENTIFIES / 10} END::DOUBLE AS confidence, CASE WHEN k = f THEN 0 ELSE 2 END AS depth, CASE WHEN k = f THEN NULL ELSE 'shared' END AS kind, d FROM o
    UNION ALL SELECT 'obj:' || f || ':customer:buyer:' || c, 'obj:' || k || ':order:buyer.deal:' || k, 'order.key:', k::VARCHAR, 'buyer.deal',
      (CASE WHEN k = f THEN 1.0 ELSE {IDENTIFIES / 10} END * {RELATED * SURE / 100})::DOUBLE, CASE WHEN k = f THEN 1 ELSE 3 END, 'intra', d FROM o
    UNION ALL SELECT 'obj:' || pf || ':priority:rank:' || p, 'obj:' || k || ':priority:rank:' || p, 'priority:', p, 'rank', CASE WHEN k = pf THEN 1.0 ELSE 0.7 END::DOUBLE,
      CASE WHEN k = pf THEN 0 ELSE 2 END, CASE WHEN k = pf THEN NULL ELSE 'shared' END, d FROM o) """
_EITHER = "round((1 - product(1 - confidence))::DOUBLE, 6)"


@query(_NODES + "SELECT seed, node, round(confidence, 6) AS confidence, depth, kind AS reason_kind FROM n")
def mined_members(spark: SparkSession, folder: str) -> DataFrame:
    """How far each node belongs to which seed: hubs, relations, path confidence, taint and all seeds."""
    return knowledge(spark, folder).members.select("seed", "node", F.round("confidence", 6).alias("confidence"), "depth", "reason_kind")


@query(_NODES + f"SELECT seed, attribute, value, {_EITHER} AS confidence, max(CASE attribute WHEN 'customer.key:' THEN 200 WHEN 'order.key:' THEN 90 ELSE 50 END) AS cnp, count(*) AS n_nodes FROM n GROUP BY 1, 2, 3")
def mined_attributes(spark: SparkSession, folder: str) -> DataFrame:
    return knowledge(spark, folder).attributes().withColumn("confidence", F.round("confidence", 6))


@query(_NODES + """, a AS (SELECT seed, concept, 1 - product(1 - confidence) AS c FROM n GROUP BY seed, concept, attribute, value)
    SELECT seed, concept, round((1 - product(1 - c))::DOUBLE, 6) AS confidence FROM a GROUP BY 1, 2""")
def mined_concept_names(spark: SparkSession, folder: str) -> DataFrame:
    return knowledge(spark, folder).concept_names().withColumn("confidence", F.round("confidence", 6))


@query(_NODES + "SELECT DISTINCT seed, concept, value AS title, 1 + count(*) FILTER (WHERE attribute = 'order.key:') OVER (PARTITION BY seed) AS n_attributes FROM n QUALIFY seed = node")
def mined_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Instances with their best concept name and title."""
    return knowledge(spark, folder).instances()


@query(_NODES + f"SELECT seed, attribute, value, strftime(d, '%Y-%m-%dT%H:%M:%S.%fZ') AS start, {_EITHER} AS confidence FROM n GROUP BY seed, attribute, value, d")
def mined_timeline(spark: SparkSession, folder: str) -> DataFrame:
    line = knowledge(spark, folder).timeline()
    return line.select("seed", "attribute", "value", "start", F.round("confidence", 6).alias("confidence"))


@query(
    _NODES
    + """, e AS (SELECT a.seed AS x, b.seed AS y, a.confidence * 0.4 * b.confidence AS c FROM n a JOIN n b ON split_part(a.node, ':', 2) = split_part(b.node, ':', 2)
      AND a.attribute = 'customer.key:' AND b.attribute = 'priority:'), two_ways AS (SELECT x, y, c FROM e UNION ALL SELECT y, x, c FROM e)
    SELECT x AS seed, y AS related_seed, round((1 - product(1 - c))::DOUBLE, 6) AS confidence FROM two_ways GROUP BY 1, 2"""
)
def mined_related(spark: SparkSession, folder: str) -> DataFrame:
    return knowledge(spark, folder).related().withColumn("confidence", F.round("confidence", 6))


@query(_NODES + "SELECT DISTINCT seed, 'buyer' AS found_by FROM n WHERE concept = 'buyer' UNION ALL SELECT DISTINCT seed, 'attribute' FROM n WHERE attribute = 'priority:'")
def mined_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Instances of a concept, and those that have an attribute."""
    known = knowledge(spark, folder)
    one = known.of_concept("buyer").members.select("seed").distinct().withColumn("found_by", F.lit("buyer"))
    return one.unionByName(known.with_attribute("priority:").members.select("seed").distinct().withColumn("found_by", F.lit("attribute")))


@query(_NODES + """, t AS (SELECT min(seed) AS s FROM n WHERE attribute = 'priority:')
    SELECT DISTINCT n.seed FROM n JOIN o ON split_part(n.node, ':', 2) = o.k::VARCHAR, t WHERE n.attribute = 'customer.key:' AND 'obj:' || o.pf || ':priority:rank:' || o.p = t.s""")
def mined_related_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Customers related to one priority."""
    known = knowledge(spark, folder)
    least = known.members.where("attribute = 'priority:'").agg(F.min("seed")).first()[0]
    return known.related_to([least]).members.select("seed").distinct()


@query(_NODES + "SELECT seed, count(*) AS n_nodes FROM n WHERE confidence >= 0.5 GROUP BY 1 UNION ALL SELECT 'obj:' || k || ':order:buyer.deal:' || k, 1 FROM o")
def mined_sure(spark: SparkSession, folder: str) -> DataFrame:
    """With a confidence of 0.5 and more no order is reached from a customer, so that each is an instance."""
    return knowledge(spark, folder, min_confidence=0.5).members.groupBy("seed").agg(F.count(F.lit(1)).alias("n_nodes"))


@query(
    _NODES
    + """, b AS (SELECT min(k) AS k FROM o), w AS (SELECT o.* FROM o JOIN b USING (k)) SELECT n.seed, n.node, round(n.confidence, 6) AS confidence FROM n JOIN w ON n.seed = 'obj:' || w.f || ':customer:buyer:' || w.c WHERE w.k = w.f
    AND n.depth <= 2"""
)
def mined_from_seed(spark: SparkSession, folder: str) -> DataFrame:
    """What belongs to one given seed within two steps."""
    first = table(spark, folder, "orders").agg(F.min_by("o_custkey", "o_orderkey"), F.min("o_orderkey")).first()
    known = knowledge(spark, folder, seeds=[f"obj:{first[1]}:customer:buyer:{first[0]}"])
    return known.members.where("depth <= 2").select("seed", "node", F.round("confidence", 6).alias("confidence"))


@query(_NODES + """SELECT depth, CASE WHEN kind IS NULL THEN 'Found a ' || concept ELSE 'Discovery: this ' || split_part(seed, ':', 4) || ' has ' || attribute || ' = ' || value END AS sentence, count(*) AS n
    FROM n GROUP BY 1, 2""")
def mined_sentences(spark: SparkSession, folder: str) -> DataFrame:
    told = knowledge(spark, folder).narrate()
    return told.groupBy("depth", F.regexp_replace("sentence", " because of .*", "").alias("sentence")).agg(F.count(F.lit(1)).alias("n"))


@query(_NODES + f"SELECT seed, attribute, value, {_EITHER} AS confidence, 128 AS cnp FROM n GROUP BY 1, 2, 3")
def mined_json(spark: SparkSession, folder: str) -> DataFrame:
    """Instances written as JSON and read again."""
    back = concepts_from_json(knowledge(spark, folder).concepts_json(), "json")
    return back.withColumn("confidence", F.round("confidence", 6))


@query(_NODES + "SELECT node, min(node) OVER (PARTITION BY CASE WHEN attribute = 'priority:' THEN 'p' || value ELSE split_part(seed, ':', 5) END) AS component FROM n")
def linked_components(spark: SparkSession, folder: str) -> DataFrame:
    """Components by relations and shared values."""
    frame = trades(spark, folder)
    return graph.components(graph.nodes(frame), graph.relation_edges(frame, "intra"))


@query("""SELECT 'name' AS kind, 'status' AS object_type, o_orderstatus AS value, 'order.key' AS by_object_type, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 3
    UNION ALL SELECT 'description', 'status', o_orderstatus, 'priority', count(DISTINCT o_orderpriority) FROM orders GROUP BY 3
    UNION ALL SELECT 'container', 'order.key', o_orderkey::VARCHAR, 'customer.key', 1 FROM orders""")
def universals(spark: SparkSession, folder: str) -> DataFrame:
    """Names, descriptions and containers."""
    found = links.universals(trades(spark, folder))
    return found.groupBy("kind", "object_type", "value", "by_object_type").agg(F.count(F.lit(1)).alias("n"))


# -- operators on their own


@query("""WITH h AS (SELECT *, sha1('/events/'::BLOB || '\\x0Auser.event\\x0A'::BLOB || encode('name:' || event_type) || '\\xFF\\xFF\\xFF\\xFF'::BLOB || encode('user-id:' || user_id)) AS hash FROM events),
    f AS (SELECT hash, min(event_id) AS parent_id FROM h WHERE event_id % 5 <> 0 GROUP BY 1)
    SELECT event_id, h.hash AS parent_hash, parent_id FROM h LEFT JOIN f USING (hash) WHERE event_id % 5 <> 0""")
def parents_by_own_hash(spark: SparkSession, folder: str) -> DataFrame:
    """Each event linked to the first one that collides with it."""
    frame = user_events(spark, folder)
    linked = frame.hashed().withColumn("parents", F.array("sticky_hash")).drop("sticky_hash").where("event_id % 5 <> 0")
    return links.parents_by_hash(frame.with_df(linked))


@query("SELECT coalesce(event_type, '') AS event_type, count(*) AS n_events FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'stray' WHEN o_orderkey % 7 = 1 THEN NULL END AS event_type FROM orders WHERE o_orderkey % 7 < 2) GROUP BY 1")
def unknown_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of types that the ontology doesn't have, by an operator."""
    frame = trades(spark, folder)
    n = F.col("event_id") % 7
    changed = frame.df.withColumn("event_type", F.when(n == 0, "stray").when(n != 1, F.col("event_type")))
    found = filters.unknown_events(frame.with_df(changed))
    return found.groupBy(F.coalesce("event_type", F.lit("")).alias("event_type")).agg(F.count(F.lit(1)).alias("n_events"))


@query("SELECT source, string_agg(DISTINCT lang, '|' ORDER BY lang) AS langs, max(n_chars) AS longest FROM (SELECT coalesce(source, '') AS source, lang, n_chars FROM documents) GROUP BY 1")
def strategies_on_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Strategies used as aggregates over plain columns."""
    rows = table(spark, folder, "documents")
    order = F.col("doc_id")
    langs = merge.strategy("add", DataType("string:0:mc:u"), F.array_compact(F.array("lang")), order)
    longest = merge.strategy("max", DataType("number:bigint"), F.array_compact(F.array(F.col("n_chars").cast("string"))), order)
    out = rows.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(langs.alias("l"), longest.alias("m"))
    return out.select("source", F.nullif(F.array_join("l", "|"), F.lit("")).alias("langs"), F.get("m", F.lit(0)).cast("bigint").alias("longest"))


@query("SELECT event_id, user_id::VARCHAR AS user FROM events WHERE event_type LIKE 'c%'")
def routed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Rows handed to the handler of their type."""
    rows = table(spark, folder, "events").select("event_id", F.col("user_id").cast("string").alias("user"), "event_type", F.lit("/events/").alias("source_uri"))
    got: list[DataFrame] = []
    filters.route(rows, {"click": got.append}, {"/other": lambda df: None})
    return got[0].select("event_id", "user")


@query("SELECT o_orderkey AS event_id, strftime(TIMESTAMP '2031-01-01 00:00:00' + (o_orderdate - (SELECT min(o_orderdate) FROM orders)), '%Y-%m-%dT%H:%M:%S.%fZ') AS day FROM orders")
def replayed_times(spark: SparkSession, folder: str) -> DataFrame:
    """Events moved so that the first starts at a given time."""
    moved = replay.shifted(trades(spark, folder), F.lit("2031-01-01 00:00:00").cast("timestamp"), 1.0).df
    return moved.select("event_id", F.col("properties")["day"][0].alias("day"))


@query("SELECT CASE WHEN g = 1 THEN NULL ELSE 'trade' END AS event_type, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S.%fZ') AS first_start, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S.%fZ') AS last_end FROM orders, (VALUES (0), (1)) t(g) GROUP BY g")
def covered_span(spark: SparkSession, folder: str) -> DataFrame:
    return stats.covered_times(trades(spark, folder))


@query("SELECT 40::BIGINT AS n_events, 40::BIGINT AS n_hashes, 0::BIGINT AS n_invalid")
def dummy_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Made-up events without collisions all differ, and keep their schema's rules."""
    from tidemark.operators import validation

    frame = replay.dummy_events(spark, 40, 0.0, 5)
    checked = validation.is_valid(frame)
    return checked.join(frame.hashed().select("event_id", "sticky_hash"), "event_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_distinct("sticky_hash").alias("n_hashes"), F.count_if(~F.col("is_valid")).alias("n_invalid")
    )


@query("SELECT o_orderkey AS event_id, o_orderpriority || ' order ' || o_orderkey AS text FROM orders WHERE o_custkey IS NOT NULL")
def relation_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """The description of a relation, for each event."""
    from tidemark.operators.render import relation_texts

    frame = trades(spark, folder)
    own = frame.ontology.event_types["trade"]
    bare = own.with_(relations=()).relate("other", "priority", "order", "order")
    return relation_texts(EventFrame(frame.df, frame.ontology.put(bare)), "trade").select("event_id", "text")


@query("SELECT o_orderkey AS order_key, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders")
def union_of_collections(spark: SparkSession, folder: str) -> DataFrame:
    """A collection united with itself and merged is itself."""
    from tidemark.operators.compare import union_distinct

    frame = orders(spark, folder)
    both = union_distinct(frame, frame)
    p = F.col("properties")
    rows = both.df.select(p["order-key"][0].cast("bigint").alias("order_key"), p["customer"][0].alias("c"), p["priority"][0].alias("r"))
    n = rows.groupBy("c", "r").agg(F.count(F.lit(1)).alias("n"))
    return texts(rows.join(n, ["c", "r"]).select("order_key", "n"), "order_key")
