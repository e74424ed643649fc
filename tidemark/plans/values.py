"""Queries over single values: each data type's normal form and validity, template formatters, and edits of events.

Inputs are made from columns of the tables, in forms that vary from row to row, so that each rule is kept and broken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import EventFrame
from tidemark.functions import scalars
from tidemark.functions.datatypes import DataType
from tidemark.ontology.model import Attachment, EventProperty, EventSource, EventType, ObjectType, Ontology
from tidemark.operators import edits, merge, render, validation
from tidemark.plans.schemas import user_events
from tidemark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TIME = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ')"


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


def _form(*forms: str) -> str:
    """One of several expressions, by the row's number."""
    n = len(forms)
    return "CASE " + " ".join(f"WHEN event_id % {n} = {i} THEN {f}" for i, f in enumerate(forms)) + " END"


def _register(name: str, columns: dict[str, tuple[str, str, bool]], inputs: dict[str, str], sql: dict[str, str]) -> None:
    """A query over ``events``: each column is an input in the normal form of a data type, or whether it is valid."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        rows = table(spark, folder, "events").select("event_id", *[F.expr(e).alias(f"_{n}") for n, e in inputs.items()])
        out = []
        for column, (source, kind, normal) in columns.items():
            own = DataType(kind)
            out.append((own.normalize(F.col(f"_{source}")) if normal else own.valid(F.col(f"_{source}"))).alias(column))
        return rows.select("event_id", *out)

    QUERIES[name] = run
    SQL[name] = "SELECT event_id, " + ", ".join(f"{e} AS {c}" for c, e in sql.items()) + " FROM events"


# -- normal forms

_register(
    "normalize_datetime",
    {"time": ("t", "datetime", True)},
    {"t": _form("date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS')", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "date_format(ts, 'yyyy/MM/dd HH:mm:ss')", "date_format(ts, 'dd MMM yyyy')", "date_format(ts, 'yyyyMMddHHmmss')", "'low tide'", "date_format(ts, 'EEE, dd MMM yyyy HH:mm:ss')", "date_format(ts, 'MMMM d, yyyy h:mm a')", "date_format(ts, 'dd.MM.yyyy')")},
    {
        "time": "CASE event_id % 9 WHEN 0 THEN " + TIME.format("ts") + " WHEN 3 THEN " + TIME.format("date_trunc('day', ts)") + " WHEN 8 THEN " + TIME.format("date_trunc('day', ts)")
        + " WHEN 5 THEN NULL WHEN 7 THEN " + TIME.format("date_trunc('minute', ts)") + " ELSE " + TIME.format("date_trunc('second', ts)") + " END"
    },
)
_register(
    "normalize_number",
    {"whole": ("w", "number:int:signed", True), "money": ("m", "number:currency", True), "fixed": ("m", "number:decimal:9:1:signed", True), "number": ("f", "number:double:signed", True), "seq": ("w", "sequence", True)},
    {"w": _form("concat('+', user_id)", "concat('-00', user_id)", "concat(' ', user_id, ' ')", "concat(user_id, '.')"), "m": "concat('0', user_id, '.25')", "f": "concat(user_id * 4, '.5')"},
    {
        "whole": "CASE event_id % 4 WHEN 1 THEN CASE WHEN user_id = 0 THEN '0' ELSE '-' || user_id END WHEN 3 THEN NULL ELSE user_id::VARCHAR END",
        "money": "user_id || '.2500'", "fixed": "user_id || '.3'", "number": "upper(format('{:e}', user_id * 4 + 0.5))",
        "seq": "CASE event_id % 4 WHEN 1 THEN CASE WHEN user_id = 0 THEN '0' ELSE '-' || user_id END WHEN 3 THEN NULL ELSE user_id::VARCHAR END",
    },
)
_register(
    "normalize_hex",
    {"hex": ("h", "hex:4", True), "uuid": ("u", "uuid", True)},
    {"h": "lpad(hex(event_id * 7919), 8, '0')", "u": "upper(concat(lpad(hex(event_id), 8, '0'), '-00aB-00Cd-00ef-', lpad(hex(user_id), 12, '0')))"},
    {"hex": "format('{:08x}', event_id * 7919)", "uuid": "format('{:08x}-00ab-00cd-00ef-{:012x}', event_id, user_id)"},
)
_register(
    "normalize_uri",
    {"uri": ("u", "uri:/", True), "file": ("u", "file", True)},
    {"u": _form("concat('/berth/%2F', event_id)", "''", "concat('http://quay.test/', event_id)")},
    {c: "CASE event_id % 3 WHEN 0 THEN '/berth/%2F' || event_id WHEN 2 THEN 'http://quay.test/' || event_id END" for c in ("uri", "file")},
)
_register(
    "normalize_ip",
    {"four": ("f", "ip:v4", True), "six": ("s", "ip:v6", True), "wrong": ("s", "ip:v4", True)},
    {"f": "concat(' 10.', event_id % 256, '.', user_id % 256, '.7')", "s": _form("concat('FE80::', lower(hex(event_id % 65536)), ':', hex(user_id))", "concat('2001:db8::10.', event_id % 256, '.0.', user_id % 256)", "concat(hex(user_id), ':1:2:3:4:5:6')", "concat('::', lpad(hex(event_id % 65536), 4, '0'))")},
    {
        "four": "'10.' || event_id % 256 || '.' || user_id % 256 || '.7'",
        "six": "CASE event_id % 4 WHEN 0 THEN format('fe80:0000:0000:0000:0000:0000:{:04x}:{:04x}', event_id % 65536, user_id) "
        "WHEN 1 THEN format('2001:0db8:0000:0000:0000:0000:0a{:02x}:00{:02x}', event_id % 256, user_id % 256) WHEN 3 THEN format('0000:0000:0000:0000:0000:0000:0000:{:04x}', event_id % 65536) END",
        "wrong": "NULL::VARCHAR",
    },
)
_register(
    "normalize_geo",
    {"point": ("p", "geo:point", True)},
    {"p": _form("concat(event_id % 91, ',', user_id % 181, '.5')", "concat('-0', event_id % 91, '.25,+', user_id % 181)", "concat(event_id, '')", "concat(event_id, ',north')")},
    {"point": "CASE event_id % 4 WHEN 0 THEN (event_id % 91) || '.000000,' || (user_id % 181) || '.500000' WHEN 1 THEN '-' || (event_id % 91) || '.250000,' || (user_id % 181) || '.000000' END"},
)
_register(
    "normalize_string",
    {"small": ("s", "string:0:lc", True), "large": ("s", "string:0:uc", True), "short": ("s", "string:7:mc", True)},
    {"s": "concat('Berth ', event_id % 1000)"},
    {"small": "'berth ' || event_id % 1000", "large": "'BERTH ' || event_id % 1000", "short": "CASE WHEN event_id % 1000 < 10 THEN 'Berth ' || event_id % 1000 END"},
)
_register(
    "normalize_base64",
    {"bytes": ("b", "base64:0", True)},
    {"b": _form("replace(base64(encode(concat('berth ', event_id), 'UTF-8')), '=', '')", "base64(encode(concat('berth ', event_id), 'UTF-8'))", "'?'")},
    {"bytes": "CASE WHEN event_id % 3 < 2 THEN base64(encode('berth ' || event_id)) END"},
)
_register(
    "normalize_boolean",
    {"flag": ("b", "boolean", True)},
    {"b": _form("'true'", "'True'", "'yes'", "''", "'0'", "'false'")},
    {"flag": "CASE WHEN event_id % 6 < 2 THEN 'true' WHEN event_id % 6 <> 3 THEN 'false' END"},
)

# -- validity

_register(
    "valid_datetime",
    {"time": ("t", "datetime", False)},
    {"t": _form("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "concat('1582', date_format(ts, \"-MM-dd'T'HH:mm:ss.SSSSSS'Z'\"))", "concat('1583', date_format(ts, \"-MM-dd'T'HH:mm:ss.SSSSSS'Z'\"))", "concat(date_format(ts, 'yyyy-MM-dd'), 'T24:00:00.000000Z')", "NULL")},
    {"time": "event_id % 6 IN (0, 3)"},
)
_register(
    "valid_sequence",
    {"seq": ("s", "sequence", False)},
    {"s": _form("concat(event_id, '')", "concat('18446744073709551', lpad(event_id % 1000, 3, '0'))", "concat('0', event_id)", "concat('-', event_id + 1)", "''")},
    {"seq": "event_id % 5 = 0 OR (event_id % 5 = 1 AND event_id % 1000 <= 615)"},
)
_register(
    "valid_integers",
    {f"{kind}{'_signed' if s else ''}": ("n", f"number:{kind}{s}", False) for kind in ("tinyint", "smallint", "mediumint", "int", "bigint") for s in ("", ":signed")},
    {"n": _form("concat(user_id, '')", "concat('-', user_id)", "concat(user_id * 1000, '')", "concat(user_id * 1000000, '')", "concat('-', user_id + 1, '000000000000')", "concat('0', user_id)")},
    {
        name + suffix: f"CASE WHEN event_id % 6 = 5 OR (user_id = 0 AND event_id % 6 = 1) THEN false ELSE x BETWEEN {low} AND {high} END".replace(
            "x", "(CASE event_id % 6 WHEN 0 THEN user_id WHEN 1 THEN -user_id WHEN 2 THEN user_id * 1000 WHEN 3 THEN user_id * 1000000 ELSE -(user_id + 1) * 1000000000000 END)"
        )
        for name, bits in (("tinyint", 8), ("smallint", 16), ("mediumint", 24), ("int", 32), ("bigint", 64))
        for suffix, low, high in (("", 0, f"{2**bits - 1}"), ("_signed", f"{-(2 ** (bits - 1)) if bits != 24 else -(2**23 - 1)}", f"{2 ** (bits - 1) - 1}"))
    },
)
_register(
    "valid_decimals",
    {"fixed": ("n", "number:decimal:6:2", False), "signed": ("n", "number:decimal:6:2:signed", False), "money": ("m", "number:currency", False), "float": ("f", "number:float", False), "double": ("f", "number:double:signed", False)},
    {"n": _form("concat(user_id, '.25')", "concat('-', user_id + 1, '.50')", "concat(user_id, '.5')", "concat(user_id + 10000, '.00')"), "m": _form("concat(user_id, '.2500')", "concat(user_id, '.25')"), "f": _form("format_string('%E', user_id + 0.5D)", "format_string('%E', -user_id - 0.5D)", "concat(user_id, '.5')")},
    {"fixed": "event_id % 4 = 0", "signed": "event_id % 4 < 2", "money": "event_id % 2 = 0", "float": "event_id % 3 = 0", "double": "event_id % 3 < 2"},
)
_register(
    "valid_hex",
    {"plain": ("h", "hex:4", False), "grouped": ("g", "hex:4:2::", False), "uuid": ("u", "uuid", False)},
    {"h": _form("lower(lpad(hex(event_id), 8, '0'))", "concat('AB', lpad(event_id, 6, '0'))", "lpad(event_id, 7, '0')"), "g": _form("concat(lower(lpad(hex(user_id), 4, '0')), ':00ff')", "concat(lower(lpad(hex(user_id), 4, '0')), '00ff')"), "u": _form("concat(lower(lpad(hex(event_id), 8, '0')), '-1234-5678-9abc-def012345678')", "lower(lpad(hex(event_id), 32, '0'))")},
    {"plain": "event_id % 3 = 0", "grouped": "event_id % 2 = 0", "uuid": "event_id % 2 = 0"},
)
_register(
    "valid_geo",
    {"point": ("p", "geo:point", False)},
    {"p": _form("concat(event_id % 90, '.500000,', user_id % 180, '.500000')", "concat('90.000000,-180.00000', event_id % 2)", "concat(event_id % 90, '.5,', user_id % 180, '.5')", "concat('-', event_id % 90, '.000000,181.000000')")},
    {"point": "event_id % 4 = 0 OR (event_id % 4 = 1 AND event_id % 2 = 0)"},
)
_register(
    "valid_string",
    {"small": ("s", "string:8:lc", False), "large": ("s", "string:0:uc", False), "latin": ("t", "string:0:mc", False), "every": ("t", "string:0:mc:u", False)},
    {"s": _form("concat('pier ', event_id % 100)", "concat('Pier ', event_id % 100)", "concat('PIER ', event_id % 10000)", "''"), "t": _form("concat('Møle ', event_id)", "concat('Мол ', event_id)", "''")},
    {"small": "event_id % 4 = 0", "large": "event_id % 4 = 2", "latin": "event_id % 3 = 0", "every": "event_id % 3 < 2"},
)
_register(
    "valid_others",
    {"uri": ("e", "uri:/", False), "file": ("e", "file", False), "bytes": ("b", "base64:8", False), "four": ("i", "ip:v4", False), "six": ("j", "ip:v6", False), "flag": ("f", "boolean", False), "choice": ("c", "enum:in:out", False)},
    {
        "e": _form("concat('/', event_id)", "''"), "b": _form("base64(encode(concat(event_id, ''), 'UTF-8'))", "base64(encode(concat('long text ', event_id), 'UTF-8'))", "'?'"),
        "i": _form("concat('10.0.', user_id % 256, '.', event_id % 256)", "concat('10.0.0.', 256 + event_id % 100)", "concat('010.0.0.', event_id % 256)"), "j": _form("concat('fe80:0000:0000:0000:0000:0000:0000:', lower(lpad(hex(event_id % 65536), 4, '0')))", "concat('fe80::', event_id % 10)"),
        "f": _form("'true'", "'false'", "'True'"), "c": _form("'in'", "'out'", "'in:out'", "'ashore'"),
    },
    {
        "uri": "event_id % 2 = 0", "file": "event_id % 2 = 0", "bytes": "event_id % 3 = 0 AND length(event_id::VARCHAR) <= 8", "four": "event_id % 3 = 0", "six": "event_id % 2 = 0", "flag": "event_id % 3 < 2",
        "choice": "event_id % 4 < 2",
    },
)


@query("SELECT p_partkey, regexp_full_match(p_name, '[a-z]+[ ][0-9]{1,2}|part-[0-9]*[13579]|[A-Za-z ]+#?[0-9]*') AS ok FROM part")
def valid_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """A hard pattern has to match the whole value."""
    kind = ObjectType("name", data_type="string:0:mc:u", regex_hard="[a-z]+[ ][0-9]{1,2}|part-[0-9]*[13579]|[A-Za-z ]+#?[0-9]*")
    return table(spark, folder, "part").select("p_partkey", validation.valid_value(kind, F.col("p_name")).alias("ok"))


@query(
    r"""SELECT doc_id, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', chr(65533), 'g') AS shown, regexp_replace(title, '\p{C}', '', 'g') AS plain FROM
    (SELECT doc_id, coalesce(title, 'none') || chr(7) || 'x' AS text, coalesce(title, 'none') || chr(27) || chr(8203) || 'y' AS title FROM documents)"""
)
def unprintable_texts(spark: SparkSession, folder: str) -> DataFrame:
    title = F.coalesce("title", F.lit("none"))
    return table(spark, folder, "documents").select(
        "doc_id", scalars.replace_invalid(F.concat(title, F.lit("\x07x"))).alias("shown"), scalars.strip_controls(F.concat(title, F.lit("\x1b​y"))).alias("plain")
    )


# -- templates


def _story(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """A template over ``events``: a call with its times, a state, and a note that every third one lacks."""
    kinds = {"who": "string:0:mc", "name": "string:0:mc", "note": "string:0:mc", "from": "datetime", "to": "datetime", "ok": "boolean", "link": "uri:/"}
    own = EventType("call", story=text, summary=text).with_attachment(Attachment("log", description="log"))
    for name in kinds:
        own = own.with_property(EventProperty(name, name, name))
    ontology = Ontology().create(*[ObjectType(n, n, n, n, k) for n, k in kinds.items()], EventSource("/calls/"), own)
    minutes, seconds = F.col("event_id") % 50 + 1, F.col("event_id") % 59
    end = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (minutes * 60 + seconds) * 1_000_000)
    note = F.when(F.col("event_id") % 3 != 0, F.col("props"))
    rows = table(spark, folder, "events")
    parts = {"who": F.concat(F.lit("user "), F.col("user_id").cast("string")), "name": "event_type", "note": note, "from": "ts", "to": end, "ok": F.col("event_id") % 2 == 0, "link": F.concat(F.lit("/e/"), F.col("event_id").cast("string"))}
    frame = EventFrame.from_columns(rows, ontology, "call", "/calls/", F.col("event_id"), parts)
    filed = frame.transform(lambda df: df.withColumn("attachments", edits.set_attachment(F.col("attachments"), "log", F.concat(F.lit("log of "), F.col("event_id").cast("string")))))
    return render.texts(filed).select("event_id", "text")


_END = "ts + to_seconds((event_id % 50 + 1) * 60 + event_id % 59)"
_SHOWN = "(CASE WHEN epoch_us({0}) % 1000000 = 0 THEN strftime({0}, '%Y-%m-%d %H:%M:%S') ELSE strftime({0}, '%Y-%m-%d %H:%M:%S.%f') END) || '+00:00'"
_NOTE = "(CASE WHEN event_id % 3 <> 0 THEN props END)"
# Each formatter with a template over ``_story`` and the text that it must give.
FORMATTERS = {
    "time_span": ("it went [[time_span:from,to]]", f"'It went between ' || {_SHOWN.format('ts')} || ' and ' || {_SHOWN.format('(' + _END + ')')}"),
    "duration": ("took [[duration:from,to]]", "'Took ' || (event_id % 50 + 1) || ' minutes and ' || (event_id % 59) || ' seconds'"),
    "date_time": ("by [[date_time:from,hour]]", "'By ' || strftime(ts, '%A, %B %d %Y at %Hh')"),
    "merge": ("[[merge:who,name]]", "'User ' || user_id || ' and ' || event_type"),
    "url": ("see [[url:link,the entry]]", "'See the entry (/e/' || event_id || ')'"),
    "attachment": ("log: [[attachment:log]]", r"'Log: ' || chr(10) || chr(10) || 'log of ' || event_id || chr(10) || chr(10)"),
    "empty": ("note [[empty:note,missing]]", f"CASE WHEN {_NOTE} IS NULL THEN 'Note missing' ELSE '' END"),
    "unless_empty": ("{[[unless_empty:note,name,has]] more}{ and [[note]]}", f"'Has more' || coalesce(' and ' || {_NOTE}, '')"),
    "boolean_string_choice": ("it is [[boolean_string_choice:ok,fine,lost]]", "'It is ' || CASE WHEN event_id % 2 = 0 THEN 'fine' ELSE 'lost' END"),
    "boolean_on_off": ("switched [[boolean_on_off:ok]]", "'Switched ' || CASE WHEN event_id % 2 = 0 THEN 'on' ELSE 'off' END"),
    "boolean_is_is_not": ("it [[boolean_is_is_not:ok]] so", "'It ' || CASE WHEN event_id % 2 = 0 THEN 'is' ELSE 'is not' END || ' so'"),
    "scopes": ("a call{ of [[who]]{, noted [[note]]}}", f"'A call of user ' || user_id || coalesce(', noted ' || {_NOTE}, '')"),
}


def _register_formatter(name: str, text: str, sql: str) -> None:
    QUERIES[f"template_{name}"] = lambda spark, folder: _story(spark, folder, text)
    SQL[f"template_{name}"] = f"SELECT event_id, {sql} AS text FROM events"


for _name, (_text, _sql) in FORMATTERS.items():
    _register_formatter(_name, _text, _sql)


# -- edits


@query(
    """SELECT event_id, props || '|' || event_type AS both, event_type AS name, CASE WHEN event_id % 2 = 0 THEN 'even' END AS parity, props AS any_payload, 'none' AS any_missing, 0::BIGINT AS n_amount FROM
    (SELECT event_id, event_type, CASE WHEN props < event_type THEN props ELSE props END AS props FROM events)"""
)
def edit_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Copied, set, removed and chosen properties."""
    p = F.col("properties")
    df = user_events(spark, folder).df
    df = df.withColumn("properties", edits.copy_properties(p, {"payload": ["both"], "name": ["both"]}))
    df = df.withColumn("properties", edits.set_property(p, "parity", F.when(F.col("event_id") % 2 == 0, F.array(F.lit("even")))))
    df = df.withColumn("properties", edits.delete_property(p, "amount"))
    both = edits.values_of(p, "both")
    return df.select(
        "event_id", F.array_join(F.reverse(F.array_sort(both)), "|").alias("both"), F.get(p["name"], F.lit(0)).alias("name"), F.get(edits.values_of(p, "parity"), F.lit(0)).alias("parity"),
        edits.any_value(p, "payload").alias("any_payload"), edits.any_value(p, "missing", "none").alias("any_missing"), F.size(edits.values_of(p, "amount")).cast("bigint").alias("n_amount"),
    )


@query(
    """SELECT event_id, sha1('text of ' || event_id) AS attachment_id, 'text of ' || event_id AS attachment, array_to_string(list_sort(list_distinct([sha1(event_type), sha1(user_id::VARCHAR)])), ',') AS parents,
    'tide' AS origin, 'moved' AS event_type, '/moved/' AS source_uri FROM events"""
)
def edit_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Attachments, parents, foreign attributes, type and source set."""
    df = user_events(spark, folder).df
    name, user = F.col("properties")["name"][0], F.col("properties")["user-id"][0]
    df = df.withColumn("attachments", edits.set_attachment(F.col("attachments"), "doc", F.concat(F.lit("text of "), F.col("event_id").cast("string"))))
    df = df.withColumn("parents", edits.add_parents(edits.add_parents(F.col("parents"), F.array(F.sha1(name.cast("binary")))), F.array(F.sha1(user.cast("binary")), F.sha1(name.cast("binary")))))
    df = df.withColumn("foreign_attribs", edits.set_foreign({"origin": "tide"})).withColumn("event_type", F.lit("moved")).withColumn("source_uri", F.lit("/moved/"))
    doc = F.map_entries(F.col("attachments")["doc"])[0]
    return df.select("event_id", doc["key"].alias("attachment_id"), doc["value"].alias("attachment"), F.array_join("parents", ",").alias("parents"), F.col("foreign_attribs")["origin"].alias("origin"), "event_type", "source_uri")


# -- strategies


def _merged(spark: SparkSession, folder: str, **strategies: str) -> DataFrame:
    frame = user_events(spark, folder)
    own = frame.ontology.event_types["user.event"]
    for name, strategy in strategies.items():
        own = own.with_property(own[name].with_(merge=strategy, multivalued=True))
    return merge.merge_type(EventFrame(frame.df, frame.ontology.put(own)), "user.event")


@query("SELECT user_id, event_type AS name, arg_min(props, event_id) AS payload, count(*) AS n_events FROM events WHERE event_id % 4 <> 0 GROUP BY 1, 2")
def merge_set(spark: SparkSession, folder: str) -> DataFrame:
    """The strategy set: the values of the first version that has any."""
    frame = user_events(spark, folder)
    own = frame.ontology.event_types["user.event"]
    ontology = frame.ontology.put(own.with_property(own["payload"].with_(merge="set", multivalued=True)))
    p = F.col("properties")
    some = frame.df.where(F.col("event_id") % 4 != 0)
    # the first version lacks the property
    blank = frame.df.where(F.col("event_id") % 4 == 0).withColumn("properties", edits.delete_property(p, "payload"))
    merged = merge.merge_type(EventFrame(blank.unionByName(some), ontology), "user.event")
    n_some = some.select(p["user-id"][0].alias("u"), p["name"][0].alias("n")).groupBy("u", "n").agg(F.count(F.lit(1)).alias("n_some"))
    out = merged.where(p["payload"].isNotNull()).select(p["user-id"][0].alias("u"), p["name"][0].alias("n"), p["payload"][0].alias("payload"))
    return out.join(n_some, ["u", "n"]).select(F.col("u").cast("bigint").alias("user_id"), F.col("n").alias("name"), "payload", F.col("n_some").alias("n_events"))


@query("SELECT user_id, event_type AS name, string_agg(DISTINCT props, '|' ORDER BY props) AS payloads, min(round(value, 2))::DECIMAL(12,2)::VARCHAR AS least FROM events GROUP BY 1, 2")
def merge_add_min(spark: SparkSession, folder: str) -> DataFrame:
    merged = _merged(spark, folder, payload="add", amount="min")
    p = F.col("properties")
    return merged.select(p["user-id"][0].cast("bigint").alias("user_id"), p["name"][0].alias("name"), F.array_join(p["payload"], "|").alias("payloads"), p["amount"][0].alias("least"))


@query("SELECT user_id, event_type AS name, arg_max(props, event_id) AS payload, min(round(value, 2)::DECIMAL(12,2)::VARCHAR) AS amount FROM events GROUP BY 1, 2")
def merge_replace_any(spark: SparkSession, folder: str) -> DataFrame:
    merged = _merged(spark, folder, amount="any")
    p = F.col("properties")
    return merged.select(p["user-id"][0].cast("bigint").alias("user_id"), p["name"][0].alias("name"), p["payload"][0].alias("payload"), p["amount"][0].alias("amount"))


