"""Events as delimited rows and as texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.frame import EventFrame, no_texts
from tidemark.functions.template import Template


def escape(value: Column, delimiter: str) -> Column:
    """With delimiters and line ends written by escapes."""
    for raw, shown in ((delimiter, f"\\{delimiter}"), ("\n", "\\n"), ("\r", "\\r")):
        value = F.replace(value, F.lit(raw), F.lit(shown))
    return value


def delimited(
    frame: EventFrame, event_type: str, properties: Sequence[str] | None = None, attachments: Sequence[str] | None = None, delimiter: str = "\t", header: bool = False
) -> DataFrame:
    """``line`` for every combination of the values of an event's columns; empty where a column has none.

    Columns that the type doesn't have are left out. The product is made inside each row, by one generator for each
    column, without a join. A header comes as the first line of the union, for a file written from one partition.
    """
    own = frame.ontology.event_types[event_type]
    names = [n for n in (properties if properties is not None else [p.name for p in own.properties]) if n in own.by_name]
    files = [n for n in (attachments if attachments is not None else [a.name for a in own.attachments]) if own.attachment(n)]
    df = frame.of_type(event_type).df
    lists = [F.coalesce(F.col("properties")[n], no_texts()) for n in names]
    lists += [F.coalesce(F.map_values(F.col("attachments")[n]), no_texts()) for n in files]
    df = df.select("event_id", *[v.alias(f"c{i}") for i, v in enumerate(lists)])
    for i in range(len(lists)):
        df = df.select(*[c for c in df.columns if c != f"c{i}"], F.explode_outer(f"c{i}").alias(f"c{i}"))
    cells = [F.coalesce(escape(F.col(f"c{i}"), delimiter), F.lit("")) for i in range(len(lists))]
    lines = df.select("event_id", F.concat_ws(delimiter, *cells).alias("line"))
    if header:
        first = frame.df.sparkSession.createDataFrame([(None, delimiter.join([*names, *files]))], "event_id bigint, line string")
        return first.unionByName(lines)
    return lines


def all_delimited(frame: EventFrame, delimiter: str = "\t") -> DataFrame:
    """``event_id``, ``event_type`` and ``line``, as ``delimited`` with all properties and attachments of each type; one
    scan, the product of an event's columns being made by one fold over them. Columns come in the order of the schema."""
    lists = F.lit(None).cast("array<array<string>>")
    for name, own in sorted(frame.ontology.event_types.items()):
        values = [F.coalesce(F.col("properties")[p.name], no_texts()) for p in own.properties]
        values += [F.coalesce(F.map_values(F.col("attachments")[a.name]), no_texts()) for a in own.attachments]
        lists = F.when(F.col("event_type") == name, F.array(*values)).otherwise(lists)
    cells = F.transform(lists, lambda v: F.when(F.size(v) == 0, F.array(F.lit(""))).otherwise(F.transform(v, lambda x: escape(F.coalesce(x, F.lit("")), delimiter))))
    start = F.array(F.array().cast("array<string>"))
    lines = F.aggregate(
        cells, start, lambda rows, own: F.flatten(F.transform(rows, lambda row: F.transform(own, lambda x: F.concat(row, F.array(x)))))
    )
    made = frame.df.select("event_id", "event_type", F.explode(lines).alias("_row"))
    return made.select("event_id", "event_type", F.array_join("_row", delimiter).alias("line"))


def texts(frame: EventFrame, short: bool = False, colored: bool = False) -> DataFrame:
    """``event_id`` and ``text``: the story of each event, or its summary."""
    out: Column = F.lit(None).cast("string")
    for name, own in sorted(frame.ontology.event_types.items()):
        compiled = Template(own.summary if short else own.story, frame.kinds(name))
        text = compiled.column(lambda n: F.col("properties")[n], lambda n: F.map_values(F.col("attachments")[n]), colored=colored)
        out = F.when(F.col("event_type") == name, text).otherwise(out)
    return frame.df.select("event_id", "event_type", out.alias("text"))


def relation_texts(frame: EventFrame, event_type: str) -> DataFrame:
    """The description of each relation of each event of a type, where it isn't empty."""
    own, kinds = frame.ontology.event_types[event_type], frame.kinds(event_type)
    rows = [
        F.struct(
            F.lit(r.id).alias("relation"),
            Template(r.description, kinds).column(lambda n: F.col("properties")[n], lambda n: F.map_values(F.col("attachments")[n])).alias("text"),
        )
        for r in own.relations
        if r.description
    ]
    if not rows:
        return frame.df.select("event_id", F.lit("").alias("relation"), F.lit("").alias("text")).limit(0)
    return frame.of_type(event_type).df.select("event_id", F.inline(F.array(*rows))).where("text <> ''")
