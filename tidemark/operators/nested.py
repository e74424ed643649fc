"""Deeply nested records as flat node tables, linked by interval containment."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What may wrap an event.
WRAPPERS = ("event", "events", "record", "data", "payload", "body", "message")
EVENT_PARTS = ("event-type", "source-uri", "properties", "attachments", "parents", "children")

NODE_SCHEMA = (
    "node string, kind string, name string, pos int, value string, item_id string, enter int, leave int, depth int"
)
_ARROW = [
    ("node", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("pos", pa.int32()), ("value", pa.string()),
    ("item_id", pa.string()), ("enter", pa.int32()), ("leave", pa.int32()), ("depth", pa.int32()),
]


_BLANKS = re.compile(r"[ \t\n\r]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity")


def read_json(text: str | bytes) -> Any:
    """As ``json.loads``, to any depth."""
    try:
        return json.loads(text)
    except RecursionError:
        return _read_deep(text if isinstance(text, str) else text.decode())


def _read_deep(text: str) -> Any:
    """JSON read with a stack of the open lists and objects, each with the key that its next value gets."""
    at, size, stack = _BLANKS.match(text, 0).end(), len(text), []

    def skip(to: int) -> int:
        return _BLANKS.match(text, to).end()

    def key_at(to: int) -> tuple[str, int]:
        if text[to : to + 1] != '"':
            raise ValueError(f"no key at {to}")
        key, to = scanstring(text, to + 1, True)
        if text[(to := skip(to)) : to + 1] != ":":
            raise ValueError(f"no colon at {to}")
        return key, skip(to + 1)

    while True:
        mark = text[at : at + 1]
        if mark and mark in "[{":
            value: Any = [] if mark == "[" else {}
            at = skip(at + 1)
            if text[at : at + 1] != "]}"["[{".index(mark)]:
                key = None
                if mark == "{":
                    key, at = key_at(at)
                stack.append([value, key])
                continue
            at += 1
        elif mark == '"':
            value, at = scanstring(text, at + 1, True)
        elif found := _SCALAR.match(text, at):
            value, at = json.loads(found[0]), found.end()
        else:
            raise ValueError(f"no value at {at}")
        while True:
            at = skip(at)
            if not stack:
                if at != size:
                    raise ValueError(f"more than one value at {at}")
                return value
            held, key = stack[-1]
            if key is None:
                held.append(value)
            else:
                held[key] = value
            mark = text[at : at + 1]
            if mark == ",":
                at = skip(at + 1)
                if key is not None:
                    stack[-1][1], at = key_at(at)
                break
            if mark != ("]" if key is None else "}"):
                raise ValueError(f"no end at {at}")
            value, at = held, at + 1
            stack.pop()


def write_json(value: Any) -> str:
    """As ``json.dumps`` with sorted keys, to any depth."""
    try:
        return json.dumps(value, ensure_ascii=False, sort_keys=True)
    except RecursionError:
        out: list[str] = []
        todo: list[tuple[bool, Any]] = [(False, value)]
        while todo:
            done, item = todo.pop()
            if done:
                out.append(item)
            elif isinstance(item, (dict, list)):
                parts: list[tuple[bool, Any]] = []
                for x in sorted(item.items()) if isinstance(item, dict) else item:
                    parts += [(True, ", ")] * bool(parts)
                    parts += [(True, write_json(x[0]) + ": "), (False, x[1])] if isinstance(item, dict) else [(False, x)]
                todo += [(True, "}" if isinstance(item, dict) else "]"), *reversed(parts), (True, "{" if isinstance(item, dict) else "[")]
            else:
                out.append(write_json(item))
        return "".join(out)


def _text(value: Any) -> str | None:
    """A scalar as text; null for what is null or empty."""
    if value is None or value == "":
        return None
    if isinstance(value, str):
        return value
    return write_json(value)


def _is_event(value: Any) -> bool:
    return isinstance(value, dict) and any(k in value for k in EVENT_PARTS)


def unwrap(value: Any) -> list[dict]:
    """The events in a parsed body, in their order, whatever they are wrapped in: texts that hold JSON, objects, lists. Most
    bodies have one. An object that is no event is looked into by its fields in ``WRAPPERS``, or else by all of its lists
    and objects. The walk keeps its own stack, so that no wrapping is too deep."""
    found: list[dict] = []
    todo = [value]
    while todo:
        value = todo.pop()
        if isinstance(value, (str, bytes)):
            try:
                todo.append(read_json(value))
            except ValueError:
                continue
        elif isinstance(value, list):
            todo += reversed(value)
        elif isinstance(value, dict):
            if _is_event(value):
                found.append(value)
            else:
                inside = [value[k] for k in WRAPPERS if k in value] or [x for x in value.values() if isinstance(x, (dict, list))]
                todo += reversed(inside)
    return found


def _listed(value: Any) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def _objects(properties: Any) -> Iterator[tuple[str, list]]:
    """Each property with its values, from an object by name or a list of named objects."""
    if isinstance(properties, dict):
        yield from ((name, _listed(value)) for name, value in properties.items())
        return
    for each in _listed(properties):
        if isinstance(each, dict) and each.get("name") is not None:
            held = next((each[k] for k in ("objects", "values", "value") if k in each), None)
            yield str(each["name"]), _listed(held)


def _value(item: Any) -> str | None:
    """The text of a value; of an object its value, text or hash, or if it has none of these the object as JSON."""
    if isinstance(item, dict):
        item = next((item[k] for k in ("value", "text", "hash") if k in item), item or None)
    return _text(item)


def _attachments(attachments: Any) -> Iterator[tuple[str, list[tuple[str | None, Any]]]]:
    """Each attachment with its texts and their ids."""
    if isinstance(attachments, dict):
        for name, held in attachments.items():
            if isinstance(held, dict) and not {"text", "value"} & held.keys():
                yield name, list(held.items())
            else:
                yield name, [(x.get("id") if isinstance(x, dict) else None, x) for x in _listed(held)]
        return
    for each in _listed(attachments):
        if isinstance(each, dict) and each.get("name") is not None:
            held = next((each[k] for k in ("values", "texts", "value", "text") if k in each), None)
            if isinstance(held, dict) and not {"text", "value"} & held.keys():
                yield str(each["name"]), list(held.items())
            else:
                yield str(each["name"]), [(x.get("id") if isinstance(x, dict) else None, x) for x in _listed(held)]


def _parents(parents: Any) -> Iterator[str]:
    for each in _listed(parents):
        if isinstance(each, str):
            yield from (h for h in (part.strip() for part in each.split(",")) if h)
        elif (text := _value(each)) is not None:
            yield text


def event_nodes(events: list[dict]) -> list[list]:
    """The nodes of the events of a body and all events in them, each with its interval: ``enter`` counts the nodes met
    before it in a depth-first walk, ``leave`` the largest ``enter`` inside it. A node lies in another one if its ``enter``
    is in the other's interval. Outermost events are 0, 1 and so on. The walk keeps its own stack, so that no depth is
    too deep.
    """
    rows: list[list] = []
    todo: list[tuple] = [("open", event, str(n), n, 0) for n, event in reversed([*enumerate(events)])]
    while todo:
        step, item, path, place, depth = todo.pop()
        if step == "close":
            rows[item][7] = len(rows) - 1
            continue
        here = len(rows)
        kind = item.get("event-type")
        rows.append([path, "event", _text(kind), place, None, None, here, here, depth])

        def leaf(*of: Any, path: str = path, depth: int = depth) -> None:
            at = len(rows)
            rows.append([path, *of, at, at, depth + 1])

        for name, values in _objects(item.get("properties")):
            kept = (t for t in map(_value, values) if t is not None)
            for n, text in enumerate(kept):
                leaf("object", name, n, text, None)
        for name, texts in _attachments(item.get("attachments")):
            kept_texts = ((i, t) for i, t in ((i, _value(x)) for i, x in texts) if t is not None)
            for n, (own_id, text) in enumerate(kept_texts):
                leaf("attachment", name, n, text, own_id)
        for n, parent in enumerate(_parents(item.get("parents"))):
            leaf("parent", parent, n, None, None)
        todo.append(("close", here, path, place, depth))
        children = [c for c in _listed(item.get("children")) if isinstance(c, dict) and c]
        todo += reversed([("open", c, f"{path}.{n}", n, depth + 1) for n, c in enumerate(children)])
    return rows


def parse_body(body: str | None) -> list[list]:
    """The nodes of a body; none if it can't be read as an event."""
    return [] if body is None else event_nodes(unwrap(body))


def flatten_bodies(df: DataFrame, id_column: str, body_column: str) -> DataFrame:
    """All nodes of all bodies, with ``id_column`` and the columns of ``NODE_SCHEMA``, in one pass without a shuffle.

    ``node`` is the path of the event that a node belongs to. Null, empty and unreadable bodies have no rows;
    null and empty values are no items. Repeated rows give repeated nodes.
    """
    of_id = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index: list[int] = []
            rows: list[list] = []
            for i, body in enumerate(batch.column(1).to_pylist()):
                own = parse_body(body)
                index += [i] * len(own)
                rows += own
            columns = list(zip(*rows)) if rows else [[] for _ in _ARROW]
            arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, _ARROW)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(index, pa.int64())), *arrays], names=[id_column, *[n for n, _ in _ARROW]]
            )

    return df.select(id_column, body_column).mapInArrow(run, f"`{id_column}` {of_id}, {NODE_SCHEMA}")


def nodes_of_kind(nodes: DataFrame, kind: str, id_column: str) -> DataFrame:
    """The flat table of one kind of node; ``event`` rows also name the event they lie in."""
    own = nodes.where(F.col("kind") == kind)
    if kind == "event":
        inside = F.when(F.col("depth") > 0, F.regexp_replace("node", r"\.[0-9]+$", ""))
        return own.select(id_column, "node", inside.alias("parent_node"), F.col("name").alias("event_type"), "pos", "enter", "leave")
    return own.select(id_column, "node", "name", "pos", "value", "item_id", "enter")


def contained(nodes: DataFrame, id_column: str, depth: int) -> DataFrame:
    """Each node of a record with the event at ``depth`` that it lies in: ``outer_node`` and ``inner_enter``, by intervals.

    Events at one depth have intervals apart from each other, so the last one opened before a node is the only one
    that can hold it: one window over the record in the order of its nodes, and one row a node, however deep the
    record is. For all ancestors of a node take each depth in turn.
    """
    opened = F.when((F.col("kind") == "event") & (F.col("depth") == depth), F.struct(F.col("node").alias("outer_node"), F.col("leave").alias("_end")))
    last = F.last(opened, ignorenulls=True).over(Window.partitionBy(id_column).orderBy("enter").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    held = nodes.select(id_column, "enter", "kind", "depth", last.alias("_outer"))
    inside = (F.col("enter") <= F.col("_outer._end")) & ~((F.col("kind") == "event") & (F.col("depth") == depth))
    return held.where(inside).select(id_column, F.col("_outer.outer_node").alias("outer_node"), F.col("enter").alias("inner_enter"))


def flatten_events(df: DataFrame, id_column: str, kind: Column, properties: Column, attachments: Column, parents: Column) -> DataFrame:
    """The same node table for events whose parts are columns already; it is made without Python.

    Items are numbered by name, then by place: objects, attachments, parents. Null and empty values take no place.
    """

    def filled(values: Column) -> Column:
        return F.filter(values, lambda v: v.isNotNull() & (v != ""))

    def items(kind_name: str, name: Column, values: Column, ids: Column | None = None) -> Column:
        return F.transform(
            values,
            lambda v, i: F.struct(
                F.lit(kind_name).alias("kind"),
                name.alias("name"),
                i.alias("pos"),
                (v if ids is None else v["value"]).alias("value"),
                (F.lit(None).cast("string") if ids is None else v["key"]).alias("item_id"),
            ),
        )

    objects = F.flatten(
        F.transform(F.array_sort(F.map_keys(properties)), lambda k: items("object", k, filled(properties[k])))
    )
    texts = F.flatten(
        F.transform(
            F.array_sort(F.map_keys(attachments)),
            lambda k: items(
                "attachment",
                k,
                F.filter(F.array_sort(F.map_entries(attachments[k])), lambda e: e["value"].isNotNull() & (e["value"] != "")),
                F.lit(True),
            ),
        )
    )
    above = F.transform(
        filled(parents),
        lambda h, i: F.struct(
            F.lit("parent").alias("kind"), h.alias("name"), i.alias("pos"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("item_id")
        ),
    )
    empty = F.array().cast("array<struct<kind:string,name:string,pos:int,value:string,item_id:string>>")
    event = F.array(
        F.struct(
            F.lit("event").alias("kind"), kind.alias("name"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("item_id")
        )
    )
    every = F.concat(event, F.coalesce(objects, empty), F.coalesce(texts, empty), F.coalesce(above, empty))
    return df.select(id_column, F.size(every).alias("_all"), F.posexplode(every).alias("enter", "x")).select(
        id_column,
        F.lit("0").alias("node"),
        "x.*",
        "enter",
        F.when(F.col("enter") == 0, F.col("_all") - 1).otherwise(F.col("enter")).alias("leave"),
        F.when(F.col("enter") == 0, 0).otherwise(1).alias("depth"),
    )
