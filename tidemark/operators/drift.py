"""Files whose fields drift, read into one consistent table, with a report of every change."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from decimal import Decimal
from difflib import SequenceMatcher
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: File numbers that one window looks back over; feeds of any length are cut into such stretches.
STRETCH = 10_000


#: Files whose values are compared that may be named to every executor; more of them meet their files by a shuffled join.
BROADCAST_FILES = 100_000
#: The most digits of a number column; fields with longer numbers come as text.
MOST_DIGITS = 38

HEADER = "array<struct<name:string,type:string,types:array<string>,whole:int,part:int>>"
HELD = "array<struct<name:string,keys:array<bigint>,values:array<bigint>>>"


def json_type(value: Any) -> str | None:
    """The type of a value as it is written; nulls have none."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "truth value"
    return {int: "integer", Decimal: "decimal", float: "decimal", str: "text", list: "list", dict: "object"}[type(value)]


def promote(a: str | None, b: str | None) -> str | None:
    """The least type that values of both fit in: integers are decimals, and everything is text."""
    if a is None or b is None or a == b:
        return b if a is None else a
    return "decimal" if {a, b} == {"integer", "decimal"} else "text"


def as_text(value: Any, exact: bool = False) -> str | None:
    """A value read as text: texts as they are, all else as written in JSON; numbers with a point as the shortest text that
    stands for them or, if ``exact``, with all their digits."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, Decimal) and exact:
        return format(value, "f")
    return json.dumps(float(value) if isinstance(value, Decimal) else value, ensure_ascii=False, sort_keys=True, default=float)


def read_records(content: str | None) -> list[dict]:
    """The records of a file, an array or one object per line. What can't be read is left out."""
    if not content or not content.strip():
        return []
    try:
        whole = json.loads(content, parse_float=Decimal)
        found = whole if isinstance(whole, list) else [whole]
    except (ValueError, RecursionError):
        found = []
        for line in content.splitlines():
            try:
                found.append(json.loads(line, parse_float=Decimal))
            except (ValueError, RecursionError):
                continue
    return [x for x in found if isinstance(x, dict)]


def _digits(value: Any) -> tuple[int, int]:
    """How many digits a number has before and after the point."""
    if isinstance(value, bool) or not isinstance(value, (int, Decimal)):
        return 0, 0
    number = Decimal(value)
    if not number.is_finite():
        return MOST_DIGITS + 1, 0
    return max(1, number.adjusted() + 1), max(0, -number.as_tuple().exponent)


def header(records: list[dict]) -> list[tuple[str, str | None, list[str], int, int]]:
    """Each field that any record has, with its promoted type, its types, and its numbers' most digits before and after
    the point."""
    types: dict[str, set[str]] = {}
    digits: dict[str, tuple[int, int]] = {}
    for record in records:
        for name, value in record.items():
            mine = types.setdefault(name, set())
            if (kind := json_type(value)) is not None:
                mine.add(kind)
            old, new = digits.get(name, (0, 0)), _digits(value)
            digits[name] = (max(old[0], new[0]), max(old[1], new[1]))
    return [(name, reduce(promote, sorted(kinds), None), sorted(kinds), *digits[name]) for name, kinds in types.items()]


def held_values(records: list[dict], key: str, names: Iterable[str]) -> list[dict]:
    """What some fields hold for which record, as hashes, and under the empty name all records that have a key.

    Of several records with one key the first counts; records without a key have no values to compare.
    """
    out: dict[str, tuple[list[int], list[int]]] = {n: ([], []) for n in ["", *names]}
    seen: set[int] = set()
    for record in records:
        own = as_text(record.get(key))
        if own is None or (hashed := _hash(own)) in seen:
            continue
        seen.add(hashed)
        for name, (keys, values) in out.items():
            if name == "" or record.get(name) is not None:
                keys.append(hashed)
                values.append(0 if name == "" else _hash(as_text(record[name])))
    return [{"name": n, "keys": k, "values": v} for n, (k, v) in out.items()]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), signed=True)


def _likeness(a: str, b: str) -> float:
    a, b = plain_name(a), plain_name(b)
    return 2.0 if a == b else SequenceMatcher(None, a, b).ratio()


def plain_name(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def renames(gone: list[str], came: list[str], old: list[dict], new: list[dict]) -> dict[str, str]:
    """The gone fields that came back under a new name: one that holds equal texts for the same records, those that both
    files have. Of several such pairs the ones of the most similar names count, each field in one pair."""
    before, after = ({f["name"]: dict(zip(f["keys"], f["values"])) for f in side} for side in (old, new))
    both = before.get("", {}).keys() & after.get("", {}).keys()

    def kept(field: dict[int, int] | None) -> dict[int, int]:
        return {k: v for k, v in (field or {}).items() if k in both}

    a_kept, b_kept = {a: kept(before.get(a)) for a in gone}, {b: kept(after.get(b)) for b in came}
    out: dict[str, str] = {}
    for _, a, b in sorted((-_likeness(a, b), a, b) for a in gone for b in came if a_kept[a] and a_kept[a] == b_kept[b]):
        if a not in out and b not in out.values():
            out[a] = b
    return out


def changes(before: list[dict], after: list[dict], renamed: Mapping[str, str]) -> list[tuple[str, str, str]]:
    """The differences between the headers of two files: kind, name of the field, and what it was before."""
    old, new = ({f["name"]: f["type"] for f in side} for side in (before, after))
    names = {n: n for n in old if n in new} | dict(renamed)
    out = [("renamed", b, a) for a, b in renamed.items()]
    out += [("removed", "", a) for a in old if a not in names]
    out += [("added", b, "") for b in new if b not in names.values()]
    out += [("retyped", b, a) for a, b in names.items() if None not in (old[a], new[b]) and old[a] != new[b]]
    return out


def latest_copies(files: DataFrame, feed: list[str], number: str, file_id: str) -> DataFrame:
    """Of each file of a feed that was delivered several times, the copy with the smallest id."""
    ids = files.groupBy(*feed, number).agg(F.min(file_id).alias(file_id))
    return ids.where(F.col(file_id).isNotNull() & F.col(number).isNotNull())


def predecessors(ids: DataFrame, feed: list[str], number: str, file_id: str, stretch: int = STRETCH) -> DataFrame:
    """``file_id`` and ``_before``, the id of the file before it in its feed; without the first file of each feed.

    A feed is cut into stretches of file numbers. A window looks back in each stretch; the first file of one gets
    the last file of the stretch before it, by a window over one row for each stretch.
    """
    cut = ids.withColumn("_stretch", F.floor(F.col(number) / stretch))
    same = ", ".join(f"`{c}`" for c in feed)
    inside = cut.withColumn(
        "_before", F.expr(f"lag(`{file_id}`) OVER (PARTITION BY {same}, _stretch ORDER BY `{number}`)")
    )
    ends = cut.groupBy(*feed, "_stretch").agg(F.max_by(file_id, number).alias("_last"))
    ends = ends.withColumn("_earlier", F.expr(f"lag(_last) OVER (PARTITION BY {same} ORDER BY _stretch)"))
    joined = inside.join(ends.select(*feed, "_stretch", "_earlier"), [*feed, "_stretch"])
    return joined.select(*feed, file_id, F.coalesce("_before", "_earlier").alias("_before")).where("_before IS NOT NULL")


def headers(files: DataFrame, file_id: str, content: str) -> DataFrame:
    """``file_id`` and ``_fields`` of each file, read in parallel where the files are; one row a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["_fields"] = [[dict(zip(("name", "type", "types", "whole", "part"), f)) for f in header(read_records(c))] for c in batch["_content"]]
            yield batch[["_id", "_fields"]]

    kind = files.schema[file_id].dataType.simpleString()
    own = files.where(F.col(file_id).isNotNull()).select(F.col(file_id).alias("_id"), F.col(content).alias("_content"))
    read = own.mapInPandas(run, f"_id {kind}, _fields {HEADER}")
    return read.groupBy(F.col("_id").alias(file_id)).agg(F.first("_fields").alias("_fields"))


def _held(files: DataFrame, file_id: str, content: str, key: Column, wanted: DataFrame) -> DataFrame:
    """``_to``, ``_now`` and ``_held`` of the files that ``wanted`` names (``file_id``, ``_to``, ``_now``, ``_names``)."""
    own = files.select(F.col(file_id).alias("_id"), key.alias("_key"), F.col(content).alias("_content"))
    met = own.join(wanted.withColumnRenamed(file_id, "_id"), "_id").select("_to", "_now", "_key", "_names", "_content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["_held"] = [held_values(read_records(c), k, n) for c, k, n in zip(batch["_content"], batch["_key"], batch["_names"])]
            yield batch[["_to", "_now", "_held"]]

    return met.mapInPandas(run, f"_to {files.schema[file_id].dataType.simpleString()}, _now boolean, _held {HELD}")


def compared(
    files: DataFrame, feed: list[str], number: str, file_id: str, content: str, stretch: int = STRETCH
) -> DataFrame:
    """``_to``, ``_before``, ``_old`` and ``_new``: each file, the one before it in its feed, and the headers of both, written
    once."""
    ids = latest_copies(files.dropna(subset=[*feed, number, file_id]), feed, number, file_id)
    pairs = predecessors(ids, feed, number, file_id, stretch).select(F.col(file_id).alias("_to"), "_before")
    read = headers(files.dropna(subset=[*feed, number]), file_id, content)
    # each header is sent to two places: its own comparison and that of the file after it
    roles = pairs.select("_to", F.col("_to").alias(file_id), F.lit(True).alias("_now")).unionByName(
        pairs.select("_to", F.col("_before").alias(file_id), F.lit(False).alias("_now"))
    )
    met = read.join(roles, file_id).groupBy("_to").agg(
        F.first(F.when(~F.col("_now"), F.col(file_id)), ignorenulls=True).alias("_before"),
        F.first(F.when(~F.col("_now"), F.col("_fields")), ignorenulls=True).alias("_old"),
        F.first(F.when(F.col("_now"), F.col("_fields")), ignorenulls=True).alias("_new"),
    )
    return cut_lineage(met)


def drift_report(
    files: DataFrame, feed: list[str], number: str, file_id: str, content: str, key: Column, stretch: int = STRETCH
) -> DataFrame:
    """``file_id``, ``change_kind``, ``field_name``, ``was`` of each difference between a file and the one before it.

    Names and types of all files are read first, and no value is sent anywhere. Only where a field is gone and another
    came are the two files read again, for what these fields hold.

    Files with a null number or id are in no feed; a null feed column is a value like any other only if it is not
    null, so such files are left out too. A file without records has no fields. Repeated deliveries count once.
    """
    met = compared(files, feed, number, file_id, content, stretch)
    old_names, new_names = F.transform("_old", lambda f: f["name"]), F.transform("_new", lambda f: f["name"])
    named = met.withColumn("_gone", F.array_except(old_names, new_names)).withColumn("_came", F.array_except(new_names, old_names))
    unclear = named.where((F.size("_gone") > 0) & (F.size("_came") > 0))
    wanted = unclear.select(F.col("_to").alias(file_id), "_to", F.lit(True).alias("_now"), F.col("_came").alias("_names")).unionByName(
        unclear.select(F.col("_before").alias(file_id), "_to", F.lit(False).alias("_now"), F.col("_gone").alias("_names"))
    )
    if 2 * unclear.count() <= BROADCAST_FILES:
        wanted = F.broadcast(wanted)
    held = _held(files, file_id, content, key, wanted).groupBy("_to").agg(
        F.first(F.when(~F.col("_now"), F.col("_held")), ignorenulls=True).alias("_held_old"),
        F.first(F.when(F.col("_now"), F.col("_held")), ignorenulls=True).alias("_held_new"),
    )
    kind = files.schema[file_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for to, old, new, gone, came, held_old, held_new in zip(*(batch[c] for c in ("_to", "_old", "_new", "_gone", "_came", "_held_old", "_held_new"))):
                found = {} if held_old is None or held_new is None else renames(list(gone), list(came), list(held_old), list(held_new))
                rows += [(to, *change) for change in changes(list(old), list(new), found)]
            yield pd.DataFrame(rows, columns=["_id", "change_kind", "field_name", "was"])

    return (
        named.join(held, "_to", "left")
        .mapInPandas(run, f"_id {kind}, change_kind string, field_name string, was string")
        .withColumnRenamed("_id", file_id)
    )


@dataclass
class Field:
    """What all files together say of a field name."""

    types: list[str]
    whole: int
    part: int
    files: int


def field_types(read: DataFrame) -> tuple[dict[str, Field], set[tuple[str, str]]]:
    """Each field name of all files, and the pairs of names that some file has both of; one pass. On the driver there is
    one row for each such pair: the schema, whose size is that of the records, not of their number."""
    each = read.select(F.explode("_fields").alias("f"), F.transform("_fields", lambda f: f["name"]).alias("others"))
    pairs = each.select("f.*", F.explode("others").alias("other"))
    found = pairs.groupBy("name", "other").agg(
        F.array_distinct(F.flatten(F.collect_set("types"))).alias("types"), F.max("whole").alias("whole"), F.max("part").alias("part"), F.count(F.lit(1)).alias("files")
    ).collect()
    fields = {r["name"]: Field(r["types"], r["whole"], r["part"], r["files"]) for r in found if r["name"] == r["other"]}
    return fields, {(r["name"], r["other"]) for r in found if r["name"] != r["other"]}


def united_names(fields: Mapping[str, Field], together: set[tuple[str, str]], renamed: Mapping[tuple[str, str], int]) -> dict[str, str]:
    """The one name of each field by all of its names: names that differ in case and punctuation alone, and those that
    renames lead to, the frequent ones first. Names that one file has both of are different fields and stay apart, so
    that no record has two values for one. The name is that which most files have, of equal ones the least."""
    group = {n: {n} for n in fields}
    weight: dict[tuple[str, str], int] = {}
    for (a, b), n in renamed.items():
        pair = (min(a, b), max(a, b))
        weight[pair] = weight.get(pair, 0) + n
    links = [pair for pair, _ in sorted(weight.items(), key=lambda x: (-x[1], x[0]))]
    spelt: dict[str, list[str]] = {}
    for n in sorted(fields):
        spelt.setdefault(plain_name(n), []).append(n)
    links += [(own[0], n) for own in spelt.values() for n in own[1:]]
    for a, b in links:
        if a not in group or b not in group or group[a] is group[b]:
            continue
        if not any((x, y) in together for x in group[a] for y in group[b]):
            both = group[a] | group[b]
            for n in both:
                group[n] = both
    return {n: min(own, key=lambda x: (-fields[x].files, x)) for n, own in group.items()}


def union_schema(fields: Mapping[str, Field], names: Mapping[str, str]) -> list[tuple[str, str]]:
    """Names and Spark types of the consistent table: all fields under the names that ``names`` gives them, their types
    folded through the lattice. Numbers get the digits that all their values need, or come as text."""
    groups: dict[str, list[Field]] = {}
    for name, own in fields.items():
        groups.setdefault(names.get(name, name), []).append(own)
    out = []
    for name, own in sorted(groups.items()):
        kind = reduce(promote, sorted({t for f in own for t in f.types}), None) or "text"
        whole, part = max(f.whole for f in own), max(f.part for f in own)
        if kind == "integer":
            spark = "bigint" if whole <= 18 else f"decimal({whole},0)" if whole <= MOST_DIGITS else "string"
        elif kind == "decimal":
            spark = f"decimal({whole + part},{part})" if whole + part <= MOST_DIGITS else "string"
        else:
            spark = "boolean" if kind == "truth value" else "string"
        out.append((name, spark))
    return out


def consistent_table(files: DataFrame, feed: list[str], number: str, file_id: str, content: str, key_name: str) -> DataFrame:
    """All records of all files of one kind in one table: the feed, the file, and each field under one name, cast to
    the type that all files' values fit in. Lists, objects and mixed types come as text.

    The names of a field are those that the drift report finds to be renamed into each other, in whatever feed, and
    spellings that differ in case and punctuation alone. As the types are those of the values themselves, no cast
    fails and no digit is lost.
    """
    named = files.dropna(subset=[*feed, number, file_id])
    ids = latest_copies(named, feed, number, file_id).select(*feed, number, file_id)
    read = cut_lineage(headers(named, file_id, content).join(ids.select(file_id), file_id, "left_semi"))
    fields, together = field_types(read)
    report = drift_report(files, feed, number, file_id, content, F.lit(key_name)).where("change_kind = 'renamed'")
    renamed = {(r["was"], r["field_name"]): r["count"] for r in report.groupBy("was", "field_name").count().collect()}
    names = united_names(fields, together, renamed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (i, n, {names.get(k, k): as_text(v, True) for k, v in record.items()})
                for i, c in zip(batch["_id"], batch["_content"])
                for n, record in enumerate(read_records(c))
            ]
            yield pd.DataFrame(rows, columns=["_id", "record_no", "_record"])

    kind = files.schema[file_id].dataType.simpleString()
    # files of one id are equal
    latest = named.join(ids.select(file_id), file_id, "left_semi").groupBy(file_id).agg(F.first(content).alias("_content"))
    records = latest.select(F.col(file_id).alias("_id"), "_content").mapInPandas(run, f"_id {kind}, record_no bigint, _record map<string,string>")
    values = [F.col("_record")[name].try_cast(kind).alias(f"field_{name}") for name, kind in union_schema(fields, names)]
    return records.withColumnRenamed("_id", file_id).join(ids, file_id).select(*feed, number, file_id, "record_no", *values)
