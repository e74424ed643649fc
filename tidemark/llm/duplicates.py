"""Records that differ in formatting only, collapsed to one with the number of their copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: A group is hot if it has more records than a task has on average, or than this part of all; there are at most as many
#: hot groups as tasks.
LEAST_PARTS = 200


def plain(text: Column) -> Column:
    """``text`` without case and with only its letters and digits, of any script."""
    # by way of capitals, as ß is SS; the replacement between keeps Catalyst from dropping the inner function
    capitals = F.replace(F.upper(text), F.lit("ẞ"), F.lit("SS"))
    folded = F.translate(F.lower(capitals), "ς", "σ")  # a final sigma is a sigma
    return F.regexp_replace(folded, r"[^\p{L}\p{N}]", "")


def canonical(source: Column, kind: Column, properties: Column) -> Column:
    """One text for all spellings of a record: fields by name, each with its values as a sorted set.

    Empty value lists and null values are absent; a null map has no properties. The parts are joined by control
    characters, which no canonical value holds. Null if ``source`` or ``kind`` is null.
    """
    present = F.filter(
        F.map_entries(properties), lambda e: F.size(F.filter(e["value"], lambda v: v.isNotNull())) > 0
    )
    texts = F.transform(
        present,
        lambda e: F.concat(
            e["key"],
            F.lit("\u0001"),
            F.array_join(F.array_sort(F.array_distinct(F.transform(e["value"], plain))), "\u0002"),
        ),
    )
    fields = F.coalesce(F.array_join(F.array_sort(texts), "\u0003"), F.lit(""))
    return F.concat(plain(kind), F.lit("\u0004"), source, F.lit("\u0004"), fields)


def keyed_records(df: DataFrame, record_id: str, canon: Column) -> DataFrame:
    """``_id``, ``_key`` (128 bits of the canonical text), ``_check`` (64 bits by another function) of each record.

    Equal keys with unequal checks would be a collision; both together identify a group, so that colliding
    texts fall apart into their own groups. Records whose canonical text is null get a key of their own.
    """
    text = F.coalesce(canon, F.concat(F.lit("\u0005"), F.col(record_id).cast("string")))
    return df.select(F.col(record_id).alias("_id"), text.alias("_text")).select(
        "_id", F.unhex(F.md5("_text")).alias("_key"), F.xxhash64("_text").alias("_check")
    )


def copy_counts(keyed: DataFrame) -> DataFrame:
    """One row for each group of equal records: ``first_id``, ``n_records``, ``n_rows`` and the number of other
    checks under the same key (``n_collisions``, 0 unless the 128 bits collide)."""
    records = keyed.groupBy("_key", "_check", "_id").agg(F.count(F.lit(1)).alias("_n"))
    groups = records.groupBy("_key", "_check").agg(
        F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("n_records"), F.sum("_n").alias("n_rows")
    )
    clash = groups.groupBy("_key").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    return groups.join(clash, "_key", "left").select(
        "first_id", "n_records", "n_rows", (F.coalesce(F.col("_c"), F.lit(1)) - 1).alias("n_collisions")
    )


def duplicate_pairs(df: DataFrame, record_id: str, canon: Column, hot_parts: int | None = None) -> DataFrame:
    """``first_id`` and ``event_id`` of each record that equals an earlier one but for formatting.

    The groups are counted with map-side combining. Members then meet their group's first id in a shuffled join;
    the members of hot groups (each more than 1/``hot_parts`` of all records, so at most ``hot_parts`` groups; by
    default as many as a shuffle has partitions, so that a cold group is never more than a task's share) stay
    where they are and get it by broadcast. No group is gathered in one task.

    Null keys never match; repeated rows of one record are one record; an empty table gives no rows.
    """
    records = cut_lineage(keyed_records(df.where(F.col(record_id).isNotNull()), record_id, canon))
    groups = records.groupBy("_key", "_check").agg(
        F.min("_id").alias("first_id"), F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    groups = groups.where(F.col("first_id") != F.col("_last"))
    hot_parts = hot_parts or max(LEAST_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limit = records.count() // hot_parts + 1
    hot = groups.where(F.col("_n") >= limit).select("_key", "_check", "first_id")
    cold = groups.where(F.col("_n") < limit).select("_key", "_check", "first_id")
    on = ["_key", "_check"]
    pairs = (
        records.join(F.broadcast(hot.select(*on)), on, "left_anti")
        .join(cold, on)
        .unionByName(records.join(F.broadcast(hot), on))
    )
    return pairs.where(F.col("_id") != F.col("first_id")).select("first_id", F.col("_id").alias("event_id")).distinct()
