"""Unions and differences of event collections."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.frame import COLUMNS, EventFrame
from tidemark.operators.merge import merge, merge_all
from tidemark.ontology.upgrade import merge_ontologies


def concatenate(first: EventFrame, *others: EventFrame) -> EventFrame:
    """All events of several collections under one ontology, nothing merged."""
    df, ontology = first.df, first.ontology
    for other in others:
        df, ontology = df.unionByName(other.df), merge_ontologies(ontology, other.ontology)
    return EventFrame(df, ontology)


def union_distinct(first: EventFrame, *others: EventFrame) -> EventFrame:
    return merge(concatenate(first, *others))


def content_key() -> Column:
    """What makes two events equal: type, source, properties, the ids of attachments, and parents; a hash of 128 bits."""
    ids = F.transform(F.array_sort(F.map_keys("attachments")), lambda k: F.struct(k.alias("name"), F.array_sort(F.map_keys(F.col("attachments")[k])).alias("ids")))
    parts = F.to_json(
        F.struct("event_type", "source_uri", F.array_sort(F.map_entries("properties")).alias("p"), ids.alias("a"), F.array_sort("parents").alias("r"))
    )
    return F.md5(parts)


def difference(a: EventFrame, b: EventFrame) -> DataFrame:
    """``sticky_hash``, ``status`` (only in a, only in b, changed) and both contents of the events that differ; each
    side is merged first, so that a hash is one event."""
    sides, texts = [], []
    for side, frame in (("a", a), ("b", b)):
        merged = merge_all(frame)
        sides.append(merged.select("sticky_hash", content_key().alias(f"key_{side}")))
        texts.append(merged.select("sticky_hash", F.to_json(F.struct(*list(COLUMNS)[1:])).alias(side)))
    status = F.when(F.col("key_b").isNull(), "only in a").when(F.col("key_a").isNull(), "only in b").when(F.col("key_a") != F.col("key_b"), "changed")
    # hashes and content keys meet first; the contents of events that are equal, which most are, are never written out
    differ = sides[0].join(sides[1], "sticky_hash", "full_outer").select("sticky_hash", status.alias("status")).where("status IS NOT NULL")
    for side in texts:
        differ = differ.join(side, "sticky_hash", "left")
    return differ.select("sticky_hash", "status", "a", "b")


def equivalent(a: EventFrame, b: EventFrame) -> bool:
    """Whether two collections hold the same events after collisions are resolved."""
    return not difference(a, b).limit(1).collect()


def difference_lines(differences: DataFrame) -> Iterator[str]:
    """The differences as a unified diff, for reading, in the order of the events' hashes; one partition at a time."""
    for row in differences.orderBy("sticky_hash").toLocalIterator():
        yield from difflib.unified_diff((row["a"] or "").split(","), (row["b"] or "").split(","), "a", "b", lineterm="", n=1)


def text_difference(differences: DataFrame) -> Sequence[str]:
    return list(difference_lines(differences))
