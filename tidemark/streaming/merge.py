"""Incremental merging, filtering and windows over streams of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.frame import COLUMNS, EventFrame
from tidemark.operators.merge import merge, merge_type, strategy, version_of


def continuous_merge(frame: EventFrame, event_type: str) -> DataFrame:
    """The merged events of one type of a stream, kept up to date: to be written in update or complete mode.

    The strategies are the same native aggregates as in a batch, so state is one buffer for each hash, and the last
    output of a hash is what a batch over all its events gives.
    """
    return merge_type(frame, event_type)


def windowed_merge(frame: EventFrame, event_type: str, time: str, delay: str, width: str) -> DataFrame:
    """Merged events of one type within windows of event time. State of windows that end ``delay`` before the latest
    time is dropped, so it stays bounded; events later than that are left out."""
    own = frame.ontology.event_types[event_type]
    at = F.try_to_timestamp(F.array_min(F.col("properties")[time]))
    timed = frame.of_type(event_type).hashed().withColumn("_at", at).withWatermark("_at", delay)
    kinds = frame.kinds(event_type)
    order = F.struct(version_of(own, F.col("properties")).alias("version"), F.col("event_id").alias("id"))
    none = F.array().cast("array<string>")
    return timed.groupBy(F.window("_at", width), "sticky_hash").agg(
        F.count(F.lit(1)).alias("n_events"),
        *[strategy(p.merge, kinds[p.name], F.coalesce(F.col("properties")[p.name], none), order).alias(p.name) for p in own.properties],
    )


def buffered_merge(frame: EventFrame, sink: Callable[[EventFrame, int], None], latency: str = "10 seconds") -> DataStreamWriter:
    """Merges each micro-batch and hands it to ``sink``, the last one too. A hash that occurs in several batches comes
    out of each; a sink that merges again, as into a table, gives the whole."""

    def each(batch: DataFrame, number: int) -> None:
        sink(merge(frame.with_df(batch.select(*COLUMNS))), number)

    return frame.df.writeStream.foreachBatch(each).trigger(processingTime=latency)


def type_counts(df: DataFrame, time: Column, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Events of each type in tumbling or sliding windows over event time."""
    window = F.window("_at", width, slide) if slide else F.window("_at", width)
    return (
        df.withColumn("_at", time)
        .withWatermark("_at", delay)
        .groupBy(window.alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n_events")
    )


def sessions(df: DataFrame, key: str, time: Column, gap: str, delay: str) -> DataFrame:
    """Runs of events of one key without a gap of event time."""
    return (
        df.withColumn("_at", time)
        .withWatermark("_at", delay)
        .groupBy(key, F.session_window("_at", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")
    )
