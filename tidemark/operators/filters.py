"""Filters over events, and routes to handlers."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.frame import EventFrame
from tidemark.ontology.model import EventSource, EventType


def prefix_match(column: Column, pattern: str) -> Column:
    """Whether a pattern matches from the start of a text."""
    return column.rlike(f"^(?:{pattern})")


def filter_events(frame: EventFrame, type_pattern: str | None = None, source_pattern: str | None = None) -> EventFrame:
    """Events whose type and source match, with an ontology of what matches and the parents of it.

    The patterns are matched against the ontology once; the rows are filtered by the names that are left, which
    reaches the scan.
    """
    ontology = frame.ontology
    types = {n for n in ontology.event_types if type_pattern is None or re.match(type_pattern, n)}
    sources = {u for u in ontology.sources if source_pattern is None or re.match(source_pattern, u)}
    parents = {t.parent.event_type for n in types if (t := ontology.event_types[n]).parent}
    for name in set(ontology.event_types) - types - parents:
        ontology = ontology.drop(EventType, name)
    for uri in set(ontology.sources) - sources:
        ontology = ontology.drop(EventSource, uri)
    kept = frame.df.where(F.col("event_type").isin(*sorted(types | (parents & set(ontology.event_types)))))
    if source_pattern is not None:
        kept = kept.where(F.col("source_uri").isin(*sorted(sources)))
    return EventFrame(kept, ontology)


def route(
    df: DataFrame, by_type: Mapping[str, Callable[[DataFrame], None]], by_source: Mapping[str, Callable[[DataFrame], None]], default: Callable[[DataFrame], None] | None = None
) -> None:
    """Hands each handler the rows of its type, or of the sources that its pattern matches (a row may go to both kinds),
    and the default the rest."""
    rest = F.lit(True)
    for name, handle in by_type.items():
        mine = F.col("event_type") == name
        handle(df.where(mine))
        rest = rest & ~mine
    for pattern, handle in by_source.items():
        mine = prefix_match(F.col("source_uri"), pattern)
        handle(df.where(mine))
        rest = rest & ~mine
    if default is not None:
        default(df.where(rest))


def unknown_events(frame: EventFrame) -> DataFrame:
    """Events whose type or source the ontology doesn't know."""
    known = F.col("event_type").isin(*sorted(frame.ontology.event_types)) & F.col("source_uri").isin(*sorted(frame.ontology.sources))
    return frame.df.where(~F.coalesce(known, F.lit(False)))
