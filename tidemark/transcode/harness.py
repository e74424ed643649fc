"""A harness for transcoders: records in, merged and validated events out."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession

from tidemark.frame import EventFrame
from tidemark.ontology.check import checked
from tidemark.operators import validation
from tidemark.operators.merge import checked_merge
from tidemark.transcode.records import Mediator, Transcoder
from tidemark.transcode.xml import XmlMediator


def run(spark: SparkSession, mediator: Mediator, records: Sequence[dict[str, Any]], schema: str | None = None) -> EventFrame:
    """The events of some records after collisions are resolved; an error if the ontology or an event is invalid."""
    return _settled(mediator.transcode(spark.createDataFrame(list(records), schema)))


def run_xml(spark: SparkSession, mediator: XmlMediator, documents: Sequence[str]) -> EventFrame:
    """As ``run``, for XML documents."""
    return _settled(mediator.transcode(spark.createDataFrame([(d,) for d in documents], "document string"), "document"))


def _settled(made: EventFrame) -> EventFrame:
    checked(made.ontology)
    frame = checked_merge(made)
    if bad := validation.validate(frame).where("size(issues) > 0").limit(1).collect():
        raise ValueError(f"invalid after the merge: {bad[0]['issues']}")
    return frame


def describe(spec: Transcoder) -> str:
    """What a transcoder does, in a few lines."""
    if spec.event_type is None:
        return "discards its records"
    lines = [f"makes {spec.event_type.name}:"] + [f"  {path} -> {names if isinstance(names, str) else ', '.join(names)}" for path, names in spec.properties.items()]
    return "\n".join(lines)
