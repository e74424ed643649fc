"""Events together with their schema."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.functions.datatypes import DataType
from tidemark.functions.scalars import as_object
from tidemark.ontology.model import EventType, Ontology

TEXTS = "array<string>"
COLUMNS = {
    "event_id": "bigint",
    "event_type": "string",
    "source_uri": "string",
    "properties": f"map<string,{TEXTS}>",
    "attachments": "map<string,map<string,string>>",
    "parents": TEXTS,
    "foreign_attribs": "map<string,string>",
}


def no_texts() -> Column:
    return F.array().cast(TEXTS)


def present(properties: Column) -> Column:
    """A map of value lists as sets: sorted, distinct, without nulls; properties without values are absent."""
    tidy = F.transform_values(
        F.coalesce(properties, F.create_map().cast(COLUMNS["properties"])),
        lambda _, v: F.array_sort(F.array_distinct(F.filter(F.coalesce(v, no_texts()), lambda x: x.isNotNull()))),
    )
    return F.map_filter(tidy, lambda _, v: F.size(v) > 0)


def _as_objects(kind: str) -> Callable[[Column], Column]:
    return lambda v: as_object(v, kind)


@dataclass(frozen=True)
class EventFrame:
    """A DataFrame with the columns of ``COLUMNS`` and the ontology that its events follow.

    Property values are sets: canonical frames hold them sorted, distinct and without nulls.
    """

    df: DataFrame
    ontology: Ontology

    @classmethod
    def from_events(cls, df: DataFrame, ontology: Ontology, **names: str) -> EventFrame:
        """From a table with parts of an event in columns; ``names`` maps our columns to those of the table. Missing
        columns are empty, other columns are left out."""
        columns = []
        for name, kind in COLUMNS.items():
            own = names.get(name, name)
            value = F.col(own).cast(kind) if own in df.columns else F.lit(None).cast(kind)
            if name == "properties":
                value = present(value)
            elif name == "parents":
                value = F.array_sort(F.array_distinct(F.coalesce(value, no_texts())))
            elif name in ("attachments", "foreign_attribs"):
                value = F.coalesce(value, F.create_map().cast(kind))
            columns.append(value.alias(name))
        return cls(df.select(*columns), ontology)

    @classmethod
    def from_columns(
        cls, df: DataFrame, ontology: Ontology, event_type: str, source_uri: str, event_id: Column, properties: Mapping[str, str | Column]
    ) -> EventFrame:
        """From a flat table: each property is a column or an expression over it."""
        pairs = []
        for name, value in properties.items():
            column = F.col(value) if isinstance(value, str) else value
            kind = df.select(column.alias("x")).schema["x"].dataType.simpleString()
            if kind.startswith("array<"):
                texts = F.filter(F.transform(column, _as_objects(kind[6:-1])), lambda v: v.isNotNull())
                texts = F.when(F.size(texts) > 0, F.array_sort(F.array_distinct(texts)))
            else:
                text = as_object(column, kind)
                texts = F.when(text.isNotNull(), F.array(text))
            pairs += [F.lit(name), texts.cast(TEXTS)]
        # each list is a set already; only absent properties have to go
        whole = F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast(COLUMNS["properties"])
        made = df.select(
            event_id.cast("bigint").alias("event_id"),
            F.lit(event_type).alias("event_type"),
            F.lit(source_uri).alias("source_uri"),
            whole.alias("properties"),
            F.create_map().cast(COLUMNS["attachments"]).alias("attachments"),
            no_texts().alias("parents"),
            F.create_map().cast(COLUMNS["foreign_attribs"]).alias("foreign_attribs"),
        )
        return cls(made, ontology)

    def with_df(self, df: DataFrame) -> EventFrame:
        return EventFrame(df, self.ontology)

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> EventFrame:
        return self.with_df(f(self.df))

    def kinds(self, event_type: str) -> dict[str, DataType]:
        return {p.name: DataType(self.ontology.data_type(event_type, p.name)) for p in self.ontology.event_types[event_type].properties}

    def of_type(self, name: str) -> EventFrame:
        """The events of one type, with the whole ontology."""
        return self.with_df(self.df.where(F.col("event_type") == name))

    def hash_column(self, function: str = "sha1") -> Column:
        hashed = {n: t.hashed_properties for n, t in self.ontology.event_types.items()}
        return hashing.sticky_hash(hashed, F.col("source_uri"), F.col("event_type"), F.col("properties"), function)

    def hashed(self, function: str = "sha1") -> DataFrame:
        """The events with ``sticky_hash``."""
        return self.df.withColumn("sticky_hash", self.hash_column(function))

    def wide(self, event_type: str) -> DataFrame:
        """One typed column for each property of an event type: a single value, or an array of values."""
        own, kinds = self.ontology.event_types[event_type], self.kinds(event_type)
        columns = []
        for p in own.properties:
            values = F.col("properties")[p.name]
            typed = F.transform(values, kinds[p.name].typed) if p.multivalued else kinds[p.name].typed(F.get(values, F.lit(0)))
            columns.append(typed.alias(p.name))
        return self.of_type(event_type).df.select("event_id", "source_uri", *columns)

    def objects(self, event_types: Iterable[str] | None = None) -> DataFrame:
        """One row for each value: ``event_id``, ``event_type``, ``source_uri``, ``property``, ``object_type``, ``value``."""
        df = self.df
        if event_types is not None:
            df = df.where(F.col("event_type").isin(*event_types))
        rows = df.select("event_id", "event_type", "source_uri", F.explode("properties").alias("property", "_v")).select(
            "event_id", "event_type", "source_uri", "property", F.explode("_v").alias("value")
        )
        return rows.withColumn("object_type", self.lookup(lambda t: {p.name: p.object_type for p in t.properties}))

    def lookup(self, of: Callable[[EventType], Mapping[str, object]]) -> Column:
        """What the ontology says of each row's event type and property, as a literal map; null for unknown ones."""
        pairs: Sequence[Column] = [
            F.lit(x) for n, t in sorted(self.ontology.event_types.items()) for p, v in sorted(of(t).items()) for x in (f"{n}\n{p}", v)
        ]
        if not pairs:
            return F.lit(None).cast("string")
        return F.try_element_at(F.create_map(*pairs), F.concat(F.col("event_type"), F.lit("\n"), F.col("property")))
