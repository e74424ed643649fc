"""Records of other kinds turned into events by declared maps, compiled to one projection."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.frame import COLUMNS, TEXTS, EventFrame, present
from tidemark.functions.scalars import as_object
from tidemark.ontology.model import EventSource, EventType, Ontology, OntologyError
from tidemark.operators import validation

EMPTY = (None, "")
#: A function from a value to one or several values.
PostProcessor = Callable[[Column], Column]


@dataclass(frozen=True)
class Transcoder:
    """How records of one kind become events.

    ``properties``: by path into the record (``a.b.0``, or an XPath) the property, or properties, that its value goes
    to. ``empty``: values that count as none, for each path. ``post``: functions for values of a property, applied to
    each. ``attachments``: by path the attachment. ``explode``: a path to a list whose items are records of their own.
    ``edit``: a last change of the made events, as a DataFrame function that may give several rows or none.
    """

    event_type: EventType | None
    properties: Mapping[str, str | Sequence[str]] = field(default_factory=dict)
    attachments: Mapping[str, str] = field(default_factory=dict)
    empty: Mapping[str, Sequence[Any]] = field(default_factory=dict)
    post: Mapping[str, PostProcessor] = field(default_factory=dict)
    explode: str | None = None
    edit: Callable[[DataFrame], DataFrame] | None = None

    def check(self) -> Transcoder:
        """An error for properties that the event type doesn't have."""
        if self.event_type is not None:
            named = {n for v in self.properties.values() for n in ([v] if isinstance(v, str) else v)} | set(self.post)
            if lost := sorted(named - set(self.event_type.by_name)):
                raise OntologyError(f"event type {self.event_type.name} has no {', '.join(lost)}")
        return self


#: Records of this transcoder are left out on purpose.
DISCARD = Transcoder(None)


def field_at(schema: T.StructType, path: str, root: Column | None = None) -> tuple[Column, T.DataType] | None:
    """The column at a dotted path with its type: fields of structs, keys of maps, places in lists. Null if the schema
    has nothing there, so that a missing field is an absent value."""
    column, kind = root, schema
    for part in path.split("."):
        if isinstance(kind, T.StructType):
            if part not in kind.fieldNames():
                return None
            column = F.col(f"`{part}`") if column is None else column.getField(part)
            kind = kind[part].dataType
        elif isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(part).cast(kind.keyType)), kind.valueType
        elif isinstance(kind, T.ArrayType) and part.lstrip("-").isdigit():
            n = int(part)
            column, kind = F.try_element_at(column, F.lit(n + 1 if n >= 0 else n)), kind.elementType
        elif isinstance(kind, T.VariantType):
            column, kind = F.try_variant_get(column, f"$[{part}]" if part.isdigit() else f"$.{part}", "variant"), T.VariantType()
        else:
            return None
    return column, kind


def _texts(column: Column, kind: T.DataType) -> Column:
    """All values of a column as texts: lists are several values, truth values are written in small letters."""
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, T.ArrayType):
            return _texts(F.flatten(column), inner)
        name = inner.simpleString()
        return F.transform(column, lambda v: as_object(v, name))
    if isinstance(kind, T.VariantType):
        many = F.try_variant_get(column, "$", TEXTS)
        return F.coalesce(many, F.array(F.try_variant_get(column, "$", "string")))
    return F.array(as_object(column, kind.simpleString()))


def _kept(values: Column, empty: Sequence[Any]) -> Column:
    none = [str(x).lower() if isinstance(x, bool) else str(x) for x in empty if x is not None]
    return F.filter(values, lambda v: v.isNotNull() & ~v.isin(*(none or [""])))


def _process(values: Column, f: PostProcessor) -> Column:
    made = F.transform(values, f)
    return F.flatten(made) if _gives_array(f) else made


def _gives_array(f: PostProcessor) -> bool:
    return bool(getattr(f, "several", False))


def several(f: PostProcessor) -> PostProcessor:
    """Marks a function that gives an array of values."""
    f.several = True  # type: ignore[attr-defined]
    return f


def transcode_type(
    df: DataFrame, spec: Transcoder, source: str | Column, value_at: Callable[[str], Column | None] | None = None, guard: bool = False
) -> DataFrame:
    """Events of one transcoder from its records. Lists become several values; ``event_id`` is kept if there is one."""
    if spec.event_type is None:
        raise ValueError("a discarding transcoder makes no events")
    spec.check()
    has_id = "event_id" in df.columns
    if spec.explode is not None:
        found = field_at(df.schema, spec.explode)
        if found is None:
            raise ValueError(f"no field {spec.explode}")
        df = df.select(*([F.col("event_id")] if has_id else []), F.explode(found[0]).alias("_item")).select(*(["event_id"] if has_id else []), "_item.*")

    def at(path: str) -> Column | None:
        if value_at is not None:
            return value_at(path)
        found = field_at(df.schema, path)
        return None if found is None else _texts(*found)

    properties, attachments = event_parts(spec, at, guard)
    out = df.select(
        (F.col("event_id") if has_id else F.monotonically_increasing_id()).cast("bigint").alias("event_id"),
        F.lit(spec.event_type.name).alias("event_type"),
        (F.lit(source) if isinstance(source, str) else source).alias("source_uri"),
        properties.alias("properties"),
        attachments.alias("attachments"),
        F.array().cast(TEXTS).alias("parents"),
        F.create_map().cast(COLUMNS["foreign_attribs"]).alias("foreign_attribs"),
    )
    return spec.edit(out) if spec.edit is not None else out


def event_parts(spec: Transcoder, at: Callable[[str], Column | None], guard: bool = False) -> tuple[Column, Column]:
    """The properties and attachments of a record's event; ``at`` gives the texts at a path, or null. With ``guard`` a
    property whose function fails is left out with a warning, else the failure is an error."""
    parts: dict[str, list[Column]] = {}
    for path, names in spec.properties.items():
        values = at(path)
        if values is None:
            continue
        for name in [names] if isinstance(names, str) else names:
            mine = _kept(values, [*EMPTY, *spec.empty.get(path, ())])
            if name in spec.post:
                try:
                    mine = _kept(_process(mine, spec.post[name]), EMPTY)
                except Exception as e:
                    if not guard:
                        raise
                    warnings.warn(f"property {name} is left out, its function fails: {e}", stacklevel=2)
                    continue
            parts.setdefault(name, []).append(F.coalesce(mine, F.array().cast(TEXTS)))
    pairs = [x for name, values in sorted(parts.items()) for x in (F.lit(name), F.concat(*values))]
    files = []
    for path, name in spec.attachments.items():
        if (values := at(path)) is not None:
            entries = F.map_from_entries(F.transform(_kept(values, EMPTY), lambda v: F.struct(F.sha1(v.cast("binary")), v)))
            files += [F.lit(name), F.coalesce(entries, F.create_map().cast("map<string,string>"))]
    return (
        present(F.create_map(*pairs) if pairs else F.create_map().cast(COLUMNS["properties"])),
        F.map_filter(F.create_map(*files), lambda _, v: F.size(v) > 0) if files else F.create_map().cast(COLUMNS["attachments"]),
    )


class Mediator:
    """Transcoders by kind of record, the ontology they need, and what to do with invalid events."""

    def __init__(self, ontology: Ontology, source: str = "/", type_field: str | None = None) -> None:
        self.ontology, self.source, self.type_field = ontology, source, type_field
        if source not in ontology.sources:
            self.ontology = ontology.put(EventSource(source))
        self.specs: dict[str | None, Transcoder] = {}
        self.normalize: dict[str, Iterable[str]] | None = {}
        self.drop: dict[str, Iterable[str]] = {}
        self.ignore_invalid = False
        self.guard = False
        self.closed = False
        self._emitted: int | None = None

    def ontology_update(self) -> Ontology | None:
        """The ontology if it has changed since it was last asked for, to be written before the events that need it."""
        if self._emitted == self.ontology.version:
            return None
        self._emitted = self.ontology.version
        return self.ontology

    def close(self) -> Ontology | None:
        """The last update of the ontology; nothing can be transcoded any more."""
        self.closed = True
        return self.ontology_update()

    def register(self, kind: str | None, spec: Transcoder) -> Mediator:
        """A transcoder for records whose type field has a value; ``None`` is for all others. A kind has one."""
        if kind in self.specs:
            raise ValueError(f"there is a transcoder for {kind}")
        self.specs[kind] = spec.check()
        if spec.event_type is not None and spec.event_type.name not in self.ontology.event_types:
            self.ontology = self.ontology.put(spec.event_type)
        return self

    def _selected(self, df: DataFrame, kind: str | None) -> DataFrame:
        found = None if self.type_field is None else field_at(df.schema, self.type_field)
        if found is None:
            return df if kind is None else df.limit(0)
        value = found[0].cast("string")
        if kind is not None:
            return df.where(value == kind)
        others = [k for k in self.specs if k is not None]
        return df.where(~F.coalesce(value.isin(*others), F.lit(False))) if others else df

    def unknown(self, df: DataFrame) -> DataFrame:
        """Records that no transcoder takes."""
        return df.limit(0) if None in self.specs else self._selected(df, None)

    def transcode(self, df: DataFrame) -> EventFrame:
        """All records as events. Each kind's records are one filtered scan and one projection; invalid events are
        repaired as far as allowed, then left out or an error."""
        if self.closed:
            raise ValueError("the mediator is closed")
        parts = [transcode_type(self._selected(df, k), s, self.source, guard=self.guard) for k, s in self.specs.items() if s.event_type is not None]
        if not parts:
            raise ValueError("no transcoder makes events")
        return self.checked(EventFrame.from_events(reduce(DataFrame.unionByName, parts), self.ontology))

    def checked(self, frame: EventFrame) -> EventFrame:
        """Events repaired as far as allowed; those that are invalid still are left out or an error."""
        repaired = validation.repair(frame, self.normalize, self.drop)
        good = repaired.where(F.size("issues") == 0)
        if not self.ignore_invalid:
            first = F.element_at("issues", 1)
            message = F.concat(F.lit("invalid event, "), first["property"], F.lit(": "), first["reason"])
            good = repaired.where(F.when(F.size("issues") == 0, True).otherwise(F.raise_error(message).cast("boolean")))
        return frame.with_df(good.select(*COLUMNS))
