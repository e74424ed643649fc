"""The schema of event data as immutable values.

What an XML attribute is called, how long it may be and whether an upgrade may change it stands beside each field;
reading, writing, checking and comparing are driven by these notes.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

NAME = re.compile(r"[a-z][a-z0-9-]*(\.[a-z][a-z0-9-]*)*")
MERGE_STRATEGIES = ("match", "any", "add", "set", "replace", "min", "max")
CONCEPT_RELATIONS = ("inter", "intra")
UNIVERSAL_RELATIONS = ("name", "description", "container", "original")
RELATION_TYPES = (*CONCEPT_RELATIONS, "other", *UNIVERSAL_RELATIONS)
DEFAULT_DATA_TYPE = "string:0:mc:u"


class OntologyError(ValueError):
    """A schema that breaks a rule, or an element that can't be an upgrade of another one."""


def note(
    xml: str, default: Any = dataclasses.MISSING, *, most: int | None = None, token: bool = False, fixed: bool = False, omit: bool = False
) -> Any:
    """A field with its XML attribute, its greatest length, whether it is an XML token, whether an upgrade must keep
    it, and whether the attribute is left out when it has the default."""
    return field(default=default, metadata={"xml": xml, "most": most, "token": token, "fixed": fixed, "omit": omit})


class Element:
    """What all parts of a schema have in common."""

    def with_(self, **changes: Any) -> Any:
        return replace(self, **changes)

    @classmethod
    def notes(cls) -> dict[str, dataclasses.Field]:
        return {f.name: f for f in dataclasses.fields(cls) if "xml" in f.metadata}


@dataclass(frozen=True)
class ObjectType(Element):
    """A named domain of values."""

    name: str = note("name", most=64, fixed=True)
    display_name_singular: str = note("display-name-singular", "", most=32, token=True)
    display_name_plural: str = note("display-name-plural", "", most=32, token=True)
    description: str = note("description", "", most=128, token=True)
    data_type: str = note("data-type", DEFAULT_DATA_TYPE)
    unit_name: str | None = note("unit-name", None, most=32, token=True, fixed=True, omit=True)
    unit_symbol: str | None = note("unit-symbol", None, most=32, token=True, fixed=True, omit=True)
    prefix_radix: int | None = note("prefix-radix", None, fixed=True, omit=True)
    compress: bool = note("compress", False, omit=True)
    xref: str | None = note("xref", None, omit=True)
    fuzzy_matching: str | None = note("fuzzy-matching", None, omit=True)
    regex_hard: str | None = note("regex-hard", None, omit=True)
    regex_soft: str | None = note("regex-soft", None, omit=True)
    version: int = note("version", 1)


@dataclass(frozen=True)
class Concept(Element):
    name: str = note("name", most=64, fixed=True)
    display_name_singular: str = note("display-name-singular", "", most=32, token=True)
    display_name_plural: str = note("display-name-plural", "", most=32, token=True)
    description: str = note("description", "", most=128, token=True)
    version: int = note("version", 1)


def share_branch(a: str, b: str) -> bool:
    """Whether one concept name is the beginning of the other, letter by letter."""
    return a.startswith(b) or b.startswith(a)


def is_specialization(general: str, special: str) -> bool:
    return special != general and special.startswith(general)


def generalizations(name: str) -> list[str]:
    """``a.b.c`` gives ``a.b`` and ``a``."""
    parts = name.split(".")
    return [".".join(parts[:n]) for n in range(len(parts) - 1, 0, -1)]


def specializations(names: Iterable[str], name: str) -> list[str]:
    return sorted(n for n in names if n.startswith(f"{name}."))


@dataclass(frozen=True)
class PropertyConcept(Element):
    """A property's association with a concept: how well it identifies it, and how well it names it."""

    concept: str = note("name", fixed=True)
    confidence: int = note("confidence", 10)
    cnp: int = note("cnp", 128)
    extension: str = note("attr-extension", "", most=16, fixed=True, omit=True)
    display_name_singular: str = note("attr-display-name-singular", "", token=True, omit=True)
    display_name_plural: str = note("attr-display-name-plural", "", token=True, omit=True)


@dataclass(frozen=True)
class EventProperty(Element):
    name: str = note("name", most=64, fixed=True)
    object_type: str = note("object-type", fixed=True)
    description: str = note("description", "", most=128, token=True)
    optional: bool = note("optional", True)
    multivalued: bool = note("multivalued", True)
    similar: str = note("similar", "", most=64, token=True, omit=True)
    confidence: int = note("confidence", 10)
    merge: str = note("merge", "any", fixed=True, omit=True)
    concepts: tuple[PropertyConcept, ...] = ()

    @property
    def hashed(self) -> bool:
        return self.merge == "match"

    def concept(self, name: str) -> PropertyConcept | None:
        return next((c for c in self.concepts if c.concept == name), None)

    def attribute_name(self, concept: str) -> str:
        """``object-type:extension``, by which values of a concept are told apart."""
        found = self.concept(concept)
        return f"{self.object_type}:{found.extension if found else ''}"

    def with_merge(self, strategy: str) -> EventProperty:
        """With a merge strategy and what it implies: one value for min, max and replace, a value for min and max."""
        changes: dict[str, Any] = {"merge": strategy}
        if strategy in ("min", "max", "replace"):
            changes["multivalued"] = False
        if strategy in ("min", "max"):
            changes["optional"] = False
        return self.with_(**changes)

    def identifies(self, concept: str, confidence: int = 10, cnp: int = 128, **attribute: str) -> EventProperty:
        others = tuple(c for c in self.concepts if c.concept != concept)
        return self.with_(concepts=(*others, PropertyConcept(concept, confidence, cnp, **attribute)))


@dataclass(frozen=True)
class Relation(Element):
    type: str
    source: str = note("source", fixed=True)
    target: str = note("target", fixed=True)
    source_concept: str | None = note("source-concept", None, fixed=True, omit=True)
    target_concept: str | None = note("target-concept", None, fixed=True, omit=True)
    description: str | None = note("description", None, most=255, token=True, omit=True)
    predicate: str | None = note("predicate", None, most=32, token=True, omit=True)
    confidence: int | None = note("confidence", None, omit=True)

    @property
    def id(self) -> str:
        if self.type in CONCEPT_RELATIONS:
            return f"{self.type}:{self.source_concept},{self.target_concept}:{self.source},{self.target}"
        return f"{self.type}:{self.source},{self.target}"

    def reversed(self) -> Relation:
        return self.with_(
            source=self.target, target=self.source, source_concept=self.target_concept, target_concept=self.source_concept
        )


@dataclass(frozen=True)
class Attachment(Element):
    name: str = note("name", most=64, fixed=True)
    media_type: str = note("media-type", "text/plain", fixed=True)
    display_name_singular: str = note("display-name-singular", "", most=32, token=True)
    display_name_plural: str = note("display-name-plural", "", most=32, token=True)
    description: str = note("description", "", most=128, token=True)
    encoding: str = note("encoding", "unicode", fixed=True)


@dataclass(frozen=True)
class Parent(Element):
    """A declared foreign key: each hashed property of the parent has a property of the child."""

    event_type: str = note("event-type", most=64, fixed=True)
    property_map: tuple[tuple[str, str], ...] = field(default=(), metadata={"fixed": True})
    parent_description: str = note("parent-description", "belonging to", most=128, token=True)
    siblings_description: str = note("siblings-description", "sharing", most=128, token=True)

    @property
    def columns(self) -> dict[str, str]:
        """Child property to parent property."""
        return dict(self.property_map)

    def map(self, child: str, parent: str | None = None) -> Parent:
        return self.with_(property_map=tuple(sorted({**self.columns, child: parent or child}.items())))


@dataclass(frozen=True)
class EventSource(Element):
    uri: str = note("uri", fixed=True)
    description: str = note("description", "no description available", most=128, token=True)
    date_acquired: str | None = note("date-acquired", None, omit=True)
    version: int = note("version", 1)


@dataclass(frozen=True)
class EventType(Element):
    name: str = note("name", most=64, fixed=True)
    display_name_singular: str = note("display-name-singular", "", most=32, token=True)
    display_name_plural: str = note("display-name-plural", "", most=32, token=True)
    description: str = note("description", "", most=128, token=True)
    summary: str = note("summary", "", token=True)
    story: str = note("story", "")
    version: int = note("version", 1)
    timespan_start: str | None = note("timespan-start", None, fixed=True, omit=True)
    timespan_end: str | None = note("timespan-end", None, fixed=True, omit=True)
    event_version: str | None = note("event-version", None, fixed=True, omit=True)
    sequence: str | None = note("sequence", None, fixed=True, omit=True)
    properties: tuple[EventProperty, ...] = ()
    relations: tuple[Relation, ...] = ()
    attachments: tuple[Attachment, ...] = ()
    parent: Parent | None = None

    @cached_property
    def by_name(self) -> dict[str, EventProperty]:
        return {p.name: p for p in self.properties}

    def __getitem__(self, name: str) -> EventProperty:
        return self.by_name[name]

    @cached_property
    def hashed_properties(self) -> list[str]:
        return sorted(p.name for p in self.properties if p.hashed)

    @property
    def singular_properties(self) -> list[str]:
        return [p.name for p in self.properties if not p.multivalued]

    @property
    def mandatory_properties(self) -> list[str]:
        return [p.name for p in self.properties if not p.optional]

    def related(self, type: str | None = None, source: str | None = None, target: str | None = None) -> list[Relation]:
        """The relations of a type, from a property, to a property."""
        return [
            r
            for r in self.relations
            if (type is None or r.type == type) and (source is None or r.source == source) and (target is None or r.target == target)
        ]

    def attachment(self, name: str) -> Attachment | None:
        return next((a for a in self.attachments if a.name == name), None)

    def _put(self, part: str, item: Any, key: str) -> EventType:
        others = tuple(x for x in getattr(self, part) if getattr(x, key) != getattr(item, key))
        return self.with_(**{part: (*others, item)})

    def with_property(self, item: EventProperty) -> EventType:
        return self._put("properties", item, "name")

    def with_attachment(self, item: Attachment) -> EventType:
        return self._put("attachments", item, "name")

    def with_relation(self, item: Relation) -> EventType:
        return self._put("relations", item, "id")

    def without_property(self, name: str) -> EventType:
        """Without a property and the relations that need it."""
        return self.with_(
            properties=tuple(p for p in self.properties if p.name != name),
            relations=tuple(r for r in self.relations if name not in (r.source, r.target)),
        )

    def relate(
        self, type: str, source: str, target: str, predicate: str = "related to", description: str | None = None,
        confidence: int = 10, source_concept: str | None = None, target_concept: str | None = None,
    ) -> EventType:
        """With a relation. Concepts that aren't named are taken from the properties where there is only one."""
        for name in (source, target):
            if name not in self.by_name:
                raise OntologyError(f"event type {self.name} has no property {name}")
        if type in UNIVERSAL_RELATIONS:
            return self.with_relation(Relation(type, source, target))
        if type in CONCEPT_RELATIONS:
            source_concept = source_concept or self._only_concept(source)
            target_concept = target_concept or self._only_concept(target)
        text = description or f"[[{source}]] {predicate} [[{target}]]"
        return self.with_relation(Relation(type, source, target, source_concept, target_concept, text, predicate, confidence))

    def _only_concept(self, name: str) -> str:
        found = [c.concept for c in self[name].concepts]
        if len(found) != 1:
            raise OntologyError(f"property {name} of event type {self.name} has {len(found)} concepts; name one")
        return found[0]

    def child_of(self, parent: EventType, parent_description: str = "belonging to", siblings_description: str = "sharing") -> EventType:
        """With a parent; its hashed properties are mapped if the child has all of them under the same names."""
        same = [n for n in parent.hashed_properties if n in self.by_name]
        pairs = tuple((n, n) for n in same) if len(same) == len(parent.hashed_properties) else ()
        return self.with_(parent=Parent(parent.name, pairs, parent_description, siblings_description))


@dataclass(frozen=True)
class Ontology:
    """Named object types, concepts, event types and sources. ``version`` counts the changes that led to it."""

    object_types: Mapping[str, ObjectType] = field(default_factory=dict)
    concepts: Mapping[str, Concept] = field(default_factory=dict)
    event_types: Mapping[str, EventType] = field(default_factory=dict)
    sources: Mapping[str, EventSource] = field(default_factory=dict)
    version: int = 0

    PARTS = {ObjectType: "object_types", Concept: "concepts", EventType: "event_types", EventSource: "sources"}

    def modified_since(self, version: int) -> bool:
        return self.version > version

    def part(self, kind: type) -> Mapping[str, Any]:
        return getattr(self, self.PARTS[kind])

    def put(self, *items: ObjectType | Concept | EventType | EventSource) -> Ontology:
        """With elements added or replaced."""
        parts = {name: dict(getattr(self, name)) for name in self.PARTS.values()}
        for item in items:
            key = item.uri if isinstance(item, EventSource) else item.name
            parts[self.PARTS[type(item)]][key] = item
        return Ontology(**parts, version=self.version + len(items))

    def create(self, *items: ObjectType | Concept | EventType | EventSource) -> Ontology:
        """With new elements; a name that exists already is an error."""
        out = self
        for item in items:
            key = item.uri if isinstance(item, EventSource) else item.name
            if key in out.part(type(item)):
                raise OntologyError(f"{type(item).__name__} {key} exists already")
            out = out.put(item)
        return out

    def drop(self, kind: type, key: str) -> Ontology:
        """Without an element and what can't be without it: an object type takes the properties that have it along,
        a concept its associations, an event type the parent links to it."""
        if key not in self.part(kind):
            return self
        parts = {name: dict(getattr(self, name)) for name in self.PARTS.values()}
        del parts[self.PARTS[kind]][key]
        for name, event_type in parts["event_types"].items():
            if kind is ObjectType:
                for gone in [p.name for p in event_type.properties if p.object_type == key]:
                    event_type = event_type.without_property(gone)
            elif kind is Concept:
                event_type = event_type.with_(
                    properties=tuple(p.with_(concepts=tuple(c for c in p.concepts if c.concept != key)) for p in event_type.properties),
                    relations=tuple(r for r in event_type.relations if key not in (r.source_concept, r.target_concept)),
                )
            elif kind is EventType and event_type.parent and event_type.parent.event_type == key:
                event_type = event_type.with_(parent=None)
            parts["event_types"][name] = event_type
        return Ontology(**parts, version=self.version + 1)

    def data_type(self, event_type: str, name: str) -> str:
        return self.object_types[self.event_types[event_type][name].object_type].data_type

    def is_timeless(self, event_type: str) -> bool:
        own = self.event_types[event_type]
        return not any(self.object_types[p.object_type].data_type == "datetime" for p in own.properties if p.object_type in self.object_types)


class Bricks:
    """Shared definitions that ontologies import by name when they need them."""

    def __init__(self, *elements: ObjectType | Concept) -> None:
        self.elements = {(type(e), e.name): e for e in elements}

    def complete(self, ontology: Ontology) -> Ontology:
        """With every known object type and concept that event types refer to and that is missing."""
        wanted: list[tuple[type, str]] = []
        for event_type in ontology.event_types.values():
            for p in event_type.properties:
                wanted.append((ObjectType, p.object_type))
                wanted += [(Concept, c.concept) for c in p.concepts]
        missing = {k: self.elements[k] for k in wanted if k in self.elements and k[1] not in ontology.part(k[0])}
        return ontology.put(*missing.values()) if missing else ontology
