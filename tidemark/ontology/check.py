"""Whether a schema keeps the rules; every broken rule is one text."""

from __future__ import annotations

import re
from collections.abc import Iterator

from tidemark.functions import template
from tidemark.functions.datatypes import DataType
from tidemark.ontology.model import (
    CONCEPT_RELATIONS, MERGE_STRATEGIES, NAME, RELATION_TYPES, UNIVERSAL_RELATIONS, Attachment, Bricks, Concept, Element, EventProperty, EventSource,
    EventType, ObjectType, Ontology, OntologyError, Parent, PropertyConcept, Relation,
)

#: A source's path, and how a fuzzy matching method is written.
SOURCE = re.compile(r"(/[a-z0-9-]+)*/")
FUZZY = re.compile(r"phonetic|substring:.*|\[\d{1,2}:\]|\[:\d{1,2}\]")


def _pattern_error(pattern: str) -> str | None:
    try:
        re.compile(pattern)
    except re.error as e:
        return str(e)
    return None


def _texts(item: Element, what: str) -> Iterator[str]:
    """Lengths and blanks of all texts."""
    for name, f in item.notes().items():
        value = getattr(item, name)
        if isinstance(value, str):
            if f.metadata["most"] is not None and len(value) > f.metadata["most"]:
                yield f"{what}: {f.metadata['xml']} is longer than {f.metadata['most']}"
            if f.metadata["token"] and " ".join(value.split()) != value:
                yield f"{what}: {f.metadata['xml']} has blanks at its ends, in a row, or of another kind"


def _name(name: str, what: str) -> Iterator[str]:
    if not NAME.fullmatch(name):
        yield f"{what}: invalid name"


def object_type_errors(item: ObjectType) -> Iterator[str]:
    what = f"object type {item.name}"
    yield from _name(item.name, what)
    yield from _texts(item, what)
    kind = DataType(item.data_type)
    yield from (f"{what}: {e}" for e in kind.definition_errors())
    if item.prefix_radix not in (None, 2, 10, 60):
        yield f"{what}: prefix radix must be 2, 10 or 60"
    if (item.unit_name is None) != (item.unit_symbol is None):
        yield f"{what}: a unit needs both name and symbol"
    if item.unit_name is not None and kind.family != "number":
        yield f"{what}: a unit needs a number"
    if item.prefix_radix is not None and item.unit_name is None:
        yield f"{what}: a prefix radix needs a unit"
    if item.fuzzy_matching is not None:
        if kind.family != "string":
            yield f"{what}: fuzzy matching needs a string"
        if not FUZZY.fullmatch(item.fuzzy_matching):
            yield f"{what}: unknown fuzzy matching {item.fuzzy_matching}"
        elif item.fuzzy_matching.startswith("substring:") and _pattern_error(item.fuzzy_matching[10:]):
            yield f"{what}: fuzzy matching has an invalid pattern"
    for side, pattern in (("hard", item.regex_hard), ("soft", item.regex_soft)):
        if pattern is not None:
            if kind.family != "string":
                yield f"{what}: a {side} pattern needs a string"
            if e := _pattern_error(pattern):
                yield f"{what}: invalid {side} pattern, {e}"


def concept_errors(item: Concept) -> Iterator[str]:
    yield from _name(item.name, f"concept {item.name}")
    yield from _texts(item, f"concept {item.name}")


def source_errors(item: EventSource) -> Iterator[str]:
    what = f"source {item.uri}"
    yield from _texts(item, what)
    if not SOURCE.fullmatch(item.uri):
        yield f"{what}: invalid uri"
    if not item.description:
        yield f"{what}: empty description"
    if item.date_acquired is not None and not re.fullmatch(r"\d{8}", item.date_acquired):
        yield f"{what}: invalid acquisition date"


def association_errors(item: PropertyConcept, what: str) -> Iterator[str]:
    what = f"{what}, concept {item.concept}"
    yield from _texts(item, what)
    if not 0 <= item.confidence <= 10:
        yield f"{what}: confidence is not between 0 and 10"
    if not 0 <= item.cnp <= 255:
        yield f"{what}: naming priority is not between 0 and 255"
    if not item.extension and (item.display_name_singular or item.display_name_plural):
        yield f"{what}: display names need an attribute extension"


def property_errors(item: EventProperty, what: str, kind: DataType | None = None) -> Iterator[str]:
    what = f"{what}, property {item.name}"
    yield from _name(item.name, what)
    yield from _name(item.object_type, f"{what}, object type {item.object_type}")
    yield from _texts(item, what)
    if item.name.startswith("xml"):
        yield f"{what}: names that begin with xml are reserved"
    if not 1 <= item.confidence <= 10:
        yield f"{what}: confidence is not between 1 and 10"
    if item.merge not in MERGE_STRATEGIES:
        yield f"{what}: unknown merge strategy {item.merge}"
    if item.merge in ("min", "max") and item.optional:
        yield f"{what}: strategy {item.merge} needs a mandatory property"
    if item.merge in ("min", "max", "replace") and item.multivalued:
        yield f"{what}: strategy {item.merge} needs a single value"
    for concept in item.concepts:
        yield from association_errors(concept, what)
    if kind is not None:
        if item.merge in ("min", "max") and not (kind.family in ("number", "datetime", "sequence")):
            yield f"{what}: strategy {item.merge} can't order {kind}"
        if item.merge == "match" and kind.is_floating:
            yield f"{what}: strategy match can't compare {kind}"


def relation_errors(item: Relation, event_type: EventType, kinds: dict[str, DataType]) -> Iterator[str]:
    what = f"event type {event_type.name}, relation {item.id}"
    yield from _texts(item, what)
    if item.type not in RELATION_TYPES:
        yield f"{what}: unknown type"
    lost = [n for n in (item.source, item.target) if n not in event_type.by_name]
    yield from (f"{what}: no property {n}" for n in lost)
    if item.confidence is not None and not 1 <= item.confidence <= 10:
        yield f"{what}: confidence is not between 1 and 10"
    ends = ((item.source, item.source_concept), (item.target, item.target_concept))
    if item.type in CONCEPT_RELATIONS:
        for name, concept in ends:
            if concept is None:
                yield f"{what}: {name} has no concept"
            elif name not in lost and event_type[name].concept(concept) is None:
                yield f"{what}: {name} isn't associated with {concept}"
    elif any(c is not None for _, c in ends):
        yield f"{what}: only inter and intra relations have concepts"
    if item.type in UNIVERSAL_RELATIONS:
        for part in ("description", "predicate", "confidence"):
            if getattr(item, part) is not None:
                yield f"{what}: must not have a {part}"
        if item.source not in lost and event_type[item.source].multivalued:
            yield f"{what}: the source must have a single value"
        if item.type == "original" and item.target not in lost and event_type[item.target].multivalued:
            yield f"{what}: the target must have a single value"
    if item.description is not None:
        yield from (f"{what}, description: {e}" for e in template.errors(item.description, event_type, kinds))


def attachment_errors(item: Attachment, what: str) -> Iterator[str]:
    what = f"{what}, attachment {item.name}"
    yield from _texts(item, what)
    if not re.fullmatch(r"[a-z][a-z0-9-]*", item.name):
        yield f"{what}: invalid name"
    if not item.description:
        yield f"{what}: empty description"
    if item.encoding not in ("unicode", "base64"):
        yield f"{what}: encoding must be unicode or base64"


def parent_errors(item: Parent, what: str) -> Iterator[str]:
    what = f"{what}, parent {item.event_type}"
    yield from _name(item.event_type, what)
    yield from _texts(item, what)
    if not item.property_map:
        yield f"{what}: empty property map"
    if not item.parent_description or not item.siblings_description:
        yield f"{what}: empty description"


def event_type_errors(item: EventType, kinds: dict[str, DataType]) -> Iterator[str]:
    """Of an event type alone; ``kinds`` has the data types of its properties as far as they are known."""
    what = f"event type {item.name}"
    yield from _name(item.name, what)
    yield from _texts(item, what)
    for p in item.properties:
        yield from property_errors(p, what, kinds.get(p.name))
    for r in item.relations:
        yield from relation_errors(r, item, kinds)
    for a in item.attachments:
        yield from attachment_errors(a, what)
    if item.parent:
        yield from parent_errors(item.parent, what)
    for role, name, family in (
        ("timespan-start", item.timespan_start, "datetime"), ("timespan-end", item.timespan_end, "datetime"),
        ("event-version", item.event_version, "sequence"), ("sequence", item.sequence, "sequence"),
    ):
        if name is None:
            continue
        if name not in item.by_name:
            yield f"{what}: {role} names no property"
            continue
        if name in kinds and kinds[name].family != family:
            yield f"{what}: {role} must be a {family}"
        if family == "sequence" and (item[name].optional or item[name].multivalued):
            yield f"{what}: {role} must be mandatory and have a single value"
        if role == "event-version" and item[name].merge != "max":
            yield f"{what}: {role} must have the strategy max"
    if item.event_version is None and any(p.merge == "replace" for p in item.properties):
        yield f"{what}: strategy replace needs an event version"
    for name in ("summary", "story"):
        yield from (f"{what}, {name}: {e}" for e in template.errors(getattr(item, name), item, kinds))


def ontology_errors(ontology: Ontology) -> list[str]:
    """All broken rules, of the elements alone and of the links between them."""
    out: list[str] = []
    for o in ontology.object_types.values():
        out += object_type_errors(o)
    for c in ontology.concepts.values():
        out += concept_errors(c)
    for s in ontology.sources.values():
        out += source_errors(s)
    for e in ontology.event_types.values():
        kinds = {p.name: DataType(ontology.object_types[p.object_type].data_type) for p in e.properties if p.object_type in ontology.object_types}
        out += event_type_errors(e, kinds)
        for p in e.properties:
            if p.object_type not in ontology.object_types:
                out.append(f"event type {e.name}, property {p.name}: no object type {p.object_type}")
            out += [f"event type {e.name}, property {p.name}: no concept {c.concept}" for c in p.concepts if c.concept not in ontology.concepts]
        if e.parent:
            out += _link_errors(e, ontology.event_types.get(e.parent.event_type))
    return out


def _link_errors(child: EventType, parent: EventType | None) -> Iterator[str]:
    what = f"event type {child.name}, parent {child.parent.event_type}"
    if parent is None:
        yield f"{what}: not defined"
        return
    pairs = child.parent.columns
    for name in parent.hashed_properties:
        if name not in pairs.values():
            yield f"{what}: hashed property {name} isn't mapped"
    for own, other in pairs.items():
        if own not in child.by_name:
            yield f"{what}: no child property {own}"
        elif child[own].merge not in ("match", "any"):
            yield f"{what}: child property {own} must have the strategy match or any"
        if other not in parent.by_name or not parent[other].hashed:
            yield f"{what}: parent property {other} isn't hashed or doesn't exist"


def checked(ontology: Ontology) -> Ontology:
    """The ontology, or an error with all broken rules."""
    if found := ontology_errors(ontology):
        raise OntologyError("; ".join(found))
    return ontology


def brick_errors(bricks: Bricks) -> list[str]:
    """What is wrong with shared definitions, each alone."""
    by_kind = {ObjectType: object_type_errors, Concept: concept_errors}
    return [e for (kind, _), item in sorted(bricks.elements.items(), key=lambda x: (x[0][0].__name__, x[0][1])) for e in by_kind[kind](item)]
