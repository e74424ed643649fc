"""Event types declared by class constants."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from tidemark.ontology.check import checked
from tidemark.ontology.model import Attachment, Bricks, Concept, EventProperty, EventSource, EventType, ObjectType, Ontology, OntologyError


class EventTypes:
    """Base of declarations. A subclass says in its constants what its event types are:

    ``TYPES``: the names; ``PROPERTIES``: by type the object type of each property; and by type, each optional:
    ``DESCRIPTIONS``, ``DISPLAY_NAMES`` (one, or singular and plural), ``SUMMARIES``, ``STORIES``, ``VERSIONS``,
    ``PROPERTY_DESCRIPTIONS``, ``SIMILAR``, ``MERGE`` (strategies by property), ``OPTIONAL`` and ``MANDATORY``,
    ``MULTIVALUED`` and ``SINGLE``, ``CONFIDENCE``, ``CONCEPTS`` (by property the concepts with confidence and naming
    priority), ``RELATIONS`` (type, source, target, predicate), ``ATTACHMENTS`` (names), ``TIMESPANS`` (start, end),
    ``EVENT_VERSION``, ``SEQUENCE``, ``PARENTS`` (parent type, descriptions).
    """

    TYPES: Iterable[str] = ()
    PROPERTIES: Mapping[str, Mapping[str, str]] = {}
    DESCRIPTIONS: Mapping[str, str] = {}
    DISPLAY_NAMES: Mapping[str, str | tuple[str, str]] = {}
    SUMMARIES: Mapping[str, str] = {}
    STORIES: Mapping[str, str] = {}
    VERSIONS: Mapping[str, int] = {}
    PROPERTY_DESCRIPTIONS: Mapping[str, Mapping[str, str]] = {}
    SIMILAR: Mapping[str, Mapping[str, str]] = {}
    MERGE: Mapping[str, Mapping[str, str]] = {}
    OPTIONAL: Mapping[str, Iterable[str]] = {}
    MANDATORY: Mapping[str, Iterable[str]] = {}
    MULTIVALUED: Mapping[str, Iterable[str]] = {}
    SINGLE: Mapping[str, Iterable[str]] = {}
    CONFIDENCE: Mapping[str, Mapping[str, int]] = {}
    CONCEPTS: Mapping[str, Mapping[str, Mapping[str, tuple[int, int]]]] = {}
    RELATIONS: Mapping[str, Iterable[tuple[str, str, str, str]]] = {}
    ATTACHMENTS: Mapping[str, Iterable[str]] = {}
    TIMESPANS: Mapping[str, tuple[str | None, str | None]] = {}
    EVENT_VERSION: Mapping[str, str] = {}
    SEQUENCE: Mapping[str, str] = {}
    PARENTS: Mapping[str, tuple[str, str, str]] = {}

    BY_TYPE = (
        "PROPERTIES DESCRIPTIONS DISPLAY_NAMES SUMMARIES STORIES VERSIONS PROPERTY_DESCRIPTIONS SIMILAR MERGE OPTIONAL MANDATORY MULTIVALUED SINGLE "
        "CONFIDENCE CONCEPTS RELATIONS ATTACHMENTS TIMESPANS EVENT_VERSION SEQUENCE PARENTS"
    ).split()
    BY_PROPERTY = "PROPERTY_DESCRIPTIONS SIMILAR MERGE OPTIONAL MANDATORY MULTIVALUED SINGLE CONFIDENCE CONCEPTS".split()

    @classmethod
    def problems(cls) -> list[str]:
        """Constants that speak of types or properties that aren't declared."""
        out, known = [], set(cls.TYPES)
        for constant in cls.BY_TYPE:
            out += [f"{constant} names the undeclared type {t}" for t in getattr(cls, constant) if t not in known]
        for constant in cls.BY_PROPERTY:
            for t, names in getattr(cls, constant).items():
                out += [f"{constant} of {t} names the undeclared property {n}" for n in names if n not in cls.PROPERTIES.get(t, {})]
        for t, relations in cls.RELATIONS.items():
            out += [f"RELATIONS of {t} name the undeclared property {n}" for r in relations for n in r[1:3] if n not in cls.PROPERTIES.get(t, {})]
        for t, parent in cls.PARENTS.items():
            if parent[0] not in known:
                out.append(f"PARENTS of {t} names the undeclared type {parent[0]}")
        return out

    @classmethod
    def event_type(cls, name: str) -> EventType:
        """The declared type, without its parent."""
        shown = cls.DISPLAY_NAMES.get(name, name.replace(".", " "))
        one, many = shown if isinstance(shown, tuple) else (shown, f"{shown}s")
        start, end = cls.TIMESPANS.get(name, (None, None))
        out = EventType(
            name, one, many, cls.DESCRIPTIONS.get(name, name), cls.SUMMARIES.get(name, f"a {one}"), cls.STORIES.get(name, cls.SUMMARIES.get(name, f"a {one}")),
            cls.VERSIONS.get(name, 1), start, end, cls.EVENT_VERSION.get(name), cls.SEQUENCE.get(name),
        )
        for p, object_type in cls.PROPERTIES.get(name, {}).items():
            out = out.with_property(cls._property(name, p, object_type))
        for kind, source, target, predicate in cls.RELATIONS.get(name, ()):
            out = out.relate(kind, source, target, predicate)
        for a in cls.ATTACHMENTS.get(name, ()):
            out = out.with_attachment(Attachment(a, display_name_singular=a, display_name_plural=f"{a}s", description=f"the {a}"))
        return out

    @classmethod
    def _property(cls, type: str, name: str, object_type: str) -> EventProperty:
        def of(constant: str, default: Any) -> Any:
            return getattr(cls, constant).get(type, {}).get(name, default)

        out = EventProperty(
            name, object_type, of("PROPERTY_DESCRIPTIONS", name), similar=of("SIMILAR", ""), confidence=of("CONFIDENCE", 10),
            optional=name not in cls.MANDATORY.get(type, ()), multivalued=name not in cls.SINGLE.get(type, ()),
        ).with_merge(of("MERGE", "any"))
        if name in cls.OPTIONAL.get(type, ()):
            out = out.with_(optional=True)
        if name in cls.MULTIVALUED.get(type, ()):
            out = out.with_(multivalued=True)
        for concept, (confidence, cnp) in of("CONCEPTS", {}).items():
            out = out.identifies(concept, confidence, cnp)
        return out

    @classmethod
    def ontology(cls, *elements: ObjectType | Concept | EventSource, bricks: Bricks | None = None) -> Ontology:
        """The declared types with the elements they need, from ``elements`` and ``bricks``; checked."""
        if found := cls.problems():
            raise OntologyError("; ".join(found))
        types = {t: cls.event_type(t) for t in cls.TYPES}
        for t, (parent, description, siblings) in cls.PARENTS.items():
            types[t] = types[t].child_of(types[parent], description, siblings)
        out = Ontology().create(*elements, *types.values())
        return checked(bricks.complete(out) if bricks else out)
