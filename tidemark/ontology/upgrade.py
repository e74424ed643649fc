"""Comparing definitions and merging newer ones into an ontology."""

from __future__ import annotations

from collections.abc import Iterable
from enum import Enum
from typing import Any

from tidemark.functions.datatypes import DataType
from tidemark.ontology.model import (
    Attachment, Concept, Element, EventProperty, EventSource, EventType, ObjectType, Ontology, OntologyError, Parent, PropertyConcept, Relation,
)


class Outcome(Enum):
    EQUAL = 0
    UPGRADE = 1


class UpgradeError(OntologyError):
    """Two definitions of which neither is a valid upgrade of the other; the text shows both."""

    def __init__(self, reason: str, old: Any, new: Any) -> None:
        super().__init__(f"{reason}\n  known: {old}\n  other: {new}")


def _kept(old: Element, new: Element, skip: Iterable[str] = ()) -> bool:
    """Compares the noted fields: whether any differs; a fixed one must not."""
    differ = False
    for name, f in old.notes().items():
        if name == "version" or name in skip or getattr(old, name) == getattr(new, name):
            continue
        if f.metadata["fixed"]:
            raise UpgradeError(f"{f.metadata['xml']} of a {type(old).__name__} can't change", old, new)
        differ = True
    return differ


def _object_type(old: ObjectType, new: ObjectType) -> bool:
    differ = _kept(old, new, ("data_type", "regex_hard"))
    if old.data_type != new.data_type:
        if not DataType(new.data_type).is_upgrade_of(DataType(old.data_type)):
            raise UpgradeError("the data type can't change like this", old, new)
        differ = True
    if old.regex_hard != new.regex_hard:
        widened = new.regex_hard is None or (old.regex_hard is not None and new.regex_hard.startswith(f"{old.regex_hard}|"))
        if old.regex_hard is None or not widened:
            raise UpgradeError("a hard pattern may only be widened", old, new)
        differ = True
    return differ


def _property(old: EventProperty, new: EventProperty) -> bool:
    differ = _kept(old, new)
    if old.multivalued and not new.multivalued:
        raise UpgradeError("a property can't lose values", old, new)
    if old.optional and not new.optional:
        raise UpgradeError("a property can't become mandatory", old, new)
    return _parts(old.concepts, new.concepts, "concept", _association, "concept association") or differ


def _association(old: PropertyConcept, new: PropertyConcept) -> bool:
    return _kept(old, new)


def _relation(old: Relation, new: Relation) -> bool:
    return _kept(old, new)


def _parts(old: Iterable[Any], new: Iterable[Any], key: str, compare: Any, what: str, addable: Any = lambda x: True) -> bool:
    """Compares named parts: none may vanish, and only ``addable`` ones may come."""
    before, after = {getattr(x, key): x for x in old}, {getattr(x, key): x for x in new}
    if gone := sorted(before.keys() - after.keys()):
        raise UpgradeError(f"a {what} can't vanish: {', '.join(gone)}", before, after)
    came = [after[k] for k in after.keys() - before.keys()]
    if not all(map(addable, came)):
        raise UpgradeError(f"a {what} can't be added like this", before, after)
    return bool(came) | any([compare(before[k], after[k]) for k in before])


def _parent(old: Parent | None, new: Parent | None) -> bool:
    if old is None or new is None:
        if old is not None:
            raise UpgradeError("a parent can't vanish", old, new)
        return new is not None
    if old.property_map != new.property_map:
        raise UpgradeError("a parent's property map can't change", old, new)
    return _kept(old, new)


def _event_type(old: EventType, new: EventType, times: set[str] = frozenset()) -> bool:
    differ = _kept(old, new)
    # an event type without times must stay so
    timeless = not any(p.object_type in times for p in old.properties)

    def addable(p: EventProperty) -> bool:
        return p.optional and not (timeless and p.object_type in times)

    differ |= _parts(old.properties, new.properties, "name", _property, "property", addable)
    differ |= _parts(old.relations, new.relations, "id", _relation, "relation")
    differ |= _parts(old.attachments, new.attachments, "name", lambda a, b: _kept(a, b), "attachment")
    return _parent(old.parent, new.parent) or differ


_COMPARE = {ObjectType: _object_type, Concept: _kept, EventSource: _kept}


def compare(one: Element, other: Element, times: set[str] = frozenset()) -> tuple[Outcome, Element]:
    """Whether two definitions of one thing are equal, and the newer one. Anything else than a valid upgrade is an
    error: another fixed field, a change without another version, a part that vanished.

    ``times`` names the object types that hold times.
    """
    if not isinstance(one, (Attachment, Parent, PropertyConcept, EventProperty, Relation)) and one.version > other.version:
        one, other = other, one
    if isinstance(one, EventType):
        differ = _event_type(one, other, times)
    else:
        simple = {EventProperty: _property, Relation: _relation, PropertyConcept: _association, Parent: _parent, Attachment: _kept}
        differ = (_COMPARE | simple)[type(one)](one, other)
    versions = (getattr(one, "version", None), getattr(other, "version", None))
    if differ and versions[0] == versions[1] and versions[0] is not None:
        raise UpgradeError("definitions differ but have one version", one, other)
    return (Outcome.UPGRADE if differ or versions[0] != versions[1] else Outcome.EQUAL), other


def merge_ontologies(known: Ontology, other: Ontology) -> Ontology:
    """``known`` with everything new or newer in ``other``; invalid upgrades are errors. Nothing is ever lost."""
    times = {n for o in (known, other) for n, t in o.object_types.items() if t.data_type == "datetime"}
    news = []
    for kind in Ontology.PARTS:
        mine = known.part(kind)
        for key, item in other.part(kind).items():
            if key not in mine:
                news.append(item)
                continue
            outcome, newest = compare(mine[key], item, times)
            if outcome is Outcome.UPGRADE and newest is not mine[key]:
                news.append(newest)
    return known.put(*news) if news else known


def compare_ontologies(known: Ontology, other: Ontology) -> Outcome:
    """EQUAL, or UPGRADE if the two differ but can be merged; two that can't are an error."""
    merge_ontologies(known, other)
    times = {n for o in (known, other) for n, t in o.object_types.items() if t.data_type == "datetime"}
    for kind in Ontology.PARTS:
        mine, its = known.part(kind), other.part(kind)
        if mine.keys() != its.keys() or any(compare(mine[k], its[k], times)[0] is Outcome.UPGRADE for k in mine):
            return Outcome.UPGRADE
    return Outcome.EQUAL


def bump(old: Element, new: Element) -> Element:
    """``new`` with the next version if it differs from ``old``, else ``old``."""
    if new.with_(version=old.version) == old:
        return old
    raised = new.with_(version=old.version + 1)
    compare(old, raised)
    return raised
