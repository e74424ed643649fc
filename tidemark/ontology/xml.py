"""Schemas as XML. Names of the root element and the namespace are parameters; readers accept any."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from typing import Any, TypeVar
from xml.etree import ElementTree as ET

from tidemark.ontology.model import (
    Attachment, Bricks, Concept, Element, EventProperty, EventSource, EventType, ObjectType, Ontology, OntologyError, Parent, PropertyConcept, Relation,
)

E = TypeVar("E", bound=Element)
#: Containers of a schema, what they hold, and the part of the ontology it belongs to; in the order they are written.
CONTAINERS = (
    ("object-types", "object-type", ObjectType, "object_types"),
    ("concepts", "concept", Concept, "concepts"),
    ("event-types", "event-type", EventType, "event_types"),
    ("sources", "source", EventSource, "sources"),
)


def local(tag: str) -> str:
    """A tag without its namespace."""
    return tag.rpartition("}")[2]


def _kids(node: ET.Element, *path: str) -> Iterator[ET.Element]:
    for child in node:
        if isinstance(child.tag, str) and local(child.tag) == path[0]:
            if len(path) == 1:
                yield child
            else:
                yield from _kids(child, *path[1:])


def _parse(text: str, kind: str) -> Any:
    if kind.startswith("bool"):
        return text == "true"
    return int(text) if kind.startswith("int") else text


def _read(node: ET.Element, kind: type[E], **more: Any) -> E:
    values = dict(more)
    for name, f in kind.notes().items():
        text = node.get(f.metadata["xml"])
        if text is not None:
            try:
                values[name] = _parse(text, f.type)
            except ValueError:
                raise OntologyError(f"{f.metadata['xml']}={text!r} of a {local(node.tag)} is not a number") from None
        elif f.default is dataclasses.MISSING:
            raise OntologyError(f"a {local(node.tag)} lacks its {f.metadata['xml']}")
    return kind(**values)


def read_event_type(node: ET.Element) -> EventType:
    properties = tuple(
        _read(p, EventProperty, concepts=tuple(_read(c, PropertyConcept) for c in _kids(p, "property-concept")))
        for p in _kids(node, "properties", "property")
    )
    relations = tuple(
        _read(r, Relation, type=local(r.tag)) for group in _kids(node, "relations") for r in group if isinstance(r.tag, str)
    )
    attachments = tuple(_read(a, Attachment) for a in _kids(node, "attachments", "attachment"))
    parent = None
    for p in _kids(node, "parent"):
        pairs = tuple(sorted(tuple(x.strip().split(":", 1)) for x in p.get("property-map", "").split(",") if ":" in x))
        parent = _read(p, Parent, property_map=pairs)
    return _read(node, EventType, properties=properties, relations=relations, attachments=attachments, parent=parent)


def read_ontology(node: ET.Element) -> Ontology:
    """The ontology in an ``ontology`` element."""
    out = Ontology()
    for container, tag, kind, _ in CONTAINERS:
        for child in _kids(node, container, tag):
            out = out.put(read_event_type(child) if kind is EventType else _read(child, kind))
    return out


def parse_ontology(text: str | bytes) -> Ontology:
    """The ontology in a text: its root, or all ontology elements below it, the later ones as upgrades."""
    from tidemark.ontology.upgrade import merge_ontologies

    root = ET.fromstring(text)
    found = [root] if local(root.tag) == "ontology" else list(_kids(root, "ontology"))
    out = Ontology()
    for node in found:
        out = merge_ontologies(out, read_ontology(node))
    return out


def _write(tag: str, item: Element) -> ET.Element:
    node = ET.Element(tag)
    for name, f in item.notes().items():
        value = getattr(item, name)
        if value is None or (f.metadata["omit"] and value == f.default):
            continue
        node.set(f.metadata["xml"], {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value))
    return node


def write_event_type(item: EventType) -> ET.Element:
    node = _write("event-type", item)
    if item.parent:
        parent = _write("parent", item.parent)
        parent.set("property-map", ",".join(f"{c}:{p}" for c, p in item.parent.property_map))
        node.append(parent)
    properties = ET.SubElement(node, "properties")
    for p in sorted(item.properties, key=lambda p: p.name):
        own = _write("property", p)
        own.extend(_write("property-concept", c) for c in sorted(p.concepts, key=lambda c: c.concept))
        properties.append(own)
    for container, parts in (("relations", item.relations), ("attachments", item.attachments)):
        if parts:
            group = ET.SubElement(node, container)
            if container == "relations":
                group.extend(_write(r.type, r) for r in sorted(parts, key=lambda r: r.id))
            else:
                group.extend(_write("attachment", a) for a in sorted(parts, key=lambda a: a.name))
    return node


def write_ontology(ontology: Ontology) -> ET.Element:
    """An ``ontology`` element with everything sorted by name."""
    root = ET.Element("ontology")
    for container, tag, kind, part in CONTAINERS:
        group = ET.SubElement(root, container)
        for _, item in sorted(getattr(ontology, part).items()):
            group.append(write_event_type(item) if kind is EventType else _write(tag, item))
    return root


def ontology_text(ontology: Ontology, indent: bool = True) -> str:
    root = write_ontology(ontology)
    if indent:
        ET.indent(root)
    return ET.tostring(root, encoding="unicode")


def brick_text(bricks: Bricks) -> str:
    """Shared definitions as an ``ontology`` element."""
    return ontology_text(Ontology().put(*bricks.elements.values()))
