"""What a schema is about, in words and as graphs in the DOT language."""

from __future__ import annotations

import json
from collections import defaultdict

from tidemark.ontology.model import Ontology, generalizations, share_branch


def _and(words: list[str]) -> str:
    return words[0] if len(words) == 1 else f"{', '.join(words[:-1])} and {words[-1]}" if words else ""


def describe(ontology: Ontology, producer: str = "producer") -> str:
    """What the events of a producer tell, as reStructuredText: its types, the concepts they find, and their relations."""

    def concept(name: str) -> str:
        found = ontology.concepts.get(name)
        return found.display_name_singular if found and found.display_name_singular else name

    def attribute(object_type: str) -> str:
        found = ontology.object_types.get(object_type)
        return found.display_name_singular if found and found.display_name_singular else object_type

    names = [f"*{t.display_name_plural or n}*" for n, t in sorted(ontology.event_types.items())]
    lines = [f"The {producer} yields {_and(names)}.", ""]
    found: dict[str, set[str]] = defaultdict(set)
    inter: dict[tuple[str, str], set[str]] = defaultdict(set)
    intra: dict[str, set[tuple[str, str]]] = defaultdict(set)
    general: set[tuple[str, str]] = set()
    universal: set[tuple[str, str, str]] = set()
    for n, t in sorted(ontology.event_types.items()):
        for p in t.properties:
            for c in p.concepts:
                found[c.concept].add(attribute(p.object_type))
                general |= {(g, c.concept) for g in generalizations(c.concept) if g in ontology.concepts}
        for r in t.relations:
            if r.type == "inter":
                inter[(r.source_concept, r.target_concept)].add(t.display_name_plural or n)
            elif r.type == "intra":
                intra[r.source_concept].add((attribute(t[r.source].object_type), attribute(t[r.target].object_type)))
            elif r.type in ("name", "description", "container"):
                universal.add((r.type, attribute(t[r.source].object_type), attribute(t[r.target].object_type)))
    if found:
        lines += ["It identifies:", ""] + [f"- {concept(c)} by {_and(sorted(a))}" for c, a in sorted(found.items())] + [""]
    if inter:
        lines += ["It relates:", ""] + [f"- {concept(a)} to {concept(b)}, in {_and(sorted(t))}" for (a, b), t in sorted(inter.items())] + [""]
    if intra:
        lines += ["It extends what is known of:", ""] + [f"- {concept(c)}: {_and([f'{a} by {b}' for a, b in sorted(x)])}" for c, x in sorted(intra.items())] + [""]
    if general:
        lines += ["It makes more precise:", ""] + [f"- {concept(a)}, which may be {concept(b)}" for a, b in sorted(general)] + [""]
    if universal:
        lines += ["It gives:", ""] + [f"- {k}s: {a} of {b}" for k, a, b in sorted(universal)] + [""]
    return "\n".join(lines)


def concept_paths(ontology: Ontology) -> str:
    """How reasoning may go from concept to concept: by relations, and by object types that event types share."""
    lines, places = ["graph {"], []
    for n, t in sorted(ontology.event_types.items()):
        for p in t.properties:
            places += [(n, p.object_type, c.concept) for c in p.concepts]
        for r in t.relations:
            if r.type in ("inter", "intra"):
                a, b = f"{t[r.source].object_type}:{r.source_concept}", f"{t[r.target].object_type}:{r.target_concept}"
                lines.append(f"  {json.dumps(a)} -- {json.dumps(b)} [label={json.dumps(r.predicate or r.type)} style={'solid' if r.type == 'intra' else 'dashed'}]")
    for i, (n, o, c) in enumerate(places):
        for m, q, d in places[i + 1 :]:
            if n != m and o == q and share_branch(c, d):
                lines.append(f"  {json.dumps(n)} -- {json.dumps(m)} [label={json.dumps(o)} style=dotted]")
    return "\n".join([*dict.fromkeys(lines), "}"])


def hierarchy(ontology: Ontology) -> str:
    """Event types and their parents."""
    lines = ["digraph {"] + [f"  {json.dumps(n)}" for n in sorted(ontology.event_types)]
    for n, t in sorted(ontology.event_types.items()):
        if t.parent:
            lines.append(f"  {json.dumps(t.parent.event_type)} -> {json.dumps(n)} [label={json.dumps(t.parent.siblings_description)}]")
    return "\n".join([*lines, "}"])
