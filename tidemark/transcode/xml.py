"""XML records turned into events. A document is parsed once; each element goes to the first transcoder whose path selects
it, with the values that the transcoder's paths select in it."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.frame import COLUMNS, TEXTS, EventFrame
from tidemark.ontology.model import EventSource, Ontology
from tidemark.ontology.xml import local
from tidemark.transcode.records import Mediator, Transcoder, event_parts

ROW = "_spec int, _tag string, _values map<string,array<string>>"
_ARROW = pa.schema([("_spec", pa.int32()), ("_tag", pa.string()), ("_values", pa.map_(pa.string(), pa.list_(pa.string())))])
#: What an element is that no transcoder takes, and a text that can't be parsed.
UNKNOWN, BROKEN = -1, -2


def path_pattern(path: str) -> re.Pattern:
    """A path of tags as a pattern for the paths of elements: ``*`` is any tag, ``//`` any number of them; a path without a
    slash at its start may begin anywhere."""
    steps = path.strip("/") if not path.startswith("//") else path
    text = "/".join("[^/]+" if s == "*" else "(?:[^/]+/)*" if s == "" else re.escape(s) for s in steps.strip("/").split("/"))
    text = text.replace("(?:[^/]+/)*/", "(?:[^/]+/)*")
    return re.compile(("/" if path.startswith("/") and not path.startswith("//") else "/(?:[^/]+/)*") + text)


def walk(root: ET.Element, choose: Callable[[str], int | None], discards: frozenset[int]) -> Iterator[tuple[int, str, ET.Element]]:
    """Each element in the order of the document, with its path and the number of the transcoder that takes it, or
    ``UNKNOWN``. What a discarding transcoder takes is passed over with all that is in it."""
    todo = [(root, f"/{local(root.tag)}")]
    while todo:
        element, path = todo.pop()
        number = choose(path)
        if number in discards:
            continue
        yield (UNKNOWN if number is None else number), path, element
        todo += [(child, f"{path}/{local(child.tag)}") for child in reversed(element) if isinstance(child.tag, str)]


def bare(root: ET.Element) -> ET.Element:
    """The tree with its tags without namespaces, so that paths need none."""
    for element in root.iter():
        if isinstance(element.tag, str):
            element.tag = local(element.tag)
    return root


def select(element: ET.Element, path: str, root: ET.Element) -> list[str]:
    """The texts that a path selects in an element, or from the root on if it begins with a slash: of elements (all text
    in them), of attributes (``@name``) or of an element's own text (``text()``)."""
    at = element
    if path.startswith("/") and not path.startswith("//"):
        first, _, path = path[1:].partition("/")
        if first not in ("*", root.tag):
            return []
        at = root
    head, _, last = path.rpartition("/")
    own = last == "text()" or last.startswith("@")
    where = head if own else path
    found = [at] if where in ("", ".") else at.findall(f".{where}" if where.startswith("//") else where)
    if last.startswith("@"):
        return [v for e in found if (v := e.get(last[1:])) is not None]
    if last == "text()":
        return [t for e in found for t in [e.text, *(c.tail for c in e)] if t]
    return [t for e in found if (t := "".join(e.itertext()))]


class XmlMediator:
    """Transcoders by the path of the elements they take; of several the first registered one that selects an element
    takes it, and no other. Elements in a taken one may be taken by transcoders of their own."""

    def __init__(self, ontology: Ontology, source: str = "/", ignore_invalid: bool = False) -> None:
        self.base = Mediator(ontology if source in ontology.sources else ontology.put(EventSource(source)), source)
        self.base.ignore_invalid = ignore_invalid
        self.specs: list[tuple[str, Transcoder]] = []

    @property
    def ontology(self) -> Ontology:
        return self.base.ontology

    def register(self, path: str, spec: Transcoder) -> XmlMediator:
        """``path`` selects elements in a document (``/a/b``, ``b``, ``//b``, ``/a/*``). A discarding transcoder takes its
        elements, and all that is in them, out of the way of later ones. ``spec.explode`` is a path in the element to
        parts that become an event each; paths of values then are those in the part."""
        if any(p == path for p, _ in self.specs):
            raise ValueError(f"there is a transcoder for {path}")
        self.specs.append((path, spec.check()))
        if spec.event_type is not None and spec.event_type.name not in self.ontology.event_types:
            self.base.ontology = self.ontology.put(spec.event_type)
        return self

    def elements(self, df: DataFrame, column: str) -> DataFrame:
        """``_spec`` (the transcoder's number), ``_tag`` and ``_values`` (texts by path) of each element of each document, in
        one pass; null texts have none."""
        patterns = [path_pattern(p) for p, _ in self.specs]
        discards = frozenset(n for n, (_, s) in enumerate(self.specs) if s.event_type is None)
        wanted = [([*s.properties, *s.attachments], s.explode) for _, s in self.specs]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, int | None] = {}

            def choose(path: str) -> int | None:
                if path not in known:
                    known[path] = next((n for n, p in enumerate(patterns) if p.fullmatch(path)), None)
                return known[path]

            for batch in batches:
                for text in batch.column(0).to_pylist():
                    rows: list[tuple] = []
                    try:
                        root = None if text is None else bare(ET.fromstring(text))
                    except ET.ParseError:
                        root = None
                        rows.append((BROKEN, None, []))
                    for number, _, element in () if root is None else walk(root, choose, discards):
                        paths, parts = wanted[number] if number >= 0 else ([], None)
                        for part in [element] if parts is None else element.findall(parts):
                            rows.append((number, element.tag, [(p, select(part, p, root)) for p in paths]))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

        return df.select(column).mapInArrow(run, ROW)

    def transcode(self, df: DataFrame, column: str) -> EventFrame:
        """The events of all documents, from one pass over them; invalid ones are repaired as far as allowed, then left out
        or an error, as are texts that can't be parsed. ``df`` may be a stream."""
        made = [(n, s) for n, (_, s) in enumerate(self.specs) if s.event_type is not None]
        if not made:
            raise ValueError("no transcoder makes events")
        rows = self.elements(df, column).where(F.col("_spec") != UNKNOWN)
        if self.base.ignore_invalid:
            rows = rows.where(F.col("_spec") != BROKEN)
        else:
            rows = rows.where(F.when(F.col("_spec") == BROKEN, F.raise_error(F.lit("a text is no XML document")).cast("boolean")).otherwise(True))
        at = lambda path: F.col("_values")[path]
        if self.base.closed:
            raise ValueError("the mediator is closed")
        parts = {n: event_parts(s, at, self.base.guard) for n, s in made}

        def chosen(of: Callable[[int, Transcoder], object]):
            return reduce(lambda out, x: out.when(F.col("_spec") == x[0], of(*x)), made[1:], F.when(F.col("_spec") == made[0][0], of(*made[0])))

        events = rows.select(
            # a stream has no numbers that go on from batch to batch
            (F.xxhash64("_spec", F.to_json("_values")) if df.isStreaming else F.monotonically_increasing_id()).alias("event_id"),
            chosen(lambda n, s: F.lit(s.event_type.name)).alias("event_type"),
            F.lit(self.base.source).alias("source_uri"),
            chosen(lambda n, s: parts[n][0]).alias("properties"),
            chosen(lambda n, s: parts[n][1]).alias("attachments"),
            F.array().cast(TEXTS).alias("parents"),
            F.create_map().cast(COLUMNS["foreign_attribs"]).alias("foreign_attribs"),
        )
        # edits may give several rows or none; each reads its own events
        edited = [s for _, s in made if s.edit is not None]
        names = [s.event_type.name for s in edited]
        out = events.where(~F.col("event_type").isin(*names)) if names else events
        for s in edited:
            out = out.unionByName(s.edit(events.where(F.col("event_type") == s.event_type.name)))
        return self.base.checked(EventFrame.from_events(out, self.ontology))

    def unknown(self, df: DataFrame, column: str, tags: Sequence[str]) -> DataFrame:
        """How many elements with one of the tags no transcoder takes: ``tag`` and ``n``."""
        stray = self.elements(df, column).where((F.col("_spec") == UNKNOWN) & F.col("_tag").isin(*tags))
        return stray.groupBy(F.col("_tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))
