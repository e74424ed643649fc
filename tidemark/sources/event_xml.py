"""Events in XML files: a source that Spark splits by rows, for batches and streams, and a sink.

Names of the root element and the namespace are parameters of the sink; the source takes any. A file's ontology
elements are read with the events skipped and merged on the driver; events become rows on the executors.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from io import BytesIO
from typing import Any, BinaryIO
from xml.etree import ElementTree as ET
from xml.sax.saxutils import quoteattr

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.frame import COLUMNS, EventFrame
from tidemark.functions.scalars import replace_invalid
from tidemark.ontology.check import checked
from tidemark.ontology.model import Ontology, OntologyError
from tidemark.ontology.upgrade import merge_ontologies
from tidemark.ontology.xml import local, ontology_text, parse_ontology, read_ontology
from tidemark.operators import validation
from tidemark.session import cut_lineage

VERSION = re.compile(r"3\.0\.\d+")
#: Files whose numbers may be sent to every executor, and the events that one file has room for.
BROADCAST_FILES, MOST_PLACES = 1_000_000, 1_000_000_000
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
DEFAULT_ROOT = "event-stream"
EVENT_PARTS = "event_type string, source_uri string, properties map<string,array<string>>, attachments map<string,map<string,string>>, parents array<string>, foreign_attribs map<string,string>"


def event_row(node: ET.Element) -> dict[str, Any]:
    """The parts of an ``event`` element."""
    properties: dict[str, list[str]] = {}
    attachments: dict[str, dict[str, str]] = {}
    for part in node:
        for child in part:
            name = local(child.tag)
            if local(part.tag) == "properties":
                properties.setdefault(name, []).append(child.text or "")
            elif local(part.tag) == "attachments":
                attachments.setdefault(name, {})[child.get("id", "")] = child.text or ""
    own = ("event-type", "source-uri", "parents")
    parents = node.get("parents", "")
    return {
        "event_type": node.get("event-type"),
        "source_uri": node.get("source-uri"),
        "properties": {k: sorted(set(v)) for k, v in properties.items()},
        "attachments": attachments,
        "parents": sorted({p for p in parents.split(",") if p}),
        "foreign_attribs": {k: v for k, v in node.attrib.items() if k not in own},
    }


class Nesting:
    """Where a walk over a document is, and whether an element may be there: events and ontologies are right below the
    root, unless values or elements of other vocabularies have these names."""

    def __init__(self) -> None:
        self.names: list[str] = []

    def enter(self, tag: str) -> int:
        name = local(tag)
        if name in ("event", "ontology") and len(self.names) > 1 and self.names[1] in ("event", "ontology") and self.names[-1] not in ("properties", "attachments"):
            raise OntologyError(f"misplaced element {name} in {'/'.join(self.names)}")
        self.names.append(name)
        return len(self.names)

    def leave(self) -> int:
        self.names.pop()
        return len(self.names)


def _stream(source: str | BinaryIO, keep: Sequence[str]) -> Iterator[tuple[str, ET.Element]]:
    """Elements right below the root with one of the names, each dropped after use; the root comes first."""
    root, nesting = None, Nesting()
    for event, node in ET.iterparse(source, events=("start", "end")):
        if event == "start":
            nesting.enter(node.tag)
            if root is None:
                root = node
                yield "root", node
        elif nesting.leave() == 1:
            if local(node.tag) in keep:
                yield local(node.tag), node
            root.clear()


def checked_root(root: ET.Element) -> None:
    version = root.get("version")
    if version is None or not VERSION.fullmatch(version):
        raise OntologyError(f"unsupported version {version}")


def read_file_ontology(source: str | BinaryIO) -> Ontology:
    """All ontology elements of a file, the later ones as upgrades; events are passed over."""
    out = Ontology()
    for name, node in _stream(source, ("ontology",)):
        if name == "root":
            checked_root(node)
        else:
            out = merge_ontologies(out, read_ontology(node))
    return out


def _listed(files: DataFrame, path: str) -> DataFrame:
    """``path`` and ``content`` of files; the content is null where tasks can open the file by its path (``file:``), so that
    none has to be held whole."""
    spark = files.sparkSession
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    return files.select("path", F.lit(None).cast("binary").alias("content") if system.getUri().getScheme() == "file" else "content")


@contextmanager
def _opened(path: str, content: bytes | None) -> Iterator[BinaryIO]:
    """A file as a stream: of its content or, where that is null, of the file itself."""
    with BytesIO(content) if content is not None else open(re.sub("^file:/*", "/", path), "rb") as stream:
        yield stream


def read_ontologies(files: DataFrame) -> Ontology:
    """The ontologies of files (``path``, ``content``), read by all tasks and merged in the order of the files' names. Equal
    ones come to the driver once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _opened(path, content) as stream:
                    texts.append(ontology_text(read_file_ontology(stream)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    found = files.select("path", "content").mapInArrow(run, "path string, text string").groupBy("text").agg(F.min("path").alias("path"))
    out = Ontology()
    for row in found.orderBy("path").collect():
        out = merge_ontologies(out, parse_ontology(row["text"]))
    return out


def scan(spark: SparkSession, path: str, ontology: Ontology, namespace: bool = True) -> DataFrame:
    """Events of large files by the built-in splittable XML reader: a struct of all properties that the ontology knows,
    turned into the map form. Attachments and foreign attributes are not read; ``read_events`` has them."""
    names = sorted({p.name for t in ontology.event_types.values() for p in t.properties})
    schema = T.StructType(
        [
            T.StructField("_event-type", T.StringType()), T.StructField("_source-uri", T.StringType()), T.StructField("_parents", T.StringType()),
            T.StructField("properties", T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in names])),
        ]
    )
    raw = spark.read.format("xml").option("rowTag", "event").option("ignoreNamespace", str(namespace).lower()).option("ignoreSurroundingSpaces", "false").schema(schema).load(path)
    pairs = [x for n in names for x in (F.lit(n), F.coalesce(F.col("properties")[n], F.array().cast("array<string>")))]
    return raw.select(
        F.col("_event-type").alias("event_type"), F.col("_source-uri").alias("source_uri"),
        F.map_filter(F.create_map(*pairs) if pairs else F.create_map().cast(COLUMNS["properties"]), lambda _, v: F.size(v) > 0).alias("properties"),
        F.filter(F.split(F.coalesce("_parents", F.lit("")), ","), lambda p: p != "").alias("parents"),
    )


def parse_events(texts: DataFrame, column: str = "value") -> DataFrame:
    """The parts of events from a column that holds one ``event`` element in each row; malformed ones are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                try:
                    rows.append(event_row(ET.fromstring(text)))
                except (ET.ParseError, TypeError):
                    rows.append(dict.fromkeys(_ARROW.names[2:]))
            yield _batch(rows, _ARROW.names[2:])

    return texts.select(column).mapInArrow(run, EVENT_PARTS)


def _events_of(files: DataFrame) -> DataFrame:
    """``path``, ``place`` and the parts of all events of files (``path``, ``content``), each read as a stream by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: list[dict] = []
                place = 0
                with _opened(path, content) as stream:
                    for name, node in _stream(stream, ("event",)):
                        if name == "root":
                            checked_root(node)
                            continue
                        rows.append({"path": path, "place": place, **event_row(node)})
                        place += 1
                        if len(rows) == 5_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, f"path string, place bigint, {EVENT_PARTS}")


def known_only(df: DataFrame, ontology: Ontology, unknown: str) -> DataFrame:
    """Events of types and sources that the ontology doesn't know are kept, dropped, or an error (``keep``, ``drop``, ``raise``)."""
    if unknown == "keep":
        return df
    known = F.col("event_type").isin(*sorted(ontology.event_types)) & F.col("source_uri").isin(*sorted(ontology.sources))
    known = F.coalesce(known, F.lit(False))
    if unknown == "drop":
        return df.where(known)
    name = F.concat(F.lit("event of unknown type "), F.coalesce("event_type", F.lit("")), F.lit(" or source "), F.coalesce("source_uri", F.lit("")))
    return df.where(F.when(known, True).otherwise(F.raise_error(name).cast("boolean")))


def read_events(spark: SparkSession, path: str, ontology: Ontology | None = None, unknown: str = "raise", check: bool = True) -> EventFrame:
    """Whole files of any file system, each read by one task: all parts of all events, numbered by file, in the order of
    names, and place. Files that the tasks can open by path (``file:``) are read as streams, of any size; those of other
    file systems are held whole (one of more than 2 GB is for ``scan``).

    Without ``ontology`` those of the files are read first, in parallel, merged and, unless ``check`` is off, checked; then each file is read
    again for its events. ``unknown``: what becomes of events of types and sources that the ontology doesn't know.
    """
    files = _listed(spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path), path)
    if ontology is None:
        ontology = read_ontologies(files)
        ontology = checked(ontology) if check else ontology
    names = files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("long").alias("_file"))
    if names.count() <= BROADCAST_FILES:
        names = F.broadcast(names)
    numbered = _events_of(files).join(names, "path").withColumn("event_id", F.col("_file") * MOST_PLACES + F.col("place"))
    return EventFrame.from_events(known_only(numbered, ontology, unknown), ontology)


def stream_events(spark: SparkSession, path: str, ontology: Ontology, unknown: str = "drop", files_per_batch: int = 100) -> EventFrame:
    """The files of a folder as a stream, each read once, when it appears. Ids are hashes of the file's name and the place."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", files_per_batch).load(path)
    files = _listed(files, path)
    numbered = _events_of(files).withColumn("event_id", F.xxhash64("path", "place"))
    return EventFrame.from_events(known_only(numbered, ontology, unknown), ontology)


_ARROW = pa.schema(
    [
        ("path", pa.string()), ("place", pa.int64()), ("event_type", pa.string()), ("source_uri", pa.string()),
        ("properties", pa.map_(pa.string(), pa.list_(pa.string()))), ("attachments", pa.map_(pa.string(), pa.map_(pa.string(), pa.string()))),
        ("parents", pa.list_(pa.string())), ("foreign_attribs", pa.map_(pa.string(), pa.string())),
    ]
)


def _batch(rows: list[dict], names: Sequence[str] = _ARROW.names) -> pa.RecordBatch:
    def pairs(value: Any) -> Any:
        return [(k, pairs(v)) for k, v in value.items()] if isinstance(value, dict) else value

    return pa.RecordBatch.from_pylist([{k: pairs(v) for k, v in r.items()} for r in rows], schema=pa.schema([_ARROW.field(n) for n in names]))


def foreign_elements(path: str, tags: Sequence[str]) -> list[str]:
    """Elements of other vocabularies right below the root of a local file, as texts."""
    return [ET.tostring(n, encoding="unicode") for name, n in _stream(path, tags) if name != "root"]


def event_text() -> Column:
    """Each event as an ``event`` element with its parts sorted; made without Python."""

    def safe(text: Column) -> Column:
        text = replace_invalid(text)
        for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(raw), F.lit(shown))
        return text

    def element(name: Column, value: Column, id: Column | None = None) -> Column:
        attribute = F.lit("") if id is None else F.concat(F.lit(' id="'), safe(id), F.lit('"'))
        return F.concat(F.lit("<"), name, attribute, F.lit(">"), safe(value), F.lit("</"), name, F.lit(">"))

    properties = F.flatten(
        F.transform(F.array_sort(F.map_keys("properties")), lambda k: F.transform(F.array_sort(F.col("properties")[k]), lambda v: element(k, v)))
    )
    attachments = F.flatten(
        F.transform(
            F.array_sort(F.map_keys("attachments")),
            lambda k: F.transform(F.array_sort(F.map_entries(F.col("attachments")[k])), lambda e: element(k, e["value"], e["key"])),
        )
    )
    foreign = F.array_join(F.transform(F.array_sort(F.map_keys("foreign_attribs")), lambda k: F.concat(F.lit(" "), k, F.lit('="'), safe(F.col("foreign_attribs")[k]), F.lit('"'))), "")
    parents = F.when(F.size("parents") > 0, F.concat(F.lit(' parents="'), F.array_join(F.array_sort("parents"), ","), F.lit('"'))).otherwise("")
    return F.concat(
        F.lit('<event event-type="'), safe(F.col("event_type")), F.lit('" source-uri="'), safe(F.col("source_uri")), F.lit('"'), parents, F.coalesce(foreign, F.lit("")),
        F.lit("><properties>"), F.array_join(properties, ""), F.lit("</properties>"),
        F.when(F.size("attachments") > 0, F.concat(F.lit("<attachments>"), F.array_join(attachments, ""), F.lit("</attachments>"))).otherwise(""),
        F.lit("</event>"),
    )


def write_events(frame: EventFrame, path: str, root: str = DEFAULT_ROOT, namespace: str | None = None, foreign: Iterable[str] = ()) -> None:
    """A folder of complete files: every part has the ontology before its events and can be read alone."""
    head = f"<?xml version='1.0' encoding='UTF-8'?>\n<{root}{'' if namespace is None else f' xmlns={quoteattr(namespace)}'} version=\"3.0.0\">\n{ontology_text(frame.ontology)}\n" + "".join(f"{x}\n" for x in foreign)
    tail = f"</{root}>"
    lines = frame.df.select(event_text().alias("value"))

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [head]})
        yield from batches
        yield pa.RecordBatch.from_pydict({"value": [tail]})

    lines.mapInArrow(framed, "value string").write.mode("errorifexists").text(path)


def write_checked(
    frame: EventFrame, path: str, normalize: Mapping[str, Iterable[str]] | None = None, drop: Mapping[str, Iterable[str]] | None = None,
    ignore_invalid: bool = False, root: str = DEFAULT_ROOT, namespace: str | None = None,
) -> dict[str, int]:
    """Writes the events that are valid, after repair of the others: values normalized, then what is still invalid dropped,
    as far as the two maps name properties by event type (``normalize=None``: all). Events that stay invalid are left out
    with ``ignore_invalid``, else an error before anything is written. Gives the numbers of events written, repaired and left
    out, and warns if more than one in ten was repaired."""
    checked_events = cut_lineage(validation.repair(frame, normalize, drop))
    bad = F.size("issues") > 0
    n = checked_events.agg(F.count_if(~bad).alias("written"), F.count_if(F.col("repaired") & ~bad).alias("repaired"), F.count_if(bad).alias("left_out")).first().asDict()
    if n["left_out"] and not ignore_invalid:
        first = checked_events.where(bad).orderBy("event_id").first()
        raise ValueError(f"{n['left_out']} invalid events; event {first['event_id']}: {first['issues']}")
    if 10 * n["repaired"] > n["written"]:
        warnings.warn(f"{n['repaired']} of {n['written']} events had to be repaired", stacklevel=2)
    write_events(frame.with_df(checked_events.where(~bad).select(*COLUMNS)), path, root, namespace)
    return n


def document_parts(frame: EventFrame, root: str = DEFAULT_ROOT, namespace: str | None = None) -> tuple[str, Iterator[tuple[int, str]], str]:
    """A collection as the text before its events, the events with their ids in their order, and the text after them."""
    rows = frame.df.select("event_id", event_text().alias("x")).orderBy("event_id").toLocalIterator()
    head = f"<{root}{'' if namespace is None else f' xmlns={quoteattr(namespace)}'} version=\"3.0.0\">"
    return "\n".join(["<?xml version='1.0' encoding='UTF-8'?>", head, ontology_text(frame.ontology)]), ((r["event_id"], r["x"]) for r in rows), f"</{root}>"


def document(frame: EventFrame, root: str = DEFAULT_ROOT, namespace: str | None = None) -> str:
    """A small collection as one text."""
    head, rows, tail = document_parts(frame, root, namespace)
    return "\n".join([head, *(text for _, text in rows), tail])


class PushReader:
    """Takes a stream in pieces of any size and gives the events that are complete, with the ontology so far."""

    def __init__(self) -> None:
        self.parser, self.ontology, self.root, self.nesting = ET.XMLPullParser(("start", "end")), Ontology(), None, Nesting()
        self.foreign: list[str] = []
        self.counts: dict[str, int] = {}

    def feed(self, data: str | bytes) -> list[dict[str, Any]]:
        self.parser.feed(data)
        out = []
        for event, node in self.parser.read_events():
            if event == "start":
                self.nesting.enter(node.tag)
                if self.root is None:
                    checked_root(node)
                    self.root = node
                continue
            if self.nesting.leave() == 1:
                name = local(node.tag)
                if name == "ontology":
                    self.ontology = merge_ontologies(self.ontology, read_ontology(node))
                elif name == "event":
                    row = event_row(node)
                    if row["event_type"] not in self.ontology.event_types or row["source_uri"] not in self.ontology.sources:
                        raise OntologyError(f"event of unknown type {row['event_type']} or source {row['source_uri']}")
                    self.counts[row["event_type"]] = self.counts.get(row["event_type"], 0) + 1
                    out.append(row)
                else:
                    self.foreign.append(ET.tostring(node, encoding="unicode"))
                self.root.clear()
        return out

    def close(self) -> None:
        self.parser.close()
