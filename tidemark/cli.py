"""Commands over event files: ``python -m tidemark.cli COMMAND …``."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import EventFrame
from tidemark.functions import template
from tidemark.mining.results import Knowledge, dot_instances, dot_reasons
from tidemark.ontology.check import ontology_errors
from tidemark.operators import compare, filters, merge, render, replay, stats, validation
from tidemark.sources.event_xml import document, document_parts, read_events


def _session() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _show(df: DataFrame, column: str | None = None) -> None:
    for row in df.toLocalIterator():
        print(row[column] if column else "\t".join("" if v is None else str(v) for v in row))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, about: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=about)
        c.add_argument("-f", "--file", action="append", default=[], help="an event file or a folder of them; may be repeated")
        c.add_argument("-v", "--verbose", action="count", default=0)
        c.add_argument("-q", "--quiet", action="store_true")
        return c

    command("union", "all events of several files under one ontology")
    command("diff", "how two files differ; the status tells whether they do")
    c = command("filter", "events by type and source")
    c.add_argument("-s", "--source-uri")
    c.add_argument("-e", "--event-type")
    c = command("hash", "the hash of each event")
    c.add_argument("--sha256", action="store_true")
    c = command("merge", "colliding events merged")
    c.add_argument("-b", "--buffer", type=int, default=0)
    c.add_argument("-l", "--max-latency", type=float, default=0)
    c = command("mine", "concept instances in events")
    c.add_argument("--min-confidence", type=float, default=0.1)
    c.add_argument("--max-depth", type=int, default=10)
    c.add_argument("--tell", action="store_true")
    c.add_argument("--with-reasons", action="store_true")
    c.add_argument("--dump-json", action="store_true")
    c.add_argument("--dump-concept-graph", action="store_true")
    c.add_argument("--dump-mining-graph", action="store_true")
    c = command("replay", "events moved to now")
    c.add_argument("-s", "--speed", type=float, default=1.0)
    c.add_argument("--at-once", action="store_true", help="without waiting between events")
    c = command("stats", "counts")
    c.add_argument("-c", "--count", action="store_true")
    for name in ("event-types", "object-types", "source-uris", "concepts"):
        c.add_argument(f"--{name}", action="store_true")
    c.add_argument("--object-values", metavar="TYPE")
    c.add_argument("--property-stats", metavar="TYPE")
    c = command("generate", "made-up events")
    c.add_argument("-r", "--rate", type=float, default=0)
    c.add_argument("-c", "--collisions", type=float, default=0.0)
    c.add_argument("-d", "--diversity", type=int, default=100)
    c.add_argument("--limit", type=int, default=100)
    c.add_argument("--object-size", type=int, default=12)
    c.add_argument("--content-size", type=int, default=0)
    c.add_argument("--random-objects", action="store_true")
    c.add_argument("--random-content", action="store_true")
    c.add_argument("--event-type-name", default="event-type.a")
    c.add_argument("--object-type-name", default="object-type.a")
    c = command("delimited", "one line for each combination of values")
    c.add_argument("event_type")
    c.add_argument("-p", "--properties")
    c.add_argument("-a", "--attachments")
    c.add_argument("-d", "--delimiter", default="\t")
    c.add_argument("--with-header", action="store_true")
    c = command("text", "the story of each event")
    c.add_argument("-s", "--short", action="store_true")
    c.add_argument("-c", "--colored", action="store_true")
    c = command("template-test", "how the templates of a type degrade")
    c.add_argument("event_type")
    c.add_argument("-s", "--short", action="store_true")
    c.add_argument("-c", "--colored", action="store_true")
    command("validate", "whether files are valid; the status tells")
    return p


def _read(spark: SparkSession, files: Sequence[str], check: bool) -> list[EventFrame]:
    if not files:
        raise SystemExit("name a file with -f")
    return [read_events(spark, f, unknown="raise" if check else "keep", check=check) for f in files]


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.ERROR if args.quiet else logging.WARNING - 10 * min(2, args.verbose))
    spark = _session()
    if args.command == "generate":
        own = replay.dummy_ontology(args.collisions > 0, args.event_type_name, args.object_type_name)
        made = replay.dummy_events(
            spark, args.limit, args.collisions, args.diversity, ontology=own, size=args.object_size, content_size=args.content_size, random_objects=args.random_objects, random_content=args.random_content
        )
        return _print_paced(made, lambda rows: replay.at_rate((text for _, text in rows), args.rate))
    frames = _read(spark, args.file, args.command != "validate")
    frame = compare.concatenate(*frames) if args.command in ("union", "stats", "validate") else frames[0]
    return globals()[f"_{args.command.replace('-', '_')}"](args, frame, frames)


def _print_paced(frame: EventFrame, timed: Callable[[Iterator[tuple[int, str]]], Iterable[tuple[float, str]]]) -> int:
    """A collection printed event by event, each at its time."""
    head, rows, tail = document_parts(frame)
    print(head)
    for text in replay.paced(timed(rows)):
        print(text, flush=True)
    print(tail)
    return 0


def _union(args: argparse.Namespace, frame: EventFrame, frames: list[EventFrame]) -> int:
    if len(frames) < 2:
        raise SystemExit("union takes two files or more")
    print(document(frame))
    return 0


def _diff(args: argparse.Namespace, frame: EventFrame, frames: list[EventFrame]) -> int:
    if len(frames) != 2:
        raise SystemExit("diff takes two files")
    found = False
    for line in compare.difference_lines(compare.difference(*frames)):
        print(line)
        found = True
    return int(found)


def _filter(args: argparse.Namespace, frame: EventFrame, frames: list[EventFrame]) -> int:
    print(document(filters.filter_events(frame, args.event_type, args.source_uri)))
    return 0


def _hash(args: argparse.Namespace, frame: EventFrame, frames: list[EventFrame]) -> int:
    _show(frame.hashed("sha256" if args.sha256 else "sha1").orderBy("event_id"), "sticky_hash")
    return 0


def _merge(args: argparse.Namespace, frame: EventFrame, frames: list[EventFrame]) -> int:
    # a latency bounds the wait for a buffer to fill; a file is there at once
    print(document(merge.merge_in_buffers(frame, args.buffer) if args.buffer > 1 else merge.checked_merge(frame)))
    return 0


def _mine(args: argparse.Namespace, frame: EventFrame, frames: list[EventFrame]) -> int:
    knowledge = Knowledge.mine(frame, args.min_confidence, args.max_depth)
    if args.tell or args.with_reasons:
        told = knowledge.narrate().orderBy("seed", "depth", "node")
        _show(told if args.with_reasons else told.withColumn("sentence", F.regexp_replace("sentence", r" because of .*", "")), "sentence")
    if args.dump_concept_graph:
        print(dot_instances(knowledge))
    if args.dump_mining_graph:
        print(dot_reasons(knowledge))
    if args.dump_json:
        print(knowledge.to_json())
    return 0


def _replay(args: argparse.Namespace, frame: EventFrame, frames: list[EventFrame]) -> int:
    """Events in the order of their times, each when its time has come; ``--at-once`` doesn't wait."""
    moved = replay.shifted(frame, F.current_timestamp(), args.speed)
    offsets = {r["event_id"]: r["offset_seconds"] for r in replay.delays(frame, args.speed).select("event_id", "offset_seconds").toLocalIterator()}

    def timed(rows: Iterator[tuple[int, str]]) -> Iterable[tuple[float, str]]:
        return sorted((0.0 if args.at_once else offsets.get(n, 0.0), text) for n, text in rows)

    return _print_paced(moved, timed)


def _stats(args: argparse.Namespace, frame: EventFrame, frames: list[EventFrame]) -> int:
    asked = [
        (args.count, lambda: frame.df.agg(F.count(F.lit(1)).alias("n"))),
        (args.event_types, lambda: stats.event_type_counts(frame).orderBy(F.desc("n_events"), "event_type")),
        (args.source_uris, lambda: stats.source_counts(frame).orderBy("source_uri")),
        (args.object_types, lambda: stats.object_type_counts(frame).orderBy("object_type")),
        (args.concepts, lambda: stats.concept_counts(frame).orderBy("concept")),
        (args.object_values, lambda: stats.value_histogram(frame, args.object_values).orderBy(F.desc("n_values"), "value")),
        (args.property_stats, lambda: stats.property_stats(frame, args.property_stats).orderBy("property")),
    ]
    every = not any(a for a, _ in asked)
    for wanted, make in asked[: 5 if every else None]:
        if wanted or every:
            _show(make())
    if every:
        _show(stats.covered_times(frame).orderBy("event_type"))
    return 0


def _delimited(args: argparse.Namespace, frame: EventFrame, frames: list[EventFrame]) -> int:
    names = [None if x is None else x.split(",") for x in (args.properties, args.attachments)]
    _show(render.delimited(frame, args.event_type, *names, args.delimiter, args.with_header).orderBy("event_id"), "line")
    return 0


def _text(args: argparse.Namespace, frame: EventFrame, frames: list[EventFrame]) -> int:
    _show(render.texts(frame, args.short, args.colored).orderBy("event_id"), "text")
    return 0


def _template_test(args: argparse.Namespace, frame: EventFrame, frames: list[EventFrame]) -> int:
    own = frame.ontology.event_types[args.event_type]
    text = own.summary if args.short else own.story
    names = {n: (o.display_name_singular or n, o.display_name_plural or n) for n, o in frame.ontology.object_types.items()}
    for properties, attachments, shown in template.collapsed(frame.df.sparkSession, text, own, frame.kinds(own.name), names):
        print(f"{', '.join(sorted(properties | attachments)) or 'nothing'} omitted: {shown}")
    unused = sorted(set(own.by_name) - set(template.property_names(text)))
    if unused:
        print(f"not used: {', '.join(unused)}", file=sys.stderr)
    return 0


def _validate(args: argparse.Namespace, frame: EventFrame, frames: list[EventFrame]) -> int:
    wrong = ontology_errors(frame.ontology)
    print("\n".join(wrong), end="\n" if wrong else "")
    bad = validation.reason_counts(validation.validate(frame)).orderBy("event_type", "property", "reason").collect()
    for row in bad:
        print(f"{row['event_type']}, {row['property']}: {row['reason']} ({row['n_events']})")
    return int(bool(wrong or bad))


if __name__ == "__main__":
    sys.exit(main())
