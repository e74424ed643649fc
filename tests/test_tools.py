"""Commands, declared types, descriptions and streams."""

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.frame import EventFrame
from tidemark.ontology.describe import concept_paths, describe, hierarchy
from tidemark.ontology.factory import EventTypes
from tidemark.ontology.model import Bricks, Concept, EventSource, ObjectType, OntologyError
from tidemark.operators import replay
from tidemark.sources.event_xml import PushReader, document
from tidemark.streaming import merge as streams


class Declared(EventTypes):
    TYPES = ("ship", "call")
    PROPERTIES = {"ship": {"name": "text", "owner": "text", "seen": "time"}, "call": {"name": "text", "berth": "text"}}
    DISPLAY_NAMES = {"ship": ("ship", "ships")}
    SUMMARIES = {"ship": "[[name]]{ of [[owner]]}", "call": "[[name]]"}
    MERGE = {"ship": {"name": "match", "seen": "min"}, "call": {"name": "match"}}
    SINGLE = {"ship": ("name",), "call": ("name",)}
    CONCEPTS = {"ship": {"name": {"vessel": (9, 200)}, "owner": {"firm": (7, 100)}}, "call": {"name": {"vessel": (8, 100)}}}
    RELATIONS = {"ship": (("inter", "name", "owner", "owned by"), ("name", "name", "owner", ""))}
    TIMESPANS = {"ship": ("seen", None)}
    PARENTS = {"call": ("ship", "calls of", "calling")}
    ATTACHMENTS = {"ship": ("photo",)}


@pytest.fixture(scope="module")
def ontology():
    bricks = Bricks(Concept("vessel", "vessel", "vessels", "a vessel"), Concept("firm", "firm", "firms", "a firm"), ObjectType("time", "time", "times", "a time", "datetime"))
    return Declared.ontology(ObjectType("text", "text", "texts", "a text"), EventSource("/a/", "all"), bricks=bricks)


def test_factory(ontology):
    ship = ontology.event_types["ship"]
    assert ship["seen"].merge == "min" and not ship["seen"].optional and ship.hashed_properties == ["name"]
    assert ontology.event_types["call"].parent.columns == {"name": "name"} and "vessel" in ontology.concepts

    class Wrong(Declared):
        MERGE = {"ship": {"nope": "add"}, "no.type": {}}

    assert len(Wrong.problems()) == 2
    with pytest.raises(OntologyError):
        Wrong.ontology()


def test_descriptions(ontology):
    text = describe(ontology, "harbour feed")
    assert "ships" in text and "vessel to firm" in text
    assert "--" in concept_paths(ontology) and '"ship" -> "call"' in hierarchy(ontology)


@pytest.fixture(scope="module")
def file(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("events") / "a.xml"
    path.write_text(document(replay.dummy_events(spark, 20, 0.5, 3, size=6)))
    return str(path)


@pytest.mark.parametrize(
    "argv,has",
    [
        (["union", "-f", "FILE", "-f", "FILE"], "<event "), (["filter", "-f", "FILE", "-e", "event-type"], "<event "), (["hash", "-f", "FILE", "--sha256"], ""), (["merge", "-f", "FILE"], "<event "), (["merge", "-f", "FILE", "-b", "5", "-l", "2"], "<event "),
        (["replay", "-f", "FILE", "--at-once"], "<event "), (["generate", "--limit", "4", "-r", "200", "--content-size", "70", "--random-content"], "<content id="), (["stats", "-f", "FILE"], "event-type.a"), (["stats", "-f", "FILE", "--property-stats", "event-type.a"], "property-a"),
        (["delimited", "-f", "FILE", "event-type.a", "-p", "property-a,version", "--with-header"], "property-a\tversion"), (["text", "-f", "FILE", "-s"], "Dummy event"),
        (["template-test", "-f", "FILE", "event-type.a"], "Dummy event"), (["generate", "--limit", "3"], "<event "),
    ],
)
def test_commands(spark, file, capsys, argv, has):
    assert cli.main([file if a == "FILE" else a for a in argv]) == 0
    assert has in capsys.readouterr().out


def test_commands_with_status(spark, file, tmp_path, capsys):
    other = tmp_path / "b.xml"
    other.write_text(document(replay.dummy_events(spark, 5, 0.0, 3, seed=9, size=6)))
    assert cli.main(["diff", "-f", file, "-f", str(other)]) == 1 and cli.main(["diff", "-f", file, "-f", file]) == 0
    assert cli.main(["validate", "-f", file]) == 0
    bad = tmp_path / "c.xml"
    bad.write_text(other.read_text().replace("<version>", "<nope>").replace("</version>", "</nope>"))
    assert cli.main(["validate", "-f", str(bad)]) == 1
    with pytest.raises(SystemExit):
        cli.main(["union", "-f", file])
    capsys.readouterr()


def test_paces():
    now, waits = [0.0], []

    def sleep(seconds):
        waits.append(round(seconds, 6))
        now[0] += seconds

    def slow(items):
        for at, item in items:
            now[0] += 0.3 if item == "late" else 0.0
            yield at, item

    got = list(replay.paced(slow([(0.0, "a"), (0.5, "b"), (0.6, "late"), (1.5, "c")]), lambda: now[0], sleep))
    # the late one comes at once, and the next one at its own time
    assert got == ["a", "b", "late", "c"] and waits == [0.5, 0.7]
    assert list(replay.at_rate("xyz", 4)) == [(0.0, "x"), (0.25, "y"), (0.5, "z")] and list(replay.at_rate("xy", 0)) == [(0.0, "x"), (0.0, "y")]


def test_made_up_contents(spark):
    made = replay.dummy_events(spark, 5, 0.0, 3, content_size=100, random_content=True, random_objects=False)
    rows = made.df.collect()
    texts = {t for r in rows for t in r["attachments"]["content"].values()}
    assert len(texts) == 5 and {len(t) for t in texts} == {100} and made.ontology.event_types["event-type.a"].attachment("content")
    assert len({tuple(r["properties"]["property-b"]) for r in rows}) == 1


def test_reader_rejects(file):
    text = open(file).read()
    with pytest.raises(OntologyError):
        PushReader().feed(text.replace('version="3.0.0"', 'version="2.0.0"', 1))
    with pytest.raises(OntologyError):
        PushReader().feed(text.replace('event event-type="event-type.a"', 'event event-type="other"', 1))


def test_streams(spark, tmp_path):
    frame = replay.dummy_events(spark, 60, 0.7, 4)
    frame.df.repartition(3).write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(frame.df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    run = streams.buffered_merge(EventFrame(rows, frame.ontology), lambda f, n: got.append(f.df.count())).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert len(got) == 3 and sum(got) >= 4
    counted = streams.type_counts(frame.df.withColumn("t", F.timestamp_seconds("event_id")), F.col("t"), "30 seconds", "1 minute")
    assert sorted(r["n_events"] for r in counted.collect()) == [30, 30]
    slid = streams.type_counts(frame.df.withColumn("t", F.timestamp_seconds("event_id")), F.col("t"), "30 seconds", "1 minute", "10 seconds")
    assert slid.agg(F.sum("n_events")).first()[0] == 180
