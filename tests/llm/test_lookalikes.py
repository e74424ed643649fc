import pytest

from tidemark.llm.lookalikes import alike, dominant_script, find_lookalikes, repair_texts

VALUES = "record_kind string, record_id bigint, _field string, _text string, text string, ref_id bigint"
NAMES = ["Pearl Tempête", "Kai Süd-3", "frozen fly ash", "Тихий Сокол", "Παλαιά Βροχή", "カモメ丸", "Official Brücke", "Ship's waste"]
PAIRS = [
    ("Реаrl Tempête", "Pearl Tempête"), ("Pearl Tempête", "Pearl Tempête"), ("Pearl Tempête", "Pearl Tempête"), ("P​earl Temp­ête﻿", "Pearl Tempête"),
    ("Ｐｅａｒｌ　Ｔｅｍｐｅ̂ｔｅ", "Pearl Tempête"), ("Кai Süd‑3", "Kai Süd-3"), ("frоzеn fӏу аѕһ", "frozen fly ash"), ("Tихий Coкол", "Тихий Сокол"),
    ("Пαλαιά Bρоχή", "Παλαιά Βροχή"), ("ｶﾓﾒ丸", "カモメ丸"), ("Oﬃcial Brücke", "Official Brücke"), ("Shipʼs waste", "Ship's waste"), ("Οffісіɑӏ Вrüсkе", "Official Brücke"),
]
OTHERS = ["pearl tempête", "Pearl  Tempête", "Pearl\tTempête", " Pearl Tempête", "Pearl Tempête.", "PearlTempête", "Pearl Tempete", "Pear1 Tempête", "Kai Süd 3", "", "Pearl  Tempête"]


def repaired(spark, texts, names, field="f"):
    refs = spark.createDataFrame([(i, field, n) for i, n in enumerate(names)], "ref_id bigint, field_name string, text string")
    rows = spark.createDataFrame([(field, t, "clash") for t in texts], "_field string, _text string, token string")
    return {r["_text"]: r["_repaired"] for r in repair_texts(rows, refs).collect()}


def test_repaired(spark):
    got = repaired(spark, [t for t, _ in PAIRS], NAMES)
    assert got == dict(PAIRS) and all(alike(a, b) for a, b in PAIRS)


def test_others_stay_unequal(spark):
    got = repaired(spark, OTHERS, NAMES)
    assert not set(got.values()) & set(NAMES)
    assert not any(alike(text, n) for text in OTHERS for n in NAMES)


def test_a_token_that_is_known_in_one_script_is_repaired_in_another(spark):
    # the last letter is Cyrillic, and a token of the other reference
    assert repaired(spark, ["Bar А", "Ваr А", "Ваr A"], ["Bar A", "Бар А"]) == {"Bar А": "Bar A", "Ваr А": "Bar A", "Ваr A": "Bar A"}


def test_tokens_are_repaired_without_a_whole_reference(spark):
    assert repaired(spark, ["Вlue Moon", "Ѕtar"], ["Blue Star"]) == {"Вlue Moon": "Blue Moon", "Ѕtar": "Star"}


def test_only_tokens_that_mix_scripts_take_the_corpus_spelling(spark):
    # "Моле" in one script is frequent in the corpus; the mixed token becomes it, and so does no token in one script
    texts = ["Моле x", "Моле y", "Моле z", "Моле q", "Moлe w", "Mole r"]
    got = repaired(spark, texts, ["nothing"])
    assert got["Moлe w"] == "Моле w" and got["Mole r"] == "Mole r" and got["Моле x"] == "Моле x"


def test_scripts():
    assert dominant_script("Bаr") == ("LATIN", True) and dominant_script("カモメ丸") == ("CJK", False) and dominant_script("12-3") == ("", False)


def found(spark, values, reference):
    rows = [(*v, "clash", 99) for v in values]
    refs = spark.createDataFrame(reference, "ref_id bigint, field_name string, text string")
    return sorted(map(tuple, find_lookalikes(spark.createDataFrame(rows, VALUES), refs).collect()))


REFERENCE = [(1, "vessel", "Pearl Tempête"), (2, "goods", "Pearl Tempête"), (3, "vessel", None), (4, None, "x"), (5, "vessel", "abc"), (6, "vessel", "abc")]


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_find(spark, threshold):
    values = [("event", 1, "vessel", "Реаrl Tempête"), ("event", 1, "vessel", "Реаrl Tempête"), ("event", 2, "vessel", "Pearl Tempête"), ("event", 3, "vessel", None),
              ("event", 4, "other", "Реаrl Tempête"), ("event", 5, "vessel", "аbc"), ("event", 6, "vessel", ""), ("event", 7, "vessel", "ж" * 200_000), (None, None, None, None)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        assert found(spark, values, REFERENCE) == [("event", 1, 1), ("event", 5, 5), ("event", 5, 6)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty(spark):
    assert found(spark, [], REFERENCE) == [] and found(spark, [("event", 1, "vessel", "а")], []) == []


def test_query_finds_all_that_look_alike(spark, data):
    from tidemark.llm import queries
    from tidemark.session import table

    refs = [(r["field_name"], r["text"], r["ref_id"]) for r in table(spark, data, "reference_text").collect()]
    wanted = set()
    events = [(r["event_id"], r["properties"]) for r in table(spark, data, "parsed_event").select("event_id", "properties").collect()]
    rows = [("event", i, f, v) for i, p in events for f in queries.NAME_FIELDS for v in (p or {}).get(f) or [] if v is not None]
    rows += [("event_type", r["decl_id"], "event_type.description", r["description"]) for r in table(spark, data, "event_type").collect() if r["description"] is not None]
    equal = {(f, t) for f, t, _ in refs}
    for kind, i, f, v in rows:
        if (f, v) not in equal:
            wanted |= {(kind, i, n) for g, t, n in refs if g == f and alike(v, t)}
    assert {tuple(r) for r in queries.p2_found(spark, data).collect()} == wanted and wanted
