import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.consensus import alignment, by_rank, choose_values, distance, elected, nearest

SCHEMA = "id bigint, g string, text string, trust int, at bigint, _text string, _rank int"


def chosen(spark, rows, weights=None, hot_rows=None, keys=("g",)):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    out = choose_values(df, keys, "id", {"text": F.col("text")}, [F.col("trust"), F.col("at")], weights, hot_rows=hot_rows)
    return {r["g"]: (r["text"]["value"], r["text"]["id"]) for r in out.collect()}


def test_best_rank_wins_nulls_last_and_ties_by_id(spark):
    rows = [(1, "a", "x", None, 9), (2, "a", "y", 1, None), (3, "a", "z", 1, 5), (4, "a", "w", 1, 5), (5, "a", None, 9, 9), (6, "a", " ", 9, 9)]
    for hot in (None, 0):
        for order in itertools.islice(itertools.permutations(rows), 0, 700, 350):
            assert chosen(spark, order, hot_rows=hot) == {"a": ("z", 3)}
    assert chosen(spark, rows[:1]) == {"a": ("x", 1)}
    assert chosen(spark, rows[:2]) == {"a": ("y", 2)}


def test_weighted_tokens_elect_the_value_nearest_to_all(spark):
    texts = ["time of the crane lift", "the time of crane lift", "time of the crane lift given", "time of the grane lift", "another thing"]
    rows = [(i, "a", t, 1, 1) for i, t in enumerate(texts)]
    for hot in (None, 0):
        assert chosen(spark, rows, {"text": F.lit(1)}, hot) == {"a": ("time of the crane lift", 0)}


def test_repeated_rows_vote_once(spark):
    rows = [(1, "a", "p", 1, 1)] * 5 + [(2, "a", "q", 1, 1), (3, "a", "q", 1, 1)]
    for hot in (None, 0):
        assert chosen(spark, rows, {"text": F.lit(1)}, hot)["a"][0] == "q"


@pytest.mark.parametrize("weighted", [True, False])
def test_hot_groups_give_what_others_give(spark, weighted):
    rng, words = random.Random(5), "the time when a lift of the crane began or ended here".split()
    rows = []
    for i in range(900):
        own = [w for w in words if rng.random() < 0.8]
        if rng.random() < 0.3:
            own.insert(rng.randrange(len(own) + 1), rng.choice(["new", "old", "the"]))
        # one group has a third of all rows
        rows.append((i, "hot" if i % 3 == 0 else f"g{i % 40}", " ".join(own), rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2])))
    weights = {"text": F.coalesce("trust", F.lit(0)) + 0.5} if weighted else None
    want = chosen(spark, rows, weights)
    assert len(want) == 41
    for hot in (100, 15, 0):
        assert chosen(spark, rows, weights, hot) == want


def test_null_keys_ids_and_empty(spark):
    assert chosen(spark, [(1, None, "x", 1, 1), (None, "a", "x", 1, 1)]) == {} and chosen(spark, []) == {}
    assert chosen(spark, [], {"text": F.lit(1)}) == {}


def test_long_text(spark):
    rows = [(1, "a", "w " * 30_000, 1, 1), (2, "a", "w " * 30_000 + "end", 2, 1)]
    assert chosen(spark, rows)["a"][1] == 2


def test_records_vote_for_themselves(spark):
    rows = [(1, "a", "x", 5, 1, None, None), (2, "a", None, 9, 9, None, None), (3, "a", "y", 5, 2, None, None), (3, "a", "y", 5, 2, None, None), (4, "b", None, None, None, None, None), (5, None, "x", 1, 1, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    filled = F.col("text").isNotNull().cast("int")
    for hot in (None, 0):
        out = choose_values(df, ["g"], "id", {"keep": F.lit("keep")}, [F.col("trust"), F.col("at")], first_rank={"keep": filled}, hot_rows=hot)
        assert {r["g"]: (r["keep"]["id"], r["keep"]["first"], r["keep"]["last"]) for r in out.collect()} == {"a": (3, 1, 3), "b": (4, 4, 4)}


@pytest.mark.parametrize("a,b,want", [("", "", 0), ("a b", "a b", 0), ("a b c", "a c", 1), ("a b", "c d", 2), ("", "a", 1), ("x a b y", "x b a y", 2)])
def test_distance(a, b, want):
    assert distance(a.split(), b.split()) == want == distance(b.split(), a.split())
    assert distance(a.split(), b.split(), 0) == min(want, 1)


def test_columns_and_votes():
    assert alignment("a b c".split(), "a x c d".split()) == [(0, 0, "a"), (1, 0, "x"), (2, 0, "c"), (2, 1, "d")]
    assert alignment("b".split(), "a b".split()) == [(-1, 1, "a"), (0, 0, "b")]
    assert elected({(0, 0): {"a": 3, "b": 3}, (0, 1): {"c": 2}, (1, 0): {"d": 4}}, 6) == ["a", "d"]
    assert by_rank([(1,), (3,), (2,)]) == {(3,): 1, (2,): 2, (1,): 4}
    # five weak voters for another text don't outvote the best rank, but outweigh it
    values = [("x y", (0,), None), *[(f"z{n} y", (n,), None) for n in range(1, 6)]]
    assert nearest(values) == 0
    assert nearest([("x y", (0,), 1), ("z y", (1,), 1), ("z y w", (2,), 1)]) == 1


def test_survivors_of_a_whole_table(spark, data):
    """Every group of the table worked out one by one: each field by rank, descriptions by weight of trust."""
    from tidemark.llm import queries
    from tidemark.session import table

    flags = queries.FLAGS
    groups, seen = {}, set()
    for r in table(spark, data, "event_property").collect():
        if None in (r["producer_id"], r["event_type_name"], r["name"]) or r["decl_id"] in seen:
            continue
        seen.add(r["decl_id"])
        groups.setdefault((r["producer_id"], r["event_type_name"], r["name"]), []).append(r)

    def usable(r):
        word = (r["merge_strategy"] or "").strip().lower()
        return {
            "object_type": r["object_type"], "description": r["description"], "optional": flags.get((r["optional"] or "").strip().lower()), "multivalued": flags.get((r["multivalued"] or "").strip().lower()),
            "merge_strategy": word if word in queries.STRATEGIES else None, "confidence": None if r["confidence"] is None else str(r["confidence"]),
        }

    def rank(r):
        at = r["declared_at"]
        return (-(r["trust"] if r["trust"] is not None else float("-inf")), -(at.timestamp() if at is not None else float("-inf")), r["decl_id"])

    want = {}
    for key, rows in groups.items():
        keep = min(rows, key=lambda r: (-sum(v is not None for v in usable(r).values()), rank(r)))
        own = {"keep_id": keep["decl_id"]}
        for field in usable(rows[0]):
            held = sorted((rank(r), usable(r)[field], (r["trust"] or 0) + 1) for r in rows if usable(r)[field] is not None and usable(r)[field].strip())
            texts = {}
            for order, text, weight in held:
                best, sum_ = texts.get(text, (order, 0))
                texts[text] = (min(best, order), sum_ + weight * 1_000_000)
            values = [(t, o, w if field == "description" else None) for t, (o, w) in texts.items()]
            own[field] = values[nearest(values)][0] if values else None
        want[key] = own
    got = {tuple(r[k] for k in queries.GROUP): {f: r[f] for f in want[tuple(r[k] for k in queries.GROUP)]} for r in queries.p3_survivors(spark, data).collect()}
    assert got == want and len(want) > 50
    # fields of one word are those of the best rank
    assert all(own["optional"] in ("true", "false", None) for own in got.values())
