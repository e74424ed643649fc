"""One surviving record for each group of duplicates, chosen field by field by weighted votes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows from which a group may be hot; it is if it also has more rows than a task has on average.
HOT_ROWS = 50_000
#: Counters of the sketch that finds hot groups; its size does not depend on the data.
SKETCH_ITEMS = 16_384
#: Weights are counted in millionths, so that sums don't depend on their order.
UNIT = 1_000_000

PLACED = T.ArrayType(T.StructType([T.StructField("_pos", T.IntegerType()), T.StructField("_put", T.IntegerType()), T.StructField("_token", T.StringType())]))

Place = tuple[int, int]  # the token of the guide, and 0 for its column or 1, 2 … for tokens put in after it
Order = tuple  # rank of a record, the smaller the better


def alignment(guide: Sequence[str], tokens: Sequence[str]) -> list[tuple[int, int, str]]:
    """The column of each token of a value that is aligned to the guide: equal tokens share a column, others stand in for
    the guide's tokens between them or are put in after these. Tokens of the guide that the value lacks have no row."""
    start, end = common_ends(guide, tokens)
    out = [(n, 0, tokens[n]) for n in range(start)]
    for _, i, j, k, m in SequenceMatcher(None, guide[start : len(guide) - end], tokens[start : len(tokens) - end], autojunk=False).get_opcodes():
        for step in range(m - k):
            place = (i + step, 0) if i + step < j else (j - 1, step - (j - i) + 1)
            out.append((place[0] + start, place[1], tokens[start + k + step]))
    out += [(len(guide) - n, 0, tokens[len(tokens) - n]) for n in range(end, 0, -1)]
    return out


def common_ends(a: Sequence[str], b: Sequence[str]) -> tuple[int, int]:
    """How many tokens at the start, and then at the end, are equal."""
    start, end, most = 0, 0, min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    while end < most - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    return start, end


def elected(votes: Mapping[Place, Mapping[str, int]], whole: int) -> list[str]:
    """The token with the most weight in each column, in their order. A column's gap has the weight of all values that
    have no token there and wins a tie; of equal tokens the smallest is taken."""
    out = []
    for place in sorted(votes):
        weight, token = min((-w, t) for t, w in votes[place].items())
        if -weight > whole - sum(votes[place].values()):
            out.append(token)
    return out


def distance(a: Sequence[str], b: Sequence[str], bound: int | None = None) -> int:
    """The least number of tokens to insert, remove or change; more than ``bound`` is given as any number above it."""
    start, end = common_ends(a, b)
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if bound is not None and min(row) > bound:
            return bound + 1
    return row[-1]


def by_rank(orders: Iterable[Order]) -> dict[Order, int]:
    """Weights for ranked voters: each outweighs all that rank below it together."""
    return {order: 1 << n for n, order in enumerate(sorted(set(orders), reverse=True))}


def nearest(values: Sequence[tuple[str, Order, int | None]]) -> int:
    """The number of the value closest to the consensus of ``values``: text, best order of its records, weight.

    The heaviest value, of equal ones the one with the best order, is the guide to which all others are aligned, one
    after the other. Without weights the values vote by rank. Of values equally near the best order is taken.
    """
    if len(values) == 1:
        return 0
    ranks = by_rank(order for _, order, _ in values)
    weights = [ranks[order] if w is None else w for _, order, w in values]
    tokens = [text.split() for text, _, _ in values]
    guide = tokens[min(range(len(values)), key=lambda n: (-weights[n], values[n][1], values[n][0]))]
    votes: dict[Place, dict[str, int]] = defaultdict(lambda: defaultdict(int))
    for own, weight in zip(tokens, weights):
        for pos, put, token in alignment(guide, own):
            votes[pos, put][token] += weight
    consensus = elected(votes, sum(weights))
    best, least = None, None
    for n in sorted(range(len(values)), key=lambda n: (values[n][1], values[n][0])):
        if (d := distance(tokens[n], consensus, least)) < (least if least is not None else d + 1):
            best, least = n, d
    return best


def _survivors(batches: Iterator[pa.RecordBatch], n_keys: int, fields: list[str], n_rank: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal keys in sorted votes; the votes of one group are held at a time."""
    key, held = None, defaultdict(list)

    def row() -> list:
        out: list = list(key)
        for name in fields:
            own = held.get(name)
            if own is None:
                out.append(None)
                continue
            text, order, _, first, last = own[nearest([v[:3] for v in own])]
            out.append({"value": text, "id": order[-1], "first": first, "last": last})
        return out

    for batch in batches:
        rows = []
        for vote in zip(*(c.to_pylist() for c in batch.columns)):
            if vote[:n_keys] != key:
                if key is not None:
                    rows.append(row())
                key, held = vote[:n_keys], defaultdict(list)
            field, text, weight, first, last, *order = vote[n_keys:]
            held[field].append((text, tuple(order), weight, first, last))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row(), schema)], schema=schema)


def hot_groups(df: DataFrame, keys: Sequence[str], hot_rows: int | None = None) -> list[int]:
    """The hashes of groups with more rows than a task has on average, by a sketch; at most one for each task. They only
    decide where a group is aligned, never the result."""
    parts = max(8, min(1000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = df.select(F.xxhash64(*keys).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {parts}, {SKETCH_ITEMS})").alias("top")).first()
    least = max(HOT_ROWS, found["n"] // parts) if hot_rows is None else hot_rows
    return [x["item"] for x in found["top"] or [] if x["count"] > least]


@F.pandas_udf(PLACED)
def _aligned(guide: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([[{"_pos": p, "_put": n, "_token": t} for p, n, t in alignment(g.split(), x.split())] for g, x in zip(guide, text)])


@F.pandas_udf(T.IntegerType())
def _apart(text: pd.Series, consensus: pd.Series) -> pd.Series:
    return pd.Series([distance(a.split(), b.split()) for a, b in zip(text, consensus)], dtype="int32")


def _hot_survivors(votes: DataFrame, keys: Sequence[str], fields: list[str], order: list[str], weighted: Sequence[str]) -> DataFrame:
    """As ``_survivors`` for the few hot groups, each step spread over all tasks: values are aligned to their guide one by
    one, columns are counted with partial sums, and only guides and consensus texts are broadcast, one a group and field.
    A ranked field's guide outweighs all else in each column, so that it is the value elected."""
    group = [*keys, "_field"]
    best = [F.col(c) for c in order]
    guides = votes.groupBy(*group).agg(
        F.min(F.struct((-F.coalesce("_weight", F.lit(0))).alias("_w"), *best, "_text", "_first", "_last")).alias("_g"), F.sum("_weight").alias("_whole")
    )
    chosen = F.struct(F.col("_text").alias("value"), F.col(order[-1]).alias("id"), F.col("_first").alias("first"), F.col("_last").alias("last"))
    out = guides.select(*group, "_g.*").select(*group, chosen.alias("_c")).where(~F.col("_field").isin(*weighted)) if weighted else guides.select(*group, "_g.*").select(*group, chosen.alias("_c"))
    if weighted:
        mine = votes.where(F.col("_field").isin(*weighted))
        heads = F.broadcast(guides.select(*group, F.col("_g._text").alias("_guide"), "_whole"))
        placed = mine.join(heads, group).select(*group, "_whole", "_weight", F.inline(_aligned("_guide", "_text")))
        counted = placed.groupBy(*group, "_whole", "_pos", "_put", "_token").agg(F.sum("_weight").alias("_w"))
        columns = counted.groupBy(*group, "_whole", "_pos", "_put").agg(F.min(F.struct((-F.col("_w")).alias("_w"), "_token")).alias("_top"), F.sum("_w").alias("_all"))
        kept = columns.where(-F.col("_top._w") > F.col("_whole") - F.col("_all"))
        lines = kept.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_pos", "_put", F.col("_top._token").alias("_token")))).alias("_l"))
        texts = guides.select(*group).join(lines, group, "left").select(*group, F.coalesce(F.array_join(F.col("_l._token"), " "), F.lit("")).alias("_consensus"))
        near = mine.join(F.broadcast(texts), group).withColumn("_d", _apart("_text", "_consensus"))
        taken = near.groupBy(*group).agg(F.min(F.struct("_d", *best, "_text", "_first", "_last")).alias("_g"))
        out = out.unionByName(taken.select(*group, "_g.*").select(*group, chosen.alias("_c")))
    return out.groupBy(*keys).agg(*[F.max(F.when(F.col("_field") == f, F.col("_c"))).alias(f) for f in fields])


def choose_values(
    df: DataFrame,
    keys: Sequence[str],
    record_id: str,
    fields: Mapping[str, Column],
    rank: Sequence[Column],
    weights: Mapping[str, Column] | None = None,
    first_rank: Mapping[str, Column] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """For each group and field, the existing value closest to the consensus of the group's values.

    ``fields``: the usable value of each field as text, null where unusable. ``rank``: what makes a record better,
    the more the better, nulls worst; then the smaller ``record_id``; ``first_rank`` comes before it for the fields
    named there. The tokens of the distinct values are aligned one value after the other to a guide, the heaviest
    value, and in each column the tokens and the gap are voted on: by the sum of ``weights`` for the fields named
    there, else by rank, where a voter outweighs all that rank below. The value nearest to the elected tokens is
    taken, of equally near ones the best rank.

    Result: keys and for each field a struct ``value``, ``id`` (the best-ranked record with that value), ``first``
    and ``last`` (the least and greatest id of its records), or null. Equal values are counted before they are
    shuffled; a group then is aligned by the task that has it. The result doesn't depend on the order of values, so
    that hot groups, those with more rows than a task has on average, are aligned by all tasks with the same result.
    Groups without a usable value, and those with a null key or id, have no row. Blank values are unusable. Repeated
    rows of one record have one vote.
    """
    weights, first_rank = weights or {}, first_rank or {}
    usable = df.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in [*keys, record_id]]))

    def less(c: Column) -> Column:
        return -F.coalesce(c.cast("double"), F.lit(float("-inf")))

    several_ranks = bool(first_rank)
    order = [*(["_o0"] if several_ranks else []), *[f"_o{n + 1}" for n in range(len(rank))], "_oid"]
    held = usable.select(
        *keys,
        *[less(c).alias(f"_o{n + 1}") for n, c in enumerate(rank)],
        F.col(record_id).alias("_oid"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("_field"),
                        value.cast("string").alias("_text"),
                        F.round(weights.get(name, F.lit(None)).cast("double") * UNIT).cast("long").alias("_weight"),
                        *([(less(first_rank[name]) if name in first_rank else F.lit(0.0)).alias("_o0")] if several_ranks else []),
                    )
                    for name, value in fields.items()
                ]
            )
        ),
    ).where(F.length(F.trim("_text")) > 0)
    group = [*keys, "_field", "_text"]
    ranks = F.min(F.struct(*order)).alias("_best")
    ends = [F.min("_oid").alias("_first"), F.max("_oid").alias("_last")]
    ranked_only = held.where(~F.col("_field").isin(*weights)) if weights else held
    votes = ranked_only.groupBy(*group).agg(ranks, *ends, F.lit(None).cast("long").alias("_weight"))
    if weights:
        # repeated rows of one record have one vote
        once = held.where(F.col("_field").isin(*weights)).groupBy(*group, "_oid").agg(F.min(F.struct(*order)).alias("_one"), F.max("_weight").alias("_weight"))
        votes = votes.unionByName(once.groupBy(*group).agg(F.min("_one").alias("_best"), *ends, F.sum("_weight").alias("_weight")))
    votes = votes.select(*group, "_weight", "_first", "_last", *[f"_best.{c}" for c in order])

    names = list(fields)
    hot = hot_groups(usable, keys, hot_rows)
    is_hot = F.xxhash64(*keys).isin(*hot)
    of_id = df.schema[record_id].dataType.simpleString()
    of_field = f"struct<value:string,id:{of_id},first:{of_id},last:{of_id}>"
    kinds = [*[f"`{f.name}` {f.dataType.simpleString()}" for f in usable.select(*keys).schema], *[f"`{n}` {of_field}" for n in names]]
    schema = _arrow_schema(df.sparkSession, ", ".join(kinds))
    n_keys, n_rank = len(keys), len(order)
    cold = (
        (votes.where(~is_hot) if hot else votes)
        .repartition(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(lambda it: _survivors(it, n_keys, names, n_rank, schema), ", ".join(kinds))
    )
    return cold.unionByName(_hot_survivors(votes.where(is_hot), keys, names, order, sorted(weights))) if hot else cold


def _arrow_schema(spark, kinds: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], kinds).schema)
