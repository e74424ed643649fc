"""Texts of several sources combined so that each has its share of the tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.tokens import Tokenizer
from tidemark.session import cut_lineage

#: Tokens of a block, blocks of an output shard, and texts that one task packs.
BLOCK, SHARD, RUN = 256, 1024, 4_000
#: Blocks of one Arrow batch, and runs and sources whose first numbers may be sent to every executor.
BATCH, BROADCAST_RUNS = 1_000, 1_000_000
#: The most named sources; the target table is a setting, not data.
MOST_SOURCES = 100_000


def permuted(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0 .. size-1 for each seed, at ``index``: four Feistel rounds over the next
    power of four, walked on until the result lies in the range."""
    index, size, seed = (np.asarray(x).astype(np.uint64) for x in (index, size, seed))
    half = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2).astype(float)) / 2)).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)

    def once(x: np.ndarray, half: np.ndarray, low: np.ndarray, seed: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & low
        for turn in range(4):
            z = right + seed * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn) * np.uint64(0xD1B54A32D192ED03)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & low)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = once(index, half, low, seed)
        while (far := out >= size).any():
            out[far] = once(out[far], half[far], low[far], seed[far])
    return out.astype(np.int64)


def pack(rows: Iterator[tuple], block: int) -> Iterator[tuple]:
    """Blocks of ``block`` tokens from rows of run, source, id and tokens, sorted by run and source: run, source, number in
    the run, ids of the texts, tokens. The last block of a source in a run may be short."""
    key, number, docs, held = None, 0, [], []
    for run, source, doc, ids in rows:
        if (run, source) != key:
            if held:
                yield (*key, number, docs, held)
            key, number, docs, held = (run, source), 0, [], []
        at = 0
        while at < len(ids):
            took = ids[at : at + block - len(held)]
            docs.append(doc)
            held += took
            at += len(took)
            if len(held) == block:
                yield (*key, number, docs, held)
                number, docs, held = number + 1, [], []
    if held:
        yield (*key, number, docs, held)


def packed_blocks(texts: DataFrame, tokenizer: Tokenizer, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """``source``, ``_run``, ``_at``, ``doc_ids``, ``ids``: the tokens of each source, one text after the other, in blocks.

    ``texts`` has ``source``, ``doc_id`` and ``text``. They are cut into runs of about ``run`` texts by their id, so that no
    source makes a task large and the blocks don't depend on the number of tasks. Texts are shuffled as texts and
    tokenized where they are packed. The last block of a source in a run may be short. Empty texts are in no block.
    """
    runs = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, texts.count() // run))).alias("_run")
    kind = texts.schema["doc_id"].dataType
    sent = texts.select(runs, "source", "doc_id", "text").repartition("_run").sortWithinPartitions("_run", "source", "doc_id", "text")
    schema = T.StructType(
        [
            T.StructField("_run", T.LongType()), T.StructField("source", T.StringType()), T.StructField("_at", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )
    encode, arrow = tokenizer.encoder(), to_arrow_schema(schema)

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encode()
        rows = ((r, s, d, own(t)) for b in batches for r, s, d, t in zip(*(c.to_pylist() for c in b.columns)))
        made = pack(rows, block)
        while some := list(islice(made, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), arrow)], schema=arrow)

    return sent.mapInArrow(run_all, schema)


def quotas(targets: list[tuple[str, float, int]], held: dict[str, tuple[int, int]], total: int | None = None) -> dict[str, tuple[int, int]]:
    """For each source its slots and its blocks; ``held``: the blocks and tokens that each source has. The total is the
    largest at which every source with texts can have its weight without use of a block beyond its cap, or ``total``,
    which is an error if it is more. Sources without texts, without a positive weight, or with a cap of 0 get nothing,
    and the weights of the others are scaled up."""
    live = {s: (w, r) for s, w, r in targets if w and w > 0 and r and r > 0 and held.get(s, (0, 0))[1] > 0}
    weight = sum(w for w, _ in live.values())
    if not live:
        return {}
    most = {s: held[s][1] * r * weight / w for s, (w, r) in live.items()}
    least = min(most.values())
    if total is not None and total > least:
        short = {s: math.ceil(total * live[s][0] / weight) - held[s][1] * live[s][1] for s, n in sorted(most.items()) if n < total}
        raise ValueError(f"{total} tokens can't be mixed, {int(least)} can; tokens that sources lack: {short}")
    out = {}
    for s, (w, r) in live.items():
        blocks, tokens = held[s]
        # slots by mean block size, so that short last blocks don't count as full
        out[s] = (min(blocks * r, round((least if total is None else total) * w / weight / (tokens / blocks))), blocks)
    return out


def mix(
    docs: DataFrame, targets: DataFrame, tokenizer: Tokenizer, block: int = BLOCK, shard: int = SHARD, total: int | None = None, seed: int = 1, run: int = RUN
) -> DataFrame:
    """``shard``, ``place``, ``source``, ``block_no``, ``turn``, ``doc_ids``, ``ids``, ``n_tokens`` of the mixture.

    Every source has an exact number of slots by its weight. The slots of all sources are shuffled by one
    pseudorandom permutation and cut into shards, so that each shard's counts by source are a multinomial draw,
    given the totals. A slot finds its block through a pseudorandom permutation of its source's blocks, another
    one for each turn, and slots and blocks are joined by that index, which no source makes hot.

    Texts of sources that ``targets`` doesn't name, or with a null source, are left out, as are empty and null
    texts. A source named twice has its first target by weight. No row comes out if no target can be met.
    """
    named = (
        targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.max(F.struct("weight", F.coalesce("max_repeat", F.lit(1)).alias("max_repeat"))).alias("t"))
        .select("source", "t.*")
        .limit(MOST_SOURCES + 1)
        .collect()
    )
    if len(named) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources have a target")
    wanted = [r["source"] for r in named]
    texts = docs.where(F.col("source").isin(wanted) & (F.length("text") > 0)).select("source", "doc_id", "text")
    blocks = cut_lineage(packed_blocks(texts, tokenizer, block, run))
    counted = cut_lineage(blocks.groupBy("source", "_run").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.size("ids")).alias("_tokens")))
    sums = {r["source"]: (r["n"], r["t"]) for r in counted.groupBy("source").agg(F.sum("_n").alias("n"), F.sum("_tokens").alias("t")).collect()}
    quota = quotas([(r["source"], r["weight"], r["max_repeat"]) for r in named], sums, total)
    spark = docs.sparkSession
    # a block's number in its source: those of the runs before it come first; there is one row for each run and source
    bases = counted.selectExpr("source", "_run", "sum(_n) OVER (PARTITION BY source ORDER BY _run) - _n AS _base")
    few = counted.count() <= BROADCAST_RUNS
    numbered = blocks.join(F.broadcast(bases) if few else bases, ["source", "_run"]).select(
        "source", (F.col("_base") + F.col("_at")).alias("block_no"), "doc_ids", "ids"
    )
    names = sorted(quota)
    ends = np.cumsum([quota[s][0] for s in names])
    begins = ends - np.array([quota[s][0] for s in names], dtype=np.int64)
    size = np.array([quota[s][1] for s in names], dtype=np.int64)
    slots = int(ends[-1]) if names else 0

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            place = permuted(at, np.full(len(at), slots), np.full(len(at), seed))
            own = np.searchsorted(ends, at, side="right")
            inside = at - begins[own]
            turn = inside // size[own]
            number = permuted(inside % size[own], size[own], seed + 1 + own * 1_000_003 + turn)
            yield pa.RecordBatch.from_pydict(
                {"shard": place // shard, "place": place % shard, "source": pa.array([names[n] for n in own], pa.string()), "turn": turn, "block_no": number}
            )

    every = spark.range(slots).mapInArrow(drawn, "shard long, place long, source string, turn long, block_no long")
    return every.join(numbered, ["source", "block_no"]).select(
        "shard", "place", "source", "block_no", "turn", "doc_ids", "ids", F.size("ids").alias("n_tokens")
    )


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``, ``weight``, ``n_blocks``, ``n_tokens``, ``actual_share``, ``most_turns`` of each named source; zeros
    for one that gave nothing."""
    counted = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.sum("n_tokens").alias("n_tokens"), (F.max("turn") + 1).alias("most_turns")
    )
    whole = counted.agg(F.sum("n_tokens")).scalar()
    none: Column = F.lit(0).cast("long")
    return targets.join(counted, "source", "left").select(
        "source",
        "weight",
        F.coalesce("n_blocks", none).alias("n_blocks"),
        F.coalesce("n_tokens", none).alias("n_tokens"),
        F.coalesce(F.col("n_tokens") / whole, F.lit(0.0)).alias("actual_share"),
        F.coalesce("most_turns", none).alias("most_turns"),
    )
