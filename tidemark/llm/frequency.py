"""How often every distinct value occurs, by heavy-light aggregation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Counters of one field in the local arrays. A term with more than 1/(2*HEAVY_SLOTS) of a field's rows is among them.
HEAVY_SLOTS = 16
#: Counters of the frequent-items sketch that finds the heavy terms; its size does not depend on the data.
SKETCH_ITEMS = 1024
#: Ids of repeated records that may be sent to every executor; more of them meet their rows by a shuffled join.
BROADCAST_IDS = 500_000


def letters_and_digits(text: Column) -> Column:
    """``text`` in lower case with nothing but letters and digits (of any script) kept."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def heavy_terms(df: DataFrame, fields: Mapping[str, Column], slots: int = HEAVY_SLOTS) -> dict[str, list[str]]:
    """At most ``slots`` of the most frequent terms of each field, from one pass with a sketch of fixed size.

    Which terms are found only decides where they are counted, never the counts.
    """
    found = df.select(
        *[F.expr(f"approx_top_k(`{name}`, {slots}, {SKETCH_ITEMS})").alias(name) for name in fields]
    ).first()
    return {name: [x["item"] for x in (found[name] or []) if x["item"] is not None] for name in fields}


def _terms(base: DataFrame, names: list[str]) -> DataFrame:
    """``_id``, ``field`` (its number) and ``term``: one row for each term of each row."""
    each = F.array(*[F.struct(F.lit(i).alias("field"), F.col(n).alias("term")) for i, n in enumerate(names)])
    return base.select("_id", F.inline(each)).where(F.col("term").isNotNull())


def repeated_ids(base: DataFrame) -> DataFrame:
    """``_id`` and ``n`` of the records that have several rows, written once; only ids are shuffled to find them."""
    counted = base.where(F.col("_id").isNotNull()).groupBy("_id").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(counted.where("n > 1"))


def term_frequencies(df: DataFrame, record_id: str, fields: Mapping[str, Column], slots: int = HEAVY_SLOTS) -> DataFrame:
    """Rows and distinct records that hold each distinct term of each field.

    ``fields`` names the columns (expressions over ``df``) whose terms are counted; rows with the same
    ``record_id`` are one record. Result: ``field_name``, ``term``, ``n_rows``, ``n_records``, ``total_records``.

    The heavy terms, at most ``slots`` a field, are broadcast and their rows counted in exact local arrays, of which
    each task hands on one; only the other terms are shuffled, as counts made before the shuffle. Both tables are
    united. A record with several rows is counted once by a correction: its ids are found by a shuffle of ids alone,
    and only the rows of those ids meet, whatever their terms, to subtract what was counted too often.

    Null terms are not counted; a null ``record_id`` counts its rows but no record; an empty text is a term like
    any other; an empty table gives no rows. Ties and repeated rows need no rule. Other columns of ``df`` are
    not read, so clashing names do no harm.
    """
    names = list(fields)
    base = df.select(F.col(record_id).alias("_id"), *[fields[n].cast("string").alias(n) for n in names])
    heavy = heavy_terms(base, {n: F.col(n) for n in names}, slots)
    spark = df.sparkSession
    slot_rows = [(i, term, s) for i, n in enumerate(names) for s, term in enumerate(heavy[n])]
    slot_table = F.broadcast(spark.createDataFrame(slot_rows, "field int, term string, slot int"))
    found = _terms(base, names)

    # heavy: one row of counters a task
    met = found.join(slot_table, ["field", "term"])
    counters = [
        F.struct(
            F.lit(i).alias("field"),
            F.lit(term).alias("term"),
            F.count_if((F.col("field") == i) & (F.col("slot") == s)).alias("n_rows"),
            F.count_if((F.col("field") == i) & (F.col("slot") == s) & F.col("_id").isNotNull()).alias("n_records"),
        )
        for i, term, s in slot_rows
    ]
    light = found.join(slot_table, ["field", "term"], "left_anti").groupBy("field", "term").agg(F.count(F.lit(1)).alias("n_rows"), F.count("_id").alias("n_records"))
    counted = light
    if counters:
        counted = met.agg(F.array(*counters).alias("arrays")).select(F.inline("arrays")).unionByName(light)

    # records with several rows: what their terms were counted too often
    again = repeated_ids(base)
    n_again, surplus = again.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") - 1), F.lit(0))).first()
    if n_again:
        ids = again.select("_id")
        own = base.join(F.broadcast(ids) if n_again <= BROADCAST_IDS else ids, "_id")
        excess = (
            _terms(own, names)
            .groupBy("field", "term", "_id")
            .agg((F.count(F.lit(1)) - 1).alias("x"))
            .where("x > 0")
            .groupBy("field", "term")
            .agg(F.lit(0).cast("long").alias("n_rows"), (-F.sum("x")).alias("n_records"))
        )
        counted = counted.unionByName(excess).groupBy("field", "term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"))
    total = base.agg(F.count("_id") - F.lit(surplus).cast("long"))
    return counted.where("n_rows > 0").select(
        F.array(*[F.lit(n) for n in names])[F.col("field")].alias("field_name"), "term", "n_rows", "n_records", total.scalar().alias("total_records")
    )


def mark_terms(counts: DataFrame, at_most: int = 3, more_than: float = 0.09) -> DataFrame:
    """Adds ``mark``: ``rare`` with at most ``at_most`` records, ``common`` with more than that share of all records, else null.

    A term that is both, as in tiny tables, is ``rare``.
    """
    share = int(round(more_than * 1_000_000))
    return counts.withColumn(
        "mark",
        F.when(F.col("n_records") <= at_most, "rare").when(
            F.col("n_records") * 1_000_000 > F.col("total_records") * share, "common"
        ),
    )
