"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import consensus, duplicates, frequency, lookalikes, mixing, sentences
from tidemark.llm.tokens import Tokenizer
from tidemark.session import table

NAME_FIELDS = ("vessel", "operator", "berth", "goods")


def _frequencies(spark: SparkSession, folder: str) -> DataFrame:
    events = frequency.term_frequencies(
        table(spark, folder, "parsed_event"),
        "event_id",
        {
            "event_type_name": frequency.letters_and_digits(F.col("event_type_name")),
            "source_uri": F.col("source_uri"),
        },
    )
    properties = frequency.term_frequencies(
        table(spark, folder, "event_property"), "decl_id", {"object_type": F.col("object_type")}
    )
    return frequency.mark_terms(events.unionByName(properties))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _frequencies(spark, folder).where(F.col("mark").isNotNull()).select("field_name", "term", "mark")


def p1_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    return _frequencies(spark, folder)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "parsed_event")
    values = lookalikes.property_values(events, F.col("event_id"), F.col("properties"), NAME_FIELDS)
    types = table(spark, folder, "event_type").select(
        F.lit("event_type").alias("record_kind"),
        F.col("decl_id").alias("record_id"),
        F.lit("event_type.description").alias("_field"),
        F.col("description").alias("_text"),
    )
    return lookalikes.find_lookalikes(values.unionByName(types), table(spark, folder, "reference_text"))


GROUP = ("producer_id", "event_type_name", "name")
STRATEGIES = ("match", "any", "add", "set", "replace", "min", "max")
FLAGS = {"true": "true", "yes": "true", "y": "true", "1": "true", "false": "false", "no": "false", "n": "false", "0": "false"}


def _declared() -> dict[str, F.Column]:
    """The usable value of each field of a declaration."""

    def word(name: str) -> F.Column:
        return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))

    def flag(name: str) -> F.Column:
        return F.create_map(*[F.lit(x) for pair in FLAGS.items() for x in pair])[word(name)]

    return {
        "object_type": F.col("object_type"),
        "description": F.col("description"),
        "optional": flag("optional"),
        "multivalued": flag("multivalued"),
        "merge_strategy": F.when(word("merge_strategy").isin(*STRATEGIES), word("merge_strategy")),
        "confidence": F.col("confidence").cast("string"),
    }


def _rank() -> list[F.Column]:
    return [F.col("trust"), F.unix_micros(F.col("declared_at").cast("timestamp"))]


def _filled() -> F.Column:
    return sum((c.isNotNull().cast("int") for c in _declared().values()), F.lit(0))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every record votes for itself as the one to keep, by its usable fields and then by rank."""
    usable = _declared()
    fields = {"keep": F.lit("keep"), "merge": usable["merge_strategy"], "multivalued": usable["multivalued"]}
    chosen = consensus.choose_values(table(spark, folder, "event_property"), GROUP, "decl_id", fields, _rank(), first_rank={"keep": _filled()})
    return chosen.where("keep.first <> keep.last").select(
        F.col("keep.id").alias("keep_id"),
        F.coalesce("merge.id", F.lit(-1)).alias("merge_id"),
        F.coalesce("multivalued.id", F.lit(-1)).alias("multivalued_id"),
    )


def p3_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving declaration of every property, each field by its own vote, descriptions by weight of trust."""
    declared, usable = table(spark, folder, "event_property"), _declared()
    weights = {"description": F.coalesce("trust", F.lit(0)) + 1}
    chosen = consensus.choose_values(declared, GROUP, "decl_id", {"keep": F.lit("keep"), **usable}, _rank(), weights, {"keep": _filled()})
    return chosen.select(*GROUP, F.col("keep.id").alias("keep_id"), *[F.col(f"{f}.value").alias(f) for f in usable])


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", Tokenizer(spark).ids(F.col("text")).alias("ids"))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A digest of each text made from its ids, the number of its characters, and whether it has ids."""
    tokenizer = Tokenizer(spark)
    coded = table(spark, folder, "documents").select("doc_id", tokenizer.ids(F.col("text")).alias("ids"))
    back = tokenizer.text(F.col("ids"))
    return coded.select("doc_id", F.size("ids") > 0, back).toDF("doc_id", "has_ids", "back").select("doc_id", "has_ids", F.md5("back").alias("digest"), F.length("back").cast("bigint").alias("n_chars"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_target"), Tokenizer(spark))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(p8_mix(spark, folder), table(spark, folder, "mix_target"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.split_sentences(table(spark, folder, "documents"))


def _canonical_events() -> F.Column:
    return duplicates.canonical(F.col("source_uri"), F.col("event_type_name"), F.col("properties"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates.duplicate_pairs(table(spark, folder, "parsed_event"), "event_id", _canonical_events())


def p6_copies(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "parsed_event")
    return duplicates.copy_counts(duplicates.keyed_records(events, "event_id", _canonical_events()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


P1_SQL = r"""
WITH held AS (
  SELECT 'event_type_name' AS field_name, regexp_replace(lower(event_type_name), '[^\p{L}\p{N}]', '', 'g') AS term, event_id AS id FROM parsed_event
  UNION ALL SELECT 'source_uri', source_uri, event_id FROM parsed_event
  UNION ALL SELECT 'object_type', object_type, decl_id FROM event_property),
counted AS (
  SELECT field_name, term, count(*) AS n_rows, count(DISTINCT id) AS n_records FROM held WHERE term IS NOT NULL GROUP BY 1, 2),
marked AS (
  SELECT *, CASE WHEN field_name = 'object_type' THEN (SELECT count(DISTINCT decl_id) FROM event_property)
            ELSE (SELECT count(DISTINCT event_id) FROM parsed_event) END AS total_records FROM counted),
final AS (
  SELECT *, CASE WHEN n_records <= 3 THEN 'rare' WHEN n_records * 100 > total_records * 9 THEN 'common' END AS mark FROM marked)
"""

P6_SQL = r"""
WITH ev AS (SELECT event_id, any_value(source_uri) AS source_uri, any_value(event_type_name) AS kind, any_value(properties) AS properties,
  count(*) AS n FROM parsed_event GROUP BY event_id),
keyed AS (
  SELECT event_id, n, CASE WHEN source_uri IS NULL OR kind IS NULL THEN 'id ' || event_id ELSE
    regexp_replace(lower(upper(kind)), '[^\p{L}\p{N}]', '', 'g') || '|' || source_uri || '|' || coalesce(array_to_string(list_sort(list_transform(
      list_filter(map_entries(properties), lambda e: len(e.value) > 0),
      lambda e: e.key || '=' || array_to_string(list_sort(list_distinct(list_transform(e.value,
        lambda v: regexp_replace(replace(lower(upper(v)), 'ς', 'σ'), '[^\p{L}\p{N}]', '', 'g')))), chr(2)))), chr(3)), '') END AS k FROM ev),
grouped AS (SELECT *, min(event_id) OVER (PARTITION BY k) AS first_id FROM keyed)
"""


_FLAG = "lower(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')) IN ('true', 'false', 'yes', 'no', 'y', 'n', '1', '0')"
_MERGE = "lower(regexp_replace(merge_strategy, '^\\s+|\\s+$', '', 'g')) IN ('match', 'any', 'add', 'set', 'replace', 'min', 'max')"
P3_SQL = f"""
WITH d AS (
  SELECT DISTINCT *, coalesce(({_MERGE})::INT, 0) AS um, coalesce(({_FLAG.format("multivalued")})::INT, 0) AS uv,
    coalesce(({_FLAG.format("optional")})::INT, 0) AS uo,
    (object_type IS NOT NULL)::INT + (description IS NOT NULL)::INT + (confidence IS NOT NULL)::INT AS others
  FROM event_property WHERE producer_id IS NOT NULL AND event_type_name IS NOT NULL AND name IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY producer_id, event_type_name, name
  ORDER BY trust DESC NULLS LAST, declared_at DESC NULLS LAST, decl_id) AS rank FROM d)
SELECT arg_min(decl_id, (um + uv + uo + others) * -1000000 + rank) AS keep_id,
  coalesce(arg_min(decl_id, rank) FILTER (WHERE um = 1), -1) AS merge_id,
  coalesce(arg_min(decl_id, rank) FILTER (WHERE uv = 1), -1) AS multivalued_id
FROM r GROUP BY producer_id, event_type_name, name HAVING count(DISTINCT decl_id) > 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": P3_SQL,
        "p7_round_trip": "SELECT doc_id, coalesce(text, '') <> '' AS has_ids, md5(coalesce(text, '')) AS digest, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents",
        "p1_found": P1_SQL + "SELECT field_name, term, mark FROM final WHERE mark IS NOT NULL",
        "p1_frequencies": P1_SQL + "SELECT field_name, term, n_rows, n_records, total_records, mark FROM final",
        "p6_found": P6_SQL + "SELECT first_id, event_id FROM grouped WHERE event_id <> first_id",
        "p6_copies": P6_SQL
        + "SELECT first_id, count(*) AS n_records, sum(n)::BIGINT AS n_rows, 0::BIGINT AS n_collisions FROM grouped GROUP BY first_id, k",
    }
