import pytest

from sqlcheck import differences
from tidemark.llm import queries

NAMES = sorted(queries.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, data, name):
    assert not differences(spark, data, queries.queries()[name], queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(NAMES)))
def test_query_without_sql_runs(spark, data, name):
    assert queries.queries()[name](spark, data).count() > 0


def test_found_columns(spark, data):
    want = {
        "p1_found": [("field_name", "string"), ("term", "string"), ("mark", "string")],
        "p2_found": [("record_kind", "string"), ("record_id", "bigint"), ("ref_id", "bigint")],
        "p3_found": [("keep_id", "bigint"), ("merge_id", "bigint"), ("multivalued_id", "bigint")],
        "p6_found": [("first_id", "bigint"), ("event_id", "bigint")],
        "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p9_found": [("doc_id", "bigint"), ("start_pos", "bigint"), ("end_pos", "bigint")],
    }
    assert {name: queries.queries()[name](spark, data).dtypes for name in want} == want
