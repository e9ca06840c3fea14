import pytest

from foliospark.llm import queries
from tests.oracle import TABLES, check


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_like_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_on_small_tables(spark, name):
    if not TABLES.exists():
        pytest.skip("no test tables")
    df = queries.QUERIES[name](spark, str(TABLES))
    assert len(df.collect()) >= 0


def test_found_columns(spark):
    want = {"p1_found": ["chunk_a", "chunk_b"], "p2_found": ["item_kind", "item_id"], "p3_found": ["chunk_id"], "p4_found": ["block_id", "noise"], "p7_found": ["doc_id"]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, str(TABLES)).columns == columns
