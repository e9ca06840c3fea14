import pytest

import __spark_entry__ as entry
from foliospark.plans import catalogue
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_like_sql(spark, name):
    check(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_entry(spark):
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 1


def test_prose_chunks(spark):
    from foliospark.operators import stats

    got = catalogue.QUERIES["prose_chunks"](spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and stats.orphans(got).count() == 0 and got.groupBy("chunk_id").count().filter("count > 1").count() == 0
