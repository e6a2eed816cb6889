"""Every registered query against its SQL statement on the smallest tables."""
import pytest

from tests.oracle_compare import compare, duck
from kreditflow.catalog import oracle_sql, queries

QS = queries()
SQL = oracle_sql()
FAST = [k for k in QS if k in SQL and not k.startswith(("src_0", "src_1", "agg_29", "dec_", "scl_22", "agg_30"))]


@pytest.fixture(scope="module")
def con():
    return duck("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, QS[name], SQL[name], "/root/testdata/sf0.001") == []


@pytest.mark.parametrize("name", ["dec_10_decision_summary", "scl_22_decision_record", "src_10_version_as_of"])
def test_decision_queries_match_sql(spark, con, name):
    assert compare(spark, con, name, QS[name], SQL[name], "/root/testdata/sf0.001") == []


def test_entry_runs(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
