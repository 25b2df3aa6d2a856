"""Every query with an oracle: Spark result == DuckDB result (sf0.001)."""
import pytest

import __spark_entry__ as E
from tests.oracle_compare import compare, duck

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con(sf_tiny):
    return duck(sf_tiny)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, sf_tiny, name):
    df = QUERIES[name](spark, sf_tiny)
    rows = [r.asDict() for r in df.collect()]
    cur = con.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
    assert compare(rows, df.columns, drows, dcols) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, sf_tiny, name):
    df = QUERIES[name](spark, sf_tiny)
    assert df.count() > 0 and len(df.columns) > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns
