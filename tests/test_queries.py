"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from modelgraph import plans

SF = "/root/testdata/sf0.001"
TABLES = "customer part orders lineitem events conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_each_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES) and len(plans.QUERIES) > 100


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    got = plans.QUERIES[name](spark, SF)
    want = con.execute(plans.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted([str(c) for c in r] for r in got.select(*columns).collect()) == sorted([str(c) for c in r] for r in want.fetchall())
