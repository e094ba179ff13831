import os

import pytest

import __spark_entry__ as entry
from archivolt.plans import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_contract():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(QUERIES) <= set(queries) and set(ORACLES) <= set(oracles) <= set(queries)
    assert len(ORACLES) >= 100


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["p3_found", "agg1_representatives", "bnd1_related", "gr9_duplicate_candidates"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"create view {f[:-8]} as select * from '{SMALL}/{f}'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = entry.queries()[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
