"""Registered queries vs their DuckDB oracle on the smallest fixture."""
import pytest

SF = "/root/testdata/sf0.001"


def _names():
    from fraudlens.plans import registry
    registry.load_all()
    return sorted(registry.ORACLE)


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, name):
    import os
    if not os.path.isdir(SF):
        pytest.skip("fixture data not present")
    import duckdb
    import __spark_entry__ as E
    from scripts.oracle_check import TABLES, frame_hash
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sp = E.queries()[name](spark, SF).toPandas()
    dd = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dd.columns)
    assert len(sp) == len(dd)
    assert frame_hash(sp)[0] == frame_hash(dd)[0]


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
