import importlib

import pytest

entry = importlib.import_module("__spark_entry__")


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90


@pytest.mark.parametrize("name", ["normalize_ws", "canonicalize_url", "domain_blocklist", "dedupe_first", "threshold_tuning", "overlap_summary", "registry_upsert", "null_rates"])
def test_core_queries_against_sql(spark, sf, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry.queries()[name](spark, sf)
    want = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    norm = lambda rows: sorted(tuple("None" if v is None else str(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert norm(df.select(*cols).collect()) == norm(want.fetchall())
