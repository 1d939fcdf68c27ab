"""Every operator of the inventory is registered and has SQL to be checked against."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from evalloom import dims
from evalloom.plans import registry

COUNTS = {
    "src": 8, "snk": 6, "prj": 13, "jn": 14, "agg": 35, "dia": 7, "win": 10, "top": 5, "set": 6,
    "par": 14, "sco": 8, "fld": 13, "rwd": 9, "gen": 11, "key": 13, "str": 1, "udf": 5,
}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def test_inventory_is_covered():
    wanted = {f"{prefix}{i}" for prefix, n in COUNTS.items() for i in range(1, n + 1)} | {"agg6b"}
    assert wanted <= set(entry_module.queries())
    own = registry.QUERIES
    assert set(own) <= set(entry_module.queries()) and set(registry.ORACLES) == set(own)
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_tables_of_constants():
    assert len(dims.TAXONOMY) == 34 and len({t for t, *_ in dims.TAXONOMY}) == 34
    assert len(dims.BENCHMARK_TASKS) == 9 and len(dims.STRATEGIES) == 10 and len(dims.ROUTES) == 10
    assert len(dims.SENSITIVITY_PAIRS) == 20


def test_flagship(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "failure_class" in df.columns


@pytest.mark.parametrize("name", ["agg1", "agg10", "agg27", "sco5", "fld3", "rwd5", "win2", "jn11", "gen5", "key3", "set3"])
def test_queries_match_their_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = con.execute(entry_module.oracle_sql()[name])
    columns = sorted(d[0] for d in cursor.description)
    order = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted(repr(tuple(row[i] for i in order)) for row in cursor.fetchall())
    df = entry_module.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == columns
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want
