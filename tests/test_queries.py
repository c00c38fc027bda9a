"""Every registered query of the dialogue engine against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from cuelight.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(v):
    return ("number", round(float(v), 6) + 0.0) if isinstance(v, float) else (type(v).__name__, str(v))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(same(r[c]) for c in names) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = db.execute(ORACLES[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    assert got == sorted(tuple(same(r[order.index(c)]) for c in names) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
