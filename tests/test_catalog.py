"""Every registered base query against its SQL in DuckDB: columns, types, rows."""

import duckdb
import pytest

from factloom.plans import all_oracles, all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_sql(spark, sf_dir, db, name):
    df = all_queries()[name](spark, sf_dir)
    rows = df.collect()
    if name not in all_oracles():
        assert rows
        return
    cols = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({all_oracles()[name]})")
    kinds = dict(df.dtypes)
    assert sorted(db.sql(all_oracles()[name]).columns) == cols
    assert [TYPES[kinds[c]] for c in cols] == [str(t) for t in want.types]
    assert sorted((tuple(r[c] for c in cols) for r in rows), key=str) == sorted(want.fetchall(), key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
