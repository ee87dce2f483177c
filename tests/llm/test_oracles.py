"""Operators that SQL can express, against their SQL in DuckDB."""

import duckdb
import pytest

from factloom.llm.queries import ORACLES, QUERIES

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})")
    kinds = dict(df.dtypes)
    assert [TYPES[kinds[c]] for c in cols] == [str(t) for t in want.types]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted(want.fetchall(), key=str)
