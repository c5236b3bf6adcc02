"""The queries that SQL can express, against DuckDB over the same tables."""

import duckdb
import pytest

from codeloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.queries()[name](spark, sf_dir)
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    found = [tuple(r[c] for c in order) for r in df.collect()]
    assert sorted(found, key=repr) == sorted((tuple(r[names.index(c)] for c in order) for r in want.fetchall()), key=repr)
