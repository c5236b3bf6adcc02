"""Every query of the engine against the same question in SQL on DuckDB."""

import duckdb
import pytest

from codeloom import catalog

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_oracle(spark, sf_dir, duck, name):
    df = catalog.queries()[name](spark, sf_dir)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    found = canon([tuple(r) for r in df.collect()], df.columns)
    assert found == canon(want.fetchall(), names)
    assert found, "a query that compares no rows shows nothing"


def test_files_are_not_broadcast(spark, sf_dir):
    """The tables of files and of their names grow with the input: joins with them must not pass through the driver."""
    plan = catalog.queries()["import_resolution"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 4 and "BroadcastHashJoin" not in plan
