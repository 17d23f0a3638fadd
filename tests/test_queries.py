"""Every query of the inventory against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quirework.plans.queries import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    got = rows_of(df.columns, df.collect())
    want = db.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows_of(names, want.fetchall())


def test_placeholder_errors_of_clean_rows(spark):
    """All ten classes are there, and the undamaged ones have no error."""
    rows = {r["c"]: r for r in QUERIES["placeholder_errors"](spark, SMALL).collect()}
    assert set(rows) == set(range(10)) and all((r["least_risk"] == 0) == (c % 4 == 0) and r["clean_errors"] == 0 for c, r in rows.items())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 7
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
