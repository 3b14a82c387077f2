"""Every query with SQL against DuckDB on the same tables, as the driver does."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: (0.0 if v == 0 else round(v, 6)) if isinstance(v, float) and not math.isnan(v) else float(v) if v.__class__.__name__ == "Decimal" else v
    return [names[i] for i in order], sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    want = db.execute(entry.oracle_sql()[name])
    want = plain(want.fetchall(), [x[0] for x in want.description])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
