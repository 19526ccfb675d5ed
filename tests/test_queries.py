"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from provlake import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return list(frame.columns), sorted((tuple(clean(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_against_sql(spark, db, name):
    got = rows(entry.queries()[name](spark, SF).toPandas())
    assert got[1]
    if name in plans.ORACLES:
        assert got == rows(db.execute(plans.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
