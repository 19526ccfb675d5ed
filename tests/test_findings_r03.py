"""Queries against their SQL where copies of the given tables did not lead: files out of order, ties of durations, uneven counts."""

from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as entry
from provlake import plans

from test_queries import rows


def against_sql(spark, folder, name, **tables):
    """The query's rows and its SQL's over tables of (columns, rows); a list of these is written as so many files."""
    con = duckdb.connect()
    for t, files in tables.items():
        files = files if isinstance(files, list) else [files]
        for i, (schema, data) in enumerate(files):
            spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    got, want = rows(entry.queries()[name](spark, str(folder)).toPandas()), rows(con.execute(plans.ORACLES[name]).df())
    assert want[1]
    return got, want


def test_change_sessions_of_files_out_of_order(spark, tmp_path):
    """the earliest events come in the smallest files, which Spark deals out, writes and reads last; none of them is too late."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    file = lambda first, n: (schema, [(i, day(first) + timedelta(minutes=i), i % 7, "error", 1.0, "x" * 50) for i in range(n)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a task for each file
    got, want = against_sql(spark, tmp_path, "change_sessions", events=[file(30 * (12 - i), 60_000 >> i) for i in range(12)])
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == want


def test_sessions_end_at_a_gap_of_just_the_limit(spark, tmp_path):
    """F1: rows just six hours apart are of one session, as session_window has it; a microsecond more ends it."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    at = [datetime(2024, 1, 1) + timedelta(hours=h) for h in (0, 5, 11, 18, 24)] + [datetime(2024, 1, 2, 6, 0, 0, 1)]
    got, want = against_sql(spark, tmp_path, "change_sessions", events=(schema, [(i, t, 1, "click", 1.0, "") for i, t in enumerate(at)]))
    assert got == want and len(got[1]) == 3


@pytest.mark.parametrize("frames, long", [((100, 122), False), ((100, 121), True)])
def test_media_amounts_at_just_100_ms(spark, tmp_path, frames, long):
    """100 frames at 24 a second last 100 ms longer than 122 at 30, which binary fractions make a little more."""
    day = datetime(1995, 1, 1)
    orders = ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string", [(3, 1, "F", 1.0, day, "1-URGENT"), (6, 1, "F", 1.0, day, "3-MEDIUM")])
    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    items = (line, [(key, 1, 1, 1, float(n), 1.0, 0.0, 0.0, "N", "F", day) for key, n in zip((3, 6), frames)])
    got, want = against_sql(spark, tmp_path, "media_amounts", orders=orders, lineitem=items)
    assert got == want
    assert ("audio_duration" in str(got)) == long


def test_mean_images_of_every_tenth_part(spark, tmp_path):
    """of 16 frames and a sample of 10 all count, as every 16/10-th, rounded down, is every frame."""
    vectors = ("vec_id long, embedding array<float>, label int", [(i, [(i * i + 0.5) / 100] * 64, 0) for i in range(16)])
    got, want = against_sql(spark, tmp_path, "mean_images", embeddings=vectors)
    assert got == want
    assert set(got[1][0][1].split(",")) == {"7750"}
