"""Media checks and image tables on small cases worked out by hand, nulls and empty tables included."""

from pyspark.sql import functions as F

from provlake.functions import scalars
from provlake.operators import media_checks, segments


def test_snap_to_frames(spark):
    frames = spark.createDataFrame([(1, 1, 0.0), (1, 2, 33.0), (1, 3, 70.0)], "set_id long, frame_no long, time_ms double")
    segs = spark.createDataFrame([(1, 1, 33.0, 69.0, 0.5), (1, 2, 40.0, 90.0, None), (1, 3, 80.0, 90.0, 0.0), (2, 1, 5.0, None, 1.0)], "set_id long, seg_no long, starttime double, endtime double, error double")
    got = {(r.set_id, r.seg_no): (r.startframe, r.endframe, r.starttime, r.endtime, r.error) for r in segments.snap_to_frames(segs, frames).collect()}
    assert got == {
        (1, 1): (2, 2, 33.0, 33.0, 37.5),
        (1, 2): (2, None, 33.0, 90.0, 30.0),
        (1, 3): (None, None, 80.0, 90.0, 0.0),
        (2, 1): (None, None, 5.0, None, 1.0),
    }
    assert segments.snap_to_frames(segs.limit(0), frames).count() == 0


def test_seed_segments(spark):
    segs = spark.createDataFrame([("cut", 5, 9, 5, 40.0, 100.0), ("crop", 5, 9, 5, 40.0, 100.0), ("cut", 0, 3, 4, 0.0, 100.0), (None, 1, 1, 1, 0.0, 10.0)], "op string, startframe long, endframe long, frames long, starttime double, rate double")
    got = [(r.op, r.startframe, r.endframe, r.starttime, r.endtime) for r in segments.seed_segments(segs).collect()]
    assert got == [("cut", 4, 5, 30.0, 40.0), ("crop", 1, 4, 0.0, 80.0), ("cut", 1, 0, 0.0, 0.0)]


def test_size_rules_without_sizes(spark):
    kinds = "project_id long, src long, dst long, op string, src_w int, src_h int, dst_w int, dst_h int, interpolation string, rotated string, orientation string, dst_file string, pastemask string, mask_w int, mask_h int"
    rows = [(1, 1, 2, "TransformCrop", *[None] * 11), (1, 2, 3, "Blur", 40, 30, 40, 30, None, "yes", "Rotate 270 CW", "a.jpg", None, None, None), (1, 3, 4, "Blur", 40, 30, 36, 27, "none", None, None, "a.JPG", "m", None, None)]
    got = sorted((r.start, r.module) for r in media_checks.size_rules(spark.createDataFrame(rows, kinds)).collect())
    assert got == [(2, "rotation"), (3, "eight"), (3, "interpolation"), (3, "pastemask")]


def test_mask_rules_with_nulls(spark):
    kinds = "project_id long, src long, dst long, maskname string, inputmask string, n_videomasks int, generate string, src_type string, dst_type string"
    rows = [(1, 1, 2, None, None, None, None, "image", None), (1, 2, 3, "m", "i", 0, "all", "image", "image"), (1, 3, 4, None, "x", 1, "all", "image", "image"), (1, 4, 5, None, None, 0, None, None, None)]
    files = spark.createDataFrame([(1, "m", 4, 4), (1, "m", 4, 4), (1, "i", 4, 5), (None, None, 1, 1)], "project_id long, file string, width int, height int")
    got = sorted((r.start, r.message) for r in media_checks.mask_rules(spark.createDataFrame(rows, kinds), files).collect())
    assert got == [(1, "Link mask is missing. Recompute the link mask."), (2, "input mask name parameter has an invalid size"), (3, "Input mask file x is missing")]


def test_stamps_and_dates(spark):
    rows = spark.createDataFrame([({"Create Date": "2010:01:02 Mon", "Time": "10.5", "Size": "1"}, {"Create Date": "2010:01:02 Tuesday", "Time": "10x5", "Size": "a", "New Date": "1"}), (None, {"Date": "1"})], "old map<string,string>, new map<string,string>")
    assert [r[0] for r in rows.select(media_checks.stamp_mismatches(F.col("old"), F.col("new"))).collect()] == [["Time"], []]
    diff = "project_id long, src long, dst long, exifdiff map<string,struct<action:string,old:string,new:string>>"
    edges = spark.createDataFrame([(1, 1, 2, {"Date": ("change", "2010:01", "2010-01"), "End Date": ("change", "1:1", "2:2"), "My Date": ("delete", "1", None)}), (1, 2, 3, None)], diff)
    assert [r.message for r in media_checks.format_rules(edges).collect()] == ["Meta Data Date Date Format Changed: 2010-01"]


def test_levels_rule(spark):
    smooth = [("s", i, 1000 + i * i, 1000) for i in range(256)]
    rough = [("r", i, 100 * (i % 2), 50) for i in range(256)]
    flat = [("f", i, 5, 5) for i in range(256)]
    rows = spark.createDataFrame(smooth + rough + flat + [(None, 3, 1, 0)], "k string, tone long, n_src long, n_dst long")
    got = {r.k: r.correlation for r in media_checks.levels_rule(rows, ["k"]).collect()}
    assert set(got) == {"r", None} and got["r"] < -0.99


def test_image_tables(spark):
    row = spark.createDataFrame([(list(range(64)), 3)], "t array<long>, n int")
    first = row.select(scalars.unzigzag(F.col("t")).alias("z"), scalars.unzigzag(F.slice("t", 1, 5)).alias("short"), scalars.jpeg_quality(F.array("t")).alias("one"), scalars.jpeg_quality(F.array("t", F.array(F.lit(1).cast("long")))).alias("cut")).first()
    assert first.z[:9] == [0, 1, 5, 6, 14, 15, 27, 28, 2] and sorted(first.z) == list(range(64))
    assert first.short is None and first.one == first.cut == 68
    turns = spark.range(10).select(scalars.exif_turn(F.col("id").cast("int")).alias("t")).collect()
    assert [tuple(r.t) for r in turns] == [(None, 0.0), (None, 0.0), ("horizontal", 0.0), (None, 180.0), ("vertical", 0.0), (None, 0.0), (None, 90.0), ("horizontal", 90.0), (None, 270.0), (None, 0.0)]
