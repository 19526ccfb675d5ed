"""Literal cases: segment algebra, times, lineage, metadata and permutations."""

from pyspark.sql import functions as F

from provlake.functions import scalars
from provlake.operators import catalog, frames, lineage, metadata, rules, segments


def segs(spark, rows, type_="video", rate=30.0):
    return spark.createDataFrame([(1, i, type_, rate, a, b, 0.0) for i, (a, b) in enumerate(rows)], "set_id long, seg_no long, type string, rate double, startframe long, endframe long, error double")


def bound(spark, a, b, op="x"):
    return spark.createDataFrame([(1, a, b, op)], "set_id long, startframe long, endframe long, op string")


def pairs(df):
    return sorted((r.startframe, r.endframe) for r in df.collect())


def test_drop_frames(spark):
    s = segs(spark, [(1, 30), (75, 104), (123, 149)])
    assert pairs(segments.drop_frames(s, bound(spark, 87, 92))) == [(1, 30), (75, 86), (87, 98), (117, 143)]
    assert pairs(segments.drop_frames(s, bound(spark, 63, 90))) == [(1, 30), (63, 76), (95, 121)]
    assert pairs(segments.drop_frames(segs(spark, [(1, 30), (75, 104)]), bound(spark, 90, 100))) == [(1, 30), (75, 89), (90, 93)]


def test_subtract_union(spark):
    a, b = segs(spark, [(10, 30), (50, 70)], rate=10.0), segs(spark, [(1, 6), (9, 15), (25, 35), (44, 47), (90, 95)], rate=10.0)
    assert pairs(segments.subtract_union(a, b)) == [(1, 6), (9, 9), (10, 30), (44, 47), (50, 70), (90, 95)]


def test_insert_undoes_drop_apart(spark):
    s = segs(spark, [(1, 30), (75, 104)])
    b = bound(spark, 40, 49)
    assert pairs(segments.insert_frames(segments.drop_frames(s, b), b)) == pairs(s)


def test_other_types_pass(spark):
    s = segs(spark, [(1, 30)], type_="audio")
    assert pairs(segments.drop_frames(s, bound(spark, 5, 9), type_="video")) == [(1, 30)]
    assert segments.drop_frames(s.limit(0), bound(spark, 5, 9)).count() == 0


def test_times(spark):
    t = scalars.time_to_ms(F.col("t"))
    rows = spark.createDataFrame([("03:10:10.434",), ("03:10:10:23",), ("00:00:00",), ("1",), ("x",), (None,)], "t string").select(t.alias("p")).collect()
    assert [r.p and (r.p.ms, r.p.frames) for r in rows] == [(1690434.0, 0), (1690000.0, 23), (0.0, 1), (0.0, 1), None, None]
    assert spark.sql("select 100001.111D ms").select(scalars.ms_to_time(F.col("ms")).alias("t")).first().t == "00:01:40.001111"


def test_time_bounds(spark):
    f = spark.createDataFrame([(1, i, 998.0 + i) for i in range(1, 11)], "media_id long, frame_no long, time_ms double")
    row = frames.time_bounds(f, 1000, 2, 1003, 4).first()
    assert (row.startframe, row.endframe) == (4, 9)


def test_positions(spark):
    p = spark.createDataFrame([(1, 0, 1000.0, 8000.0), (1, 1, 5000.0, 8000.0), (1, 2, 10000.0, 8000.0)], "set_id long, pos_no long, ms double, duration_ms double")
    out = {r.pos_no: r.end_ms for r in segments.position_segments(p, 6000.0, 11000.0, 44100.0).collect()}
    assert round(out[1], 2) == 9999.98 and out[2] == 11000


def test_permutations(spark):
    rows = catalog.permute({"a": [1, 2, 3, 4], "b": ["1", "2", "3"]}, True, spark).orderBy("row_no").collect()
    assert len(rows) == 12 and [(r.a, r.b) for r in rows[:4]] == [(1, "1"), (1, "2"), (1, "3"), (2, "1")]
    together = catalog.permute({"a": [1, 2, 3, 4], "b": ["1", "2", "3"]}, False, spark).orderBy("row_no").collect()
    assert [(r.a, r.b) for r in together] == [(1, "1"), (2, "2"), (3, "3"), (4, "1")]


def test_spec_values(spark):
    s = spark.createDataFrame([("i", "int[1:7:3]"), ("f", "float[0:1:0.5]"), ("l", "list:x,y"), ("y", "yesno")], "name string, spec string")
    out = {}
    for r in catalog.spec_values(s).orderBy("name", "pos").collect():
        out.setdefault(r.name, []).append(r.value)
    assert out == {"i": ["1", "4", "7"], "f": ["0.0", "0.5"], "l": ["x", "y"], "y": ["yes", "no"]}


def test_lineage_with_cycle(spark):
    n = spark.createDataFrame([(1, i) for i in range(1, 6)], "project_id long, node_id long")
    e = spark.createDataFrame([(1, 1, 2, "Blur"), (1, 2, 3, "Blur"), (1, 3, 2, "Blur"), (1, 4, 3, "Donor")], "project_id long, src long, dst long, op string")
    assert sorted(r.node_id for r in lineage.cycle_nodes(n, e).collect()) == [2, 3]
    assert {(r.node_id, r.component) for r in lineage.components(n, e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}
    assert {(r.node_id, r.base) for r in lineage.base_paths(n, e).collect() if r.node_id == 3} == {(3, 1)}
    assert lineage.reach(e, n.limit(0)).count() == 0
    assert lineage.cycle_nodes(n.limit(0), e.limit(0)).count() == 0


def test_argument_types(spark):
    rows = [("int[1:5]", "3", True), ("int[1:5]", "9", False), ("float[0:1]", "0.5", True), ("float[0:1]", "x", False), ("yesno", "Yes", True), ("time", "00:01:02", True), ("coordinates", "(1,2)", True), ("list:a,b", "c", False), ("time", None, False)]
    df = spark.createDataFrame(rows, "k string, v string, ok boolean")
    assert df.where(rules.argument_ok(F.col("k"), F.col("v")) != F.col("ok")).count() == 0


def test_isolated_rules(spark):
    m = spark.createDataFrame([(1, 3, 1, 2, "x", "m"), (1, 3, 1, 2, "y", "m")], "project_id long, severity int, start long, end long, module string, message string")
    e = spark.createDataFrame([(1, 1, 2, "A")], "project_id long, src long, dst long, op string")
    r = spark.createDataFrame([("A", "donor:x"), ("A", "y")], "op string, rule string")
    assert [x.module for x in rules.run_rules(m, e, r, isolated=True).collect()] == ["y"]
    assert rules.run_rules(m, e, r).count() == 2


def test_paths(spark):
    df = spark.sql("select named_struct('a', array(named_struct('b', 'x'), named_struct('b', ''), named_struct('b', 'y'))) r, map('k', 'v', 'z', '') m")
    row = df.select(scalars.path_value(F.col("r"), "a[2].b").alias("one"), scalars.path_values(F.col("r"), "a[].b").alias("all"), scalars.path_values(F.col("m"), "*").alias("m"), scalars.path_value(F.col("r"), "a[7].b", "d").alias("d")).first()
    assert (row.one, row.all, row.m, row.d) == ("y", ["x", "y"], ["v"], "d")


def test_stream_ids(spark):
    s = spark.createDataFrame([("f", 0, "video", None), ("f", 1, "audio", "mono"), ("f", 2, "audio", "mono")], "file string, stream_pos int, codec_type string, channel_layout string")
    assert [r.stream for r in metadata.stream_ids(s).orderBy("stream_pos").collect()] == ["video", "mono", "mono1"]


def test_pixels(spark):
    a, b = bytes([0, 10, 200, 255]), bytes([0, 10, 100, 255])
    row = frames.diff_mask(spark.createDataFrame([(bytearray(a), bytearray(b))], "a binary, b binary"), 0.1).first()
    assert bytes(row.mask) == bytes([255, 255, 0, 255]) and row.changed == 1 and row.psnr > 0
    bits = spark.createDataFrame([(1, 1, 1), (2, 1, 9), (3, 1, 2)], "probe_id long, group_id long, bit_number long")
    masks = spark.createDataFrame([(1, 1, bytearray([0, 255])), (2, 1, bytearray([0, 0])), (3, 1, bytearray([0, 0]))], "probe_id long, frame_no long, pixels binary")
    out = {r.plane: bytes(r.pixels) for r in frames.bitplanes(masks, bits).collect()}
    assert out == {0: bytes([3, 2]), 1: bytes([1, 1])}
