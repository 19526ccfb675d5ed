"""Changed sizes, sources, seeded choices and user names on cases worked out by hand; nulls, ties and empty tables."""

from pyspark.sql import functions as F

from provlake.functions import scalars
from provlake.operators import catalog, shape_rules

SHAPE = "project_id long, src long, dst long, shape_change string, approach string, orientation string, video_diff map<string,string>, src_w int, src_h int, dst_w int, dst_h int"


def test_shape_rules(spark):
    sides = (40, 30, 44, 33)
    rows = [
        (1, 1, 2, "(0, 0)", None, None, None, *sides),
        (1, 2, 3, "(4,3)", None, "Rotate 90 CW", None, *sides),
        (1, 3, 4, "(4L, 3L)", "Crop", None, None, *sides),
        (1, 4, 5, "(4, 3)", "Crop", None, {"a rotate": "270", "rotate": "0"}, 40, 30, 30, 40),
        (1, 5, 6, None, None, None, None, *sides),
        (1, 6, 7, "wide", None, None, None, None, None, None, None),
    ]
    got = sorted((r.start, r.module, r.severity) for r in shape_rules.shape_rules(spark.createDataFrame(rows, SHAPE)).collect())
    assert got == [(1, "size_changed", 3), (2, "size_exif", 3), (2, "size_kept", 3), (3, "size_exif", 2)]
    assert shape_rules.shape_rules(spark.createDataFrame([], SHAPE)).count() == 0


def test_exif_dimensions(spark):
    exif = {"Image Height": "30", "Image Width": "40", "AF Image Height": "3", "AF Image Width": "4", "Exif Image Height": "x", "Exif Image Width": "1", "png:IHDR.width,height": "40, 30"}
    row = spark.createDataFrame([(exif,), ({},), (None,)], "e map<string,string>")
    got = [[[tuple(p) for p in s] if s is not None else None for s in r] for r in row.select(scalars.exif_dimensions(F.col("e")), scalars.exif_dimensions(F.col("e"), True)).collect()]
    assert got == [[[(30, 40), (30, 40)], [(3, 4), (30, 40), (30, 40)]], [[], []], [None, None]]


def test_png_exif_rules(spark):
    kinds = "project_id long, src long, dst long, src_w int, src_h int, dst_w int, dst_h int, src_file string, raw boolean, exif map<string,string>, orientation string, rotated string, distortion string, location string"
    size = {"AF Image Height": "2900", "AF Image Width": "3900"}
    rows = [
        (1, 1, 2, 4000, 3000, 4000, 3000, "a.jpg", None, None, None, None, None, None),
        (1, 2, 3, 4000, 3000, 3000, 4000, "a.jpg", None, None, None, None, None, None),
        (1, 3, 4, 4000, 3000, 3000, 4000, "a.jpg", None, None, "Rotate 90 CW", "yes", None, None),
        (1, 4, 5, 4000, 3000, 4000, 3000, "a.jpg", None, None, "Rotate 90 CW", "yes", None, None),
        (1, 5, 6, 4000, 3000, 4000, 3000, "a.jpg", None, None, None, "yes", None, None),
        (1, 6, 7, 4000, 3000, 4000, 3000, "a.jpg", None, None, "Rotate 180", None, None, None),
        (1, 7, 8, 4000, 3000, 3936, 2936, "a.jpg", None, None, None, None, None, None),
        (1, 8, 9, 4000, 3000, 3936, 2936, "a.NEF", None, None, None, None, None, None),
        (1, 9, 10, 4000, 3000, 3900, 2900, "a.jpg", False, size, None, None, None, None),
        (1, 10, 11, 4000, 3000, 3900, 2900, "a.jpg", True, None, None, None, None, None),
        (1, 11, 12, 4000, 3000, 3900, 2900, "a.jpg", True, None, None, None, "yes", None),
        (1, 12, 13, 4000, 3000, 3996, 2996, "a.jpg", None, {"Image Height": "3000", "Image Width": "4000"}, None, None, None, "(2, 2)"),
    ]
    e = spark.createDataFrame(rows, kinds)
    assert sorted((r.start, r.message[:17]) for r in shape_rules.png_exif_rules(e).collect()) == [
        (2, "Image rotated; Ex"), (4, "Image not rotated"), (5, "No orientation me"), (6, "Exif indicates ro"), (7, "operation is not "), (9, "operation is not "), (10, "operation is not "),
    ]
    assert 9 not in {r.start for r in shape_rules.png_exif_rules(e, crop=True).collect()}


def test_homography_lines(spark):
    kinds = "project_id long, src long, dst long, src_w int, src_h int, matrix array<array<double>>"
    plain, affine = [[1.0, 0.0, 5.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [[2.0, 0.0, 1.0], [0.0, 1.0, 0.0]]
    folded = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [1 / 20, 1 / 20, 1.0]]
    e = spark.createDataFrame([(1, i, i + 1, 80, 60, m) for i, m in enumerate([plain, affine, folded, None])], kinds)
    assert [r.start for r in shape_rules.homography_line_rules(e).collect()] == [2]
    assert sorted(r.start for r in shape_rules.homography_line_rules(e, compat=True).collect()) == [0, 1, 2]


def test_source_rules(spark):
    nodes = [(1, "a.png", "PNG"), (2, "a.jpg", "JPEG"), (3, "a.mov", None), (4, "b.mov", None), (5, "c.mov", None), (6, "d.mov", "QT"), (7, None, None), (8, "e.nef", "NEF"), (9, "f.wav", "WAV"), (10, "g.mov", None)]
    n = spark.createDataFrame([(1, *r) for r in nodes], "project_id long, node_id long, file string, exif_type string")
    streams = [(3, 0, "video", "H.264 / AVC", "High 4:4:4 Predictive", None), (3, 1, "video", "mpeg", None, False), (4, 0, "audio", None, None, None), (5, 0, "video", "h264", "High 4:4:4 Predictive", True), (10, 2, "video", None, None, None)]
    s = spark.createDataFrame([(1, *r) for r in streams], "project_id long, node_id long, pos int, type string, codec string, profile string, vfr boolean")
    e = spark.createDataFrame([(1, i, 100, "Blur") for i in range(1, 11)], "project_id long, src long, dst long, op string")
    got = shape_rules.source_rules(e, n, s).collect()
    assert sorted(r.start for r in got if r.module == "uncompressed") == [2, 5, 6, 8]
    assert sorted(r.start for r in got if r.module == "raw_source") == [1, 2, 6]
    assert shape_rules.source_rules(e.limit(0), n, s).count() == 0


def test_random_values(spark):
    specs = [("i", "int[1:7:3]"), ("f", "float[0:1:0.25]"), ("u", "float[2:4]"), ("l", "list:x,y"), ("y", "yesno"), ("s", "int[1:2,50:51]"), ("e", "int[3:1:1]")]
    s = spark.createDataFrame(specs, "name string, spec string")
    draw = lambda seed, parts: {(r.name, r.draw): r.value for r in catalog.random_values(s.repartition(parts), 200, seed).collect()}
    one = draw(1, 1)
    assert one == draw(1, 5) and one != draw(2, 1) and len(one) == 1400
    values = lambda name: {v for (n, _), v in one.items() if n == name}
    assert values("i") == {"1", "4", "7"} and values("f") == {"0.0", "0.25", "0.5", "0.75"} and values("l") == {"x", "y"} and values("y") == {"yes", "no"}
    assert values("s") == {"1", "2", "50", "51"} and values("e") == {None}
    assert len(values("u")) > 150 and all(2 <= float(v) < 4 for v in values("u"))
    assert {r.name for r in catalog.spec_values(s).collect()} == {"i", "f", "u", "l", "y", "s"}


def test_random_donors(spark):
    bases = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (2, 7), (None, 1)], "project_id long, node_id long")
    got = {r.project_id: r.node_id for r in catalog.random_donors(bases, 3).collect()}
    assert set(got) == {1, 2, None} and got[2] == 7 and got[1] in (5, 6)
    assert len({catalog.random_donors(bases.where("project_id = 1"), s).first().node_id for s in range(12)}) == 2


def test_mend_users(spark):
    e = spark.createDataFrame([(1, 1, 2, "ann"), (1, 2, 3, "ANN"), (1, 3, 4, "zed"), (2, 1, 2, "zed"), (2, 2, 3, "ANN"), (3, 1, 2, None), (4, 1, 2, "zed")], "project_id long, src long, dst long, username string")
    j = spark.createDataFrame([(1, "BOB"), (1, "BOB"), (2, "unknown"), (3, "bob")], "project_id long, creator string")
    names = spark.createDataFrame([("ann",), ("bob",), ("bob",), (None,)], "username string")
    got = sorted((r.project_id, r.src, r.username) for r in catalog.mend_users(e, j, names).collect())
    assert got == [(1, 1, "ann"), (1, 2, "ann"), (1, 3, "bob"), (2, 1, "zed"), (2, 2, "ANN"), (3, 1, None), (4, 1, "zed")]


def test_best_name_in_blocks(spark):
    names = spark.createDataFrame([(i, f"user{i:03d}") for i in range(300)] + [(900, "ZZ"), (901, None)], "pos long, name string")
    users = spark.createDataFrame([("user12",), ("zzz",), ("user007",), (None,), ("zzz",)], "username string")
    whole = {r.username: r.best for r in catalog.best_name(users, names).collect()}
    assert whole == {r.username: r.best for r in catalog.best_name(users, names, block=7).collect()} == {"user12": "user012", "zzz": "ZZ"}
    assert catalog.best_name(users, names.limit(0)).count() == 0


def test_rotation_flag(spark):
    kinds = "project_id long, src long, dst long, op string, arguments map<string,string>, shape_change string"
    rows = [(1, 1, 2, "OutputPng", None, "(0, 0)"), (1, 1, 2, "OutputTif", {"a": "b"}, "(1,0)"), (1, 1, 2, "OutputPng", {"Image Rotated": "no"}, "(1,0)"), (1, 1, 3, "OutputPng", None, None), (1, 1, 2, "OutputPng", None, ""), (1, 1, 4, "OutputPng", None, None), (1, 1, 2, "Blur", None, "(1,0)")]
    sizes = spark.createDataFrame([(1, 1, 4, 3), (1, 2, 4, 3), (1, 3, 3, 4)], "project_id long, node_id long, width int, height int")
    got = [(r.op, r.dst, r.arguments) for r in catalog.rotation_flag(spark.createDataFrame(rows, kinds), sizes).collect()]
    key = lambda x: str(x)
    assert sorted(got, key=key) == sorted([("OutputPng", 2, {"Image Rotated": "no"}), ("OutputTif", 2, {"a": "b", "Image Rotated": "yes"}), ("OutputPng", 2, {"Image Rotated": "no"}), ("OutputPng", 3, {"Image Rotated": "yes"}), ("OutputPng", 2, {"Image Rotated": "no"}), ("OutputPng", 4, None), ("Blur", 2, None)], key=key)


def test_sheet_checks(spark):
    kinds = "file string, primary_secondary string, type string, kinematics string, collection string, model string, local_id string, flag string"
    rows = [("ok", "primary", "video", "PAN", None, "m", "d1", "TRUE"), ("bad", "Primary", "Video", "spin", "c9", "x", "d9", "maybe"), ("bare", None, "video", "", "", "", None, None), ("solid", "secondary", "model", None, None, None, "d1", None)]
    s = spark.createDataFrame(rows, kinds)
    models, local = spark.createDataFrame([("m",), ("m",)], "model string"), spark.createDataFrame([("d1",)], "local_id string")
    got = {}
    for r in catalog.sheet_checks(s, models, ["pan"], ["c1"], local, {"flag": ("video", "Video")}).collect():
        got.setdefault(r.file, set()).add(r.problem)
    assert got == {"bad": {"primary/secondary", "kinematics", "collection", "model", "local id", "flag"}, "bare": {"primary/secondary", "no kinematics", "no model", "no local id", "flag"}}
