"""Windows over media that are cut into blocks, on blocks of eight, against plain Python; streaming intake that is run again."""

import random

import pytest
from pyspark.sql import functions as F

from provlake.functions import blocks
from provlake.operators import catalog, frames, lineage, metadata, segments


@pytest.fixture
def samples(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    rng = random.Random(3)
    rows = [(m, i, rng.choice([0, 0, 1, 9])) for m in (1, 2) for i in range(1, 61)]
    return rows, spark.createDataFrame(rows, "media_id long, sample_no long, value int")


def runs(numbers, step=1):
    out = []
    for n in numbers:
        if out and n - out[-1][1] <= step:
            out[-1] = (out[-1][0], n, out[-1][2] + 1)
        else:
            out.append((n, n, 1))
    return out


def test_islands_over_blocks(samples):
    rows, df = samples
    for step in (1, 3, 20):
        got = sorted(tuple(r) for r in frames.islands(df, ["media_id"], "sample_no", F.col("value") == 0, step).collect())
        assert got == sorted((m, *r) for m in (1, 2) for r in runs([i for k, i, v in rows if k == m and v == 0], step))


def test_windows_over_blocks(samples):
    rows, df = samples
    values = {m: [v for k, _, v in rows if k == m] for m in (1, 2)}
    got = {(r.media_id, r.sample_no): r["mean"] for r in frames.moving_average(df, 5).collect()}
    assert got == {(m, i + 1): pytest.approx(sum(w := v[max(0, i - 4) : i + 1]) / len(w)) for m, v in values.items() for i in range(60)}
    quiet = {m: [i + 1 for i in range(58) if max(v[i : i + 3]) <= 1] for m, v in values.items()}
    got = sorted((r.media_id, r.start, r.stop, r.n) for r in frames.silences(df, 3, 1).collect())
    assert got == sorted((m, a, b + 2, n) for m in quiet for a, b, n in runs(quiet[m], 3))
    f = df.select("media_id", F.col("sample_no").alias("frame_no"), (F.col("sample_no") * 10.0).alias("time_ms"))
    assert {(r.startframe, r.endframe) for r in frames.time_bounds(f, 55, 7, 300, 12).collect()} == {(12, 42)}


def test_windows_longer_than_blocks(spark, monkeypatch):
    """Windows of three blocks and more: two seconds of silence at 44.1 kHz, and means over gaps in the numbers, as without blocks."""
    rows = [(1, i, 9 if i in (5, 70_010) or i > 160_000 else 0) for i in range(1, 160_100)]
    df = spark.createDataFrame(rows, "media_id long, sample_no long, value int").repartition(4)
    got = [tuple(r) for r in frames.silences(df, 70_000, 1).collect()]
    assert sorted(got) == [(1, 6, 70_009, 5), (1, 70_011, 160_000, 19_991)]
    monkeypatch.setattr(blocks, "BLOCK", 8)
    rng = random.Random(5)
    rows = [(m, i, rng.randint(-9, 9)) for m in (1, 2, None) for i in range(1, 90) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "media_id long, sample_no long, value int")
    for n in (1, 25, 300):
        got = {(r.media_id, r.sample_no): r["mean"] for r in frames.moving_average(df, n).collect()}
        held = {(m, i): [v for k, j, v in rows if k == m and i - n < j <= i] for m, i, _ in rows}
        assert got == {k: pytest.approx(sum(w) / len(w), abs=1e-6) for k, w in held.items()}


def test_one_long_medium_spreads_over_tasks(spark, monkeypatch):
    """Ranks, the row before and the last known value over blocks of one medium, null keys included, against plain Python."""
    monkeypatch.setattr(blocks, "BLOCK", 8)
    rng = random.Random(6)
    rows = [(m, i, rng.choice([None, i * 2])) for m in (1, None) for i in rng.sample(range(200), 120)]
    df = spark.createDataFrame(rows, "media_id long, frame_no long, v long").repartition(3)
    by = {m: sorted((i, v) for k, i, v in rows if k == m) for m in (1, None)}
    got = {(r.media_id, r.frame_no): (r["_i"], r["_n"]) for r in blocks.ranked(df, ["media_id"], "frame_no").collect()}
    assert got == {(m, i): (k, 120) for m, held in by.items() for k, (i, _) in enumerate(held, 1)}
    got = {(r.media_id, r.frame_no): r.p for r in blocks.previous(df, ["media_id"], "frame_no", "v", "p").collect()}
    assert got == {(m, i): held[k - 1][1] if k else None for m, held in by.items() for k, (i, _) in enumerate(held)}
    both = blocks.last_known(blocks.in_blocks(df, "frame_no"), ["media_id"], ["frame_no"], {"x": "v"}, {"y": "v"}).collect()
    for back in (False, True):
        got = {(r.media_id, r.frame_no): r.y if back else r.x for r in both}
        known = lambda held, i: [v for j, v in held if v is not None and (j >= i if back else j <= i)]
        assert got == {(m, i): (known(held, i) or [None])[0 if back else -1] for m, held in by.items() for i, _ in held}
    plan = blocks.ranked(df, ["media_id"], "frame_no")._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan


def test_pairs_that_a_bound_rules_out(spark):
    """The k best pairs of all, bounds below every score, and blocks far apart that nobody searches."""
    rng = random.Random(7)
    base = [[rng.gauss(0, 1) * s for _ in range(12)] for s in (1, 300, 900)]
    rows = [(m, i, [float(round(x + rng.gauss(0, 5))) for x in base[i // 20 % 3]]) for m, n in ((1, 120), (2, 30)) for i in range(1, n + 1)]
    f = spark.createDataFrame(rows, "media_id long, frame_no long, gray array<double>")
    std = lambda a, b: (sum(((x - y) - sum(p - q for p, q in zip(a, b)) / len(a)) ** 2 for x, y in zip(a, b)) / len(a)) ** 0.5
    pairs = sorted((m, int(std(a, b) * 1000 + 1e-9), i, j) for m, i, a in rows for k, j, b in rows if m == k and j - i >= 5)
    want = [(m, i, j, s) for x in (1, 2) for m, s, i, j in [p for p in pairs if p[0] == x][:9]]
    got = sorted(((r.media_id, r.frame_a, r.frame_b, r.score) for r in frames.best_frame_pairs(f, 5, 0, 9, block=10).collect()), key=lambda r: (r[0], r[3], r[1], r[2]))
    assert got == want
    bounds = {(r.media_id, r["_a"], r["_b"]): r.bound for r in frames.block_pairs(f.withColumn("_b", F.floor(F.col("frame_no") / 10))).collect()}
    for m, s, i, j in pairs:
        assert bounds[m, i // 10, j // 10] * 1000 <= s + 1.001
    most = max(r[3] for r in want if r[0] == 1)
    assert sum(b * 1000 > most + 1 for (m, *_), b in bounds.items() if m == 1) > len([1 for m, *_ in bounds if m == 1]) / 3


def test_overlaps_of_long_segments(spark):
    rng = random.Random(4)
    rows = [(1, "video", 30.0, i, (a := rng.randint(1, 2000)), a + rng.choice([0, 5, 700])) for i in range(80)]
    df = spark.createDataFrame(rows, "set_id long, type string, rate double, seg_no long, startframe long, endframe long")
    got = sorted((r.seg_no, r.other_no, r.startframe, r.endframe) for r in segments.intersect_segments(df, df, bucket=64).collect())
    assert got == sorted((x[3], y[3], max(x[4], y[4]), min(x[5], y[5])) for x in rows for y in rows if x[4] <= y[5] and y[4] <= x[5])


def test_packets_within_a_step(spark):
    schema = "media_id long, stream string, time_ms double, meta map<string,string>"
    a = spark.createDataFrame([(1, "v", t, {"k": k}) for t, k in ((0.0, "a"), (40.0, "b"), (80.0, "c"), (120.0, "d"))], schema)
    b = spark.createDataFrame([(1, "v", t, {"k": k}) for t, k in ((0.0, "a"), (45.0, "x"), (120.0, "e"), (160.0, "f"), (200.0, "g"))], schema)
    got = sorted((r.action, r.time_ms, r.n, dict(r["diff"] or {}).keys()) for r in metadata.packet_diff(a, b, 10.0).collect())
    assert [g[:3] for g in got] == [("add", 160.0, 2), ("change", 40.0, 1), ("change", 120.0, 1), ("delete", 80.0, 1)]


def test_first_pair_wins(spark):
    files = spark.createDataFrame([("abc.png",), ("ab.png",), ("x",)], "file string")
    pairs = spark.createDataFrame([(2, "abc", "long"), (1, "a", "short"), (3, "", "any")], "pos int, prefix string, to string")
    assert {r.file: r.to for r in catalog.pick_paired(files, pairs).collect()} == {"abc.png": "short", "ab.png": "short", "x": "any"}


def test_nearest_base_equals_shortest_path(spark):
    rng = random.Random(6)
    edges = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(70)) if a != b}
    nodes = spark.createDataFrame([(1, i) for i in range(40)], "project_id long, node_id long")
    e = spark.createDataFrame([(1, a, b, rng.choice(["Blur", "Blur", "Donor"])) for a, b in sorted(edges)], "project_id long, src long, dst long, op string")
    paths = lineage.base_paths(nodes, e).groupBy("node_id").agg(F.min(F.struct("level", "base")).alias("b")).collect()
    near = {r.node_id: (r.level, r.base) for r in lineage.nearest_bases(nodes, e).collect()}
    assert near == {r.node_id: tuple(r.b) for r in paths}


def test_intake_again_writes_each_message_once(spark, tmp_path):
    from provlake.streaming import frames as streaming

    spark.createDataFrame([(1,), (2,)], "project_id long").write.parquet(f"{tmp_path}/in")
    run = lambda n: streaming.intake(spark.readStream.schema("project_id long").parquet(f"{tmp_path}/in"), "project_id", f"{tmp_path}/done", f"{tmp_path}/report", lambda b: b.selectExpr("project_id", "'m' as message"), f"{tmp_path}/c{n}").awaitTermination()
    run(0)
    run(0)
    assert spark.read.parquet(f"{tmp_path}/report").count() == 2 and spark.read.parquet(f"{tmp_path}/done").count() == 2
    # The same batch number from the start, as after a failure: its folder is written over.
    run(1)
    assert spark.read.parquet(f"{tmp_path}/report").count() == 2


def test_written_tables_can_be_cleared(spark):
    from provlake.functions import storage

    df = storage.written(spark.range(3))
    assert storage.written(df) is df and df.count() == 3
    storage.clear_written(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) and not storage._PATHS


def test_registered_transforms_and_processors(spark):
    from provlake.operators import probes

    e = spark.createDataFrame([(1, 1, 2, "Blur", "video"), (1, 2, 3, "Shorten", "video")], "project_id long, src long, dst long, op string, media_type string")
    segs = spark.createDataFrame([(2, 1, "video", 1, 40)], "set_id long, seg_no long, type string, startframe long, endframe long")
    bounds = spark.createDataFrame([(3, 11, 20)], "set_id long, startframe long, endframe long")
    run = lambda *f: sorted((r.startframe, r.endframe) for r in probes.generate_probes(e, segs, bounds, lambda x: x.where("op = 'Blur'"), f).collect())
    assert run() == [(1, 40)]
    probes.register_transform("Shorten", {"video": [("cut", None)]})
    try:
        assert run() == [(1, 10), (11, 30)] and run(lambda p: p.where("startframe > 10")) == [(11, 30)]
    finally:
        probes.register_transform("Shorten", None)
    with pytest.raises(ValueError):
        probes.register_transform("Shorten", {"video": [("melt", None)]})
