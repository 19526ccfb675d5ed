"""Transform programs: golden cases both ways, round trips, routing by media and add type; lineage in one table; strong components."""

import random

import pytest
from pyspark.sql import functions as F

from provlake.operators import lineage, probes, segments, transforms

BOUND = "set_id long, op string, media_type string, startframe long, endframe long, add_type string, to_start long, to_end long, from_frames long, to_frames long"
SEG = "set_id long, seg_no long, type string, startframe long, endframe long"


def frame_op(spark, op, bound=(11, 20), media="video", add=None, to=(None, None), frames=(None, None), donor=False, segs=((1, "video", 1, 40),)):
    b = spark.createDataFrame([(1, op, media, *bound, add, *to, *frames)], BOUND)
    s = spark.createDataFrame([(1, n, t, a, z) for n, t, a, z in segs], SEG)
    return sorted((r.seg_no, r.startframe, r.endframe) for r in segments.apply_frame_op(s, b, donor).collect())


def test_golden(spark):
    run = lambda *a, **k: frame_op(spark, *a, **k)
    assert run("DeleteFrames") == [(1, 1, 10), (1, 11, 30)]
    assert run("DeleteFrames", donor=True) == [(1, 1, 10), (1, 21, 50)]
    assert run("InsertFrames") == [(1, 1, 10), (1, 21, 50)]
    assert run("InsertFrames", donor=True) == [(1, 1, 10), (1, 11, 30)]
    # Paste lays over unless told to insert; copy inserts unless told to lay over, and gives back what it took.
    assert run("PasteFrames") == run("PasteFrames", donor=True) == [(1, 1, 10), (1, 21, 40)]
    assert run("PasteFrames", add="insert") == [(1, 1, 10), (1, 21, 50)]
    assert run("CopyPaste", to=(31, 40)) == [(1, 1, 10), (1, 21, 50)] and run("CopyPaste", to=(31, 40), donor=True) == [(1, 1, 10), (1, 11, 30)]
    assert run("CopyPaste", add="overlay", to=(35, 44)) == [(1, 1, 10), (1, 21, 40)]
    assert run("CopyPaste", add="overlay", to=(35, 44), donor=True) == [(0, 35, 44), (1, 1, 10), (1, 21, 34)]
    assert run("CopyPaste", add="overlay", to=(60, 69), donor=True, segs=[(1, "video", 1, 40), (2, "video", 15, 30)]) == [(0, 60, 69), (1, 1, 10), (1, 21, 40), (2, 21, 30)]
    # A part that starts inside the given frames goes whole.
    assert run("CopyPaste", add="overlay", to=(21, 30), donor=True) == [(0, 21, 30), (1, 1, 10)]
    assert run("CropFrames") == [(1, 1, 10)] and run("CropFrames", donor=True) == [(1, 11, 50)]
    assert run("Reverse", segs=[(1, "video", 5, 13)]) == [(1, 5, 10), (1, 18, 20)]
    assert run("OutputMp4", frames=(40, 80)) == [(1, 1, 80)] and run("OutputMp4", frames=(80, 40), donor=True, segs=[(1, "video", 11, 20)]) == [(1, 21, 40)]
    assert run("OutputMp4") == [(1, 1, 40)]  # without lengths
    # Sound and picture apart, and no program for a picture's source.
    assert run("AddAudio", segs=[(1, "video", 1, 40), (2, "audio", 1, 40)]) == [(1, 1, 40), (2, 1, 10), (2, 21, 40)]
    assert run("ReplaceAudio", segs=[(1, "video", 1, 40), (2, "audio", 1, 40)]) == [(1, 1, 40)] and run("ReplaceAudio", donor=True, segs=[(2, "audio", 1, 40)]) == [(2, 1, 40)]
    assert run("DeleteFrames", media="image") == run("Blur") == [(1, 1, 40)]
    assert run("DeleteFrames", bound=(None, None)) == [(1, 1, 40)] and run("DeleteFrames", bound=(1, 99)) == []


@pytest.mark.parametrize("op, add", [("InsertFrames", None), ("PasteFrames", "insert"), ("TimeWarp", None), ("Reverse", None), ("AddAudio", "insert")])
def test_round_trips(spark, op, add):
    """What makes room or mirrors is undone without a loss."""
    rng = random.Random(3)
    segs = [(i, 1, "audio" if op == "AddAudio" else "video", (a := rng.randint(1, 60)), a + rng.randint(0, 40)) for i in range(60)]
    s = spark.createDataFrame(segs, SEG)
    b = spark.createDataFrame([(i, op, "video", (x := rng.randint(1, 80)), x + rng.randint(0, 20), add, None, None, None, None) for i in range(60)], BOUND)
    back = segments.apply_frame_op(segments.apply_frame_op(s, b), b, donor=True)
    covered = lambda rows: {(r[0], f) for r in rows for f in range(r[3], r[4] + 1)}
    assert covered([tuple(r) for r in back.collect()]) == covered(segs)


def test_several_steps_undo_in_reverse(spark):
    """A registered program of two steps: cut, then mirrored; the inverse mirrors first."""
    transforms.register_transform("Both", {"video": [("insert", None), ("mirror", None)]})
    try:
        assert frame_op(spark, "Both", segs=[(1, "video", 5, 12)]) == [(1, 5, 10), (1, 21, 22)]
        assert frame_op(spark, "Both", segs=[(1, "video", 11, 20)], donor=True) == []
        assert frame_op(spark, "Both", segs=[(1, "video", 21, 22)], donor=True) == [(1, 11, 12)]
    finally:
        transforms.register_transform("Both", None)


def test_probes_and_donors_by_media(spark):
    edges = "project_id long, src long, dst long, op string, media_type string, add_type string"
    e = spark.createDataFrame([(1, 1, 2, "Blur", "video", None), (1, 2, 3, "AddAudio", "video", "insert"), (1, 3, 4, "OutputMp4", "video", None), (1, 5, 6, "DeleteFrames", "video", None), (1, 6, 2, "Donor", "video", None)], edges)
    segs = spark.createDataFrame([(2, 1, "video", 1, 40), (2, 2, "audio", 1, 40)], SEG)
    bounds = spark.createDataFrame([(3, 11, 20), (6, 5, 9)], "set_id long, startframe long, endframe long")
    media = spark.createDataFrame([(1, 3, 50), (1, 4, 100)], "project_id long, node_id long, frames long")
    got = sorted((r.type, r.final, r.startframe, r.endframe) for r in probes.generate_probes(e, segs, bounds, lambda x: x.where("op = 'Blur'"), media=media).collect())
    assert got == [("audio", 4, 1, 20), ("audio", 4, 41, 100), ("video", 4, 1, 80)]
    nodes = spark.createDataFrame([(1, i) for i in range(1, 7)], "project_id long, node_id long")
    got = sorted((r.type, r.base, r.startframe, r.endframe) for r in probes.donor_segments(nodes, e, segs, bounds, media).collect())
    assert got == [(t, 5, a, z) for t in ("audio", "video") for a, z in ((1, 4), (10, 45))]


@pytest.mark.parametrize("depth", [10, 30])
def test_plan_does_not_grow_with_depth(spark, depth):
    nodes = spark.createDataFrame([(1, i) for i in range(depth)], "project_id long, node_id long")
    edges = spark.createDataFrame([(1, i, i + 1, "Blur") for i in range(depth - 1)], "project_id long, src long, dst long, op string")
    out = lineage.reach(edges, nodes.where("node_id = 0"))
    assert {(r.node_id, r.depth) for r in out.collect()} == {(i, i) for i in range(depth)}
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan parquet") <= 2
    assert {r.node_id for r in lineage.reached(edges, nodes.where("node_id in (3, 5)")).collect()} == set(range(3, depth))
    assert {r.node_id for r in lineage.nearest_bases(nodes, edges).where("base = 0").collect()} == set(range(depth))


def test_nodes_between_cycles_are_on_none(spark):
    """Two cycles joined by a path, a node that is its own successor, a tail, and a cycle of many nodes with chords."""
    edges = [(1, 1, 2), (1, 2, 1), (1, 2, 3), (1, 3, 4), (1, 4, 5), (1, 5, 6), (1, 6, 4), (1, 6, 7), (1, 8, 8), (1, 8, 1), (2, 1, 2), (2, 2, 3)]
    rng = random.Random(1)
    edges += [(3, a, (a + 1) % 40) for a in range(40)] + [(3, rng.randrange(60), rng.randrange(60)) for _ in range(50)]

    def on_cycle(p):
        after = {}
        for q, a, b in edges:
            if q == p:
                after.setdefault(a, set()).add(b)
        out = set()
        for n in after:
            seen, todo = set(), list(after[n])
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += after.get(x, ())
            if n in seen:
                out.add((p, n))
        return out

    e = spark.createDataFrame(edges, "project_id long, src long, dst long")
    nodes = e.select("project_id", F.col("src").alias("node_id"))
    got = {(r.project_id, r.node_id) for r in lineage.cycle_nodes(nodes, e).collect()}
    assert got == on_cycle(1) | on_cycle(2) | on_cycle(3) and (1, 3) not in got and (1, 8) in got
