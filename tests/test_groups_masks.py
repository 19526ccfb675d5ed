"""Nested operation groups and rules over their members; donor masks back to bases; histogram minima, last planes and local PSNR."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from provlake.operators import donor_masks, frames, groups, rollups

OPS = "op string, category string, rule string, transitions array<string>"


def test_groups_on_three_levels(spark):
    rows = [("outer", 1, "Blur"), ("outer", 2, "middle"), ("outer", 3, "Crop"), ("middle", 1, "inner"), ("middle", 2, "Paste"), ("inner", 1, "Color"), ("inner", 2, "Lost"), ("loop", 1, "pool"), ("pool", 1, "loop"), ("pool", 2, "Blur"), ("self", 1, "self")]
    g = spark.createDataFrame(rows, "group_name string, pos long, op string")
    got = sorted((r.group_name, list(r.path), r.op, r.is_cycle) for r in groups.expand_groups(g).collect())
    assert [x[2] for x in got if x[0] == "outer"] == ["Blur", "Color", "Lost", "Paste", "Crop"]
    assert [x for x in got if x[0] in ("loop", "self")] == [("loop", [1, 1], "loop", True), ("loop", [1, 2], "Blur", False), ("self", [1], "self", True)]
    o = spark.createDataFrame([("Blur", "Filter", "mask", ["image.image"]), ("Color", "Color", "mask", ["image.video"]), ("Paste", "Paste", "donor", ["image.image"]), ("Crop", "Transform", "size", ["video.audio", "image.image"])], OPS)
    out = {r.group_name: r for r in rollups.combine_ops(g, o.withColumn("mandatory", F.array(F.lower("op")))).collect()}
    assert (out["outer"].first_op, out["outer"].last_op, out["outer"].categories) == ("Blur", "Crop", ["Color", "Filter", "Paste", "Transform"])
    assert out["outer"].transitions == ["image.audio", "image.image"] and out["outer"].mandatory == ["blur", "color", "crop", "paste"]
    assert "self" not in out and out["loop"].first_op == "Blur"
    # Rules on categories look into a group, rules on names do not.
    members = groups.group_members(g, o)
    edges = spark.createDataFrame([(1, 9, "outer", "Groups", "image"), (2, 9, "inner", "Groups", "video"), (3, 9, "Blur", "Filter", "image"), (4, 9, "loop", "Groups", "image")], "project_id long, final long, op string, category string, media_type string")
    closure = edges.withColumns({"arguments": F.create_map().cast("map<string,string>"), "is_global": F.lit("no"), "common_parent": F.lit(False), "is_gan": F.lit(False)}).join(members, "op", "left")
    got = {r.project_id: (r.color, r.blur_local, r.other_enhancement) for r in rollups.property_rules(closure).collect()}
    assert got == {1: (True, False, True), 2: (True, False, False), 3: (False, True, False), 4: (False, False, False)}
    added = spark.createDataFrame([("fill", 1, "Fill")], "group_name string, pos long, op string")
    closure = closure.drop("members").withColumn("op", F.lit("fill")).join(groups.group_members(added, spark.createDataFrame([("Fill", "Fill", "x", [])], OPS)), "op", "left")
    assert all(r.other_enhancement == (r.project_id != 2) for r in rollups.property_rules(closure).collect())


def test_generated_media(spark):
    nodes = spark.createDataFrame([(1, 1, "yes", "no"), (1, 2, "no", "yes"), (2, 1, None, None)], "project_id long, node_id long, is_gan string, cgi string")
    finals = spark.createDataFrame([(1, 9, 2), (1, 9, 1), (1, 8, 2), (2, 9, 1), (2, 7, 5)], "project_id long, final long, base long")
    got = {(r.project_id, r.final): (r.gan_generated, r.cgi_generated) for r in rollups.generated_media(finals, nodes).collect()}
    assert got == {(1, 9): (True, False), (1, 8): (False, True), (2, 9): (False, False), (2, 7): (False, False)}


def test_steps_are_undone():
    """What an edge does to a picture and what undo() does to the result."""
    rng = np.random.default_rng(1)
    m = np.where(rng.random((4, 6)) < 0.3, 0, 255).astype("u1")
    done = {"horizontal": m[:, ::-1], "vertical": m[::-1], "turn:1": np.rot90(m, -1), "turn:3": np.rot90(m, -3), "none": m}
    for step, after in done.items():
        h, w, px = donor_masks.undo(*after.shape, after.astype("u1").tobytes(), step, None)
        assert (np.frombuffer(px, "u1").reshape(h, w) == m).all(), step
    h, w, px = donor_masks.undo(2, 3, m[1:3, 2:5].tobytes(), "crop:1,2,4,6", None)
    back = np.frombuffer(px, "u1").reshape(4, 6)
    assert (h, w) == (4, 6) and (back[1:3, 2:5] == m[1:3, 2:5]).all() and (back == 255).sum() >= 18
    covered = donor_masks.undo(4, 6, m.tobytes(), "cover", np.where(m == 0, 0, 255).astype("u1").tobytes())
    assert set(covered[2]) == {255} and donor_masks.undo(4, 6, m.tobytes(), "cover", b"\0") == (4, 6, m.tobytes())


def test_donor_masks_meet_and_end(spark):
    """5 -> 3 -> 1 and 5 -> 4 -> 1 meet in one base by two paths; the branch to 2 is covered whole; a video keeps the first path's mask."""
    nodes = spark.createDataFrame([(p, i, kind) for p, kind in ((1, "image"), (2, "video")) for i in range(1, 8)], "project_id long, node_id long, media_type string")
    plain = [(1, 3, "flip", "horizontal"), (1, 4, "blur", None), (3, 5, "x", None), (4, 5, "x", None), (2, 5, "paste", "cover"), (5, 7, "Donor", None)]
    edges = spark.createDataFrame([(p, *e) for p in (1, 2) for e in plain], "project_id long, src long, dst long, op string, step string")
    mask = bytes([0, 255, 255, 255, 0, 255])
    shape = "project_id long, src long, dst long, height int, width int, pixels binary"
    masks = spark.createDataFrame([(p, 5, 7, 2, 3, bytearray(mask)) for p in (1, 2)], shape)
    own = spark.createDataFrame([(p, 2, 5, 2, 3, bytearray(bytes(6))) for p in (1, 2)], shape)
    got = {(r.project_id, r.base): (r.height, r.width, bytes(r.pixels)) for r in donor_masks.donor_masks(nodes, edges, masks, own).collect()}
    flipped = bytes([255, 255, 0, 255, 0, 255])
    assert got == {(1, 1): (2, 3, bytes(min(a, b) for a, b in zip(mask, flipped))), (2, 1): (2, 3, flipped)}
    assert donor_masks.donor_masks(nodes, edges, masks.limit(0)).count() == 0


def test_minima_planes_and_psnr(spark):
    h = lambda counts: spark.createDataFrame([(1, v, n) for v, n in counts.items()], "media_id long, value int, n long")
    two = {v: 100 - abs(v - 10) * 8 for v in range(5, 16)} | {v: 90 - abs(v - 40) * 5 for v in range(30, 51)}
    s = [sum(two.get(i + k, 0) for k in range(3)) for i in range(254)]
    low = next(i for i in range(1, 253) if s[i] < s[i - 1] and s[i] < s[i + 1]) if any(s[i] < s[i - 1] and s[i] < s[i + 1] for i in range(1, 253)) else None
    run = lambda counts, **k: frames.first_minimum(h(counts), **k).first().threshold
    assert low is None and run(two, least=7) == 7  # a flat valley has no strict minimum
    sharp = {v: abs(v - 20) + 1 for v in range(256)}
    assert run(sharp) == 19 and run(sharp, least=30) == 30 and run(sharp, most=9, gain=2) == 11
    assert run({v: abs(v - 200) + 1 for v in range(256)}, least=3) == 3 and run(sharp, smoothing=0, least=6) == 6
    m = spark.createDataFrame([(1, 7, bytearray([0, 0, 255])), (2, 7, bytearray([255, 0, 255])), (3, 7, bytearray([0, 255, 255]))], "probe_id long, frame_no long, pixels binary")
    bits = spark.createDataFrame([(1, 1, 1, 5), (2, 1, 2, 4), (3, 1, 9, 1)], "probe_id long, group_id long, bit_number long, probe_no long")
    got = {r.plane: bytes(r.pixels) for r in frames.last_bitplanes(m, bits).collect()}
    assert got == {0: bytes([1, 1, 0]), 1: bytes([1, 0, 0])}
    pairs = spark.createDataFrame([(bytearray([0, 0, 9]), bytearray([0, 90, 9])), (bytearray([1, 1]), bytearray([1, 2]))], "a binary, b binary")
    local = [r.local_psnr for r in frames.diff_mask(pairs, 0.1).collect()]
    assert local == [pytest.approx(20 * np.log10(255 / 90)), 0.0]
