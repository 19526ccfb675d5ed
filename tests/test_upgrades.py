"""Journal upgrades: fixes in version order that feed one another, only those that a journal lacks, each step checked."""

from pyspark.sql import functions as F

from provlake.operators import upgrades

EDGE = "project_id long, op string, arguments map<string,string>, filetype string, description string, softwareName string, flatdiff map<string,string>, global string, change_ratio double, mask_pixels long, change_category string, rate double, recordMaskInComposite string, category string"


def run(spark, rows, done=()):
    e = spark.createDataFrame([(p, *r) for p, r in rows], EDGE)
    j = spark.createDataFrame([(p, list(done) or None) for p in {p for p, _ in rows}], "project_id long, jt_upgrades array<string>")
    return sorted(upgrades.upgraded(e, j).collect(), key=lambda r: (r.project_id, r.description or ""))


def edge(op, args=None, kind="image", said=None, software="Gimp", flat=None, widely=None, ratio=None, pixels=None, size=None, rate=None, flag=None, category=None):
    return (op, args, kind, said, software, flat, widely, ratio, pixels, size, rate, flag, category)


def test_fixes_feed_one_another(spark):
    """A removal from frames becomes a fill, and in a video, by a later fix, a sampled paste; its time keys move before its times change."""
    args = {"Insertion Start Time": "00:00:59:30", "Left": "3", "Start Time": "gone"}
    (r,) = run(spark, [(1, edge("SelectRemoveFromFrames", args, "video", rate=25.0))])
    assert r.op == "PasteSampled" and r.arguments == {"Start Time": "00:01:00.200000", "Left Pan": "3", "purpose": "remove"} and r.applied == list(upgrades.FIXES)
    # Beyond its version a fix is not applied: the names are new already, the times are not.
    (r,) = run(spark, [(1, edge("SelectRemoveFromFrames", args, "video", rate=25.0))], ["04.0810.546e996a36"])
    assert r.op == "SelectRemoveFromFrames" and r.arguments["Insertion Start Time"] == "00:01:00.200000" and r.arguments["Left"] == "3"
    (r,) = run(spark, [(1, edge("ColorBlendDissolve", None))], ["0.6.0531.ce60889744"])
    assert r.op == "ColorBlendDissolve" and r.applied is None and r.arguments == {}


def test_each_fix(spark):
    one = lambda *a, **k: run(spark, [(1, edge(*a, **k))])[0]
    assert (r := one("ColorBlendMultiply")).op == "Blend" and r.arguments == {"mode": "Multiply"}
    assert one("X", {"Copy End Time": "5", "a": None}).arguments == {"End Time": "5", "a": None}
    assert one("X", flag="true").recordMaskInComposite == "yes" and one("X", flag="true", category="Output").recordMaskInComposite == "no" and one("X").recordMaskInComposite is None
    assert one("X", {"Time": "01:02:03.5:7", "Other": "1:2:3:4"}).arguments == {"Time": "01:02:03.500000", "Other": "1:2:3:4"}  # no rate: frames go
    assert one("X", flat={"0:a": "1", "0:b:c": "2", "1:a": "3", "plain": "4"}).metadatadiff == {"0": {"a": "1", "b": "2"}, "1": {"a": "3"}}
    assert one("TransformContentAwareScale").arguments == {"inputmasktype": "keep", "apply mask": "yes"} and one("TransformContentAwareScale", kind="video").op == "PasteSampled"
    assert one("TransformSeamCarving").arguments == {"inputmasktype": "color", "apply mask": "no"}
    assert one("OutputPng").arguments == {"Lens Distortion Applied": "no"} and one("OutputPng", {"Lens Distortion Applied": "yes"}).arguments == {"Lens Distortion Applied": "yes"}
    sizes = [one("X", widely="no", ratio=0.5, pixels=n, size="large").change_category for n in (4000, 10_000, 30_000)]
    assert sizes == ["small", "medium", "large"] and one("X", widely="yes", ratio=0.5, pixels=9, size="large").change_category == "large"
    assert one("ColorCurve", widely="yes")["global"] == "no" and one("Crop", widely="yes")["global"] == "yes"
    assert one("BlurMotion", {"Blur Type": "Motion"}, said="at angle 45 and distance 12").arguments == {"Blur Type": "Motion", "Blur Radius": "12", "Blur Angle": "45"}
    assert one("Blur", {"Blur Radius": "9"}, said="a radius of 4 pixels").arguments == {"Blur Radius": "4", "Blur Angle": "0"} and one("Blur", {"Blur Radius": "9"}).arguments["Blur Radius"] == "9"


def test_software_of_the_journal(spark):
    rows = [(1, edge("X", said="a", software="B")), (1, edge("X", said="b", software="A")), (1, edge("X", said="c", software="")), (1, edge("Donor", said="d", software="")), (1, edge("Recapture", said="e", software="A")), (2, edge("X", said="a", software="no software")), (1, edge("X", said="f", software=None))]
    assert [(r.project_id, r.softwareName) for r in run(spark, rows)] == [(1, "B"), (1, "A"), (1, "A"), (1, ""), (1, "Off Camera"), (1, "A"), (2, "no software")]


def test_one_projection(spark):
    """All fixes of all journals need the joins with the journals' needs alone."""
    e = spark.createDataFrame([(1, "Blur", {})], "project_id long, op string, arguments map<string,string>").withColumn("softwareName", F.lit("x"))
    plan = upgrades.upgraded(e, spark.createDataFrame([(1, None)], "project_id long, jt_upgrades array<string>"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Python") == 0 and plan.count("Join") <= 3
