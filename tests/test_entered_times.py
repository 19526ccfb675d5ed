"""Entered times against recorded segments, by frames and by milliseconds; stale journals, cycles as one row, finals under a proxy."""

from provlake.operators import rules

EDGE = "project_id long, src long, dst long, media_type string, rate double, arguments map<string,string>"


def told(df):
    return sorted((r.start, r.message) for r in df.collect())


def test_entered_times(spark):
    rows = [
        (1, 1, 11, "video", 10.0, {"Insertion Start Time": "00:00:01.000", "End Time": "00:00:02.000"}),  # frames 11 and 21
        (1, 2, 12, "audio", 1000.0, {"Start Time": "00:00:01.000", "End Time": "00:00:02.000"}),  # 1000 and 2000 ms
        (1, 3, 13, "image", 10.0, {"Start Time": "00:00:01.000"}),
        (1, 4, 14, "video", 10.0, {"Start Time": "00:00:01.000:3"}),
        (1, 5, 15, "video", 10.0, {"Other": "1"}),
    ]
    e = spark.createDataFrame(rows, EDGE)
    found = spark.createDataFrame([(11, "video", 12, 19), (12, "audio", 1101, 2102), (13, "video", 90, 99), (15, "video", 5, 6)], "dst long, type string, start long, stop long")
    got = told(rules.entered_time_rules(e, found))
    assert got == [(1, "end frame differs from the detected end"), (2, "end time differs from the detected end"), (4, "change masks are missing")]
    assert told(rules.entered_time_rules(e, found, frames=0)) == sorted([*got, (1, "start frame differs from the detected start")])
    assert told(rules.entered_time_rules(e, found, frames=0, compat=True)) == got
    assert told(rules.entered_time_rules(e, found, frames=2, ms=200)) == [(4, "change masks are missing")]
    times = [(1, k, k, "audio", 1.0, {n: v for n, v in (("Start Time", a), ("End Time", b)) if v}) for k, (a, b) in enumerate([("00:00:01:5", "00:00:02:6"), ("00:00:01:5", None), ("00:00:01:1", "00:00:02.5"), (None, None)])]
    assert told(rules.audio_time_format_rules(spark.createDataFrame(times, EDGE))) == [(0, "end time has a frame number"), (1, "start time has a frame number")]


def test_stale_journals_cycles_and_proxies(spark):
    nodes = spark.createDataFrame([(1, i, f"f{i}.png", "p" if i == 4 else None) for i in range(1, 5)], "project_id long, node_id long, file string, proxyfile string")
    edges = spark.createDataFrame([(1, 1, 2, "Blur"), (1, 2, 3, "Blur"), (1, 3, 2, "Blur"), (1, 3, 4, "Blur")], "project_id long, src long, dst long, op string")
    j = spark.createDataFrame([(1, "0.6", ["0.5", "0.6"]), (2, "0.6", None), (3, "0.5", ["0.5"]), (4, None, ["0.6"])], "project_id long, version string, jt_upgrades array<string>")
    got = sorted((r.project_id, r.severity, r.start or 0, r.message) for r in rules.graph_rules(nodes, edges, j, "0.6").collect())
    assert got == [(1, rules.ERROR, 2, "has a cycle"), *((k, rules.ERROR, 0, "journal is not upgraded") for k in (2, 3, 4))]
    hidden = [r.start for r in rules.node_rules(nodes, edges).collect() if r.message == "final is hidden by a proxy"]
    assert hidden == [4]
