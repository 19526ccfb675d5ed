"""Queries and SQL for lineage, probes, roll-ups and rules over the journal views."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.functions.blocks import in_parts
from provlake.functions.storage import picked, written
from provlake.operators import lineage, probes, rollups, rules

from . import program_sql
from .fixture import kept_views, view, wide_edges, with_views


def _ne(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, d, "nodes"), view(spark, d, "edges").select("project_id", "src", "dst", "op")


def _kept_ne(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same where loops or several rules read them."""
    have = kept_views(spark, d, "nodes", "edges")
    return have["nodes"], picked(have["edges"], "project_id", "src", "dst", "op")


def _kept_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The same without what only rules look at: no more than the keys and the operation is written."""
    n = view(spark, d, "nodes").select("project_id", "node_id", "r", "code")
    e = written(view(spark, d, "edges", {"nodes": n}).select("project_id", "src", "dst", "op"))
    return written(n.select("project_id", "node_id")), e


NE = ("nodes", "edges")
#: Paths from every node up to its bases, with and without donor edges; degrees; reach.
UP = """up AS (SELECT project_id, node_id, node_id AS at, CAST(0 AS BIGINT) AS level FROM nodes
  UNION ALL SELECT u.project_id, u.node_id, e.src, u.level + 1 FROM up u JOIN edges e ON e.project_id = u.project_id AND e.dst = u.at WHERE e.op <> 'Donor')"""
UPALL = UP.replace("up AS", "upall AS").replace("FROM up u", "FROM upall u").replace(" WHERE e.op <> 'Donor'", "")
DEG = """deg AS (SELECT n.project_id, n.node_id, count(*) FILTER (WHERE e.dst = n.node_id) AS n_in, count(*) FILTER (WHERE e.src = n.node_id) AS n_out,
  count(*) FILTER (WHERE e.dst = n.node_id AND e.op <> 'Donor') AS n_in_plain, count(*) FILTER (WHERE e.src = n.node_id AND e.op <> 'Donor') AS n_out_plain
  FROM nodes n LEFT JOIN (SELECT project_id, src, dst, op, dst AS k FROM edges UNION ALL SELECT project_id, src, dst, op, src FROM edges) e
  ON e.project_id = n.project_id AND e.k = n.node_id GROUP BY 1, 2)"""
BASES = f"{UP}, {DEG}, bases AS (SELECT u.project_id, u.node_id, u.at AS base, u.level FROM up u JOIN deg d ON d.project_id = u.project_id AND d.node_id = u.at WHERE d.n_in = 0)"
TERM = "term AS (SELECT DISTINCT u.project_id, u.at AS node_id, u.node_id AS final FROM up u JOIN deg d ON d.project_id = u.project_id AND d.node_id = u.node_id WHERE d.n_out = 0)"
CLOSURE = f"""{UPALL}, {DEG}, closure AS (SELECT DISTINCT u.project_id, u.node_id AS final, e.src, e.dst, e.op FROM upall u
  JOIN deg d ON d.project_id = u.project_id AND d.node_id = u.node_id JOIN edges e ON e.project_id = u.project_id AND e.dst = u.at WHERE d.n_out = 0)"""


def _sql(ctes: str, body: str, *views: str) -> str:
    return f"{with_views(*(views or NE), recursive=True)},\n{ctes}\n{body}" if ctes else f"{with_views(*(views or NE))}\n{body}"


def q_base_paths(spark, d):
    n, e = _ne(spark, d)
    return lineage.base_paths(n, e).select("project_id", "node_id", "base", "level")


def q_find_base(spark, d):
    return lineage.find_base(*_ne(spark, d))


def q_terminals(spark, d):
    return lineage.terminals(*_ne(spark, d))


def q_ancestor_edges(spark, d):
    n, e = _ne(spark, d)
    out = lineage.ancestor_edges(e, n.select("project_id", "node_id"))
    return out.groupBy("project_id", "seed").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("op").alias("n_ops"))


def q_paths(spark, d):
    out = lineage.paths_to_finals(*_ne(spark, d), cond="op = 'Blur'")
    return out.groupBy("project_id", "node_id").agg(F.count(F.lit(1)).alias("n_paths"), F.count_if("hit").alias("n_hit"), F.sum(F.size("path")).alias("total_length"))


def q_donor_bases(spark, d):
    return lineage.donor_base_tuples(*_ne(spark, d))


def q_terminal_bases(spark, d):
    return lineage.terminal_base_tuples(*_ne(spark, d))


def q_has_ancestor_op(spark, d):
    return lineage.has_ancestor_op(*_ne(spark, d), "Blur")


def q_common_parent(spark, d):
    return lineage.common_parent(*_ne(spark, d))


def q_components(spark, d):
    n, e = _ne(spark, d)
    return lineage.components(n, e.where("op not in ('Blur', 'OutputMp4', 'TimeWarp')"))


def q_cycles(spark, d):
    n, e = _ne(spark, d)
    back = e.where("project_id % 10 = 0").groupBy("project_id").agg(F.min_by(F.struct("src", "dst"), F.struct("dst", "src")).alias("x"))
    return lineage.cycle_nodes(n, e.select("project_id", "src", "dst").unionByName(back.select("project_id", F.col("x.dst").alias("src"), F.col("x.src").alias("dst"))))


def q_labels(spark, d):
    return lineage.label_nodes(*_ne(spark, d))


def q_subgraph(spark, d):
    n, e = _ne(spark, d)
    _, inner = lineage.subgraph(n, e, n.where("r <= 6"))
    return inner.select("project_id", "src", "dst", "op")


def q_qa(spark, d):
    n, e = _ne(spark, d)
    return lineage.qa_invalidate(e, e.where("op = 'TransformCrop'"))


def q_probe_summary(spark, d, kept=None):
    n, e = kept or _kept_graph(spark, d)
    return probes.probe_summary(n, e, view(spark, d, "operations"))


def q_probes(spark, d):
    with _journals(spark, d) as (_, e):
        e = written(e)
    segs, ops = view(spark, d, "segments"), view(spark, d, "operations")
    return probes.generate_probes(e, segs, _places(spark, d), probes.is_localized(ops), media=view(spark, d, "media"))


def _places(spark, d):
    """Bounds with the frames from which a paste may have been copied."""
    return view(spark, d, "bounds").withColumns({"to_start": F.expr("if(set_id % 3 > 0, 10 + set_id % 40, null)"), "to_end": F.expr("10 + set_id % 40 + endframe - startframe")})


def q_probe_order(spark, d):
    return probes.order_probes(q_probe_summary(spark, d)).select("project_id", "src", "dst", "final", "level", "probe_no")


def q_probe_bits(spark, d):
    p = q_probe_order_base(spark, d)
    return probes.assign_bits(p).select("project_id", "src", "dst", "final", "group_id", "bit_number")


def q_probe_order_base(spark, d):
    p = probes.order_probes(q_probe_summary(spark, d))
    return p.withColumns({"shape": F.pmod("final", F.lit(3)), "mask_hash": F.pmod("final", F.lit(2))})


def q_video_bits(spark, d):
    """Groups of equal rate, frames, end time, width and height, which the final media have."""
    m = view(spark, d, "media").selectExpr("project_id", "node_id as final", "rate", "frames % 3 as frames", "frames % 3 * 1000 / rate as endtime", "640 + node_id % 2 as width", "480 as height")
    p = q_probe_order_base(spark, d).join(m, ["project_id", "final"], "left")
    return probes.assign_video_bits(p, ["rate", "frames", "endtime", "width", "height"]).select("project_id", "src", "dst", "final", "bit_number")


def q_donor_segments(spark, d):
    with _journals(spark, d) as (n, e):
        return probes.donor_segments(n, e, view(spark, d, "segments"), _places(spark, d), view(spark, d, "media"))


def q_designate(spark, d):
    p = q_probe_summary(spark, d).withColumns({"has_mask": F.col("op").isin("Blur", "PasteSplice", "PasteSampled"), "has_segments": F.pmod("dst", F.lit(2)) == 0})
    qa = view(spark, d, "edges").where("op = 'PasteSampled'").select("project_id", "src", "dst", F.lit("detect").alias("designation"))
    return probes.designate(p, qa).groupBy("designation").agg(F.count(F.lit(1)).alias("n"))


def q_donors(spark, d):
    n, e = kept = _kept_ne(spark, d)
    p = q_probe_summary(spark, d, kept)
    out = probes.attach_donors(p, probes.construct_donors(n, e))
    return out.select("project_id", "src", "dst", "final", F.coalesce("donor_base", F.lit(-1)).alias("donor_base"))


def q_colors(spark, d):
    e = _ne(spark, d)[1].withColumn("linkcolor", F.expr("case when project_id % 3 = 0 or dst % 7 > 0 then concat(src % 256, ' ', dst % 256, ' ', (src + dst) % 251) end"))
    return probes.assign_colors(e)


def q_detect(spark, d):
    n, e = _kept_ne(spark, d)
    ways = probes.finals_and_bases(n, e)
    p = probes.probe_summary(n, e, view(spark, d, "operations"), ways)
    return probes.extend_detect_probes(p, n, e, F.col("op").isin("ColorColorBalance", "Blur"), ways)


def q_rollups(spark, d):
    n, e = _ne(spark, d)
    return rollups.rule_rollups(rollups.final_edges(n, e))


PROPERTIES = "name string, description string, operations array<string>, parameter string, value string, nodetype string, semanticgroup boolean, includedonors boolean, rule string"


def _properties(spark):
    rows = [
        ("blurred", None, ["Blur"], None, None, None, False, True, None),
        ("pasted", None, ["PasteSplice", "PasteSampled", "PasteFrames"], "purpose", "clone", None, False, True, None),
        ("resized_video", None, ["TransformResize", "TransformCrop"], None, None, "video", False, False, None),
        ("swapped", "face", None, None, None, None, True, False, None),
        ("timed", None, ["TimeWarp"], "purpose", "add", None, False, False, "warp"),
    ]
    return spark.createDataFrame(rows, PROPERTIES)


def _property_edges(spark, d, have=None):
    group = F.when(F.pmod("dst", F.lit(8)) == 0, F.array(F.lit("face"), F.lit("body")))
    return wide_edges(spark, d, have).withColumns({"semanticGroups": group, "warp": (F.col("op") == "TimeWarp") & (F.pmod("src", F.lit(2)) == 0)})


def q_final_properties(spark, d):
    have = kept_views(spark, d, "nodes", "edges")
    return rollups.properties_of_finals(have["nodes"], _property_edges(spark, d, have), _properties(spark))


def q_project_properties(spark, d):
    return rollups.project_properties(_property_edges(spark, d), _properties(spark).where("rule is null"))


def q_units(spark, d):
    n, e = _ne(spark, d)
    return rollups.unit_count(rollups.final_edges(n, e), view(spark, d, "operations"))


def q_provenance(spark, d):
    return rollups.provenance(*_ne(spark, d))


def q_composite_size(spark, d):
    n, e = _ne(spark, d)
    c = rollups.final_edges(n, e).withColumn("size", F.when(F.col("op") == "Blur", "small").when(F.col("op") == "PasteSplice", "large").when(F.col("op") == "TimeWarp", "medium").otherwise(""))
    return rollups.composite_size(c)


def q_create_time(spark, d):
    return rollups.create_time(view(spark, d, "nodes")).withColumn("createtime", F.col("createtime").cast("string"))


@contextmanager
def _journals(spark, d):
    """Nodes and edges with what programs are compiled from. Nodes are dealt out by journal once, as their order in it asks for, and kept by the executors
    while the edges are made: joins within journals need no other exchange."""
    orders = in_parts(spark.read.parquet(f"{d}/orders.parquet"), "o_custkey")
    have = {"nodes": view(spark, d, "nodes", {"orders": orders}).select("project_id", "node_id", "r", "code", "file")}
    have["edges"] = view(spark, d, "edges", have)
    wide = view(spark, d, "wide", have)
    # Not before: views made of a table that is kept let it go.
    have["nodes"].persist()
    whole = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(whole)
    spark.conf.set(whole, "false")
    try:
        yield have["nodes"].select("project_id", "node_id"), wide.select("project_id", "src", "dst", "op", "media_type", "add_type")
    finally:
        spark.conf.set(whole, before)
        have["nodes"].unpersist()


def q_graph_rules(spark, d):
    n, e = _kept_ne(spark, d)
    # A link back from the last to the first node of a plain edge in some journals makes cycles.
    back = e.where("project_id % 10 = 0 and op <> 'OutputPng'").groupBy("project_id").agg(F.min_by(F.struct("src", "dst"), F.struct("dst", "src")).alias("x"))
    back = back.select("project_id", F.col("x.dst").alias("src"), F.col("x.src").alias("dst"), F.lit("Blur").alias("op"))
    j = view(spark, d, "journals").selectExpr("project_id", "if(project_id % 3 > 0, '0.6', '0.5') as version", "case project_id % 4 when 0 then array('0.5', '0.6') when 1 then array('0.6') when 2 then array('0.5') end as jt_upgrades")
    out = rules.graph_rules(n, e.where("op <> 'OutputPng'").unionByName(back), j, "0.6")
    return out.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("start", "end")})


def q_node_rules_messages(spark, d):
    """Some file names with bad characters, some with a suffix in upper case, some finals named by an MD5."""
    n, e = _ne(spark, d)
    listing = n.where("r % 7 <> 0").select("file")
    named = n.join(listing.withColumn("_l", F.lit(True)), "file", "left")
    file = F.expr("case node_id % 10 when 0 then concat('x~', file) when 1 then concat(substring_index(file, '.', 1), '.', upper(substring_index(file, '.', -1))) when 2 then concat(md5(file), '.', substring_index(file, '.', -1)) else file end")
    named = named.withColumn("file", file).withColumn("_l", F.when(F.col("_l"), F.col("file")))
    named = named.withColumn("proxyfile", F.expr("if(node_id % 6 = 0, 'p', null)"))
    return rules.node_rules(named.drop("_l"), e, named.where("_l is not null").select("file"))


def q_node_rules(spark, d):
    return rules.has_errors(q_node_rules_messages(spark, d))


def q_node_messages(spark, d):
    return rules.sort_messages(q_node_rules_messages(spark, d))


def q_dictionary(spark, d):
    n, e = _ne(spark, d)
    return rules.edge_dictionary_rules(e, view(spark, d, "operations").where("category <> 'Audio'"))


def q_media_rules(spark, d):
    return rules.media_rules(_ne(spark, d)[1], view(spark, d, "media"))


def q_length_rules(spark, d):
    return rules.length_rules(_ne(spark, d)[1], view(spark, d, "media"))


def q_time_rules(spark, d):
    e = _ne(spark, d)[1].where("op in ('DeleteFrames', 'InsertFrames')")
    b = rollups.edge_bounds(view(spark, d, "segments").where("type = 'video'"))
    return rules.time_rules(e, view(spark, d, "bounds"), b)


def q_entered(spark, d):
    """Entered times of all edges, some with frames, against the segments of their end; some of sound told with frame numbers."""
    times = "map('Insertion Start Time', concat('00:00:0', 2 + dst % 7, '.', 100 + src % 900, if(dst % 3 = 0, concat(':', 1 + dst % 5), '')), 'End Time', concat('00:00:1', src % 3, if(dst % 4 = 0, concat(':', dst % 6), '.5')))"
    # Both rules read the edges.
    e = written(view(spark, d, "wide").select("project_id", "src", "dst", "media_type")).withColumns({"arguments": F.expr(times), "rate": F.lit(30.0)})
    found = view(spark, d, "segments").where("set_id % 5 > 0").groupBy(F.col("set_id").alias("dst"), "type").agg(F.min("startframe").alias("start"), F.max("endframe").alias("stop"))
    return rules.entered_time_rules(e, found).unionByName(rules.audio_time_format_rules(e.where("media_type = 'audio'")))


def q_donor_rules(spark, d):
    return rules.donor_rules(*_ne(spark, d))


def q_type_rules(spark, d):
    return rules.type_rules(*_ne(spark, d))


def q_registry(spark, d):
    n, e = _ne(spark, d)
    reg = n.where("node_id % 3 = 0").select("file", (F.col("project_id") + F.pmod("node_id", F.lit(2))).alias("project_id"))
    return rules.registry_rules(n, e, reg)


def q_users(spark, d):
    j = view(spark, d, "journals")
    e = wide_edges(spark, d).withColumnRenamed("softwareName", "username")
    names = j.where("project_id % 5 <> 0").select("username").unionByName(e.where("username <> 's3'").select("username"))
    return rules.user_rules(j, names, e).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("start", "end")})


def q_edge_bounds(spark, d):
    return rollups.edge_bounds(view(spark, d, "segments"))


PROBE = f"{BASES}, {TERM}"
_PS = """ps AS (SELECT e.project_id, e.src, e.dst, e.op, t.final, b.base, b.level FROM edges e JOIN operations o ON o.op = e.op AND o.scope = 'localized'
  JOIN term t ON t.project_id = e.project_id AND t.node_id = e.dst
  LEFT JOIN (SELECT project_id, node_id, min(ROW(level, base)) AS m, min(level) AS level, arg_min(base, ROW(level, base)) AS base FROM bases GROUP BY 1, 2) b ON b.project_id = e.project_id AND b.node_id = e.src)"""
PSUM = f"{PROBE}, {_PS}"
ORD = f"{PSUM}, ord AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY final, level, src, dst) AS probe_no, final % 3 AS shape, final % 2 AS mask_hash FROM ps)"
PV = ("nodes", "edges", "operations")
_MSG = "project_id, {sev} AS severity, {s} AS start, {e} AS \"end\", '{mod}' AS module, {msg} AS message"


def _msg(sev: int, mod: str, msg: str, frm: str, s: str = "src", e: str = "dst") -> str:
    return f"SELECT {_MSG.format(sev=sev, s=s, e=e, mod=mod, msg=msg if msg.startswith('concat') else repr(msg))} FROM {frm}"


_EM = """em AS (SELECT e.*, a.frames AS a_frames, a.rate AS a_rate, a.duration_ms AS a_dur, b.frames AS b_frames, b.rate AS b_rate, b.duration_ms AS b_dur
  FROM edges e JOIN media a ON a.project_id = e.project_id AND a.node_id = e.src JOIN media b ON b.project_id = e.project_id AND b.node_id = e.dst)"""
_TYPE = """CASE WHEN {f} LIKE '%.png' OR {f} LIKE '%.jpg' THEN 'image' WHEN {f} LIKE '%.wav' THEN 'audio' ELSE 'video' END"""
_HAS = {
    "blurred": "op = 'Blur'", "pasted": "coalesce(op IN ('PasteSplice', 'PasteSampled', 'PasteFrames') AND purpose = 'clone', false)", "resized_video": "(op IN ('TransformResize', 'TransformCrop') AND media_type = 'video')",
    "swapped": "dst % 8 = 0", "timed": "coalesce(op = 'TimeWarp' AND purpose = 'add', false)",
}
_NODE_AT = {"s": "node_id", "e": "node_id"}

_NODE_MESSAGES = f"""{DEG}, lab AS (SELECT n.*, d.n_out, CASE WHEN n_in = 0 AND n_out_plain = 0 AND n_out > 0 THEN 'donor' WHEN n_in = 0 THEN 'base' WHEN n_out = 0 THEN 'final' ELSE 'interim' END AS label
  FROM nodes n JOIN deg d ON d.project_id = n.project_id AND d.node_id = n.node_id), b AS (SELECT *, count(*) OVER (PARTITION BY project_id) AS k FROM lab WHERE label = 'base'),
m AS ({' UNION ALL '.join([
    _msg(3, "node", "file name has bad characters", "nodes WHERE node_id % 10 = 0", **_NODE_AT), _msg(2, "node", "suffix is not lower case", "nodes WHERE node_id % 10 = 1", **_NODE_AT),
    _msg(2, "node", "final is not named by its MD5", "lab WHERE label = 'final' AND node_id % 10 <> 2", **_NODE_AT), _msg(3, "node", "is one of several bases", "b WHERE k > 1", **_NODE_AT), _msg(3, "node", "final is hidden by a proxy", "lab WHERE label = 'final' AND node_id % 6 = 0", **_NODE_AT), _msg(3, "node", "file is missing", "nodes WHERE r % 7 = 0", **_NODE_AT),
])})"""

QUERIES = {
    "base_paths": q_base_paths, "find_base": q_find_base, "terminal_nodes": q_terminals, "ancestor_edges": q_ancestor_edges, "paths_to_finals": q_paths,
    "donor_base_tuples": q_donor_bases, "terminal_base_tuples": q_terminal_bases, "has_ancestor_op": q_has_ancestor_op, "common_parent": q_common_parent,
    "components": q_components, "cycle_nodes": q_cycles, "label_nodes": q_labels, "subgraph": q_subgraph, "qa_invalidate": q_qa,
    "probe_summary": q_probe_summary, "generate_probes": q_probes, "probe_order": q_probe_order, "probe_bits": q_probe_bits, "probe_video_bits": q_video_bits, "donor_segments": q_donor_segments,
    "probe_designation": q_designate, "probe_donors": q_donors, "link_colors": q_colors, "detect_probes": q_detect,
    "rule_rollups": q_rollups, "final_node_properties": q_final_properties, "project_properties": q_project_properties, "unit_count": q_units,
    "provenance": q_provenance, "composite_size": q_composite_size, "create_time": q_create_time, "edge_bounds": q_edge_bounds,
    "graph_rules": q_graph_rules, "node_rules": q_node_rules, "node_messages": q_node_messages, "dictionary_rules": q_dictionary, "media_rules": q_media_rules, "length_rules": q_length_rules,
    "time_rules": q_time_rules, "entered_times": q_entered, "donor_rules": q_donor_rules, "type_rules": q_type_rules, "registry_rules": q_registry, "user_rules": q_users,
}

#: Edges with what their programs need, and a segment after or before one.
_ST = """st AS (SELECT w.project_id, w.src, w.dst, w.op, w.media_type, w.add_type, b.startframe AS bs, b.endframe AS be, b.endframe - b.startframe + 1 AS bn,
  CASE WHEN w.dst % 3 > 0 THEN 10 + w.dst % 40 END AS ts, 10 + w.dst % 40 + b.endframe - b.startframe AS te, f.frames AS f0, t.frames AS f1
  FROM wide w LEFT JOIN bounds b ON b.set_id = w.dst LEFT JOIN media f ON f.project_id = w.project_id AND f.node_id = w.src LEFT JOIN media t ON t.project_id = w.project_id AND t.node_id = w.dst WHERE w.op <> 'Donor')"""


def _moved(back: bool) -> str:
    kind = f"({program_sql.verb('st.op', 'st.media_type', 'st.add_type', 'w.type')})"
    return program_sql.parts(kind, back, "w.seg_no", "w.startframe", "w.endframe", "bs", "be", "bn", "ts", "te", "f0", "f1")


ORACLES = {
    "base_paths": _sql(BASES, "SELECT project_id, node_id, base, level FROM bases"),
    "find_base": _sql(
        """par AS (SELECT project_id, dst, min(src) AS up FROM edges WHERE op <> 'Donor' GROUP BY 1, 2),
walk AS (SELECT project_id, node_id, node_id AS at FROM nodes UNION ALL SELECT w.project_id, w.node_id, p.up FROM walk w JOIN par p ON p.project_id = w.project_id AND p.dst = w.at)""",
        "SELECT w.project_id, w.node_id, w.at AS base FROM walk w WHERE NOT EXISTS (SELECT 1 FROM par p WHERE p.project_id = w.project_id AND p.dst = w.at)",
    ),
    "terminal_nodes": _sql(PROBE, "SELECT project_id, node_id, final FROM term"),
    "ancestor_edges": _sql(
        UPALL,
        "SELECT u.project_id, u.node_id AS seed, count(*) AS n_edges, count(DISTINCT e.op) AS n_ops FROM (SELECT DISTINCT project_id, node_id, upall.at FROM upall) u JOIN edges e ON e.project_id = u.project_id AND e.dst = u.at GROUP BY 1, 2",
    ),
    "paths_to_finals": _sql(
        f"""{DEG}, down AS (SELECT project_id, node_id, node_id AS at, 1 AS len, false AS hit FROM nodes
  UNION ALL SELECT w.project_id, w.node_id, e.dst, w.len + 1, w.hit OR e.op = 'Blur' FROM down w JOIN edges e ON e.project_id = w.project_id AND e.src = w.at)""",
        "SELECT w.project_id, w.node_id, count(*) AS n_paths, count(*) FILTER (WHERE hit) AS n_hit, CAST(sum(len) AS BIGINT) AS total_length FROM down w JOIN deg d ON d.project_id = w.project_id AND d.node_id = w.at WHERE d.n_out = 0 GROUP BY 1, 2",
    ),
    "donor_base_tuples": _sql(BASES, "SELECT DISTINCT e.project_id, e.src AS donor_src, e.dst AS donor_dst, b.base FROM edges e JOIN bases b ON b.project_id = e.project_id AND b.node_id = e.src WHERE e.op = 'Donor'"),
    "terminal_base_tuples": _sql(BASES, "SELECT DISTINCT b.project_id, b.node_id AS final, b.base FROM bases b JOIN deg d ON d.project_id = b.project_id AND d.node_id = b.node_id WHERE d.n_out = 0"),
    "has_ancestor_op": _sql(UPALL, "SELECT DISTINCT u.project_id, u.node_id FROM upall u JOIN edges e ON e.project_id = u.project_id AND e.dst = u.at WHERE e.op = 'Blur'"),
    "common_parent": _sql(
        """par AS (SELECT project_id, dst, min(src) AS up FROM edges WHERE op <> 'Donor' GROUP BY 1, 2),
walk AS (SELECT project_id, node_id, node_id AS at FROM nodes UNION ALL SELECT w.project_id, w.node_id, p.up FROM walk w JOIN par p ON p.project_id = w.project_id AND p.dst = w.at),
fb AS (SELECT * FROM walk w WHERE NOT EXISTS (SELECT 1 FROM par p WHERE p.project_id = w.project_id AND p.dst = w.at)),
rk AS (SELECT *, row_number() OVER (PARTITION BY project_id, dst ORDER BY src) AS k FROM edges)""",
        "SELECT rk.project_id, rk.dst AS node_id, min(fb.at) = max(fb.at) AS same FROM rk LEFT JOIN fb ON fb.project_id = rk.project_id AND fb.node_id = rk.src WHERE k <= 2 GROUP BY 1, 2 HAVING count(*) = 2",
    ),
    "components": _sql(
        """e2 AS (SELECT project_id, src, dst FROM edges WHERE op NOT IN ('Blur', 'OutputMp4', 'TimeWarp')), both_ AS (SELECT project_id, src AS a, dst AS b FROM e2 UNION SELECT project_id, dst, src FROM e2),
rc AS (SELECT project_id, node_id, node_id AS at FROM nodes UNION SELECT r.project_id, r.node_id, b.b FROM rc r JOIN both_ b ON b.project_id = r.project_id AND b.a = r.at)""",
        "SELECT project_id, node_id, min(rc.at) AS component FROM rc GROUP BY 1, 2",
    ),
    "cycle_nodes": _sql(
        """first_ AS (SELECT project_id, arg_min(ROW(src, dst), ROW(dst, src)) AS x FROM edges WHERE project_id % 10 = 0 GROUP BY 1),
c AS (SELECT project_id, src, dst FROM edges UNION SELECT project_id, x[2], x[1] FROM first_),
rc AS (SELECT project_id, src AS a, dst AS b FROM c UNION SELECT r.project_id, r.a, c.dst FROM rc r JOIN c ON c.project_id = r.project_id AND c.src = r.b)""",
        "SELECT DISTINCT project_id, a AS node_id FROM rc WHERE a = b",
    ),
    "label_nodes": _sql(DEG, "SELECT project_id, node_id, CASE WHEN n_in = 0 AND n_out_plain = 0 AND n_out > 0 THEN 'donor' WHEN n_in = 0 THEN 'base' WHEN n_out = 0 THEN 'final' ELSE 'interim' END AS label FROM deg"),
    "subgraph": _sql("", "SELECT e.project_id, e.src, e.dst, e.op FROM edges e JOIN nodes a ON a.project_id = e.project_id AND a.node_id = e.src JOIN nodes b ON b.project_id = e.project_id AND b.node_id = e.dst WHERE a.r <= 6 AND b.r <= 6"),
    "qa_invalidate": _sql(
        """ch AS (SELECT project_id, src, dst FROM edges WHERE op = 'TransformCrop'),
u AS (SELECT project_id, src AS at FROM ch UNION SELECT u.project_id, e.src FROM u JOIN edges e ON e.project_id = u.project_id AND e.dst = u.at),
w AS (SELECT project_id, dst AS at FROM ch UNION SELECT w.project_id, e.dst FROM w JOIN edges e ON e.project_id = w.project_id AND e.src = w.at)""",
        """SELECT e.project_id, e.src, e.dst FROM edges e JOIN u ON u.project_id = e.project_id AND u.at = e.dst
UNION SELECT e.project_id, e.src, e.dst FROM edges e JOIN w ON w.project_id = e.project_id AND w.at = e.src UNION SELECT * FROM ch""",
    ),
    "probe_summary": _sql(PSUM, "SELECT * FROM ps", *PV),
    "generate_probes": _sql(
        f"""{_ST},
seed AS (SELECT DISTINCT e.project_id, e.src, e.dst FROM edges e JOIN operations o ON o.op = e.op WHERE o.scope = 'localized'),
walk AS (SELECT s.project_id, s.src, s.dst, s.dst AS at, g.seg_no, g.type, g.startframe, g.endframe FROM seed s JOIN segments g ON g.set_id = s.dst
  UNION SELECT project_id, src, dst, to_, p.n, type, p.s, p.e FROM (
    SELECT w.project_id, w.src, w.dst, st.dst AS to_, w.type, unnest({_moved(False)}) AS p FROM walk w JOIN st ON st.project_id = w.project_id AND st.src = w.at) x WHERE p.s <= p.e)""",
        "SELECT w.project_id, w.src, w.dst, w.at AS final, w.seg_no, w.type, w.startframe, w.endframe FROM walk w WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.project_id = w.project_id AND st.src = w.at)",
        *PV, "wide", "segments", "bounds", "media",
    ),
    "probe_order": _sql(ORD, "SELECT project_id, src, dst, final, level, probe_no FROM ord", *PV),
    "probe_bits": _sql(
        f"""{ORD}, f AS (SELECT project_id, base, shape, src, dst, mask_hash, min(probe_no) AS fst FROM ord GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY project_id, base, shape ORDER BY fst) AS bit_number FROM f),
g AS (SELECT project_id, base, shape, row_number() OVER (PARTITION BY project_id ORDER BY min(fst)) AS group_id FROM f GROUP BY 1, 2, 3)""",
        "SELECT o.project_id, o.src, o.dst, o.final, g.group_id, b.bit_number FROM ord o JOIN b USING (project_id, base, shape, src, dst, mask_hash) JOIN g USING (project_id, base, shape)", *PV,
    ),
    "probe_video_bits": _sql(
        f"{ORD}, vm AS (SELECT project_id, node_id, rate, frames % 3 AS f3, node_id % 2 AS w FROM media)",
        "SELECT o.project_id, src, dst, final, row_number() OVER (PARTITION BY o.project_id, rate, f3, w ORDER BY probe_no) AS bit_number FROM ord o LEFT JOIN vm ON vm.project_id = o.project_id AND vm.node_id = o.final", *PV, "media",
    ),
    "donor_segments": _sql(
        f"""{_ST},
walk AS (SELECT e.project_id, e.src, e.dst, e.src AS at, g.seg_no, g.type, g.startframe, g.endframe FROM edges e JOIN segments g ON g.set_id = e.dst WHERE e.op = 'Donor'
  UNION SELECT project_id, src, dst, to_, p.n, type, p.s, p.e FROM (
    SELECT w.project_id, w.src, w.dst, st.src AS to_, w.type, unnest({_moved(True)}) AS p FROM walk w JOIN st ON st.project_id = w.project_id AND st.dst = w.at) x WHERE p.s <= p.e)""",
        "SELECT w.project_id, w.src, w.dst, w.at AS base, w.seg_no, w.type, w.startframe, w.endframe FROM walk w WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.project_id = w.project_id AND e.dst = w.at)",
        *NE, "wide", "segments", "bounds", "media",
    ),
    "probe_designation": _sql(
        PSUM,
        """SELECT CASE WHEN op = 'PasteSampled' THEN 'detect' WHEN op IN ('Blur', 'PasteSplice') AND dst % 2 = 0 THEN 'spatial-temporal' WHEN op IN ('Blur', 'PasteSplice') THEN 'spatial'
WHEN dst % 2 = 0 THEN 'temporal' ELSE 'detect' END AS designation, count(*) AS n FROM ps GROUP BY 1""", *PV,
    ),
    "probe_donors": _sql(
        PSUM,
        "SELECT ps.project_id, ps.src, ps.dst, ps.final, coalesce(d.base, -1) AS donor_base FROM ps LEFT JOIN (SELECT DISTINCT e.project_id, e.dst, b.base FROM edges e JOIN bases b ON b.project_id = e.project_id AND b.node_id = e.src WHERE e.op = 'Donor') d ON d.project_id = ps.project_id AND d.dst = ps.dst", *PV,
    ),
    "link_colors": _sql(
        """y AS (SELECT *, CASE WHEN project_id % 3 = 0 OR dst % 7 > 0 THEN concat(src % 256, ' ', dst % 256, ' ', (src + dst) % 251) END AS own FROM edges),
n AS (SELECT project_id, count(*) AS n, count(DISTINCT own) AS d FROM y GROUP BY 1),
x AS (SELECT y.*, n.n, n.d, row_number() OVER (PARTITION BY y.project_id ORDER BY src, dst) * 16777215 // (n + 1) AS c FROM y JOIN n ON n.project_id = y.project_id)""",
        "SELECT project_id, src, dst, CASE WHEN d = n THEN own ELSE concat(c // 65536, ' ', (c // 256) % 256, ' ', c % 256) END AS color FROM x",
    ),
    "detect_probes": _sql(
        f"{PSUM}, b1 AS (SELECT project_id, node_id, min(level) AS level, arg_min(base, ROW(level, base)) AS base FROM bases GROUP BY 1, 2)",
        """SELECT e.project_id, e.src, e.dst, e.op, t.final, b.base, b.level FROM edges e JOIN term t ON t.project_id = e.project_id AND t.node_id = e.dst
LEFT JOIN b1 b ON b.project_id = e.project_id AND b.node_id = e.src WHERE e.op IN ('ColorColorBalance', 'Blur')
AND NOT EXISTS (SELECT 1 FROM ps WHERE ps.project_id = e.project_id AND ps.src = e.src AND ps.dst = e.dst)""", *PV,
    ),
    "rule_rollups": _sql(CLOSURE, "SELECT project_id, final, " + ", ".join(f"bool_or(op IN ({', '.join(map(repr, ops))})) AS {k}" for k, ops in rollups.ROLLUPS.items()) + " FROM closure GROUP BY 1, 2"),
    "final_node_properties": _sql(
        f"""{CLOSURE}, {UP}, plain AS (SELECT DISTINCT u.project_id, u.node_id AS final, e.src, e.dst FROM up u JOIN edges e ON e.project_id = u.project_id AND e.dst = u.at AND e.op <> 'Donor'),
c AS (SELECT c.final, w.*, p.src IS NOT NULL AS is_plain FROM closure c JOIN wide w ON w.project_id = c.project_id AND w.src = c.src AND w.dst = c.dst AND w.op = c.op
  LEFT JOIN plain p ON p.project_id = c.project_id AND p.final = c.final AND p.src = c.src AND p.dst = c.dst),
v AS (SELECT project_id, final, bool_or({_HAS['blurred']}) AS blurred, bool_or({_HAS['pasted']}) AS pasted, bool_or(is_plain AND {_HAS['resized_video']}) AS resized_video,
  bool_or(is_plain AND {_HAS['swapped']}) AS swapped, bool_or(is_plain AND ({_HAS['timed']} OR (op = 'TimeWarp' AND src % 2 = 0))) AS timed FROM c GROUP BY 1, 2)""",
        "SELECT project_id, final, name, value FROM v UNPIVOT (value FOR name IN (blurred, pasted, resized_video, swapped, timed))", *NE, "wide",
    ),
    "project_properties": _sql(
        f"v AS (SELECT project_id, " + ", ".join(f"bool_or({_HAS[k]}) AS {k}" for k in ("blurred", "pasted", "resized_video", "swapped")) + " FROM wide GROUP BY 1)",
        "SELECT project_id, name, value FROM v UNPIVOT (value FOR name IN (blurred, pasted, resized_video, swapped))", "wide",
    ),
    "unit_count": _sql(
        CLOSURE,
        "SELECT c.project_id, c.final, count(DISTINCT c.op) FILTER (WHERE o.category NOT IN ('Output', 'Donor')) AS units, concat('Unit-', count(DISTINCT c.op) FILTER (WHERE o.category NOT IN ('Output', 'Donor'))) AS label FROM closure c JOIN operations o ON o.op = c.op GROUP BY 1, 2", *PV,
    ),
    "provenance": _sql(BASES, "SELECT b.project_id, count(DISTINCT b.base) AS n_bases, count(DISTINCT b.base) > 1 AS is_provenance FROM bases b JOIN deg d ON d.project_id = b.project_id AND d.node_id = b.node_id WHERE d.n_out = 0 GROUP BY 1"),
    "composite_size": _sql(CLOSURE, "SELECT project_id, final, ['', 'small', 'medium', 'large'][max(CASE op WHEN 'PasteSplice' THEN 3 WHEN 'TimeWarp' THEN 2 WHEN 'Blur' THEN 1 ELSE 0 END) + 1] AS size FROM closure GROUP BY 1, 2"),
    "create_time": _sql("", "SELECT project_id, CAST(min(ctime) AS VARCHAR) AS createtime FROM nodes GROUP BY 1", "nodes"),
    "edge_bounds": _sql("", "SELECT set_id, type, min(startframe) AS start, max(endframe) AS stop FROM segments GROUP BY 1, 2", "segments"),
    "entered_times": _sql(
        """t AS (SELECT *, (2 + dst % 7) * 1000 + 100 + src % 900 AS s_ms, CASE WHEN dst % 3 = 0 THEN 1 + dst % 5 ELSE 0 END AS s_f, (10 + src % 3) * 1000 + CASE WHEN dst % 4 = 0 THEN 0 ELSE 500 END AS e_ms, CASE WHEN dst % 4 = 0 THEN dst % 6 ELSE 0 END AS e_f
  FROM wide WHERE media_type IN ('audio', 'video')),
f AS (SELECT *, floor(round(s_ms * 30 / 1000.0::DOUBLE, 6))::BIGINT + 1 + s_f AS s0, floor(round(e_ms * 30 / 1000.0::DOUBLE, 6))::BIGINT + 1 + e_f AS e0 FROM t),
r AS (SELECT set_id, type, min(startframe) AS a, max(endframe) AS z FROM segments WHERE set_id % 5 > 0 GROUP BY 1, 2),
j AS (SELECT f.*, r.type, r.a, r.z, CASE WHEN r.type = 'audio' THEN 'time' ELSE 'frame' END AS what, CASE WHEN r.type = 'audio' THEN abs(s0 - a) * 1000 / 30.0::DOUBLE > 100 ELSE abs(s0 - a) > 1 END AS soff,
  CASE WHEN r.type = 'audio' THEN abs(e0 - z) * 1000 / 30.0::DOUBLE > 100 ELSE abs(e0 - z) > 1 END AS eoff FROM f JOIN r ON r.set_id = f.dst)""",
        """SELECT project_id, 3 AS severity, src AS start, dst AS "end", 'entered_times' AS module, 'change masks are missing' AS message FROM f WHERE dst NOT IN (SELECT set_id FROM r)
UNION ALL SELECT project_id, 2, src, dst, 'entered_times', concat('end ', what, ' differs from the detected end') FROM j WHERE eoff UNION ALL SELECT project_id, 2, src, dst, 'entered_times', concat('start ', what, ' differs from the detected start') FROM j WHERE soff
UNION ALL SELECT project_id, 3, src, dst, 'audio_time_format', 'end time has a frame number' FROM t WHERE media_type = 'audio' AND e_f > 1""",
        "wide", "segments",
    ),
    "graph_rules": _sql(
        f"""first_ AS (SELECT project_id, arg_min(ROW(src, dst), ROW(dst, src)) AS x FROM edges_ WHERE project_id % 10 = 0 AND op <> 'OutputPng' GROUP BY 1),
edges AS (SELECT project_id, src, dst, op FROM edges_ WHERE op <> 'OutputPng' UNION ALL SELECT project_id, x[2], x[1], 'Blur' FROM first_), {DEG},
cy AS (SELECT project_id, src AS a, dst AS b FROM edges UNION SELECT r.project_id, r.a, e.dst FROM cy r JOIN edges e ON e.project_id = r.project_id AND e.src = r.b), both_ AS (SELECT project_id, src AS a, dst AS b FROM edges UNION SELECT project_id, dst, src FROM edges),
rc AS (SELECT project_id, node_id, node_id AS at FROM nodes UNION SELECT r.project_id, r.node_id, b.b FROM rc r JOIN both_ b ON b.project_id = r.project_id AND b.a = r.at),
comp AS (SELECT project_id, node_id, min(rc.at) AS c FROM rc GROUP BY 1, 2), main AS (SELECT project_id, min(c) AS m FROM comp GROUP BY 1),
dup AS (SELECT n.project_id, n.node_id, count(*) OVER (PARTITION BY n.project_id, n.file) AS k FROM nodes n JOIN deg d ON d.project_id = n.project_id AND d.node_id = n.node_id WHERE d.n_out = 0)""",
        " UNION ALL ".join([
            _msg(3, "graph", "is not connected to other nodes", "deg WHERE n_in + n_out = 0", **_NODE_AT),
            _msg(3, "graph", "has a donor but no other predecessor", "deg WHERE n_in = 1 AND n_in_plain = 0", **_NODE_AT),
            _msg(3, "graph", "is part of a separate graph", "(SELECT comp.project_id, node_id FROM comp JOIN main ON main.project_id = comp.project_id WHERE c = node_id AND c <> m)", **_NODE_AT),
            _msg(3, "graph", "repeats another final file", "dup WHERE k > 1", **_NODE_AT),
            _msg(3, "graph", "has a cycle", "(SELECT project_id, min(a) AS node_id FROM cy WHERE a = b GROUP BY 1)", **_NODE_AT),
            _msg(3, "graph", "journal is not upgraded", "(SELECT c_custkey AS project_id, -1 AS node_id FROM customer WHERE NOT (c_custkey % 3 > 0 AND c_custkey % 4 < 2))", **_NODE_AT),
        ]),
    ).replace("edges AS (\nSELECT b.project_id", "edges_ AS (\nSELECT b.project_id", 1),
    "node_rules": _sql(_NODE_MESSAGES, "SELECT project_id, bool_or(severity >= 3) AS has_error, count(*) FILTER (WHERE severity >= 3) AS n_error, count(*) FILTER (WHERE severity = 2) AS n_warning FROM m GROUP BY 1"),
    "node_messages": _sql(_NODE_MESSAGES, "SELECT * FROM m"),
    "dictionary_rules": _sql("", _msg(3, "dictionary", "concat('unknown operation ', op)", "edges WHERE op IN ('AddAudio', 'DeleteAudio', 'AudioSample')")),
    "media_rules": _sql(
        _EM,
        " UNION ALL ".join([
            _msg(2, "media", "frame rate has changed", "em WHERE op NOT IN ('TimeWarp', 'Donor') AND a_rate <> b_rate"),
            _msg(2, "media", "frame rate is unchanged", "em WHERE op = 'TimeWarp' AND a_rate = b_rate"),
            _msg(3, "media", "duration differs", "em WHERE op IN ('AddAudio', 'AudioSample') AND abs(a_dur - b_dur) > 100"),
        ]), *NE, "media",
    ),
    "length_rules": _sql(
        _EM,
        " UNION ALL ".join([
            _msg(3, "length", "is not shorter than its source", "em WHERE op = 'DeleteFrames' AND b_frames >= a_frames"),
            _msg(3, "length", "is not longer than its source", "em WHERE op = 'InsertFrames' AND b_frames <= a_frames"),
            _msg(3, "length", "length has changed", "em WHERE op IN ('Blur', 'ColorColorBalance') AND b_frames <> a_frames"),
        ]), *NE, "media",
    ),
    "time_rules": _sql(
        """eb AS (SELECT set_id, min(startframe) AS start, max(endframe) AS stop FROM segments WHERE type = 'video' GROUP BY 1),
j AS (SELECT e.*, b.startframe, b.endframe, eb.start, eb.stop FROM edges e JOIN bounds b ON b.set_id = e.dst JOIN eb ON eb.set_id = e.dst WHERE e.op IN ('DeleteFrames', 'InsertFrames'))""",
        " UNION ALL ".join([
            _msg(3, "time", "start is after end", "j WHERE startframe > endframe"),
            _msg(2, "time", "end differs from the detected end", "j WHERE abs(endframe - stop) > 1"),
            _msg(2, "time", "start differs from the detected start", "j WHERE abs(startframe - j.start) > 1"),
        ]), *NE, "segments", "bounds",
    ),
    "donor_rules": _sql("", _msg(3, "donor", "donor is missing", "edges e WHERE op IN ('PasteSplice', 'PasteFrames') AND NOT EXISTS (SELECT 1 FROM edges d WHERE d.op = 'Donor' AND d.project_id = e.project_id AND d.dst = e.dst)")),
    "type_rules": _sql(
        f"""t AS (SELECT e.*, {_TYPE.format(f='a.file')} AS k0, {_TYPE.format(f='b.file')} AS k1, b.file AS f1 FROM edges e JOIN nodes a ON a.project_id = e.project_id AND a.node_id = e.src
JOIN nodes b ON b.project_id = e.project_id AND b.node_id = e.dst)""",
        " UNION ALL ".join([
            _msg(3, "type", "file type has changed", "t WHERE op <> 'Donor' AND op NOT LIKE 'Output%' AND k0 <> k1"),
            _msg(3, "type", "suffix does not fit the output", "t WHERE op LIKE 'Output%' AND NOT ends_with(f1, '.' || lower(substring(op, 7)))"),
        ]),
    ),
    "registry_rules": _sql(
        f"""{DEG}, lab AS (SELECT n.*, CASE WHEN n_in = 0 AND n_out_plain = 0 AND n_out > 0 THEN 'donor' WHEN n_in = 0 THEN 'base' WHEN n_out = 0 THEN 'final' ELSE 'interim' END AS label
  FROM nodes n JOIN deg d ON d.project_id = n.project_id AND d.node_id = n.node_id)""",
        " UNION ALL ".join([
            _msg(3, "registry", "base is not registered", "lab WHERE label = 'base' AND node_id % 3 <> 0", **_NODE_AT),
            _msg(3, "registry", "final is used in another journal", "lab WHERE label = 'final' AND node_id % 3 = 0 AND node_id % 2 = 1", **_NODE_AT),
        ]),
    ),
    "user_rules": _sql(
        "", """SELECT project_id, 3 AS severity, CAST(-1 AS BIGINT) AS start, CAST(-1 AS BIGINT) AS "end", 'user' AS module, concat('unknown user ', username) AS message FROM journals WHERE project_id % 5 = 0
UNION ALL SELECT project_id, 3, src, dst, 'user', 'unknown user s3' FROM wide WHERE software = 's3'""", "journals", "wide",
    ),
}
