"""Queries and SQL for edge predicates, recorded differences, roll-up rules and messages over the wide edge view."""

from __future__ import annotations

from pyspark.sql import functions as F

from provlake.functions.storage import picked
from provlake.operators import edge_rules, edge_sets, groups, lineage, rollups, rules

from .fixture import kept_views, view, wide_edges, with_views

EDGE = ("project_id", "src", "dst")
_W = with_views("wide", "operations")
_L = "'TransformSeamCarving', 'TransformCrop', 'SelectCropFrames', 'Donor', 'TransformDownSample', 'TransformReverse', 'DeleteAudioSample'"


def q_predicates(spark, d):
    e = edge_sets.edge_predicates(wide_edges(spark, d), view(spark, d, "operations"))
    return e.select(*EDGE, "op", "not_donor", "not_donor_not_empty", "composite", "localized", "localized_post")


def q_eligible(spark, d):
    return wide_edges(spark, d).where(edge_sets.eligible_for_donor()).select(*EDGE, "op")


def q_gan(spark, d):
    software = view(spark, d, "wide").where("dst % 6 = 2").select(F.col("software").alias("name"))
    return edge_sets.is_gan(wide_edges(spark, d), software).select(*EDGE, "op", "is_gan")


def _operations(spark, d):
    return view(spark, d, "operations").withColumns(
        {"transitions": F.expr("case when rule in ('donor', 'size', 'png') then array('image.image') when rule = 'audio' then array('audio.audio', 'video.video') when rule = 'mask' then array('image.image', 'video.video') else array('video.video') end"), "deprecated": F.col("op") == "AudioSample"}
    )


def q_ops_by_category(spark, d):
    used = view(spark, d, "edges").select("op").distinct()
    return edge_sets.ops_by_category(_operations(spark, d).join(used, "op", "left_semi"), "video", "video").select("category", F.array_join("ops", ",").alias("ops"))


def q_extend(spark, d):
    e = view(spark, d, "edges").select(*EDGE, "op")
    return edge_sets.nodes_to_extend(view(spark, d, "nodes"), e, view(spark, d, "operations"), ["+Filter:Blur", "+$Paste:PasteFrames", "~Audio:", "~:TransformCrop", "finalpng", "outputsourceop"])


def _differences(spark, d):
    """Wide edges with what differs in their video and sound streams."""
    entry = "named_struct('action', 'change', 'old', cast({} as string), 'new', cast({} as string))"
    return wide_edges(spark, d).withColumn(
        "metadatadiff",
        F.expr(f"""map_filter(map(
          'video', map_filter(map('nb_frames', if(dst % 3 > 0, {entry.format('100 + src % 20', '100 + dst % 20')}, null), 'duration', if(dst % 8 = 0, {entry.format('1', '2')}, null),
                                  'width', if(src % 2 = 0, {entry.format('320', 'if(dst % 2 = 0, 640, 720)')}, null), 'height', if(src % 4 = 0, {entry.format('200', '480')}, null)), (k, v) -> v is not null),
          'stereo', if(src % 3 > 0, map_filter(map('duration', if(dst % 5 > 0, {entry.format('src % 7 / 2', 'dst % 7 / 2')}, null), 'sample_rate', if(dst % 6 = 0, {entry.format('44100', '48000')}, null)), (k, v) -> v is not null), null)
        ), (k, v) -> v is not null)"""),
    )


def q_recorded(spark, d):
    return edge_rules.recorded_length_rules(_differences(spark, d).where("op <> 'Donor'"))


def q_amounts(spark, d):
    e = wide_edges(spark, d).withColumn("given_frames", F.pmod("dst", F.lit(60)))
    m = view(spark, d, "media").withColumn("type", F.expr("case when node_id % 3 = 0 then 'audio' else 'video' end"))
    s = e.join(view(spark, d, "segments").withColumnRenamed("set_id", "dst"), "dst").select(*EDGE, "type", (F.col("endframe") - F.col("startframe") + 1).alias("frames"))
    return edge_rules.amount_rules(e, m, s)


def q_donor_paths(spark, d):
    n, e = view(spark, d, "nodes"), wide_edges(spark, d)
    plain = e.select(*EDGE, F.when(F.col("op") == "Blur", "SelectRegion").otherwise(F.col("op")).alias("op"))
    return edge_rules.donor_path_rules(e, {"SelectRegion": lineage.has_ancestor_op(n, plain, "SelectRegion")})


def q_streams(spark, d):
    n = view(spark, d, "nodes")
    s = n.select("project_id", "node_id", F.explode(F.expr("filter(array(if(node_id % 3 > 0, 'video', null), if(node_id % 4 > 0, 'audio', null), if(node_id % 5 = 0, 'audio', null)), x -> x is not null)")).alias("type"))
    return edge_rules.stream_rules(wide_edges(spark, d), n, s)


def q_composite(spark, d):
    e = wide_edges(spark, d).withColumn("n_videomasks", F.pmod("src", F.lit(3)))
    return edge_rules.composite_flag_rules(e, view(spark, d, "operations"))


PARAMS = "op string, name string, type string, mandatory boolean, source string, needed_by string, needed_value string"
_PARAMS = [
    ("Blur", "purpose", "list:clone,remove", True, None, None, None), ("Blur", "Blur Type", "list:Median Smoothing", True, "image", None, None), ("PasteSampled", "inputmaskname", "string", True, None, None, None),
    ("PasteSplice", "subject", "string", False, None, "purpose", "clone"), ("PasteSplice", "resolution", "int[0:999]", True, None, None, None), ("AddAudio", "voice", "yesno", False, None, "add type", "overlay"),
]


def q_mandatory(spark, d):
    return rules.mandatory_rules(wide_edges(spark, d).withColumn("src_type", F.col("media_type")), spark.createDataFrame(_PARAMS, PARAMS))


def q_arguments(spark, d):
    return rules.argument_rules(wide_edges(spark, d), spark.createDataFrame(_PARAMS, PARAMS))


def q_journal_properties(spark, d):
    j = view(spark, d, "journals").withColumn("props", F.expr("map('organization', substring(username, 1, cast(project_id % 5 as int)), 'projecttype', projecttype)"))
    return rules.property_rules(j, ["organization", "projecttype", "license"]).drop("start", "end")


def q_run(spark, d):
    e = wide_edges(spark, d)
    found = edge_rules.composite_flag_rules(e.withColumn("n_videomasks", F.pmod("src", F.lit(3))), view(spark, d, "operations"))
    of = spark.createDataFrame([("Blur", "local"), ("Blur", "donor:empty"), ("PasteSplice", "empty"), ("TimeWarp", "video_masks")], "op string, rule string")
    kept = rules.run_rules(found, e, of, isolated=True)
    return rules.sort_messages(rules.remove_messages(kept, (F.col("module") == "empty") & (F.pmod("start", F.lit(2)) == 0)))


def _rule_edges(spark, d):
    """Nodes, links, and the links with what the rules ask for."""
    have = kept_views(spark, d, "nodes", "edges")
    n, e = have["nodes"], picked(have["edges"], *EDGE, "op")
    common = lineage.common_parent(n, e).select("project_id", F.col("node_id").alias("dst"), F.col("same").alias("common_parent"))
    wide = edge_sets.is_gan(wide_edges(spark, d, have), spark.createDataFrame([("s2",)], "name string")).join(view(spark, d, "operations").select("op", "category"), "op", "left")
    return n, e, wide.join(common, ["project_id", "dst"], "left")


def q_property_rules(spark, d):
    return rollups.rules_of_finals(*_rule_edges(spark, d))


def q_formats(spark, d):
    n = view(spark, d, "nodes")
    finals = lineage.terminal_base_tuples(n, view(spark, d, "edges"))
    media = n.selectExpr("project_id", "node_id", "case when node_id % 4 > 0 then concat('image/', node_id % 3) end as mime", "case when node_id % 5 = 0 then 'JPEG' else 'PNG' end as file_type", "case node_id % 3 when 0 then ' LZW ' when 1 then 'Uncompressed' end as compression")
    return rollups.format_changes(finals, media)


def q_best(spark, d):
    n, e = view(spark, d, "nodes"), view(spark, d, "edges").select(*EDGE, "op")
    return rollups.best_of(rollups.unit_count(rollups.final_edges(n, e), view(spark, d, "operations"))).withColumnRenamed("count", "units")


def _grouped(spark, d):
    return wide_edges(spark, d).withColumn("semanticGroups", F.expr("filter(array(if(dst % 3 = 0, 'face', null), if(src % 2 = 0, 'body', null)), x -> x is not null)"))


def q_groups(spark, d):
    g = rollups.edges_by_group(_grouped(spark, d))
    return g.select("project_id", "group", "n", F.array_join(F.transform("edges", lambda x: F.concat_ws("-", x.src, x.dst)), ",").alias("edges"))


def q_project_groups(spark, d):
    return rollups.project_groups(_grouped(spark, d)).select("project_id", F.array_join("groups", ",").alias("groups"))


def _nested(spark, d):
    """Groups of operations by journal, groups of four of those, one group of these, and two groups that hold each other."""
    g = view(spark, d, "edges").where("op <> 'Donor'").groupBy(F.concat(F.lit("g"), F.pmod("project_id", F.lit(20))).alias("group_name"), "op").agg(F.min(F.col("src") * 1000 + F.pmod("dst", F.lit(1000))).alias("pos"))
    names = view(spark, d, "edges").where("op <> 'Donor'").select(F.pmod("project_id", F.lit(20)).alias("k")).distinct()
    four = names.selectExpr("concat('h', k div 4) as group_name", "concat('g', k) as op", "20 - k as pos")
    all_ = names.selectExpr("'i' as group_name", "concat('h', k div 4) as op", "k div 4 as pos").distinct()
    round_ = names.where("k < 2").selectExpr("explode(array(named_struct('g', concat('c', k), 'op', concat('c', 1 - k), 'pos', 1), named_struct('g', concat('c', k), 'op', if(k = 0, 'Blur', 'TimeWarp'), 'pos', 2))) as x")
    return g.unionByName(four).unionByName(all_).unionByName(round_.select(F.col("x.g").alias("group_name"), "x.op", F.col("x.pos").cast("long").alias("pos")))


def q_combine(spark, d):
    o = _operations(spark, d).withColumns({"mandatory": F.expr("array(category, substring(op, 1, 4))"), "optional": F.expr("array(rule)")})
    out = rollups.combine_ops(_nested(spark, d), o)
    return out.select("group_name", "first_op", "last_op", *(F.array_join(c, ",").alias(c) for c in ("categories", "rules", "transitions", "mandatory", "optional")))


def q_expanded(spark, d):
    out = groups.expand_groups(_nested(spark, d))
    return out.select("group_name", F.array_join("path", "/").alias("path"), "op", "is_cycle")


def q_group_rules(spark, d):
    """An edge of every twelfth end is of a group: of one, two or three levels."""
    levels = view(spark, d, "operations").where("op in ('Blur', 'ColorColorBalance', 'AddAudio', 'TransformWarp', 'TimeWarp')").selectExpr(
        "explode(case op when 'Blur' then array('g0', 'g2') when 'ColorColorBalance' then array('g0') when 'AddAudio' then array('g1') else array('g2') end) as group_name", "op", "cast(length(op) as bigint) as pos"
    )
    held = levels.select("group_name").distinct().where("group_name <> 'g0'").selectExpr("group_name", "if(group_name = 'g1', 'g0', 'g1') as op", "cast(0 as bigint) as pos")
    members = groups.group_members(levels.unionByName(held), view(spark, d, "operations"))
    grouped = F.pmod("dst", F.lit(12)) == 0
    n, e, wide = _rule_edges(spark, d)
    c = wide.withColumns({"category": F.when(grouped, "Groups").otherwise(F.col("category")), "op": F.when(grouped, F.concat(F.lit("g"), F.pmod("src", F.lit(3)))).otherwise(F.col("op"))})
    return rollups.rules_of_finals(n, e, c.join(members, "op", "left")).select("project_id", "final", "color", "audio_activity", "other_enhancement", "video_other_enhancement", "median_smoothing")


def q_generated(spark, d):
    n = view(spark, d, "nodes")
    finals = lineage.terminal_base_tuples(n, view(spark, d, "edges"))
    marks = n.selectExpr("project_id", "node_id", "case when node_id % 3 = 0 then 'yes' when node_id % 3 = 1 then 'no' end as is_gan", "if(node_id % 5 = 0, 'yes', 'no') as cgi")
    return rollups.generated_media(finals, marks)


def q_stats(spark, d):
    return rollups.collect_stats(view(spark, d, "wide"), "media_type")


QUERIES = {
    "edge_predicates": q_predicates, "donor_eligible": q_eligible, "gan_edges": q_gan, "ops_by_category": q_ops_by_category, "nodes_to_extend": q_extend, "recorded_lengths": q_recorded, "media_amounts": q_amounts,
    "donor_paths": q_donor_paths, "stream_rules": q_streams, "composite_flags": q_composite, "mandatory_rules": q_mandatory, "argument_rules": q_arguments, "journal_properties": q_journal_properties, "run_rules": q_run,
    "property_rules": q_property_rules, "format_changes": q_formats, "best_of": q_best, "edges_by_group": q_groups, "project_groups": q_project_groups, "combine_ops": q_combine, "expanded_groups": q_expanded, "group_property_rules": q_group_rules, "generated_media": q_generated, "media_stats": q_stats,
}


def _m(severity: int, module: str, message: str, table: str, where: str, s: str = "src", e: str = "dst") -> str:
    text = message if message.startswith(("concat", "'")) else "'" + message.replace("'", "''") + "'"
    return f"SELECT project_id, {severity} AS severity, {s} AS start, {e} AS \"end\", '{module}' AS module, {text} AS message FROM {table} WHERE {where}"


def _all(*parts: tuple) -> str:
    return "\nUNION ALL ".join(_m(*p) for p in parts)


_VC, _VS, _VL = "Length of video has changed", "Length of video is not shorter", "Length of video is not longer"
_OUT = "'Operation link appears affect local area in the image and should be included in the composite mask'"
_WARN = "'Operation link appears to affect local area in the image; should be included in the composite mask'"
_COMPOSITE = (
    (3, "local", _OUT, "x", "outside"), (2, "local_warn", _WARN, "x", "outside AND category <> 'Output'"), (3, "empty", "An empty change mask indicating an manipulation did not occur.", "x", "empty_mask = 'yes'"),
    (2, "sampled_input_mask", "Un-needed input mask.", "x", "coalesce(purpose, '') <> 'clone' AND inputmask IS NOT NULL"), (3, "video_masks", "Edge missing video masks", "x", "dst_type = 'video' AND src % 3 = 0"),
)
_X = f"{_W}, x AS (SELECT w.*, o.category, coalesce(is_global, 'no') <> 'yes' AND coalesce(record_mask, 'no') <> 'yes' AS outside FROM wide w JOIN operations o ON o.op = w.op WHERE w.op <> 'Donor')"
_RW = with_views("wide", "operations", recursive=True)
_UPALL = """upall AS (SELECT project_id, node_id, node_id AS at FROM nodes UNION SELECT u.project_id, u.node_id, e.src FROM upall u JOIN edges e ON e.project_id = u.project_id AND e.dst = u.at),
ends AS (SELECT project_id, node_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.project_id = n.project_id AND e.src = n.node_id)),
par AS (SELECT project_id, dst, min(src) AS up FROM edges WHERE op <> 'Donor' GROUP BY 1, 2),
walk AS (SELECT project_id, node_id, node_id AS at FROM nodes UNION ALL SELECT w.project_id, w.node_id, p.up FROM walk w JOIN par p ON p.project_id = w.project_id AND p.dst = w.at),
fb AS (SELECT * FROM walk w WHERE NOT EXISTS (SELECT 1 FROM par p WHERE p.project_id = w.project_id AND p.dst = w.at))"""
_TRANS = "CASE WHEN rule IN ('donor', 'size', 'png') THEN ['image.image'] WHEN rule = 'audio' THEN ['audio.audio', 'video.video'] WHEN rule = 'mask' THEN ['image.image', 'video.video'] ELSE ['video.video'] END"
_S = {"a": "node_id % 3 > 0", "b": "node_id % 4 > 0", "c": "node_id % 5 = 0"}
_GANW = "(software = 's2' OR (op = 'PasteSplice' AND coalesce(subject, '') LIKE '%gan%'))"
_ADDED = "(purpose = 'add' OR (purpose IS NULL AND add_type IS NULL AND voice IS NULL AND blur_type IS NULL AND subject IS NULL AND direct IS NULL AND resolution IS NULL))"
_RULES = {
    "blur_local": "op = 'Blur' AND coalesce(is_global, 'no') = 'no'", "histogram_global": "op = 'Normalization'", "contrast_global": "op = 'Contrast'", "color": "category = 'Color'",
    "clone": "(op = 'PasteSplice' AND same) OR (op = 'PasteSampled' AND purpose = 'clone')", "spatial_clone": "media_type = 'video' AND op = 'PasteSampled' AND purpose = 'clone'", "spatial_splice": "false",
    "spatial_remove": "media_type = 'video' AND op = 'PasteSampled' AND purpose = 'remove'", "spatial_moving": "false", "voice_overlay": "voice = 'yes' AND add_type = 'overlay'", "voice_swap": "voice = 'yes' AND add_type = 'replace'",
    "median_smoothing": "op = 'Blur' AND blur_type = 'Median Smoothing'", "audio_activity": "category = 'Audio'", "other_enhancement": "false", "video_other_enhancement": "false", "gan_component": _GANW,
}

#: Groups as _nested() has them, and their members.
_EXPANDED = """gr AS (SELECT concat('g', project_id % 20) AS group_name, op, min(src * 1000 + dst % 1000) AS pos FROM edges WHERE op <> 'Donor' GROUP BY 1, 2),
ks AS (SELECT DISTINCT project_id % 20 AS k FROM edges WHERE op <> 'Donor'),
raw AS (SELECT * FROM gr UNION ALL SELECT concat('h', k // 4), concat('g', k), 20 - k FROM ks UNION ALL SELECT DISTINCT 'i', concat('h', k // 4), k // 4 FROM ks
  UNION ALL SELECT concat('c', k), concat('c', 1 - k), 1 FROM ks WHERE k < 2 UNION ALL SELECT concat('c', k), CASE k WHEN 0 THEN 'Blur' ELSE 'TimeWarp' END, 2 FROM ks WHERE k < 2),
opened AS (SELECT group_name, [pos] AS path, op, [group_name] AS above FROM raw
  UNION ALL SELECT o.group_name, list_append(path, r.pos), r.op, list_append(above, r.group_name) FROM opened o JOIN raw r ON r.group_name = o.op WHERE NOT list_contains(above, o.op)),
ex AS (SELECT group_name, path, op, list_contains(above, op) AS is_cycle FROM opened WHERE list_contains(above, op) OR op NOT IN (SELECT group_name FROM raw))"""
_OTHER = f"category IN ({', '.join(map(repr, rollups.ENHANCEMENTS))}) AND op NOT IN ({', '.join(map(repr, rollups.NO_ENHANCEMENTS))})"

ORACLES = {
    "edge_predicates": f"""{_W} SELECT project_id, src, dst, w.op, w.op <> 'Donor' AS not_donor, w.op <> 'Donor' AND coalesce(empty_mask, 'no') = 'no' AS not_donor_not_empty, coalesce(record_mask, 'no') = 'yes' AS composite,
  (coalesce(record_mask, 'no') = 'yes' OR (w.op NOT IN ({_L}) AND coalesce(empty_mask, 'no') = 'no' AND coalesce(is_global, 'no') <> 'yes')) AND category NOT IN ('Output', 'AntiForensic', 'PostProcessing', 'Laundering', 'TimeAlteration') AS localized,
  coalesce(record_mask, 'no') = 'yes' OR (w.op NOT IN ({_L.replace("'SelectCropFrames', ", '')}) AND coalesce(empty_mask, 'no') = 'no' AND category NOT IN ('Output', 'TimeAlteration')) AS localized_post
FROM wide w JOIN operations o ON o.op = w.op""",
    "donor_eligible": f"{_W} SELECT project_id, src, dst, op FROM wide WHERE op = 'Donor' OR (op = 'PasteSampled' AND purpose = 'clone' AND inputmask IS NOT NULL)",
    "gan_edges": f"{_W} SELECT project_id, src, dst, op, {_GANW} AS is_gan FROM wide",
    "ops_by_category": f"{_W} SELECT category, string_agg(op, ',' ORDER BY op) AS ops FROM (SELECT *, {_TRANS} AS t FROM operations WHERE op IN (SELECT op FROM edges)) WHERE list_contains(t, 'video.video') AND op <> 'AudioSample' GROUP BY 1",
    "nodes_to_extend": f"""{_RW}, {_UPALL}, top AS (SELECT n.project_id, n.node_id, NOT EXISTS (SELECT 1 FROM edges e WHERE e.project_id = n.project_id AND e.src = n.node_id AND e.op <> 'Donor')
    AND EXISTS (SELECT 1 FROM edges e WHERE e.project_id = n.project_id AND e.src = n.node_id) AS donor FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.project_id = n.project_id AND e.dst = n.node_id)),
made AS (SELECT e.project_id, e.dst, arg_max(e.op, e.src) AS op, arg_max(o.category, e.src) AS category, bool_or(o.category = 'Output') AS output FROM edges e JOIN operations o ON o.op = e.op WHERE e.op <> 'Donor' GROUP BY 1, 2),
used AS (SELECT e.project_id, e.src, bool_or(e.op = 'PasteFrames') AS frames, bool_or(o.category = 'Output') AS output FROM edges e JOIN operations o ON o.op = e.op WHERE e.op <> 'Donor' GROUP BY 1, 2),
n AS (SELECT n.*, t.node_id IS NOT NULL AS is_top, e.node_id IS NOT NULL AS last, coalesce(m.op = 'Blur', false) AS blur, coalesce(m.category = 'Audio' OR m.op = 'TransformCrop', false) AS out_, coalesce(m.output, false) AS made_out,
    coalesce(u.frames, false) AS frames, coalesce(u.output, false) AS to_out FROM nodes n LEFT JOIN top t ON t.project_id = n.project_id AND t.node_id = n.node_id LEFT JOIN ends e ON e.project_id = n.project_id AND e.node_id = n.node_id
    LEFT JOIN made m ON m.project_id = n.project_id AND m.dst = n.node_id LEFT JOIN used u ON u.project_id = n.project_id AND u.src = n.node_id)
SELECT n.project_id, n.node_id FROM n JOIN fb ON fb.project_id = n.project_id AND fb.node_id = n.node_id JOIN top t ON t.project_id = fb.project_id AND t.node_id = fb.at AND NOT t.donor
WHERE (NOT is_top AND (blur OR frames)) OR CASE WHEN last THEN file LIKE '%png' ELSE NOT is_top AND NOT made_out AND (to_out OR NOT out_) END""",
    "recorded_lengths": f"""{_W}, y AS (SELECT *, dst % 3 > 0 AS nf, 100 + src % 20 AS o, 100 + dst % 20 AS n, coalesce(add_type, '') AS ad, src % 3 > 0 AS st FROM wide WHERE op <> 'Donor'),
x AS (SELECT *, nf OR dst % 8 = 0 AS changed, NOT nf OR o < n AS notshort, NOT nf OR o > n AS notlong, CASE WHEN st AND dst % 5 > 0 THEN (src % 7) / 2.0 - (dst % 7) / 2.0 ELSE 0 END AS sound FROM y)
{_all((3, 'duration', _VC, 'x', 'changed'), (2, 'length_same', _VC, 'x', 'changed'), (3, 'length_smaller', _VS, 'x', 'notshort'), (3, 'length_bigger', _VL, 'x', 'notlong'),
      (3, 'length_same_or_bigger', _VL, 'x', "ad NOT IN ('replace', 'overlay') AND notlong"), (2, 'length_same_or_bigger', _VC, 'x', "ad IN ('replace', 'overlay') AND changed"),
      (3, 'audio_bigger', 'Audio is not longer in duration', 'x', 'sound >= 0'), (3, 'audio_smaller', 'Audio is not shorter in duration', 'x', 'sound <= 0.001'), (3, 'audio_strict', 'Audio duration does not match', 'x', 'abs(sound) > 0.001'),
      (3, 'audio_loose', 'Audio duration does not match', 'x', 'abs(sound) >= 1'), (3, 'audio_same_or_longer', 'Audio is not longer in duration', 'x', "ad = 'insert' AND sound >= 0"), (3, 'audio_same_or_longer', 'Audio duration does not match', 'x', "ad <> 'insert' AND abs(sound) > 0.001"),
      (3, 'sample_rate', 'Sample rate changed', 'x', 'st AND dst % 6 = 0'), (3, 'resolution', 'resolution is not in correct format', 'x', "resolution = '640'"), (2, 'resolution', 'resolution width does not match video', 'x', "resolution = '640x480' AND src % 2 = 0 AND dst % 2 = 1"))}""",
    "media_amounts": f"""{with_views('wide', 'media', 'segments')}, m AS (SELECT *, CASE WHEN node_id % 3 = 0 THEN 'audio' ELSE 'video' END AS type FROM media),
sg AS (SELECT w.project_id, w.src, w.dst, w.op, s.type, s.endframe - s.startframe + 1 AS frames FROM wide w JOIN segments s ON s.set_id = w.dst),
x AS (SELECT w.*, a.type, a.rate AS r0, b.rate AS r1, a.frames AS f0, b.frames AS f1, a.duration_ms AS m0, b.duration_ms AS m1, coalesce((SELECT sum(frames) FROM sg WHERE sg.project_id = w.project_id AND sg.src = w.src AND sg.dst = w.dst AND sg.op = w.op AND sg.type = a.type), 0)::BIGINT AS s
  FROM wide w JOIN m a ON a.project_id = w.project_id AND a.node_id = w.src JOIN m b ON b.project_id = w.project_id AND b.node_id = w.dst AND b.type = a.type WHERE w.op <> 'Donor'),
df AS (SELECT DISTINCT a.project_id, a.src, a.dst FROM sg a JOIN sg b ON b.op = 'Donor' AND b.project_id = a.project_id AND b.dst = a.dst AND b.type = a.type AND b.frames <> a.frames WHERE a.op <> 'Donor')
{_all((3, 'cut_amount', "concat('Actual amount of frames of cut video is ', f0 - f1)", 'x', "type = 'video' AND f0 - f1 <> s"), (3, 'cut_amount', "concat('Actual amount of cut time in milliseconds is ', round((f0 - f1) * 1000.0 / r0)::BIGINT)", 'x', "type = 'audio' AND f0 - f1 <> s AND abs(f0 - f1 - s) > r0 * 0.1"),
      (3, 'paste_amount', 'Replacement may not increase the video beyond the size of the donor', 'x', "type = 'video' AND add_type = 'replace' AND f1 > f0"), (3, 'paste_amount', "concat('Pasted frames are not the increase: ', f1 - f0, ' added, ', s, ' recorded')", 'x', "type = 'video' AND coalesce(add_type, '') <> 'replace' AND f1 - f0 <> s"),
      (3, 'crop_length', "concat('Actual amount of frames of cropped video is ', f1)", 'x', "type = 'video' AND abs(f1 - dst % 60) > 1"), (3, 'audio_duration', 'Duration of media changed', 'x', "type = 'audio' AND round(abs(m0 - m1), 6) > 100"),
      (3, 'overlay_duration', 'Duration of media changed', 'x', "type = 'audio' AND round(abs(m0 - m1), 6) > 100 AND add_type IN ('overlay', 'replace')"), (3, 'audio_add', 'Length did not change though an insert is applied', 'x', "type = 'audio' AND round(abs(m0 - m1), 6) <= 100 AND coalesce(add_type, 'insert') = 'insert'"),
      (2, 'rate_changed', 'Frame rate changed between nodes', 'x', 'r0 <> r1'), (3, 'rate_unchanged', 'Frame rate did not change between nodes', 'x', 'r0 = r1'), (3, 'donor_times', 'Mismatch number of frames', 'df', 'true'))}""",
    "donor_paths": f"""{_RW}, {_UPALL}, rg AS (SELECT DISTINCT u.project_id, u.node_id FROM upall u JOIN edges e ON e.project_id = u.project_id AND e.dst = u.at WHERE e.op = 'Blur'), dn AS (SELECT project_id, dst, min(src) AS donor FROM edges WHERE op = 'Donor' GROUP BY 1, 2),
x AS (SELECT w.*, d.donor IS NULL AS lost, EXISTS (SELECT 1 FROM rg WHERE rg.project_id = d.project_id AND rg.node_id = d.donor) AS has FROM wide w LEFT JOIN dn d ON d.project_id = w.project_id AND d.dst = w.dst WHERE w.op <> 'Donor')
{_all((3, 'donor', 'donor image/video missing', 'x', 'lost'), (3, 'donor_audio', 'donor image/video missing', 'x', 'lost AND direct IS NULL'), (3, 'SelectRegion', 'donor image missing', 'x', 'lost'), (2, 'SelectRegion', 'SelectRegion missing on path to donor', 'x', "NOT lost AND NOT has AND coalesce(purpose, '') <> 'blend'"))}""",
    "stream_rules": f"""{_W}, n AS (SELECT project_id, node_id, split_part(file, '.', 2) AS s, CASE WHEN file LIKE '%.png' OR file LIKE '%.jpg' THEN 'image' WHEN file LIKE '%.wav' THEN 'audio' ELSE 'video' END AS k, ({_S['a']})::INT AS v, ({_S['b']})::INT + ({_S['c']})::INT AS a FROM nodes),
dn AS (SELECT e.project_id, e.dst, list(n.k) AS kinds FROM edges e JOIN n ON n.project_id = e.project_id AND n.node_id = e.src WHERE e.op = 'Donor' GROUP BY 1, 2),
x AS (SELECT e.project_id, e.src, e.dst, e.op, a.k AS k0, b.k AS k1, a.s AS s0, b.s AS s1, a.v AS v0, b.v AS v1, b.a AS a1, a.v + a.a AS n0, b.v + b.a AS n1, d.kinds, lower(substring(e.op, 7)) AS want FROM edges e JOIN n a ON a.project_id = e.project_id AND a.node_id = e.src
  JOIN n b ON b.project_id = e.project_id AND b.node_id = e.dst LEFT JOIN dn d ON d.project_id = e.project_id AND d.dst = e.dst WHERE e.op <> 'Donor')
{_all((3, 'type_change', 'operation not permitted to change the type of image or video file', 'x', 'k0 <> k1'), (3, 'type_change_donor', 'donor image missing', 'x', 'k0 <> k1 AND kinds IS NULL'),
      (3, 'type_change_donor', 'operation not permitted to change the type of image or video file', 'x', 'k0 <> k1 AND len(list_filter(kinds, lambda k: k <> k1)) > 0'), (3, 'suffix', 'File type changed', 'x', 's0 <> s1'), (3, 'audio_output', 'Expecting Audio file type', 'x', "k1 <> 'audio'"),
      (3, 'output_type', "concat('Output file extension ', upper(s1), ' doesn''t match operation allowed extensions: ', CASE want WHEN 'mp4' THEN 'mp4, mpeg, mpg' ELSE want END)", 'x', "op LIKE 'Output%' AND s1 <> want"),
      (2, 'channel_loss', 'change in the number of streams occurred', 'x', "k0 <> 'image' AND k1 <> 'image' AND n0 > n1"), (2, 'same_channels', 'change in the number of streams occurred', 'x', "k0 <> 'image' AND k1 <> 'image' AND n0 <> n1"),
      (3, 'same_channels', 'streams are not detected or missing', 'x', "k0 <> 'image' AND k1 <> 'image' AND n0 = 0 AND n1 = 0"), (3, 'has_video', 'video channel missing in file', 'x', 'v1 = 0'), (3, 'has_audio', 'audio channel not present', 'x', 'a1 = 0'), (3, 'video_kept', 'Video is missing from audio sample', 'x', 'v0 <> v1'))}""",
    "composite_flags": f"{_X}\n{_all(*_COMPOSITE)}",
    "mandatory_rules": f"""{_W}
{_all((3, 'mandatory', 'missing purpose', 'wide', "op = 'Blur' AND purpose IS NULL"), (3, 'mandatory', 'missing Blur Type', 'wide', "op = 'Blur' AND blur_type IS NULL AND media_type = 'image'"), (3, 'mandatory', 'missing inputmaskname', 'wide', "op = 'PasteSampled' AND inputmask IS NULL"),
      (3, 'mandatory', 'missing subject', 'wide', "op = 'PasteSplice' AND subject IS NULL AND purpose = 'clone'"), (3, 'mandatory', 'missing resolution', 'wide', "op = 'PasteSplice' AND resolution IS NULL"), (3, 'mandatory', 'missing voice', 'wide', "op = 'AddAudio' AND voice IS NULL AND add_type = 'overlay'"))}""",
    "argument_rules": f"""{_W}
{_all((3, 'argument', 'invalid purpose', 'wide', "op = 'Blur' AND purpose NOT IN ('clone', 'remove')"), (3, 'argument', 'invalid resolution', 'wide', "op = 'PasteSplice' AND resolution = '640x480'"))}""",
    "journal_properties": f"""{with_views('journals')} SELECT project_id, 3 AS severity, 'property' AS module, 'property organization' AS message FROM journals WHERE project_id % 5 < 3 UNION ALL SELECT project_id, 3, 'property', 'property license' FROM journals""",
    "run_rules": f"""{_X}, f AS ({_all(*_COMPOSITE)}), n AS (SELECT * FROM (VALUES ('Blur', 'local'), ('PasteSplice', 'empty'), ('TimeWarp', 'video_masks')) t(op, module))
SELECT f.* FROM f JOIN edges e ON e.project_id = f.project_id AND e.src = f.start AND e.dst = f."end" JOIN n ON n.op = e.op AND n.module = f.module WHERE NOT (f.module = 'empty' AND f.start % 2 = 0)""",
    "property_rules": f"""{_RW}, {_UPALL}, rk AS (SELECT *, row_number() OVER (PARTITION BY project_id, dst ORDER BY src) AS k FROM edges),
cp AS (SELECT rk.project_id, rk.dst, min(fb.at) = max(fb.at) AS same FROM rk LEFT JOIN fb ON fb.project_id = rk.project_id AND fb.node_id = rk.src WHERE k <= 2 GROUP BY 1, 2 HAVING count(*) = 2),
c AS (SELECT DISTINCT u.node_id AS final, w.*, o.category, coalesce(cp.same, false) AS same FROM upall u JOIN ends n ON n.project_id = u.project_id AND n.node_id = u.node_id JOIN wide w ON w.project_id = u.project_id AND w.dst = u.at
  JOIN operations o ON o.op = w.op LEFT JOIN cp ON cp.project_id = w.project_id AND cp.dst = w.dst)
SELECT project_id, final, {', '.join(f"bool_or(coalesce({v}, false)) AS {k}" for k, v in _RULES.items())} FROM c GROUP BY 1, 2""",
    "format_changes": f"""{_RW}, {_UPALL}, up AS (SELECT project_id, node_id, node_id AS at FROM ends UNION SELECT u.project_id, u.node_id, e.src FROM up u JOIN edges e ON e.project_id = u.project_id AND e.dst = u.at WHERE e.op <> 'Donor'),
b AS (SELECT u.project_id, u.node_id AS final, u.at AS base FROM up u WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.project_id = u.project_id AND e.dst = u.at))
SELECT project_id, final, base, coalesce(CASE WHEN base % 4 > 0 THEN base % 3 END <> CASE WHEN final % 4 > 0 THEN final % 3 END, false) OR (base % 5 = 0) <> (final % 5 = 0) AS reformatted, final % 5 = 0 OR final % 3 = 0 AS compressed FROM b""",
    "best_of": f"""{_RW}, {_UPALL}, u AS (SELECT u.project_id, u.node_id, count(DISTINCT e.op) FILTER (o.category NOT IN ('Output', 'Donor')) AS n FROM upall u JOIN ends n ON n.project_id = u.project_id AND n.node_id = u.node_id JOIN edges e ON e.project_id = u.project_id AND e.dst = u.at
  JOIN operations o ON o.op = e.op GROUP BY 1, 2) SELECT project_id, max(n) AS units, concat('Unit-', max(n)) AS category FROM u GROUP BY 1""",
    "edges_by_group": f"""{_W}, g AS (SELECT *, unnest(list_filter([CASE WHEN dst % 3 = 0 THEN 'face' END, CASE WHEN src % 2 = 0 THEN 'body' END], lambda x: x IS NOT NULL)) AS grp FROM wide)
SELECT project_id, grp AS "group", count(*) AS n, string_agg(concat(src, '-', dst), ',' ORDER BY src, dst) AS edges FROM g GROUP BY 1, 2""",
    "project_groups": f"{_W} SELECT project_id, concat_ws(',', CASE WHEN bool_or(src % 2 = 0) THEN 'body' END, CASE WHEN bool_or(dst % 3 = 0) THEN 'face' END) AS groups FROM wide GROUP BY 1 HAVING bool_or(src % 2 = 0 OR dst % 3 = 0)",
    "combine_ops": f"""{with_views('wide', 'operations', recursive=True)}, {_EXPANDED}, j AS (SELECT x.group_name, x.path AS pos, x.op, o.category, o.rule, {_TRANS} AS t FROM ex x JOIN operations o ON o.op = x.op WHERE NOT is_cycle),
x AS (SELECT group_name, arg_min(op, pos) AS first_op, arg_max(op, pos) AS last_op, arg_min(t, pos) AS ft, arg_max(t, pos) AS lt, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, array_to_string(list_sort(list(DISTINCT rule)), ',') AS rules FROM j GROUP BY 1),
tr AS (SELECT DISTINCT group_name, split_part(a, '.', 1) || '.' || split_part(b, '.', 2) AS t FROM (SELECT group_name, a, unnest(lt) AS b FROM (SELECT group_name, lt, unnest(ft) AS a FROM x))),
mm AS (SELECT group_name, string_agg(m, ',' ORDER BY m) AS mandatory FROM (SELECT group_name, category AS m FROM j UNION SELECT group_name, op[1:4] FROM j) GROUP BY 1)
SELECT x.group_name, first_op, last_op, categories, rules, (SELECT string_agg(t, ',' ORDER BY t) FROM tr WHERE tr.group_name = x.group_name) AS transitions, mandatory, rules AS optional FROM x JOIN mm USING (group_name)""",
    "expanded_groups": f"""{with_views('edges', recursive=True)}, {_EXPANDED} SELECT group_name, array_to_string(path, '/') AS path, op, is_cycle FROM ex""",
    "group_property_rules": f"""{_RW}, {_UPALL}, c AS (SELECT DISTINCT u.node_id AS final, w.*, o.category FROM upall u JOIN ends n ON n.project_id = u.project_id AND n.node_id = u.node_id JOIN wide w ON w.project_id = u.project_id AND w.dst = u.at JOIN operations o ON o.op = w.op),
k AS (SELECT *, CASE WHEN dst % 12 = 0 THEN src % 3 END AS g FROM c)
SELECT project_id, final, bool_or(CASE WHEN g IS NULL THEN category = 'Color' ELSE true END) AS color, bool_or(CASE WHEN g IS NULL THEN category = 'Audio' ELSE g > 0 END) AS audio_activity,
  bool_or(media_type = 'image' AND g IS NULL AND {_OTHER}) AS other_enhancement, bool_or(media_type = 'video' AND g IS NULL AND {_OTHER}) AS video_other_enhancement,
  bool_or(coalesce(g IS NULL AND op = 'Blur' AND blur_type = 'Median Smoothing', false)) AS median_smoothing FROM k GROUP BY 1, 2""",
    "generated_media": f"""{_RW}, {_UPALL}, up AS (SELECT project_id, node_id, node_id AS at FROM ends UNION SELECT u.project_id, u.node_id, e.src FROM up u JOIN edges e ON e.project_id = u.project_id AND e.dst = u.at WHERE e.op <> 'Donor'),
b AS (SELECT u.project_id, u.node_id AS final, min(u.at) AS base FROM up u WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.project_id = u.project_id AND e.dst = u.at) GROUP BY 1, 2)
SELECT project_id, final, base % 3 = 0 AS gan_generated, base % 5 = 0 AS cgi_generated FROM b""",
    "media_stats": f"{_W} SELECT media_type AS type, count(*) AS n FROM wide GROUP BY 1",
}
