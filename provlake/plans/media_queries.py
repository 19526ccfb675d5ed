"""Queries and SQL for media checks, edge segments and image tables over the journal views."""

from __future__ import annotations

from pyspark.sql import functions as F

from provlake.functions import scalars
from provlake.operators import media_checks, segments

from .fixture import kept_views, view, with_views

EDGE = media_checks.EDGE


def _edges(spark, d, have=None):
    return (have["edges"] if have else view(spark, d, "edges")).where("op <> 'Donor'")


def q_size(spark, d):
    e = _edges(spark, d).selectExpr(
        *EDGE, "op", "200 + src % 5 * 8 as src_w", "200 + src % 3 * 8 as src_h", "200 + dst % 7 * 4 as dst_w", "200 + dst % 4 * 8 as dst_h",
        "case when dst % 6 = 0 then 'none' else 'cubic' end as interpolation", "case when dst % 5 = 0 then 'yes' else 'no' end as rotated",
        "case when src % 2 = 0 then 'Rotate 90 CW' end as orientation", "case when dst % 2 = 0 then 'x.JPG' else 'x.png' end as dst_file",
        "case when op = 'PasteSplice' then 'm.png' end as pastemask", "case when dst % 9 > 0 then 200 + dst % 5 * 8 end as mask_w", "case when dst % 9 > 0 then 200 + src % 3 * 8 end as mask_h",
    )
    return media_checks.size_rules(e)


def q_masks(spark, d):
    have = kept_views(spark, d, "nodes", "edges")
    e = _edges(spark, d, have).selectExpr(
        *EDGE, "case when dst % 11 > 0 then concat('m', dst) end as maskname", "case when op = 'PasteSampled' then concat('i', dst) when op = 'Blur' then '' end as inputmask",
        "cast(case when dst % 4 = 0 then 1 else 0 end as int) as n_videomasks", "case when op like '%Audio' then 'audio' else 'all' end as generate", "case when src % 3 = 0 then 'audio' else 'video' end as src_type", "case when dst % 5 = 0 then 'zip' else 'image' end as dst_type",
    )
    n = have["nodes"]
    files = n.where("node_id % 7 > 0").selectExpr("project_id", "concat('m', node_id) as file", "10 + node_id % 3 as width", "20 as height")
    files = files.unionByName(n.where("node_id % 5 > 0").selectExpr("project_id", "concat('i', node_id) as file", "case when node_id % 8 > 0 then 10 + node_id % 2 end as width", "case when node_id % 8 > 0 then 20 end as height"))
    return media_checks.mask_rules(e, files)


def q_formats(spark, d):
    date = "concat(r, ':0', r % 10, case when dst % {} = 0 then '-' else ':' end, 'Jan')"
    e = _edges(spark, d).selectExpr(*EDGE, f"map('Create Date', struct(case when dst % 5 = 0 then 'add' else 'change' end as action, {date.format(2)} as old, {date.format(3)} as new), 'Size', struct('change' as action, '1' as old, '22' as new)) as exifdiff")
    return media_checks.format_rules(e)


def q_stamps(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr(
        "o_orderkey", "map('File Date', cast(o_orderdate as string), 'Time', concat('T', o_orderkey % 100), 'Make', 'a') as old",
        "map('File Date', case when o_custkey % 3 = 0 then replace(cast(o_orderdate as string), '-', ':') else '1999-01-02 00:00:00' end, 'Time', concat('Tab', o_custkey % 100), 'Make', '1') as new",
    )
    return o.select("o_orderkey", F.array_join(media_checks.stamp_mismatches(F.col("old"), F.col("new")), ",").alias("keys"))


def q_levels(spark, d):
    f = view(spark, d, "frames").selectExpr("media_id", "pmod(cast(floor(intensity * 10) as bigint), 256) as tone", "frame_no % 2 as side")
    h = f.groupBy("media_id", "tone").agg(F.count_if(F.col("side") == 0).alias("n_src"), F.count_if(F.col("side") == 1).alias("n_dst"))
    return media_checks.levels_rule(h, ["media_id"]).select("media_id", (F.round("correlation", 4) + 0.0).alias("correlation"))  # no negative zero


def q_edge_segments(spark, d):
    e = _edges(spark, d).selectExpr(
        *EDGE, "named_struct('ms', cast(src % 4 * 100 as double), 'frames', src % 7) as start", "case when src % 3 > 0 then named_struct('ms', cast(dst % 2 * 1000 as double), 'frames', 10 + dst % 50) end as stop"
    )
    own = view(spark, d, "segments").where("set_id % 3 = 0").withColumnRenamed("set_id", "dst")
    recorded = e.join(own, "dst").select(*EDGE, "type", "startframe", "endframe")
    media = view(spark, d, "media").where("node_id % 4 > 0").withColumn("type", F.lit("video"))
    n = view(spark, d, "nodes")
    finals = n.join(n.groupBy("project_id").agg(F.max_by("node_id", "r").alias("final_id")), "project_id").select("project_id", "node_id", "final_id")
    return media_checks.edge_segments(e, recorded, media, finals, ["video"])


def q_seeds(spark, d):
    s = view(spark, d, "segments").selectExpr("*", "case seg_no % 3 when 0 then 'cut' when 1 then 'crop' else 'other' end as op", "(startframe - 1) * 1000 / rate as starttime", "endframe - startframe + 1 as frames")
    return segments.seed_segments(s).select("set_id", "seg_no", "op", "startframe", "endframe", F.round("starttime", 4).alias("starttime"), F.round("endtime", 4).alias("endtime"))


def q_snap(spark, d):
    s = view(spark, d, "segments")
    f = s.where("type = 'video'").selectExpr("set_id", "cast(row_number() over (partition by set_id order by startframe, seg_no) as bigint) as frame_no", "startframe * 9.0D as time_ms")
    out = segments.snap_to_frames(s.selectExpr("set_id", "seg_no", "startframe * 7.0D as starttime", "endframe * 7.0D as endtime", "error"), f)
    return out.select("set_id", "seg_no", F.coalesce("startframe", F.lit(-1)).alias("startframe"), F.coalesce("endframe", F.lit(-1)).alias("endframe"), "starttime", "endtime", F.round("error", 4).alias("error"))


def q_turns(spark, d):
    t = scalars.exif_turn(F.col("p_size") % 10)
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.coalesce(t["flip"], F.lit("-")).alias("flip"), t["rotation"].alias("rotation"))


def q_quality(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100) + 1).alias("t"))
    v = v.withColumn("tables", F.slice(F.array("t", F.transform("t", lambda x: x + 5), F.reverse(F.transform("t", lambda x: x * 2))), F.lit(1), F.pmod("vec_id", F.lit(4)).cast("int")))
    z = scalars.unzigzag(F.col("t"))
    return v.select("vec_id", scalars.jpeg_quality(F.col("tables")).alias("quality"), F.array_join(F.transform(z, lambda x: x.cast("string")), ",").alias("cells"))


QUERIES = {
    "size_rules": q_size, "mask_rules": q_masks, "format_rules": q_formats, "stamp_mismatches": q_stamps, "levels_rule": q_levels, "edge_segments": q_edge_segments,
    "seed_segments": q_seeds, "snap_to_frames": q_snap, "exif_turns": q_turns, "jpeg_quality": q_quality,
}

_E = f"{with_views('edges')}, e AS (SELECT * FROM edges WHERE op <> 'Donor')"
_M = 'SELECT project_id, {severity} AS severity, src AS start, dst AS "end", \'{module}\' AS module, {message} AS message FROM {table} WHERE {where}'


def _union(*parts):
    return "\nUNION ALL ".join(_M.format(severity=s, module=m, message=t if t.startswith("concat") else f"'{t}'", table=table, where=w) for s, m, t, table, w in parts)


_STATED = "(coalesce(o LIKE '%90%', false) AND rotated AND sw = dw AND sh = dh AND sw <> sh)"
_DATE = "concat(r, ':0', r % 10, CASE WHEN dst % {} = 0 THEN '-' ELSE ':' END, 'Jan')"
_LOST = "NOT EXISTS (SELECT 1 FROM rec WHERE rec.dst = e.dst)"
_START = "CASE WHEN src % 4 > 0 THEN floor(round(src % 4 * 100.0 * m.rate / 1000, 6))::BIGINT + 1 + src % 7 ELSE greatest(src % 7, 1) END"
_STOP = "CASE WHEN src % 3 > 0 THEN least(CASE WHEN dst % 2 > 0 THEN m.rate::BIGINT + 1 + 10 + dst % 50 ELSE 10 + dst % 50 END, m.frames) ELSE m.frames END"

ORACLES = {
    "size_rules": f"""{_E}, s AS (SELECT project_id, src, dst, op, 200 + src % 5 * 8 AS sw, 200 + src % 3 * 8 AS sh, 200 + dst % 7 * 4 AS dw, 200 + dst % 4 * 8 AS dh,
  dst % 5 = 0 AS rotated, CASE WHEN src % 2 = 0 THEN 'Rotate 90 CW' END AS o, CASE WHEN dst % 9 > 0 THEN 200 + dst % 5 * 8 END AS mw FROM e)
{_union(
    (3, 'crop', 'Crop cannot increase a dimension size of the image', 's', "op = 'TransformCrop' AND (dw > sw OR dh > sh)"),
    (3, 'interpolation', 'none interpolation is not permitted with a decrease in size', 's', 'dst % 6 = 0 AND (dw < sw OR dh < sh)'),
    (3, 'rotation', 'Image was not rotated as stated by the parameter Image Rotated', 's', _STATED),
    (3, 'rotation', 'Image was rotated. Parameter Image Rotated is set to "no"', 's', f'NOT {_STATED} AND NOT rotated AND sign(sw - sh) <> sign(dw - dh)'),
    (2, 'eight', 'JPEG image size is not aligned to 8x8 pixels', 's', 'dst % 2 = 0 AND (sw <> dw OR sh <> dh) AND (dw % 8 > 0 OR dh % 8 > 0)'),
    (3, 'pastemask', 'Pastemask file is missing', 's', "op = 'PasteSplice' AND mw IS NULL"),
    (3, 'pastemask', 'Pastemask image does not match the size of the source image', 's', "op = 'PasteSplice' AND mw <> sw"),
)}""",
    "mask_rules": f"""{_E}, x AS (SELECT *, dst % 11 > 0 AND dst % 7 > 0 AS there, op = 'PasteSampled' AS asked FROM e)
{_union(
    (3, 'Change Mask', 'Link mask is missing. Recompute the link mask.', 'x', "NOT there AND dst % 4 > 0 AND op NOT LIKE '%Audio' AND (src % 3 > 0 OR dst % 5 > 0)"),
    (3, 'Input Mask', "concat('Input mask file i', dst, ' is missing')", 'x', 'asked AND dst % 5 = 0'),
    (3, 'Input Mask', 'input mask name parameter has an invalid size', 'x', 'asked AND there AND dst % 5 > 0 AND dst % 8 > 0 AND dst % 2 <> dst % 3'),
)}""",
    "format_rules": f"""{_E}
{_union((2, 'metadate', f"concat('Meta Data Create Date Date Format Changed: ', {_DATE.format(3)})", 'e', 'dst % 5 > 0 AND (dst % 2 = 0) <> (dst % 3 = 0)'))}""",
    "stamp_mismatches": """SELECT o_orderkey, concat_ws(',', CASE WHEN length(CAST(o_orderdate AS VARCHAR)) <> 19 OR o_custkey % 3 = 0 THEN 'File Date' END,
  CASE WHEN (o_orderkey % 100 < 10) <> (o_custkey % 100 < 10) THEN 'Time' END) AS keys FROM orders""",
    "levels_rule": f"""{with_views('frames')}, f AS (SELECT media_id, ((floor(intensity * 10)::BIGINT % 256) + 256) % 256 AS tone, sum(CASE frame_no % 2 WHEN 0 THEN 1 ELSE -1 END) AS n FROM frames GROUP BY 1, 2),
g AS (SELECT m.media_id, t.tone, coalesce(f.n, 0)::DOUBLE AS n FROM (SELECT DISTINCT media_id FROM f) m CROSS JOIN (SELECT unnest(generate_series(0, 255)) AS tone) t LEFT JOIN f ON f.media_id = m.media_id AND f.tone = t.tone),
p AS (SELECT media_id, n AS x, lead(n) OVER (PARTITION BY media_id ORDER BY tone) AS y FROM g)
SELECT media_id, round(corr(x, y), 4) + 0.0::DOUBLE AS correlation FROM p WHERE y IS NOT NULL GROUP BY 1 HAVING corr(x, y) < 0.9""",
    "edge_segments": f"""{with_views('edges', 'segments', 'media')}, e AS (SELECT * FROM edges WHERE op <> 'Donor'), rec AS (SELECT set_id AS dst, type, startframe, endframe FROM segments WHERE set_id % 3 = 0),
fin AS (SELECT project_id, max_by(node_id, r) AS final_id FROM nodes GROUP BY 1), m AS (SELECT * FROM media WHERE node_id % 4 > 0)
SELECT e.project_id, e.src, e.dst, type, startframe, endframe, 'recorded' AS origin FROM e JOIN rec ON rec.dst = e.dst WHERE type = 'video'
UNION ALL SELECT e.project_id, src, dst, 'video', {_START}, {_STOP}, 'source' FROM e JOIN m ON m.node_id = e.src WHERE {_LOST}
UNION ALL SELECT e.project_id, src, dst, 'video', {_START}, {_STOP}, 'final' FROM e JOIN fin ON fin.project_id = e.project_id JOIN m ON m.node_id = fin.final_id WHERE {_LOST} AND e.src NOT IN (SELECT node_id FROM m)""",
    "seed_segments": f"""{with_views('segments')}, s AS (SELECT *, seg_no % 3 = 0 AS cut, (startframe - 1) * 1000 / rate AS t, endframe - startframe + 1 AS n FROM segments WHERE seg_no % 3 < 2)
SELECT set_id, seg_no, CASE WHEN cut THEN 'cut' ELSE 'crop' END AS op, CASE WHEN cut AND startframe >= 1 THEN startframe - 1 ELSE 1 END AS startframe, CASE WHEN cut THEN startframe ELSE n - 1 END AS endframe,
  round(CASE WHEN cut AND startframe >= 1 THEN t - 1000 / rate ELSE 0 END, 4) AS starttime, round(CASE WHEN cut THEN t ELSE t + 1000 / rate * (n - 1) END, 4) AS endtime FROM s""",
    "snap_to_frames": f"""{with_views('segments')}, f AS (SELECT set_id, row_number() OVER (PARTITION BY set_id ORDER BY startframe, seg_no) AS n, startframe * 9.0::DOUBLE AS t FROM segments WHERE type = 'video'),
h AS (SELECT set_id, seg_no, error, 0 AS e, startframe * 7.0::DOUBLE AS ms FROM segments UNION ALL SELECT set_id, seg_no, error, 1, endframe * 7.0::DOUBLE FROM segments),
g AS (SELECT set_id, t, max(n) AS n FROM f GROUP BY 1, 2),
u AS (SELECT set_id, seg_no, error, e, ms AS t, 1 AS k, NULL::BIGINT AS n, NULL::DOUBLE AS ft FROM h UNION ALL SELECT set_id, NULL, NULL, NULL, t, 0, n, t FROM g),
w AS MATERIALIZED (SELECT *, last_value(n IGNORE NULLS) OVER b AS l, last_value(ft IGNORE NULLS) OVER b AS lt, first_value(ft IGNORE NULLS) OVER (PARTITION BY set_id ORDER BY t, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x
  FROM u WINDOW b AS (PARTITION BY set_id ORDER BY t, k ROWS UNBOUNDED PRECEDING)),
m AS (SELECT set_id, seg_no, error, e, CASE WHEN x IS NULL THEN -1 ELSE coalesce(l, 0) END AS fr, CASE WHEN x IS NULL THEN t ELSE coalesce(lt, 0) END AS tm, x - t AS gap FROM w WHERE k = 1)
SELECT set_id, seg_no, max(fr) FILTER (e = 0) AS startframe, max(fr) FILTER (e = 1) AS endframe, max(tm) FILTER (e = 0) AS starttime, max(tm) FILTER (e = 1) AS endtime,
  round(max(error) + coalesce(max(gap) FILTER (e = 0), max(gap) FILTER (e = 1), 0), 4) AS error FROM m GROUP BY set_id, seg_no""",
    "exif_turns": """SELECT p_partkey, CASE p_size % 10 WHEN 2 THEN 'horizontal' WHEN 7 THEN 'horizontal' WHEN 4 THEN 'vertical' ELSE '-' END AS flip,
  CAST(CASE p_size % 10 WHEN 3 THEN 180 WHEN 6 THEN 90 WHEN 7 THEN 90 WHEN 8 THEN 270 ELSE 0 END AS DOUBLE) AS rotation FROM part""",
    "jpeg_quality": f"""WITH v AS (SELECT vec_id, vec_id % 4 AS k, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 100)::BIGINT + 1) AS t FROM embeddings),
q AS (SELECT vec_id, k, t, 100 - list_sum(t[2:]) // (len(t) - 1) AS a, 100 - (list_sum(t[2:]) + 5 * (len(t) - 1)) // (len(t) - 1) AS b, 100 - 2 * list_sum(t[:-2]) // (len(t) - 1) AS c FROM v)
SELECT vec_id, CAST(CASE k WHEN 0 THEN 100 WHEN 1 THEN a WHEN 2 THEN round(floor((a + 2 * b) / 3) + abs(a - b) * 0.98::DOUBLE) ELSE round(floor((a + b + c) / 3) + abs(a - b) * 0.49::DOUBLE + abs(a - c) * 0.49::DOUBLE) END AS BIGINT) AS quality,
  array_to_string(list_transform({scalars.zigzag_places()}, lambda i: t[i + 1]), ',') AS cells FROM q""",
}
