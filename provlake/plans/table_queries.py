"""Queries and SQL for segments, frames, catalogue work and scalar functions over the journal views."""

from __future__ import annotations

from pyspark.sql import functions as F

from provlake.functions import scalars
from provlake.operators import catalog, frames, segments

from .fixture import view, with_views

SEG = ["set_id", "seg_no", "type", "startframe", "endframe"]


def _segs(spark, d):
    return view(spark, d, "segments")


def _read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


def q_drop(spark, d):
    return segments.drop_frames(_segs(spark, d), view(spark, d, "bounds"), type_="video").select(SEG)


def q_hole(spark, d):
    return segments.drop_frames(_segs(spark, d), view(spark, d, "bounds"), keep_time=True).select(SEG)


def q_insert(spark, d):
    return segments.insert_frames(_segs(spark, d), view(spark, d, "bounds")).select(SEG)


def q_crop(spark, d):
    return segments.crop_frames(_segs(spark, d), view(spark, d, "bounds")).select(SEG)


def q_reverse(spark, d):
    return segments.reverse_segments(_segs(spark, d), view(spark, d, "bounds")).select(SEG)


def q_fold(spark, d):
    b = view(spark, d, "bounds")
    two = b.withColumn("bound_no", F.lit(1)).unionByName(b.select("set_id", (F.col("startframe") + 60).alias("startframe"), (F.col("endframe") + 65).alias("endframe"), F.lit(2).alias("bound_no")))
    return segments.apply_bounds(_segs(spark, d), two).select(SEG)


def q_intersect(spark, d):
    s = _segs(spark, d)
    return segments.intersect_segments(s, s).where("seg_no <> other_no").drop("rate")


def q_subtract(spark, d):
    s = _segs(spark, d)
    return segments.subtract_union(s.where("seg_no % 3 = 1"), s.where("seg_no % 3 <> 1"))


def q_complete(spark, d):
    s = _segs(spark, d).withColumns({"starttime": segments.time_of(F.col("startframe"), F.col("rate")), "endtime": segments.time_of(F.col("endframe"), F.col("rate"))})
    # A row lacks its rate, or else some of its frames.
    s = s.withColumns({"startframe": F.expr("case when seg_no % 5 > 0 and seg_no % 2 = 0 then null else startframe end"), "endframe": F.expr("case when seg_no % 5 > 0 and seg_no % 3 = 0 then null else endframe end"), "rate": F.expr("case when seg_no % 5 > 0 then rate end")})
    return segments.complete_segments(s).select(*SEG, F.round("rate", 4).alias("rate"), F.round("starttime", 4).alias("starttime"), F.round("endtime", 4).alias("endtime"), "frames")


def q_warp(spark, d):
    m = view(spark, d, "media").withColumnRenamed("node_id", "set_id")
    to = m.select("set_id", (F.col("frames") * 2 + F.col("set_id") % 3).alias("frames"), (F.col("rate") * 2).alias("rate"))
    return segments.warp_segments(_segs(spark, d), m, to).select(*SEG, "rate", "error")


def q_span(spark, d):
    return segments.segment_span(_segs(spark, d))


def q_clamp(spark, d):
    return segments.clamp_to_end(_segs(spark, d), view(spark, d, "media").withColumnRenamed("node_id", "set_id")).select(SEG)


def _streams(spark, d):
    m = view(spark, d, "media").withColumnRenamed("node_id", "set_id")
    kinds = F.expr("filter(array(named_struct('type', 'video', 'channel', 1), if(set_id % 2 = 0, named_struct('type', 'audio', 'channel', 1), null), if(set_id % 4 = 0, named_struct('type', 'audio', 'channel', 2), null)), x -> x is not null)")
    return m.select("set_id", F.explode(kinds).alias("k"), "rate", "frames").select("set_id", "k.*", "rate", "frames")


def q_stream(spark, d):
    return segments.entire_stream(_streams(spark, d))


def q_stream_part(spark, d):
    b = view(spark, d, "media").selectExpr("node_id as set_id", "if(node_id % 3 = 0, null, named_struct('ms', cast(node_id % 4 * 500 as double), 'frames', node_id % 9)) as start", "if(node_id % 5 = 0, null, named_struct('ms', 0D, 'frames', 20 + node_id % 80)) as stop")
    return segments.entire_stream(_streams(spark, d), ["audio"], b)


def q_match(spark, d):
    s = _segs(spark, d)
    other = s.where("seg_no % 4 <> 0").withColumn("endframe", F.col("endframe") + F.when(F.col("seg_no") % 3 == 0, 5).otherwise(0))
    return segments.match_segments(s, other, 1)


def q_audio_op(spark, d):
    b = view(spark, d, "bounds").withColumn("op", F.get(F.array(*map(F.lit, ("DropAudio", "DeleteAudio", "InsertAudio", "AddAudio"))), F.pmod("set_id", F.lit(4)).cast("int")))
    return segments.apply_audio_op(_segs(spark, d), b).select(SEG)


def q_asof(spark, d):
    s = _segs(spark, d).where("type = 'audio'").select("set_id", "seg_no", (F.col("startframe") * 7.0).alias("ms"))
    f = _segs(spark, d).where("type = 'video'").select("set_id", F.col("seg_no").alias("frame_no"), (F.col("startframe") * 9.0).alias("time_ms"))
    return segments.audio_to_video(s, f).select("set_id", "seg_no", F.coalesce("frame_no", F.lit(-1)).alias("frame_no"))


def q_positions(spark, d):
    p = _segs(spark, d).select("set_id", F.col("seg_no").alias("pos_no"), (F.col("startframe") * 100.0).alias("ms"), (F.col("endframe") - F.col("startframe") + 1).cast("double").alias("n")).withColumn("duration_ms", F.col("n") * 100)
    return segments.position_segments(p, 6000.0, 20000.0, 30.0).select("set_id", "pos_no", F.round("begin_ms", 4).alias("begin_ms"), F.round("end_ms", 4).alias("end_ms"))


def q_changes(spark, d):
    return frames.change_ranges(view(spark, d, "frames"))


def _samples(spark, d):
    return view(spark, d, "frames").select("media_id", F.col("frame_no").alias("sample_no"), F.floor(F.col("intensity") * 100).cast("long").alias("value"))


def q_silence(spark, d):
    return frames.silences(_samples(spark, d), 2, 5000)


def q_silence_pairs(spark, d):
    return frames.silence_pairs(frames.silences(_samples(spark, d), 2, 5000), 5, 30)


def q_audio_changes(spark, d):
    s = _samples(spark, d)
    other = s.withColumn("value", F.col("value") + F.when(F.col("sample_no") % 9 < 3, 5).otherwise(0))
    return frames.audio_changes(s, other, 4, 3, 5)


def q_average(spark, d):
    return frames.moving_average(_samples(spark, d), 8).select("media_id", "sample_no", F.round("mean", 4).alias("mean"))


def q_equalize(spark, d):
    h = _samples(spark, d).groupBy("media_id", F.pmod("value", F.lit(256)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return frames.equalize(h)


def q_otsu(spark, d):
    h = _samples(spark, d).groupBy("media_id", F.pmod("value", F.lit(256)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return frames.otsu(h)


def q_time_bounds(spark, d):
    f = view(spark, d, "frames").withColumn("time_ms", (F.col("frame_no") * 40).cast("double"))
    return frames.time_bounds(f, 200.0, 2, 900.0, 4).select("media_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("startframe", "endframe")])


def _vectors(spark, d):
    v = _read(spark, d, "embeddings").select(F.col("label").cast("long").alias("media_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("gray"))
    return v.withColumn("frame_no", F.expr("cast(row_number() over (partition by media_id order by vec_id) as bigint)"))


def q_dup_frames(spark, d):
    v = _vectors(spark, d).withColumn("gray", F.transform("gray", lambda x: x * 10))
    return frames.drop_duplicate_frames(v, 13).select("media_id", "frame_no", "vec_id")


def q_neighbours(spark, d):
    return frames.neighbour_diffs(_vectors(spark, d), 30)


def q_pairs(spark, d):
    return frames.best_frame_pairs(_vectors(spark, d), 3, 2, 50, 64)


def q_pick(spark, d):
    f = _read(spark, d, "documents").select(F.col("source").alias("dir"), F.concat("source", F.lit("/"), "doc_id").alias("path"), F.col("n_chars").alias("length"))
    return catalog.pick_projects(f)


def q_merge(spark, d):
    p = _read(spark, d, "documents").select(F.col("doc_id").alias("node_id"), F.md5(F.col("text").cast("binary")).alias("md5"))
    a, b = p.where("node_id % 2 = 0"), p.where("node_id % 2 = 1")
    link = lambda x: x.select(F.col("node_id").alias("src"), (F.col("node_id") + 2).alias("dst"), F.lit("Blur").alias("op")).join(x.select(F.col("node_id").alias("dst")), "dst", "left_semi").select("src", "dst", "op")
    return catalog.merge_journals(a, link(a), b, link(b))[1]


def q_merge_groups(spark, d):
    j = _read(spark, d, "customer").select(F.col("c_custkey").alias("project_id"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("stem"))
    return catalog.merge_groups(j, "stem").select("stem", "n", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


def q_pick_paired(spark, d):
    p = _read(spark, d, "part").select(F.concat("p_name", F.lit("-"), "p_partkey").alias("file"), "p_name", "p_partkey")
    pairs = p.groupBy(F.substring("p_name", F.lit(1), F.pmod("p_partkey", F.lit(6)).cast("int") + 1).alias("prefix")).agg(F.max("p_partkey").alias("pos"))
    return catalog.pick_paired(p.select("file"), pairs.withColumn("to", F.concat_ws(":", "prefix", "pos")))


def q_new_media(spark, d):
    n = view(spark, d, "nodes")
    return catalog.new_media(n.select(F.concat(F.lit("a/b/"), "file").alias("file")), n.where("node_id % 3 = 0").select(F.col("file").alias("OriginalImageName")))


def q_file_index(spark, d):
    r = _read(spark, d, "lineitem").select(F.concat(F.lit("f"), "l_partkey").alias("file"), F.col("l_orderkey").alias("owner"))
    return catalog.file_index(r).select("file", "n", F.array_join(F.transform("owners", lambda x: x.cast("string")), ",").alias("owners"))


def q_orphans(spark, d):
    r = _read(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("file"))
    return catalog.orphans(_read(spark, d, "part").select(F.col("p_partkey").alias("file")), r)


def q_device(spark, d):
    p = _read(spark, d, "part").select(F.col("p_partkey").alias("file"), F.pmod("p_partkey", F.lit(7)).alias("device"), F.col("p_brand").alias("make"), F.col("p_type").alias("model"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("serial"), F.lit("image").alias("type"))
    return catalog.device_checks(p, p.where("file % 2 = 0")).select("file", "device")


def q_sets(spark, d):
    p = _read(spark, d, "part").select(F.col("p_brand").alias("collection"), F.col("p_type").alias("device"), F.col("p_size").alias("width"), F.lit(1).alias("height"))
    return catalog.hp_sets(p)


def q_names(spark, d):
    return catalog.sheet_names(_read(spark, d, "supplier").select(F.col("s_name").alias("file")), "20200101", "org", "usr")


def q_best_name(spark, d):
    users = _read(spark, d, "customer").select(F.lower(F.col("c_mktsegment")).alias("username")).unionByName(_read(spark, d, "nation").select(F.col("n_name").alias("username")))
    names = _read(spark, d, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("name"))
    return catalog.best_name(users, names)


def q_removed(spark, d):
    f = _read(spark, d, "documents").select(F.length("source").alias("project_id"), F.col("doc_id").alias("node_id"), F.md5(F.col("text").cast("binary")).alias("hash"))
    return catalog.remove_duplicates(f)


def q_software(spark, d):
    n = view(spark, d, "nodes").withColumn("softwareName", F.when(F.col("node_id") % 3 == 0, "").otherwise(F.concat(F.lit("s"), F.pmod("node_id", F.lit(4)))))
    e = view(spark, d, "edges").join(n.select("project_id", F.col("node_id").alias("dst"), "softwareName"), ["project_id", "dst"])
    return catalog.fill_software(e).select("project_id", "src", "dst", F.coalesce("softwareName", F.lit("-")).alias("softwareName"))


def q_map_diff(spark, d):
    e = view(spark, d, "frames").withColumn("m", F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("t"), F.col("event_type")))
    e = e.withColumn("_o", F.expr("lag(m) over (partition by media_id order by frame_no)")).where("_o is not null")
    out = e.select("media_id", "frame_no", F.explode(scalars.map_diff(F.col("_o"), F.col("m"))).alias("key", "v"))
    return out.select("media_id", "frame_no", "key", "v.action", "v.old", "v.new")


def q_file_types(spark, d):
    n = view(spark, d, "nodes")
    return n.groupBy(scalars.file_type(F.col("file")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def q_times(spark, d):
    o = _read(spark, d, "orders").select("o_orderkey", F.format_string("%02d:%02d:%02d.%03d", F.pmod("o_orderkey", F.lit(5)), F.pmod("o_orderkey", F.lit(60)), F.pmod("o_custkey", F.lit(60)), F.pmod("o_orderkey", F.lit(1000))).alias("t"))
    o = o.withColumn("_p", scalars.time_to_ms(F.col("t"))).select("o_orderkey", "t", F.col("_p.ms").alias("ms"), F.col("_p.frames").alias("frames"))
    return o.withColumn("text", scalars.ms_to_time(F.col("ms")))


_S = with_views("segments", "bounds")


def _split(left: str, right: str, cond: str = "true") -> str:
    return f"""{_S}, j AS (SELECT s.*, b.startframe AS b, b.endframe AS e, b.endframe - b.startframe + 1 AS n FROM segments s LEFT JOIN bounds b ON b.set_id = s.set_id AND {cond}),
p AS (SELECT set_id, seg_no, type, unnest(CASE WHEN b IS NULL THEN [{{'s': startframe, 'e': endframe}}] ELSE [{left}, {right}] END) AS p FROM j)
SELECT set_id, seg_no, type, p.s AS startframe, p.e AS endframe FROM p WHERE p.s <= p.e"""


_SAMPLES = f"{with_views('frames')}, samples AS (SELECT media_id, frame_no AS sample_no, CAST(floor(intensity * 100) AS BIGINT) AS value FROM frames)"
_HIST = f"{_SAMPLES}, h AS (SELECT media_id, value % 256 AS value, count(*) AS n FROM samples GROUP BY 1, 2)"
_QUIET = f"""{_SAMPLES}, q AS (SELECT *, max(abs(value)) OVER (PARTITION BY media_id ORDER BY sample_no ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS m,
  count(*) OVER (PARTITION BY media_id ORDER BY sample_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l FROM samples),
k AS (SELECT *, CASE WHEN sample_no - lag(sample_no) OVER (PARTITION BY media_id ORDER BY sample_no) <= 2 THEN 0 ELSE 1 END AS nw FROM q WHERE m <= 5000 AND l >= 2),
r AS (SELECT *, sum(nw) OVER (PARTITION BY media_id ORDER BY sample_no ROWS UNBOUNDED PRECEDING) AS run FROM k),
sil AS (SELECT media_id, min(sample_no) AS start, max(sample_no) + 1 AS stop, count(*) AS n FROM r GROUP BY media_id, run)"""
_VEC = "v AS (SELECT CAST(label AS BIGINT) AS media_id, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS gray, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS frame_no FROM embeddings)"
_STD = "sqrt(list_avg(list_transform(list_zip({a}, {b}), lambda z: pow(z[1] - z[2] - (list_avg({a}) - list_avg({b})), 2))))"
_DOCS = "p AS (SELECT doc_id AS node_id, md5(text) AS md5 FROM documents)"

QUERIES = {
    "drop_frames": q_drop, "punch_frames": q_hole, "insert_frames": q_insert, "crop_frames": q_crop, "reverse_segments": q_reverse, "drop_two_bounds": q_fold,
    "intersect_segments": q_intersect, "subtract_union": q_subtract, "complete_segments": q_complete, "warp_segments": q_warp, "segment_span": q_span,
    "clamp_segments": q_clamp, "entire_stream": q_stream, "bounded_streams": q_stream_part, "match_segments": q_match, "audio_ops": q_audio_op, "asof_audio_video": q_asof, "position_segments": q_positions,
    "change_ranges": q_changes, "silences": q_silence, "silence_pairs": q_silence_pairs, "audio_changes": q_audio_changes, "moving_average": q_average, "equalize": q_equalize,
    "otsu": q_otsu, "time_bounds": q_time_bounds, "duplicate_frames": q_dup_frames, "neighbour_diffs": q_neighbours, "best_frame_pairs": q_pairs,
    "pick_projects": q_pick, "merge_journals": q_merge, "merge_groups": q_merge_groups, "pick_paired": q_pick_paired, "new_media": q_new_media, "file_index": q_file_index,
    "orphan_files": q_orphans, "device_checks": q_device, "hp_sets": q_sets, "sheet_names": q_names, "best_name": q_best_name, "remove_duplicates": q_removed,
    "fill_software": q_software, "map_diff": q_map_diff, "file_types": q_file_types, "time_strings": q_times,
}

ORACLES = {
    "drop_frames": _split("{'s': startframe, 'e': least(endframe, b - 1)}", "{'s': greatest(startframe, e + 1) - n, 'e': endframe - n}", "s.type = 'video'"),
    "punch_frames": _split("{'s': startframe, 'e': least(endframe, b - 1)}", "{'s': greatest(startframe, e + 1), 'e': endframe}"),
    "insert_frames": _split("{'s': startframe, 'e': least(endframe, b - 1)}", "{'s': greatest(startframe, b) + n, 'e': endframe + n}"),
    "crop_frames": _split("{'s': greatest(startframe, b) - b + 1, 'e': least(endframe, e) - b + 1}", "{'s': CAST(1 AS BIGINT), 'e': CAST(0 AS BIGINT)}"),
    "reverse_segments": _split(
        "{'s': startframe, 'e': least(endframe, b - 1)}, {'s': greatest(startframe, e + 1), 'e': endframe}",
        "CASE WHEN greatest(startframe, b) <= least(endframe, e) THEN {'s': b + e - least(endframe, e), 'e': b + e - greatest(startframe, b)} ELSE {'s': CAST(1 AS BIGINT), 'e': CAST(0 AS BIGINT)} END",
    ),
    "drop_two_bounds": f"""{_S}, j AS (SELECT s.*, b.startframe AS b, b.endframe AS e, b.endframe - b.startframe + 1 AS n FROM segments s LEFT JOIN bounds b ON b.set_id = s.set_id),
p1 AS (SELECT set_id, seg_no, type, b + 60 AS b, e + 65 AS e, n + 5 AS n, unnest(CASE WHEN b IS NULL THEN [{{'s': startframe, 'e': endframe}}] ELSE [{{'s': startframe, 'e': least(endframe, b - 1)}}, {{'s': greatest(startframe, e + 1) - n, 'e': endframe - n}}] END) AS p FROM j),
p2 AS (SELECT set_id, seg_no, type, unnest(CASE WHEN b IS NULL THEN [p] ELSE [{{'s': p.s, 'e': least(p.e, b - 1)}}, {{'s': greatest(p.s, e + 1) - n, 'e': p.e - n}}] END) AS q FROM p1 WHERE p.s <= p.e)
SELECT set_id, seg_no, type, q.s AS startframe, q.e AS endframe FROM p2 WHERE q.s <= q.e""",
    "intersect_segments": f"""{_S} SELECT a.set_id, a.type, a.seg_no, b.seg_no AS other_no, greatest(a.startframe, b.startframe) AS startframe, least(a.endframe, b.endframe) AS endframe
FROM segments a JOIN segments b ON a.set_id = b.set_id AND a.type = b.type AND a.startframe <= b.endframe AND b.startframe <= a.endframe WHERE a.seg_no <> b.seg_no""",
    "subtract_union": f"""{_S.replace('WITH ', 'WITH RECURSIVE ', 1)}, a AS (SELECT set_id, type, startframe AS x, endframe AS y, row_number() OVER (PARTITION BY set_id, type ORDER BY startframe, endframe) AS k FROM segments WHERE seg_no % 3 = 1),
f AS (SELECT set_id, type, startframe AS s, endframe AS e, 0::BIGINT AS k FROM segments WHERE seg_no % 3 <> 1
  UNION ALL SELECT set_id, type, p.s, p.e, k FROM (SELECT f.set_id, f.type, a.k, unnest(CASE WHEN f.e < x OR f.s > y THEN [{{'s': f.s, 'e': f.e}}] WHEN f.s >= x THEN []::STRUCT(s BIGINT, e BIGINT)[]
    ELSE [{{'s': f.s, 'e': x - 1}}, {{'s': y + 1, 'e': f.e}}] END) AS p FROM f JOIN a ON a.set_id = f.set_id AND a.type = f.type AND a.k = f.k + 1) q WHERE p.s <= p.e),
n AS (SELECT set_id, type, count(*) AS n FROM a GROUP BY 1, 2)
SELECT set_id, type, x AS startframe, y AS endframe FROM a UNION ALL SELECT f.set_id, f.type, s, e FROM f LEFT JOIN n ON n.set_id = f.set_id AND n.type = f.type WHERE f.k = coalesce(n, 0)""",
    "complete_segments": f"""{_S} SELECT set_id, seg_no, type, startframe, endframe, round(CASE WHEN seg_no % 5 > 0 THEN rate WHEN endframe > startframe THEN 30 END, 4)::DOUBLE AS rate,
  round((startframe - 1) * 1000 / rate, 4) AS starttime, round((endframe - 1) * 1000 / rate, 4) AS endtime, endframe - startframe + 1 AS frames FROM segments""",
    "warp_segments": f"""{with_views('segments', 'media')}, j AS (SELECT s.*, m.frames AS f0, m.rate AS r0, m.frames * 2 + m.node_id % 3 AS f1, m.rate * 2 AS r1, (s.startframe - 1) * (CAST(m.frames * 2 + m.node_id % 3 AS DOUBLE) / m.frames) + 1 AS ex
  FROM segments s JOIN media m ON m.node_id = s.set_id),
k AS (SELECT *, CAST(least(greatest(round(ex), 1), f1) AS BIGINT) AS ns FROM j)
SELECT set_id, seg_no, type, ns AS startframe, CAST(least(greatest(round(endframe * (CAST(f1 AS DOUBLE) / f0)), ns), f1) AS BIGINT) AS endframe, r1 AS rate, (floor(error * 1e6 + 0.5::DOUBLE) + floor(abs(ex - round(ex)) * 1e9 / r1 + 0.5::DOUBLE)) / 1e6 AS error FROM k""",
    "segment_span": f"{_S} SELECT set_id, max(endframe) AS last_frame, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM segments GROUP BY 1",
    "clamp_segments": f"{with_views('segments', 'media')} SELECT s.set_id, s.seg_no, s.type, s.startframe, coalesce(least(s.endframe, m.frames), s.endframe) AS endframe FROM segments s LEFT JOIN media m ON m.node_id = s.set_id WHERE m.frames IS NULL OR s.startframe <= m.frames",
    "entire_stream": f"""{with_views('media')}, k AS (SELECT * FROM (VALUES ('video', 1), ('audio', 1), ('audio', 2)) t(type, channel)), x AS (SELECT m.*, k.* FROM media m JOIN k ON type = 'video' OR node_id % (2 * channel) = 0)
SELECT node_id AS set_id, row_number() OVER (PARTITION BY node_id ORDER BY type, channel) AS seg_no, type, channel, rate, CAST(1 AS BIGINT) AS startframe, frames AS endframe, CAST(0 AS DOUBLE) AS starttime, round((frames - 1) * 1000 / rate, 6) AS endtime FROM x""",
    "bounded_streams": f"""{with_views('media')}, k AS (SELECT * FROM (VALUES (1), (2)) t(channel)), x AS (SELECT m.*, k.*, CASE WHEN node_id % 3 = 0 THEN 1 WHEN node_id % 4 > 0 THEN floor(round(node_id % 4 * 500 * rate / 1000, 6))::BIGINT + 1 + node_id % 9 ELSE greatest(node_id % 9, 1) END AS s,
  CASE WHEN node_id % 5 = 0 THEN frames ELSE least(frames, 20 + node_id % 80) END AS e FROM media m JOIN k ON node_id % (2 * channel) = 0)
SELECT node_id AS set_id, channel::BIGINT AS seg_no, 'audio' AS type, channel, rate, s AS startframe, e AS endframe, round((s - 1) * 1000 / rate, 6) AS starttime, round((e - 1) * 1000 / rate, 6) AS endtime FROM x WHERE s <= e""",
    "match_segments": f"""{_S}, x AS (SELECT set_id, type, startframe, max(endframe) AS e FROM segments GROUP BY 1, 2, 3),
y AS (SELECT set_id, type, startframe, max(endframe + CASE WHEN seg_no % 3 = 0 THEN 5 ELSE 0 END) AS e FROM segments WHERE seg_no % 4 <> 0 GROUP BY 1, 2, 3)
SELECT coalesce(x.set_id, y.set_id) AS set_id, coalesce(x.type, y.type) AS type, coalesce(x.startframe, y.startframe) AS startframe,
CASE WHEN y.e IS NULL THEN 'missing' WHEN x.e IS NULL THEN 'unexpected' WHEN abs(x.e - y.e) > 1 THEN 'differs' ELSE 'matched' END AS status
FROM x FULL JOIN y ON x.set_id = y.set_id AND x.type = y.type AND x.startframe = y.startframe""",
    "audio_ops": f"""{_S}, j AS (SELECT s.*, s.set_id % 4 AS op, CASE WHEN s.type = 'audio' THEN b.startframe END AS b, b.endframe AS e, b.endframe - b.startframe + 1 AS n FROM segments s LEFT JOIN bounds b ON b.set_id = s.set_id),
p AS (SELECT set_id, seg_no, type, unnest(CASE WHEN b IS NULL THEN [{{'s': startframe, 'e': endframe}}] WHEN op = 0 THEN []::STRUCT(s BIGINT, e BIGINT)[]
 WHEN op = 1 THEN [{{'s': startframe, 'e': least(endframe, b - 1)}}, {{'s': greatest(startframe, e + 1) - n, 'e': endframe - n}}]
 WHEN op = 2 THEN [{{'s': startframe, 'e': least(endframe, b - 1)}}, {{'s': greatest(startframe, b) + n, 'e': endframe + n}}]
 ELSE [{{'s': startframe, 'e': least(endframe, b - 1)}}, {{'s': greatest(startframe, e + 1), 'e': endframe}}] END) AS p FROM j)
SELECT set_id, seg_no, type, p.s AS startframe, p.e AS endframe FROM p WHERE p.s <= p.e""",
    "asof_audio_video": f"""{_S}, f AS (SELECT set_id, seg_no AS frame_no, startframe * 9.0 AS t FROM segments WHERE type = 'video')
SELECT s.set_id, s.seg_no, coalesce((SELECT arg_min(f.frame_no, ROW(f.t, f.frame_no)) FROM f WHERE f.set_id = s.set_id AND f.t >= s.startframe * 7.0), -1) AS frame_no FROM segments s WHERE s.type = 'audio'""",
    "position_segments": f"""{_S}, p AS (SELECT set_id, seg_no AS pos_no, startframe * 100.0::DOUBLE AS ms, (endframe - startframe + 1) * 100.0::DOUBLE AS dur,
  lead(startframe * 100.0::DOUBLE) OVER (PARTITION BY set_id ORDER BY startframe, seg_no) AS nx FROM segments),
q AS (SELECT set_id, pos_no, greatest(ms, 6000.0) AS b, least(ms + dur, coalesce(nx - 1000.0::DOUBLE / 30, 20000.0), 20000.0) AS e FROM p)
SELECT set_id, pos_no, CAST(round(b, 4) AS DOUBLE) AS begin_ms, CAST(round(e, 4) AS DOUBLE) AS end_ms FROM q WHERE b <= e""",
    "change_ranges": f"""{with_views('frames')}, c AS (SELECT media_id, frame_no, frame_no - row_number() OVER (PARTITION BY media_id ORDER BY frame_no) AS g FROM frames WHERE changed)
SELECT media_id, min(frame_no) AS startframe, max(frame_no) AS endframe, count(*) AS frames FROM c GROUP BY media_id, g""",
    "silences": f"{_QUIET} SELECT * FROM sil",
    "silence_pairs": f"{_QUIET} SELECT a.media_id, a.start AS start_a, a.stop AS stop_a, b.start AS start_b, b.stop AS stop_b FROM sil a JOIN sil b ON a.media_id = b.media_id AND b.start > a.stop AND b.stop - a.start BETWEEN 5 AND 30",
    "audio_changes": f"""{_SAMPLES}, d AS (SELECT media_id, sample_no, avg(CASE WHEN sample_no % 9 < 3 THEN 5 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY sample_no ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS a FROM samples),
k AS (SELECT *, CASE WHEN sample_no - lag(sample_no) OVER (PARTITION BY media_id ORDER BY sample_no) <= 5 THEN 0 ELSE 1 END AS nw FROM d WHERE a > 3),
r AS (SELECT *, sum(nw) OVER (PARTITION BY media_id ORDER BY sample_no ROWS UNBOUNDED PRECEDING) AS run FROM k)
SELECT media_id, min(sample_no) AS start, max(sample_no) AS stop, count(*) AS n FROM r GROUP BY media_id, run""",
    "moving_average": f"{_SAMPLES} SELECT media_id, sample_no, round(avg(value) OVER (PARTITION BY media_id ORDER BY sample_no ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 4) AS mean FROM samples",
    "equalize": f"{_HIST} SELECT media_id, value, CAST(floor(sum(n) OVER (PARTITION BY media_id ORDER BY value) * 255 / sum(n) OVER (PARTITION BY media_id)) AS BIGINT) AS equalized FROM h",
    "otsu": f"""{_HIST}, w AS (SELECT media_id, value, CAST(sum(n) OVER o AS DOUBLE) AS w0, CAST(sum(n * value) OVER o AS DOUBLE) AS s0, CAST(sum(n) OVER p AS DOUBLE) AS w, CAST(sum(n * value) OVER p AS DOUBLE) AS s
  FROM h WINDOW o AS (PARTITION BY media_id ORDER BY value), p AS (PARTITION BY media_id)),
b AS (SELECT media_id, value, round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)), 4) AS v FROM w WHERE w > w0)
SELECT media_id, arg_min(value, ROW(-v, value)) AS threshold FROM b GROUP BY 1""",
    "time_bounds": f"""{with_views('frames')}, a AS (SELECT media_id, frame_no, sum(CASE WHEN frame_no * 40 > 200 THEN 1 ELSE 0 END) OVER w AS a, sum(CASE WHEN frame_no * 40 > 900 THEN 1 ELSE 0 END) OVER w AS z FROM frames WINDOW w AS (PARTITION BY media_id ORDER BY frame_no ROWS UNBOUNDED PRECEDING))
SELECT media_id, coalesce(min(frame_no) FILTER (WHERE a >= 2), -1) AS startframe, coalesce(min(frame_no) FILTER (WHERE z >= 4), -1) AS endframe FROM a GROUP BY 1""",
    "duplicate_frames": f"""WITH {_VEC}, l AS (SELECT media_id, frame_no, vec_id, list_transform(gray, lambda x: x * 10) AS g, lag(list_transform(gray, lambda x: x * 10)) OVER (PARTITION BY media_id ORDER BY frame_no) AS p FROM v)
SELECT media_id, frame_no, vec_id FROM l WHERE p IS NULL OR round({_STD.format(a='g', b='p')}) > 13""",
    "neighbour_diffs": f"""WITH {_VEC}, l AS (SELECT media_id, gray AS g, lag(gray) OVER (PARTITION BY media_id ORDER BY frame_no) AS p FROM v WHERE frame_no <= 30), s AS (SELECT media_id, {_STD.format(a='g', b='p')} AS d FROM l WHERE p IS NOT NULL)
SELECT media_id, round(avg(d), 4) AS mean, round(stddev_pop(d), 4) AS std FROM s GROUP BY 1""",
    "best_frame_pairs": f"""WITH {_VEC}, s AS (SELECT a.media_id, a.frame_no AS frame_a, b.frame_no AS frame_b, CAST(floor({_STD.format(a='a.gray', b='b.gray')} * 1000) AS BIGINT) AS score
  FROM v a JOIN v b ON a.media_id = b.media_id AND b.frame_no - a.frame_no >= 3 WHERE a.frame_no > 2)
SELECT media_id, frame_a, frame_b, score FROM s QUALIFY row_number() OVER (PARTITION BY media_id ORDER BY score, frame_a, frame_b) <= 50""",
    "pick_projects": "SELECT source AS dir, arg_min(concat(source, '/', doc_id), ROW(-n_chars, concat(source, '/', doc_id))) AS path, max(n_chars) AS length FROM documents GROUP BY 1",
    "merge_journals": f"""WITH {_DOCS}, a AS (SELECT * FROM p WHERE node_id % 2 = 0), b AS (SELECT * FROM p WHERE node_id % 2 = 1),
ea AS (SELECT node_id AS src, node_id + 2 AS dst FROM a WHERE node_id + 2 IN (SELECT node_id FROM a)), eb AS (SELECT node_id AS src, node_id + 2 AS dst FROM b WHERE node_id + 2 IN (SELECT node_id FROM b)),
k AS (SELECT md5, min(node_id) AS x FROM a GROUP BY 1), m AS (SELECT b.node_id, coalesce(k.x, b.node_id) AS id FROM b LEFT JOIN k ON k.md5 = b.md5),
f AS (SELECT DISTINCT s.id AS src, d.id AS dst FROM eb JOIN m s ON s.node_id = eb.src JOIN m d ON d.node_id = eb.dst)
SELECT src, dst, 'Blur' AS op FROM ea UNION ALL SELECT src, dst, 'Blur' FROM f WHERE NOT EXISTS (SELECT 1 FROM ea WHERE ea.src = f.src AND ea.dst = f.dst)""",
    "merge_groups": "SELECT concat(c_mktsegment, '-', c_nationkey) AS stem, count(*) AS n, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS members FROM customer GROUP BY 1 HAVING count(*) > 1",
    "pick_paired": """WITH p AS (SELECT concat(p_name, '-', p_partkey) AS file, substring(p_name, 1, p_partkey % 6 + 1) AS prefix, p_partkey FROM part), q AS (SELECT prefix, max(p_partkey) AS pos FROM p GROUP BY 1)
SELECT p.file, arg_min(concat(q.prefix, ':', q.pos), q.pos) AS "to" FROM p JOIN q ON starts_with(p.file, q.prefix) GROUP BY 1""",
    "new_media": f"{with_views('nodes')} SELECT concat('a/b/', file) AS file FROM nodes WHERE node_id % 3 <> 0",
    "file_index": "SELECT concat('f', l_partkey) AS file, count(DISTINCT l_orderkey) AS n, array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS owners FROM lineitem GROUP BY 1",
    "orphan_files": "SELECT p_partkey AS file FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "device_checks": """WITH p AS (SELECT p_partkey AS file, p_partkey % 7 AS device, p_brand AS make, p_type AS model, CASE WHEN p_size > 10 THEN p_size END AS serial FROM part)
SELECT a.file, a.device FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.file % 2 = 0 AND b.device = a.device AND b.make = a.make AND b.model = a.model AND b.serial IS NOT DISTINCT FROM a.serial)""",
    "hp_sets": "SELECT p_brand AS collection, count(DISTINCT p_type) AS n_devices, count(DISTINCT p_size) AS n_resolutions FROM part GROUP BY 1",
    "sheet_names": "SELECT s_name AS file, concat('20200101-org-usr-', lpad(CAST(row_number() OVER (ORDER BY s_name) AS VARCHAR), 5, '0')) AS new_name FROM supplier",
    "best_name": """WITH u AS (SELECT lower(c_mktsegment) AS username FROM customer UNION SELECT n_name FROM nation), l AS (SELECT username FROM u WHERE username NOT IN (SELECT r_name FROM region))
SELECT username, arg_min(r_name, ROW(levenshtein(lower(username), lower(r_name)), r_regionkey)) AS best FROM l CROSS JOIN region GROUP BY 1""",
    "remove_duplicates": "SELECT CAST(length(source) AS INT) AS project_id, doc_id AS node_id, md5(text) AS hash FROM documents QUALIFY row_number() OVER (PARTITION BY length(source), md5(text) ORDER BY doc_id) > 1",
    "fill_software": f"""{with_views('edges')}, e AS (SELECT project_id, src, dst, op, CASE WHEN dst % 3 = 0 THEN '' ELSE concat('s', dst % 4) END AS s FROM edges),
t AS (SELECT project_id, arg_min(s, ROW(-c, s)) AS top FROM (SELECT project_id, s, count(*) AS c FROM e WHERE s <> '' GROUP BY 1, 2) GROUP BY 1)
SELECT e.project_id, e.src, e.dst, coalesce(CASE WHEN e.s <> '' OR e.op = 'Donor' THEN e.s ELSE t.top END, '-') AS "softwareName" FROM e LEFT JOIN t ON t.project_id = e.project_id""",
    "map_diff": f"""{with_views('frames')}, l AS (SELECT media_id, frame_no, json_extract_string(props, '$.k') AS k, event_type AS t, lag(json_extract_string(props, '$.k')) OVER w AS k0, lag(event_type) OVER w AS t0, lag(1) OVER w AS o
  FROM frames WINDOW w AS (PARTITION BY media_id ORDER BY frame_no)),
u AS (SELECT media_id, frame_no, 'k' AS key, k0 AS old, k AS new FROM l WHERE o = 1 UNION ALL SELECT media_id, frame_no, 't', t0, t FROM l WHERE o = 1)
SELECT media_id, frame_no, key, CASE WHEN old IS NULL THEN 'add' WHEN new IS NULL THEN 'delete' ELSE 'change' END AS action, old, new FROM u WHERE old IS DISTINCT FROM new""",
    "file_types": f"{with_views('nodes')} SELECT CASE WHEN file LIKE '%.png' OR file LIKE '%.jpg' THEN 'image' WHEN file LIKE '%.wav' THEN 'audio' ELSE 'video' END AS type, count(*) AS n FROM nodes GROUP BY 1",
    "time_strings": """WITH t AS (SELECT o_orderkey, format('{:02d}:{:02d}:{:02d}.{:03d}', o_orderkey % 5, o_orderkey % 60, o_custkey % 60, o_orderkey % 1000) AS t,
  CAST(o_orderkey % 5 * 360000 + o_orderkey % 60 * 60000 + o_custkey % 60 * 1000 + o_orderkey % 1000 AS BIGINT) AS ms FROM orders)
SELECT o_orderkey, t, CAST(ms AS DOUBLE) AS ms, CAST(CASE WHEN ms = 0 THEN 1 ELSE 0 END AS BIGINT) AS frames,
  format('{:02d}:{:02d}:{:02d}.{:06d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000 * 1000) AS text FROM t""",
}
