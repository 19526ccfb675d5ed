"""Queries and SQL for pictures: the given vectors as images of 8 by 8 bytes."""

from __future__ import annotations

from pyspark.sql import functions as F

from provlake.operators import donor_masks, frames, probes

from .fixture import view, with_views
from .lineage_queries import q_probe_summary


def _images(spark, d):
    """(media_id, frame_no, g: 64 whole numbers below 256, pixels)."""
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").cast("long").alias("media_id"), F.col("vec_id").cast("long").alias("frame_no"), F.transform("embedding", lambda x: F.pmod(F.floor(F.abs(x.cast("double")) * 100), F.lit(256))).alias("g"))
    return v.withColumn("pixels", _bytes("g"))


def _bytes(numbers):
    return F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


def _hex(column):
    return F.hex(column)


def _pairs(spark, d):
    i = _images(spark, d)
    nxt = i.select((F.col("frame_no") - 1).alias("frame_no"), F.col("g").alias("h"))
    return i.join(nxt, "frame_no")


def q_diff_mask(spark, d):
    p = _pairs(spark, d).select("frame_no", F.col("pixels").alias("a"), _bytes("h").alias("b"))
    out = frames.diff_mask(p, 0.25).withColumn("s", frames.change_stats(F.col("changed") * 200, F.lit(64 * 200)))
    return out.select("frame_no", _hex("mask").alias("mask"), "changed", F.coalesce(F.round("psnr", 4), F.lit(-1.0)).alias("psnr"), F.round("local_psnr", 4).alias("local_psnr"), "s.ratio", "s.category", "s.is_global")


def q_histograms(spark, d):
    h = frames.histograms(_images(spark, d))
    return h.groupBy("media_id", "value").agg(F.sum("n").alias("n"), F.count_distinct("frame_no").alias("frames"))


def q_first_minimum(spark, d):
    h = frames.histograms(_images(spark, d)).groupBy("media_id", "value").agg(F.sum("n").alias("n"))
    return frames.first_minimum(h, least=4, most=90, gain=1).select("media_id", F.col("threshold").cast("long").alias("threshold"))


def q_transforms(spark, d):
    m = _images(spark, d).select("frame_no", F.lit(8).alias("height"), F.lit(8).alias("width"), "pixels")
    out = None
    for step in ("horizontal", "vertical", "invert", "crop:1,2,3,4"):
        part = frames.mask_transform(m, step).select(F.lit(step).alias("step"), "frame_no", "height", "width", _hex("pixels").alias("pixels"))
        out = part if out is None else out.unionByName(part)
    return out


def _masks(spark, d):
    """Masks: 0 (changed) where the picture is dark."""
    return _images(spark, d).withColumn("pixels", _bytes(F.transform("g", lambda x: F.when(x < 60, 0).otherwise(255))))


def q_merged(spark, d):
    return frames.merge_masks(_masks(spark, d), ["media_id"]).select("media_id", _hex("pixels").alias("pixels"))


def q_moved(spark, d):
    p = _pairs(spark, d).select("frame_no", _bytes(F.transform("g", lambda x: F.when(x > 80, x).otherwise(0))).alias("mask"), _bytes(F.transform("h", lambda x: F.when(x > 100, x).otherwise(0))).alias("inputmask"))
    return frames.moved_pixels(p).select("frame_no", "mismatch", "bad")


def q_crop_effects(spark, d):
    m = _masks(spark, d).selectExpr("frame_no", "8 as height", "8 as width", "pixels", "cast(frame_no % 3 as int) as top", "cast(frame_no % 4 as int) as left", "4 as box_height", "3 as box_width")
    return frames.crop_side_effects(m).select("frame_no", "dirty")


def q_bitplanes(spark, d):
    m = _masks(spark, d).selectExpr("frame_no as probe_id", "media_id as frame_no", "pixels")
    bits = m.selectExpr("probe_id", "probe_id % 5 as group_id", "probe_id % 20 + 1 as bit_number")
    return frames.bitplanes(m, bits).select("group_id", "frame_no", "plane", _hex("pixels").alias("pixels"))


def q_last_planes(spark, d):
    m = _masks(spark, d).selectExpr("frame_no as probe_id", "media_id as frame_no", "pixels")
    bits = m.selectExpr("probe_id", "probe_id % 5 as group_id", "probe_id % 20 + 1 as bit_number", "probe_id * 7 % 101 as probe_no")
    return frames.last_bitplanes(m, bits).select("group_id", "frame_no", "plane", _hex("pixels").alias("pixels"))


def q_donor_masks(spark, d):
    """Masks of 64 pixels, of which every thirteenth or so is selected; what each operation does to them stands for its step."""
    e = view(spark, d, "edges").select("project_id", "src", "dst", "op")
    step = F.expr("case op when 'ColorColorBalance' then 'horizontal' when 'Blur' then 'vertical' when 'TransformCrop' then 'crop:1,1,10,10' when 'TransformResize' then 'turn:1' when 'PasteSplice' then 'cover' end")
    drawn = lambda where, test: e.where(where).withColumns({"height": F.lit(8), "width": F.lit(8), "pixels": _bytes(F.expr(f"transform(sequence(0, 63), i -> if({test}, 0, 255))"))})
    nodes = view(spark, d, "nodes").select("project_id", "node_id", F.expr("case when file like '%.mov' or file like '%.mp4' then 'video' when file like '%.wav' then 'audio' else 'image' end").alias("media_type"))
    out = donor_masks.donor_masks(nodes, e.withColumn("step", step), drawn("op = 'Donor'", "(dst * (i + 3) + src) % 13 = 0"), drawn("op = 'PasteSplice'", "(src * (i + 5) + dst) % 2 = 0"))
    return out.withColumn("pixels", _hex("pixels"))


def q_compare(spark, d):
    p = _pairs(spark, d).select("frame_no", _bytes(F.transform("g", lambda x: F.when(x < 60, 0).otherwise(255))).alias("expected"), _bytes(F.transform("g", lambda x: F.when(x < 60 + F.pmod("frame_no", F.lit(4)), 0).otherwise(255))).alias("actual"))
    return frames.compare_masks(p).select("frame_no", "same")


def q_colors(spark, d):
    m = _masks(spark, d).selectExpr("media_id as project_id", "frame_no % 3 as final", "frame_no as probe_no", "concat(frame_no % 200, ' ', frame_no % 77, ' 5') as color", "pixels")
    return frames.color_composite(m).withColumn("pixels", _hex("pixels"))


def _vectors(spark, d):
    return _images(spark, d).select("media_id", "frame_no", F.transform("g", lambda x: x.cast("double")).alias("gray"))


def q_mean(spark, d):
    return frames.mean_image(_vectors(spark, d), 10).select("media_id", F.array_join(F.transform("pixels", lambda x: F.round(x * 100).cast("long").cast("string")), ",").alias("pixels"))


def q_median(spark, d):
    return frames.median_image(_vectors(spark, d), 7).select("media_id", F.array_join(F.transform("pixels", lambda x: (x * 2).cast("long").cast("string")), ",").alias("pixels"))


def _hashed(spark, d):
    f = view(spark, d, "frames").selectExpr("media_id", "frame_no", "cast(concat(event_type, '-', frame_no % 40) as binary) as pixels")
    return frames, f


def q_hashes(spark, d):
    from provlake.sources.journals import frame_hashes

    return frame_hashes(_hashed(spark, d)[1])


def q_cuts(spark, d):
    from provlake.sources.journals import frame_hashes

    h = frame_hashes(_hashed(spark, d)[1])
    b = h.where("frame_no % 40 < 30 or frame_no % 7 = 0").withColumn("hash", F.when(F.col("frame_no") % 11 == 0, F.concat("hash", F.lit("x"))).otherwise(F.col("hash")))
    return frames.cut_ranges(h, b).withColumn("side", F.lit("cut")).unionByName(frames.added_ranges(h, b).withColumn("side", F.lit("added")))


def q_nonspatial(spark, d):
    p = q_probe_summary(spark, d).withColumns({"has_mask": F.col("op").isin("Blur", "PasteSplice"), "has_segments": F.pmod("dst", F.lit(2)) == 0, "maskname": F.concat(F.lit("m"), "dst")})
    out = probes.drop_nonspatial_files(probes.designate(p))
    return out.select("project_id", "src", "dst", "final", "designation", F.coalesce("maskname", F.lit("-")).alias("maskname"))


QUERIES = {
    "diff_masks": q_diff_mask, "byte_histograms": q_histograms, "first_minimum": q_first_minimum, "mask_transforms": q_transforms, "merged_masks": q_merged, "moved_pixels": q_moved, "crop_side_effects": q_crop_effects,
    "bitplanes": q_bitplanes, "last_bitplanes": q_last_planes, "donor_masks": q_donor_masks, "compared_masks": q_compare, "color_composite": q_colors, "mean_images": q_mean, "median_images": q_median, "frame_hashes": q_hashes, "cut_ranges": q_cuts, "nonspatial_files": q_nonspatial,
}

_I = "WITH img AS (SELECT label::BIGINT AS media_id, vec_id::BIGINT AS frame_no, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 100)::BIGINT % 256) AS g FROM embeddings)"
_P = f"{_I}, p AS (SELECT a.*, b.g AS h FROM img a JOIN img b ON b.frame_no = a.frame_no + 1)"
_X = f"{_I}, px AS (SELECT media_id, frame_no, i - 1 AS i, g[i] AS v, CASE WHEN g[i] < 60 THEN 0 ELSE 255 END AS m FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM img))"


def _h(numbers: str) -> str:
    return f"array_to_string(list_transform({numbers}, lambda x: printf('%02X', x::BIGINT)), '')"


_AT = "list_transform(generate_series(0, {n}), lambda j: {v})"

_HOW = {
    "ColorColorBalance": ("h * w", "m[j // w * w + w - 1 - j % w + 1]"), "Blur": ("h * w", "m[(h - 1 - j // w) * w + j % w + 1]"), "TransformResize": ("h * w", "m[j % h * w + w - 1 - j // h + 1]"),
    "TransformCrop": ("100", "CASE WHEN j // 10 BETWEEN 1 AND h AND j % 10 BETWEEN 1 AND w THEN m[(j // 10 - 1) * w + j % 10] ELSE 255 END"),
    "PasteSplice": ("h * w", "CASE WHEN h * w = 64 AND (up * (j + 5) + here) % 2 = 0 THEN 255 ELSE m[j + 1] END"),
}
_STEPS = "CASE op " + " ".join(f"WHEN '{op}' THEN list_transform(generate_series(0, {n} - 1), lambda j: {v})" for op, (n, v) in _HOW.items()) + " ELSE m END"

ORACLES = {
    "diff_masks": f"""{_P}, z AS (SELECT frame_no, list_transform(generate_series(1, 64), lambda i: abs(g[i] - h[i])) AS d FROM p), y AS (SELECT *, len(list_filter(d, lambda x: x > 63.75)) AS changed, list_avg(list_transform(d, lambda x: x * x)) AS mse, list_avg(list_transform(list_filter(d, lambda x: x > 63.75), lambda x: x * x)) AS near FROM z)
SELECT frame_no, {_h('list_transform(d, lambda x: CASE WHEN x > 63.75 THEN 0 ELSE 255 END)')} AS mask, changed, coalesce(CASE WHEN mse > 0 THEN round(20 * log10(255 / sqrt(mse)), 4) END, -1) AS psnr, coalesce(round(20 * log10(255 / sqrt(near)), 4), 0) AS local_psnr, round(changed / 64.0::DOUBLE, 6) AS ratio,
  CASE WHEN changed * 200 < 2500 THEN 'small' WHEN changed * 200 < 10000 THEN 'medium' ELSE 'large' END AS category, changed / 64.0 > 0.75 AS is_global FROM y""",
    "byte_histograms": f"{_X} SELECT media_id, v AS value, count(*) AS n, count(DISTINCT frame_no) AS frames FROM px GROUP BY 1, 2",
    "first_minimum": f"""{_X}, h AS (SELECT media_id, v, count(*) AS n FROM px GROUP BY 1, 2), bins AS (SELECT media_id, b FROM (SELECT DISTINCT media_id FROM h), generate_series(0, 255) t(b)),
f AS (SELECT bins.media_id, b, coalesce(n, 0) AS n FROM bins LEFT JOIN h ON h.media_id = bins.media_id AND h.v = b), w AS (SELECT media_id, b, sum(n) OVER (PARTITION BY media_id ORDER BY b ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s FROM f),
x AS (SELECT *, lag(s) OVER o AS pv, lead(s) OVER o AS nx FROM w WHERE b < 254 WINDOW o AS (PARTITION BY media_id ORDER BY b)), m AS (SELECT media_id, min(b) FILTER (s < pv AND s < nx) AS low FROM x GROUP BY 1)
SELECT media_id, CASE WHEN low IS NULL OR low > 128 THEN 4 ELSE greatest(4, least(low, 90)) END + 1 AS threshold FROM m""",
    "last_bitplanes": f"""{_X}, r AS (SELECT frame_no AS probe, media_id AS frame_no, frame_no % 5 AS group_id, frame_no % 20 + 1 AS bit, frame_no * 7 % 101 AS no, i, m FROM px),
l AS (SELECT *, (bit - 1) // 8 AS plane FROM r QUALIFY row_number() OVER (PARTITION BY group_id, frame_no, (bit - 1) // 8, i ORDER BY no DESC, bit DESC) = 1)
SELECT group_id, frame_no, plane, string_agg(printf('%02X', CASE WHEN m = 0 THEN 1 << ((bit - 1) % 8)::INT ELSE 0 END::INT), '' ORDER BY i) AS pixels FROM l GROUP BY 1, 2, 3""",
    "donor_masks": f"""{with_views('edges', recursive=True)},
media AS (SELECT project_id, node_id, file LIKE '%.mov' OR file LIKE '%.mp4' AS video FROM nodes),
walk(project_id, src, dst, here, path, h, w, m) AS (
  SELECT project_id, src, dst, src, [src], 8::BIGINT, 8::BIGINT, m FROM (SELECT *, list_transform(generate_series(0, 63), lambda i: CASE WHEN (dst * (i + 3) + src) % 13 = 0 THEN 0 ELSE 255 END) AS m FROM edges WHERE op = 'Donor') WHERE list_contains(m, 0)
  UNION ALL SELECT * FROM (SELECT project_id, src, dst, up, list_append(path, up), CASE op WHEN 'TransformResize' THEN w WHEN 'TransformCrop' THEN 10 ELSE h END, CASE op WHEN 'TransformResize' THEN h WHEN 'TransformCrop' THEN 10 ELSE w END, {_STEPS} AS n
    FROM (SELECT k.*, e.src AS up, e.op FROM walk k JOIN edges e ON e.project_id = k.project_id AND e.dst = k.here WHERE e.op <> 'Donor')) WHERE list_contains(n, 0)),
ended AS (SELECT k.*, v.video FROM walk k JOIN media v ON v.project_id = k.project_id AND v.node_id = k.here WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.project_id = k.project_id AND e.dst = k.here)),
firsts AS (SELECT project_id, src, dst, here, arg_min(struct_pack(h := h, w := w, m := m), path) AS x FROM ended WHERE video GROUP BY 1, 2, 3, 4),
cells AS (SELECT project_id, src, dst, here, h, w, i, min(m[i]) AS v FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM ended WHERE NOT video) GROUP BY ALL)
SELECT project_id, src, dst, here AS base, x.h AS height, x.w AS width, {_h('x.m')} AS pixels FROM firsts
UNION ALL SELECT project_id, src, dst, here, h, w, string_agg(printf('%02X', v::BIGINT), '' ORDER BY i) FROM cells GROUP BY ALL""",
    "mask_transforms": f"""{_I} SELECT 'horizontal' AS step, frame_no, 8 AS height, 8 AS width, {_h(_AT.format(n=63, v='g[j // 8 * 8 + 7 - j % 8 + 1]'))} AS pixels FROM img
UNION ALL SELECT 'vertical', frame_no, 8, 8, {_h(_AT.format(n=63, v='g[(7 - j // 8) * 8 + j % 8 + 1]'))} FROM img UNION ALL SELECT 'invert', frame_no, 8, 8, {_h('list_transform(g, lambda x: 255 - x)')} FROM img
UNION ALL SELECT 'crop:1,2,3,4', frame_no, 3, 4, {_h(_AT.format(n=11, v='g[(1 + j // 4) * 8 + 2 + j % 4 + 1]'))} FROM img""",
    "merged_masks": f"{_X}, n AS (SELECT media_id, i, min(m) AS m FROM px GROUP BY 1, 2) SELECT media_id, string_agg(printf('%02X', m), '' ORDER BY i) AS pixels FROM n GROUP BY 1",
    "moved_pixels": f"""{_P}, c AS (SELECT frame_no, len(list_filter(g, lambda x: x > 80)) AS n, len(list_filter(generate_series(1, 64), lambda i: g[i] > 80 AND h[i] <= 100)) AS a, len(list_filter(generate_series(1, 64), lambda i: g[i] <= 80 AND h[i] > 100)) AS b FROM p)
SELECT frame_no, CASE WHEN n > 0 THEN round(abs(a - b) / n::DOUBLE, 6) ELSE 0 END AS mismatch, n > 0 AND abs(a - b) / n::DOUBLE > 0.05 AS bad FROM c""",
    "crop_side_effects": f"{_X} SELECT frame_no, count(*) FILTER (m <> 255 AND i // 8 BETWEEN frame_no % 3 AND frame_no % 3 + 3 AND i % 8 BETWEEN frame_no % 4 AND frame_no % 4 + 2) AS dirty FROM px GROUP BY 1",
    "bitplanes": f"""{_X}, b AS (SELECT frame_no % 5 AS group_id, media_id AS frame_no, ((frame_no % 20) // 8)::INT AS plane, i, bit_or(CASE WHEN m = 0 THEN 1 << (frame_no % 20 % 8)::INT ELSE 0 END) AS v FROM px GROUP BY 1, 2, 3, 4)
SELECT group_id, frame_no, plane, string_agg(printf('%02X', v), '' ORDER BY i) AS pixels FROM b GROUP BY 1, 2, 3""",
    "compared_masks": f"{_P} SELECT frame_no, len(list_filter(g, lambda x: x >= 60 AND x < 60 + frame_no % 4)) <= 0.05 * len(list_filter(g, lambda x: x < 60)) AS same FROM p",
    "color_composite": f"""{_X}, l AS (SELECT media_id AS project_id, frame_no % 3 AS final, i, max(frame_no) FILTER (m = 0) AS n FROM px GROUP BY 1, 2, 3), c AS (SELECT project_id, final, count(n) AS changed, string_agg(CASE WHEN n IS NULL THEN 'FFFFFF' ELSE printf('%02X%02X05', n % 200, n % 77) END, '' ORDER BY i) AS pixels FROM l GROUP BY 1, 2)
SELECT *, round(changed / 64.0::DOUBLE, 6) AS ratio, 'small' AS category, changed / 64.0 > 0.75 AS is_global FROM c""",
    "mean_images": f"""{_X}, n AS (SELECT *, dense_rank() OVER (PARTITION BY media_id ORDER BY frame_no) - 1 AS k FROM px), c AS (SELECT media_id, count(DISTINCT frame_no) AS n FROM px GROUP BY 1),
a AS (SELECT n.media_id, i, avg(v) AS v FROM n JOIN c ON c.media_id = n.media_id WHERE k % greatest(c.n // 10, 1) = 0 GROUP BY 1, 2) SELECT media_id, string_agg(round(round(v, 6) * 100)::BIGINT::VARCHAR, ',' ORDER BY i) AS pixels FROM a GROUP BY 1""",
    "median_images": f"""{_X}, n AS (SELECT *, dense_rank() OVER (PARTITION BY media_id ORDER BY frame_no) - 1 AS k FROM px), c AS (SELECT media_id, count(DISTINCT frame_no) AS n FROM px GROUP BY 1),
a AS (SELECT n.media_id, i, median(v) AS v FROM n JOIN c ON c.media_id = n.media_id WHERE k % greatest(ceil(c.n / 7)::BIGINT, 1) = 0 GROUP BY 1, 2) SELECT media_id, string_agg((v * 2)::BIGINT::VARCHAR, ',' ORDER BY i) AS pixels FROM a GROUP BY 1""",
    "frame_hashes": f"{with_views('frames')} SELECT media_id, frame_no, sha256(concat(event_type, '-', frame_no % 40)) AS hash FROM frames",
    "cut_ranges": f"""{with_views('frames')}, h AS (SELECT media_id, frame_no, concat(event_type, '-', frame_no % 40) AS hash FROM frames), b AS (SELECT media_id, frame_no, CASE WHEN frame_no % 11 = 0 THEN concat(hash, 'x') ELSE hash END AS hash FROM h WHERE frame_no % 40 < 30 OR frame_no % 7 = 0),
l AS (SELECT 'cut' AS side, * FROM h WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.media_id = h.media_id AND b.hash = h.hash) UNION ALL SELECT 'added', * FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE b.media_id = h.media_id AND b.hash = h.hash)),
g AS (SELECT *, frame_no - row_number() OVER (PARTITION BY side, media_id ORDER BY frame_no) AS k FROM l) SELECT side, media_id, min(frame_no) AS startframe, max(frame_no) AS endframe, count(*) AS frames FROM g GROUP BY side, media_id, k""",
}


def _nonspatial() -> str:
    from .lineage_queries import PSUM, PV, _sql

    kind = "CASE WHEN op IN ('Blur', 'PasteSplice') THEN CASE WHEN dst % 2 = 0 THEN 'spatial-temporal' ELSE 'spatial' END WHEN dst % 2 = 0 THEN 'temporal' ELSE 'detect' END"
    return _sql(PSUM, f"SELECT project_id, src, dst, final, {kind} AS designation, CASE WHEN op IN ('Blur', 'PasteSplice') THEN concat('m', dst) ELSE '-' END AS maskname FROM ps", *PV)


ORACLES["nonspatial_files"] = _nonspatial()
