"""Queries and SQL for changed sizes, sources, seeded choices and user names."""

from __future__ import annotations

from pyspark.sql import functions as F

from provlake.operators import catalog, lineage, shape_rules

from .fixture import view, with_views

_SHAPED = """project_id, src, dst, op, case dst % 5 when 0 then '(0, 0)' when 1 then concat('(', src % 3, ', 0)') when 2 then concat('(-', src % 3, 'L,', dst % 2, ')') end as shape_change,
  case when src % 4 = 0 then 'Crop' end as approach, case dst % 7 when 0 then 'Rotate 90 CW' when 1 then 'Mirror horizontal' end as orientation,
  100 + src % 3 * 50 as src_w, 150 as src_h, 100 + dst % 3 * 50 as dst_w, 150 as dst_h"""


def q_shape(spark, d):
    e = view(spark, d, "edges").selectExpr(*_columns(_SHAPED), "case when src % 6 = 0 then map('rotate', '270', 'a rotate', '90') when src % 6 = 1 then map('rotate', '90') when src % 6 = 2 then map() end as video_diff")
    return shape_rules.shape_rules(e)


def _columns(text):
    """The expressions of a list that commas outside of brackets part."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0 and text[:i].count("'") % 2 == 0:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]


_PNG = """project_id, src, dst, op, 200 + src % 2 * 200 as src_w, 300 as src_h, 200 + dst % 2 * 200 - dst % 8 as dst_w, 300 - src % 5 * 4 as dst_h, case when src % 3 = 0 then 'a.NEF' else 'a.jpg' end as src_file, src % 7 = 0 as raw,
  case dst % 6 when 0 then 'Rotate 90 CW' when 1 then 'Rotate 180' end as orientation, case when (src + dst) % 4 = 0 then 'yes' end as rotated, case when src % 2 = 0 then 'yes' end as distortion, case when dst % 3 = 0 then '(2, 0)' end as location"""


def q_png_exif(spark, d):
    exif = "map('Image Height', cast(300 - src % 5 * 4 + 4 as string), 'Image Width', cast(200 + dst % 2 * 200 - dst % 8 as string), 'AF Image Height', cast(300 - src % 5 * 4 as string), 'AF Image Width', cast(200 + dst % 2 * 200 - dst % 8 as string)) as exif"
    e = view(spark, d, "edges").where("op <> 'Donor'").selectExpr(*_columns(_PNG), exif)
    own = shape_rules.png_exif_rules(e)
    return own.withColumn("crop", F.lit(False)).unionByName(shape_rules.png_exif_rules(e, True).withColumn("crop", F.lit(True)))


def q_lines(spark, d):
    e = view(spark, d, "edges").selectExpr("project_id", "src", "dst", "op", "80 as src_w", "60 as src_h", "case when dst % 5 > 0 then array(array(1D, 0D, src % 3 + 0D), array(0D, 1D, 2D), array((dst % 4 - 1) / 64D, (src % 5 - 2) / 128D, 1D)) when src % 2 = 0 then array(array(2D, 0D, 1D), array(0D, 1D, 0D)) end as matrix")
    strict = shape_rules.homography_line_rules(e, True).withColumn("compat", F.lit(True))
    return shape_rules.homography_line_rules(e).withColumn("compat", F.lit(False)).unionByName(strict)


def q_sources(spark, d):
    n = view(spark, d, "nodes").selectExpr("project_id", "node_id", "if(node_id % 13 = 0, null, file) as file", "case node_id % 6 when 0 then 'PNG' when 1 then 'NEF' when 2 then 'MOV' when 3 then 'WAV' end as exif_type")
    lines = spark.read.parquet(f"{d}/lineitem.parquet").where("l_orderkey % 8 > 0").selectExpr(
        "l_orderkey as node_id", "l_linenumber as pos", "if(l_linestatus = 'O', 'video', 'audio') as type", "case l_orderkey % 3 when 0 then 'H264' when 1 then 'H.264 / AVC' end as codec", "if(l_linenumber % 2 = 0, 'High 4:4:4 Predictive', 'main') as profile", "l_linenumber % 4 = 0 as vfr",
    )
    streams = lines.join(view(spark, d, "nodes").select("project_id", "node_id"), "node_id")
    return shape_rules.source_rules(view(spark, d, "edges").where("op <> 'Donor'"), n, streams)


def q_random(spark, d):
    specs = spark.read.parquet(f"{d}/part.parquet").selectExpr(
        "concat('p', p_partkey) as name", "case p_partkey % 6 when 0 then concat('int[1:', p_size, ':7]') when 1 then concat('float[0:', p_size, ':0.5]') when 2 then 'yesno' when 3 then concat('list:', p_brand, ',', p_size, ',z') when 4 then concat('int[', p_size, ':', p_size + 3, ',100]') else 'float[2:3]' end as spec"
    )
    return catalog.random_values(specs, 3, 11)


def q_donors(spark, d):
    return catalog.random_donors(lineage.degrees(view(spark, d, "nodes"), view(spark, d, "edges")).where("n_in = 0"), 5)


def q_users(spark, d):
    e = view(spark, d, "edges").selectExpr("project_id", "src", "dst", "op", "case dst % 4 when 0 then concat('nation_', dst % 30) when 1 then concat('NATION_', dst % 30) when 2 then 'nobody' end as username")
    j = view(spark, d, "journals").selectExpr("project_id", "case project_id % 3 when 0 then concat('Nation_', project_id % 25) when 1 then 'other' end as creator")
    return catalog.mend_users(e, j, spark.read.parquet(f"{d}/nation.parquet").selectExpr("lower(n_name) as username")).select("project_id", "src", "dst", F.coalesce("username", F.lit("-")).alias("username"))


QUERIES = {"shape_rules": q_shape, "png_exif": q_png_exif, "homography_lines": q_lines, "source_rules": q_sources, "random_values": q_random, "random_donors": q_donors, "mended_users": q_users}

_E = with_views("edges")
_M = 'project_id, {} AS severity, src AS start, dst AS "end", \'{}\' AS module, {} AS message'


def _told(table, *parts):
    return "\nUNION ALL ".join(f"SELECT {_M.format(s, m, t if t.startswith('CASE') else repr(t))} FROM {table} WHERE {w}" for s, m, t, w in parts)


_DRAW = "('0x' || substr(md5(concat_ws(':', {})), 1, 8))::BIGINT"
_FITS = """list_bool_or(list_transform([[src_h, src_w], [dst_h + 4 - 2 * CASE WHEN dst % 3 = 0 THEN 2 ELSE 0 END, dst_w], [dst_h + 4, dst_w]{}], lambda s: (resizing AND (CASE WHEN turn THEN s[2] ELSE s[1] END - dst_h <= allowed * CASE WHEN turn THEN s[2] ELSE s[1] END
  OR CASE WHEN turn THEN s[1] ELSE s[2] END - dst_w <= allowed * CASE WHEN turn THEN s[1] ELSE s[2] END)) OR (CASE WHEN turn THEN s[2] ELSE s[1] END = dst_h AND CASE WHEN turn THEN s[1] ELSE s[2] END = dst_w)))"""
_TEXT = """CASE WHEN NOT turn AND NOT alike THEN 'Image rotated; Exif does not indicate rotation' WHEN turn AND alike THEN 'Image not rotated; Exif indicates rotation' WHEN rotated IS NOT NULL AND orientation IS NULL THEN 'No orientation metadata indicating rotation; split into two operations'
  WHEN rotated IS NULL AND orientation IS NOT NULL THEN 'Exif indicates rotation; operation settings differ.' WHEN NOT {} THEN 'operation is not permitted to change the size of the image' END"""


def _png(crop):
    text = _TEXT.format(_FITS.format(", [dst_h, dst_w]" if crop else ""))
    return f"""SELECT project_id, CASE WHEN message LIKE 'Exif indicates%' THEN 2 ELSE 3 END AS severity, src AS start, dst AS "end", 'png_exif' AS module, message, {crop} AS crop FROM (SELECT *, {text} AS message FROM y) WHERE message IS NOT NULL"""


_MEET = "({0}2 <> 0 AND {0}1 / {0}2 BETWEEN 0 AND 60 AND {0}0 / {0}2 BETWEEN 0 AND 80)"
_ERRONEOUS = "'Homography appears to be erroneous.  Adjust Homography parameters.'"


def _by(out, a, b):
    """The three parts of a cross product as SQL columns."""
    return f"{a}1 * {b}2 - {a}2 * {b}1 AS {out}0, {a}2 * {b}0 - {a}0 * {b}2 AS {out}1, {a}0 * {b}1 - {a}1 * {b}0 AS {out}2"


def _corner(name, x, y):
    return ", ".join(f"m{i}0 * {x} + m{i}1 * {y} + m{i}2 AS {name}{i}" for i in range(3))


ORACLES = {
    "shape_rules": f"""{_E}, x AS (SELECT {_SHAPED.replace('L,', ',')} FROM edges), c AS (SELECT *, coalesce(orientation, CASE WHEN src % 6 = 0 THEN '90' END) AS o, sign(src_w - src_h) = sign(dst_w - dst_h) AS alike,
  CASE dst % 5 WHEN 0 THEN false WHEN 1 THEN src % 3 > 0 WHEN 2 THEN src % 3 > 0 OR dst % 2 > 0 END AS changed FROM x)
{_told('c', (3, 'size_changed', 'operation should change the size of the image', 'NOT changed'), (3, 'size_kept', 'operation is not permitted to change the size of the image', 'changed AND approach IS NULL'),
       (3, 'size_exif', 'Rotation not applied', "changed AND regexp_matches(o, '270|90') AND alike"), (2, 'size_exif', 'operation changed the size of the image', 'changed AND o IS NULL'))}""",
    "png_exif": f"""{_E}, x AS (SELECT {_PNG} FROM edges WHERE op <> 'Donor'), y AS (SELECT *, coalesce(rotated = 'yes' AND orientation LIKE '%90%', false) AS turn, sign(src_w - src_h) = sign(dst_w - dst_h) AS alike, raw OR src % 3 = 0 AS resizing,
  ceil(greatest(0.015::DOUBLE, 65::DOUBLE / src_h, 65::DOUBLE / src_w) * 10000) / 10000 * CASE WHEN src % 2 = 0 THEN 2 ELSE 1 END AS allowed FROM x)
{_png(False)} UNION ALL {_png(True)}""",
    "homography_lines": f"""{_E}, m AS (SELECT project_id, src, dst, CASE WHEN dst % 5 > 0 THEN 1.0::DOUBLE ELSE 2 END AS m00, 0.0::DOUBLE AS m01, CASE WHEN dst % 5 > 0 THEN (src % 3)::DOUBLE ELSE 1 END AS m02, 0.0::DOUBLE AS m10, 1.0::DOUBLE AS m11, CASE WHEN dst % 5 > 0 THEN 2.0::DOUBLE ELSE 0 END AS m12,
  CASE WHEN dst % 5 > 0 THEN (dst % 4 - 1) / 64::DOUBLE ELSE 0 END AS m20, CASE WHEN dst % 5 > 0 THEN (src % 5 - 2) / 128::DOUBLE ELSE 0 END AS m21, 1.0::DOUBLE AS m22 FROM edges WHERE dst % 5 > 0 OR src % 2 = 0),
c AS (SELECT *, {_corner('a', 0, 0)}, {_corner('b', 0, 60)}, {_corner('c', 80, 0)}, {_corner('d', 80, 60)} FROM m), l AS (SELECT *, {_by('p', 'a', 'b')}, {_by('q', 'c', 'd')}, {_by('r', 'b', 'd')}, {_by('s', 'a', 'c')} FROM c),
i AS (SELECT *, {_by('v', 'p', 'q')}, {_by('z', 'r', 's')} FROM l)
SELECT {_M.format(3, 'homography_lines', _ERRONEOUS)}, false AS compat FROM i WHERE {_MEET.format('v')} OR {_MEET.format('z')}
UNION ALL SELECT {_M.format(3, 'homography_lines', _ERRONEOUS)}, true FROM i WHERE {_MEET.format('v')} OR {_MEET.format('z')} OR v2 = 0 OR z2 = 0""",
    "source_rules": f"""{_E}, l AS (SELECT l_orderkey AS node_id, arg_min(l_orderkey % 3 < 2 AND l_linenumber % 2 = 0 AND l_linenumber % 4 > 0, l_linenumber) FILTER (l_linestatus = 'O') AS h264, bool_or(l_linestatus = 'O') AS video FROM lineitem WHERE l_orderkey % 8 > 0 GROUP BY 1),
n AS (SELECT project_id, nodes.node_id AS src, node_id % 6 AS t, CASE WHEN node_id % 13 = 0 THEN false WHEN node_id % 6 IN (0, 3) OR file LIKE '%.wav' THEN false WHEN file LIKE '%.png' OR file LIKE '%.jpg' THEN true WHEN video IS NULL THEN true WHEN NOT video THEN false WHEN node_id % 3 = 2 THEN false ELSE NOT h264 END AS packed FROM nodes LEFT JOIN l USING (node_id)),
j AS (SELECT e.project_id, e.src, e.dst, t, packed FROM edges e JOIN n ON n.project_id = e.project_id AND n.src = e.src WHERE op <> 'Donor')
{_told('j', (3, 'raw_source', 'Only raw images permitted for this operation', 't IN (0, 2)'), (2, 'uncompressed', 'Starting node appears to be compressed', 'packed'))}""",
    "random_values": f"""WITH s AS (SELECT *, concat('p', p_partkey) AS name, unnest([0, 1, 2]) AS draw FROM part), u AS (SELECT *, {_DRAW.format("'11', name, draw::VARCHAR, 'value'")} AS u, {_DRAW.format("'11', name, draw::VARCHAR, 'section'")} % 2 AS part FROM s)
SELECT name, draw, CASE p_partkey % 6 WHEN 0 THEN (1 + u % ((p_size - 1) // 7 + 1) * 7)::VARCHAR WHEN 1 THEN ((u % (2 * p_size)) * 0.5::DOUBLE)::DOUBLE::VARCHAR WHEN 2 THEN CASE u % 2 WHEN 0 THEN 'yes' ELSE 'no' END WHEN 3 THEN CASE u % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_size::VARCHAR ELSE 'z' END
  WHEN 4 THEN CASE part WHEN 0 THEN (p_size + u % 4)::VARCHAR ELSE (100 + u % 2)::VARCHAR END ELSE round(2 + u / 4294967296::DOUBLE, 6)::VARCHAR END AS value FROM u""",
    "random_donors": f"""{_E}, b AS (SELECT project_id, node_id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.project_id = n.project_id AND e.dst = n.node_id))
SELECT project_id, arg_min(node_id, ROW({_DRAW.format("'5', project_id::VARCHAR, node_id::VARCHAR")}, node_id)) AS node_id FROM b GROUP BY 1""",
    "mended_users": f"""{_E} SELECT project_id, src, dst, CASE WHEN dst % 4 = 3 THEN '-' WHEN dst % 4 = 0 AND dst % 30 < 25 THEN concat('nation_', dst % 30) WHEN project_id % 3 > 0 THEN CASE dst % 4 WHEN 0 THEN concat('nation_', dst % 30) WHEN 1 THEN concat('NATION_', dst % 30) ELSE 'nobody' END
  WHEN dst % 4 = 1 AND dst % 30 < 25 THEN concat('nation_', dst % 30) ELSE concat('nation_', project_id % 25) END AS username FROM edges""",
}
