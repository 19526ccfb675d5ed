"""Journal-shaped views over the given tables, as SQL that Spark and DuckDB both run.

Table names stand in braces: Spark fills in DataFrames, DuckDB its views of the same names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

JOURNALS = """
SELECT c_custkey AS project_id, c_name AS username,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'image' WHEN 'BUILDING' THEN 'video' WHEN 'MACHINERY' THEN 'audio' ELSE 'image' END AS projecttype
FROM {customer}"""

NODES = """
SELECT o_custkey AS project_id, o_orderkey AS node_id, o_orderdate AS ctime, o_totalprice AS price,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS r,
       concat('o', o_orderkey, CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN '.png' WHEN '2' THEN '.jpg' WHEN '3' THEN '.mov' WHEN '4' THEN '.wav' ELSE '.mp4' END) AS file,
       concat(substring(o_orderpriority, 1, 1), o_orderstatus) AS code
FROM {orders}"""

OP = """CASE code WHEN '1O' THEN 'PasteSplice' WHEN '1F' THEN 'TransformCrop' WHEN '1P' THEN 'OutputPng'
  WHEN '2O' THEN 'Blur' WHEN '2F' THEN 'ColorColorBalance' WHEN '2P' THEN 'TransformResize'
  WHEN '3O' THEN 'DeleteFrames' WHEN '3F' THEN 'InsertFrames' WHEN '3P' THEN 'PasteFrames'
  WHEN '4O' THEN 'AddAudio' WHEN '4F' THEN 'DeleteAudio' WHEN '4P' THEN 'AudioSample'
  WHEN '5O' THEN 'PasteSampled' WHEN '5F' THEN 'TimeWarp' ELSE 'OutputMp4' END"""

EDGES = f"""
SELECT b.project_id, a.node_id AS src, b.node_id AS dst, {OP.replace('code', 'b.code')} AS op, b.r
FROM nodes a JOIN nodes b ON a.project_id = b.project_id AND a.r = CAST(floor(b.r / 2) AS BIGINT) WHERE b.r >= 2
UNION ALL
SELECT b.project_id, a.node_id AS src, b.node_id AS dst, 'Donor' AS op, b.r
FROM nodes a JOIN nodes b ON a.project_id = b.project_id AND a.r = b.r - 1 WHERE b.r >= 4 AND b.r % 4 = 0"""

OPERATIONS = """
SELECT * FROM (VALUES ('PasteSplice','Paste','localized','donor'), ('TransformCrop','Transform','global','size'), ('OutputPng','Output','output','png'),
 ('Blur','Filter','localized','mask'), ('ColorColorBalance','Color','global','mask'), ('TransformResize','Transform','global','size'),
 ('DeleteFrames','SelectRemove','localized','frames'), ('InsertFrames','Paste','localized','frames'), ('PasteFrames','Paste','localized','frames'),
 ('AddAudio','Audio','localized','audio'), ('DeleteAudio','Audio','localized','audio'), ('AudioSample','Audio','global','audio'),
 ('PasteSampled','Paste','localized','mask'), ('TimeWarp','TimeAlteration','global','rate'), ('OutputMp4','Output','output','mp4'),
 ('Donor','Donor','donor','donor')) AS t(op, category, scope, rule)"""

SEGMENTS = """
SELECT l_orderkey AS set_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS BIGINT) AS seg_no,
       CASE l_linestatus WHEN 'O' THEN 'video' ELSE 'audio' END AS type, CAST(30 AS DOUBLE) AS rate,
       CAST(1 + 40 * l_linenumber + l_partkey % 20 AS BIGINT) AS startframe,
       CAST(1 + 40 * l_linenumber + l_partkey % 20 AS BIGINT) + CAST(l_quantity AS BIGINT) - 1 AS endframe,
       CAST(l_tax AS DOUBLE) AS error
FROM {lineitem}"""

BOUNDS = """
SELECT o_orderkey AS set_id, CAST(60 + o_custkey % 60 AS BIGINT) AS startframe, CAST(60 + o_custkey % 60 + 10 + o_orderkey % 20 - 1 AS BIGINT) AS endframe
FROM {orders}"""

MEDIA = """
SELECT o.o_custkey AS project_id, o.o_orderkey AS node_id, s.frames,
       CAST(CASE substring(o.o_orderpriority, 1, 1) WHEN '1' THEN 24 WHEN '2' THEN 25 WHEN '3' THEN 30 WHEN '4' THEN 50 ELSE 60 END AS DOUBLE) AS rate,
       s.frames * 1000.0 / CASE substring(o.o_orderpriority, 1, 1) WHEN '1' THEN 24 WHEN '2' THEN 25 WHEN '3' THEN 30 WHEN '4' THEN 50 ELSE 60 END AS duration_ms
FROM {orders} o JOIN (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS frames FROM {lineitem} GROUP BY l_orderkey) s ON o.o_orderkey = s.l_orderkey"""

FRAMES = """
SELECT user_id AS media_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS frame_no,
       event_type IN ('error', 'click') AS changed, value AS intensity, ts, event_id, event_type, props
FROM {events}"""

WIDE = """
SELECT e.project_id, e.src, e.dst, e.op, e.r,
       CASE WHEN a.file LIKE '%.png' OR a.file LIKE '%.jpg' THEN 'image' WHEN a.file LIKE '%.wav' THEN 'audio' ELSE 'video' END AS media_type,
       CASE WHEN b.file LIKE '%.png' OR b.file LIKE '%.jpg' THEN 'image' WHEN b.file LIKE '%.wav' THEN 'audio' ELSE 'video' END AS dst_type,
       CASE e.dst % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS record_mask, CASE e.src % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS is_global,
       CASE e.dst % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS empty_mask, CASE WHEN e.dst % 3 = 0 THEN concat('i', e.dst) END AS inputmask,
       CASE (e.dst + e.src) % 5 WHEN 0 THEN 'clone' WHEN 1 THEN 'remove' WHEN 2 THEN 'add' WHEN 3 THEN 'blend' END AS purpose,
       CASE e.src % 4 WHEN 0 THEN 'insert' WHEN 1 THEN 'overlay' WHEN 2 THEN 'replace' END AS add_type,
       CASE WHEN e.src % 6 = 0 THEN 'yes' END AS voice, CASE WHEN e.dst % 5 = 0 THEN 'Median Smoothing' END AS blur_type,
       CASE WHEN e.dst % 9 = 0 THEN 'a gan face' END AS subject, CASE WHEN e.src % 8 = 0 THEN 'yes' END AS direct, concat('s', e.dst % 6) AS software,
       CASE WHEN e.src % 3 = 0 THEN '640x480' WHEN e.src % 3 = 1 THEN '640' END AS resolution
FROM edges e JOIN nodes a ON a.project_id = e.project_id AND a.node_id = e.src JOIN nodes b ON b.project_id = e.project_id AND b.node_id = e.dst"""

#: Names of the arguments that the wide view holds as columns.
ARGUMENTS = {"purpose": "purpose", "add type": "add_type", "voice": "voice", "Blur Type": "blur_type", "subject": "subject", "Direct from PC": "direct", "resolution": "resolution"}

VIEWS = {"wide": WIDE, "journals": JOURNALS, "nodes": NODES, "edges": EDGES, "operations": OPERATIONS, "segments": SEGMENTS, "bounds": BOUNDS, "media": MEDIA, "frames": FRAMES}
NEEDS = {"edges": ("nodes",), "wide": ("nodes", "edges")}


def view(spark: SparkSession, sf_dir: str, name: str, have: dict[str, DataFrame] | None = None) -> DataFrame:
    """One of the views as a DataFrame, over those of the views and tables that are there already."""
    sql, have = VIEWS[name], have or {}
    tables = {t: have[t] if t in have else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
    if name == "segments":
        from provlake.functions.blocks import in_parts

        tables["lineitem"] = in_parts(tables["lineitem"], "l_orderkey")
    for need in NEEDS.get(name, ()):
        sql = re.sub(rf"\b(FROM|JOIN) {need}\b", rf"\1 {{{need}}}", sql)
        tables[need] = have[need] if need in have else view(spark, sf_dir, need, have)
    return spark.sql(sql, **tables) if tables else spark.sql(sql)


def kept_views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    """Views that a query reads more than once, each written once and made of those before it in turn."""
    from provlake.functions.storage import written

    have: dict[str, DataFrame] = {}
    for name in names:
        have[name] = written(view(spark, sf_dir, name, have))
    return have


def wide_edges(spark: SparkSession, sf_dir: str, have: dict[str, DataFrame] | None = None) -> DataFrame:
    """The wide view with its arguments as a map; null arguments are not in it."""
    from pyspark.sql import functions as F

    e = view(spark, sf_dir, "wide", have).withColumnRenamed("software", "softwareName").withColumnRenamed("inputmask", "inputmaskname")
    pairs = F.create_map(*(x for name, column in ARGUMENTS.items() for x in (F.lit(name), F.col(column))))
    return e.withColumn("arguments", F.map_filter(pairs, lambda k, v: v.isNotNull())).drop(*ARGUMENTS.values())


def with_views(*names: str, recursive: bool = False) -> str:
    """The WITH clause that gives DuckDB the same views."""
    order = dict.fromkeys(n for name in names for n in (*NEEDS.get(name, ()), name))
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f"{n} AS ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n])})" for n in order)
