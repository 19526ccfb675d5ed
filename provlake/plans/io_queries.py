"""Queries and SQL for sources, sinks and streams: tables are written in each format to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from provlake.functions.storage import shared_dir
from provlake.operators import rules
from provlake.sources import journals as source
from provlake.streaming import frames as streaming

from .fixture import view, wide_edges, with_views
from .lineage_queries import q_node_rules_messages, q_probe_summary


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"


def _journal_lines(spark, d):
    """One journal a line; links end at positions in journals of even ids and at node ids in the others, and one link of each
    eleventh journal ends nowhere."""
    n = view(spark, d, "nodes").groupBy("project_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.struct(F.concat(F.lit("n"), "node_id").alias("id"), "file", F.col("ctime").cast("string").alias("ctime"))))), lambda x: x[F.lit("col2")]).alias("nodes"))
    at = view(spark, d, "nodes").select("project_id", "node_id", "r")
    e = view(spark, d, "edges").select("project_id", "src", "dst", "op").join(at.toDF("project_id", "src", "r0"), ["project_id", "src"]).join(at.toDF("project_id", "dst", "r1"), ["project_id", "dst"])
    by_place = F.col("project_id") % 2 == 0
    end = lambda node, r: F.when(by_place, (F.col(r) - 1).cast("string")).otherwise(F.concat(F.lit("n"), node))
    target = F.when((F.col("project_id") % 11 == 0) & (F.col("r1") == 2), "nowhere").otherwise(end("dst", "r1"))
    links = e.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct(end("src", "r0").alias("source"), target.alias("target"), "op"))).alias("links"))
    whole = n.join(links, "project_id", "left").select(F.struct(F.col("project_id").cast("string").alias("name"), F.lit("image").alias("projecttype")).alias("graph"), "nodes", "links")
    return whole.select(F.to_json(F.struct("*")).alias("value"))


def _journals(spark, d):
    path = _folder(spark)
    _journal_lines(spark, d).write.text(path)
    return source.read_journals(spark, path, multi_line=False)


def q_journal_edges(spark, d):
    _, _, edges, errors = _journals(spark, d)
    e = edges.select(F.col("project_id").cast("long"), *(F.substring(c, 2, 20).cast("long").alias(c) for c in ("src", "dst")), "op")
    bad = errors.groupBy("project_id").count().select(F.col("project_id").cast("long"), F.lit(-1).cast("long").alias("src"), F.lit(-1).cast("long").alias("dst"), F.concat(F.lit("errors "), "count").alias("op"))
    return e.unionByName(bad)


def q_journal_nodes(spark, d):
    _, nodes, _, _ = _journals(spark, d)
    return nodes.select(F.col("project_id").cast("long"), F.substring("node_id", 2, 20).cast("long").alias("node_id"), "pos", "file", F.col("ctime").cast("date").cast("string").alias("day"))


def q_edges_csv(spark, d):
    path = _folder(spark)
    # A chosen column may be a path or a function of the edge.
    source.edges_to_csv(wide_edges(spark, d), {"purpose": "arguments.purpose", "kind": F.upper("media_type")}, path, F.col("op") != "Donor")
    return spark.read.csv(path, schema="project_id long, src long, dst long, op string, purpose string, kind string").na.fill("")


def q_nodes_csv(spark, d):
    path = _folder(spark)
    n = view(spark, d, "nodes").select("project_id", "node_id", F.lit("interim").alias("nodetype"), F.lit(None).cast("string").alias("filetype"), "file", F.create_map(F.lit("code"), "code").alias("attrs"))
    source.nodes_to_csv(n, {"code": "attrs.code"}, path, F.col("r") > 2 if "r" in n.columns else None)
    return spark.read.csv(path, schema="project_id long, node_id long, nodetype string, filetype string, file string, code string").na.fill("")


def _probes(spark, d):
    s = view(spark, d, "segments").groupBy(F.col("set_id").alias("dst")).agg(F.array_sort(F.collect_list(F.struct("type", "startframe", "endframe"))).alias("target_segments"))
    p = q_probe_summary(spark, d).join(s, "dst", "left")
    return p.withColumn("donor_segments", F.when(F.pmod("dst", F.lit(3)) == 0, F.slice("target_segments", 1, 1)))


def q_probes_csv(spark, d):
    path = _folder(spark)
    source.probes_to_csv(_probes(spark, d), path)
    rows = spark.read.csv(path, schema="project_id long, src long, dst long, final long, base long, level long, kind string, type string, startframe long, endframe long")
    return rows.groupBy("project_id", "final", "kind").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("endframe"), F.lit(0)).alias("frames"))


def q_probes_json(spark, d):
    p = _probes(spark, d)
    back = source.probes_from_json(source.probes_to_json(p), p.schema)
    return back.select("project_id", "src", "dst", "final", "base", "level", F.coalesce(F.size("target_segments"), F.lit(0)).alias("segments"), F.coalesce(F.get("donor_segments", F.lit(0))["endframe"], F.lit(-1)).alias("donor_end"))


def q_report(spark, d):
    path = _folder(spark)
    source.write_error_report(q_node_rules_messages(spark, d), path)
    back = spark.read.csv(path, sep=" ", quote="|", schema="project_id long, severity int, start long, end long, module string, message string")
    return back.groupBy("project_id", "severity", "message").agg(F.count(F.lit(1)).alias("n"))


def q_software(spark, d):
    path = _folder(spark)
    line = "concat_ws(',', case p_size % 7 when 0 then 'both' when 1 then 'all' when 2 then 'audio' when 3 then 'IMAGE' when 4 then 'bad' else 'video' end, p_brand, if(p_size % 9 = 0, null, concat(' ', p_partkey)), if(p_size % 2 = 0, '1.0', null), if(p_size % 4 = 0, '2.0', null))"
    spark.read.parquet(f"{d}/part.parquet").selectExpr(f"{line} as value").write.text(path)
    good, bad = source.read_software(spark, path)
    return good.select("type", "category", "name", F.coalesce("version", F.lit("-")).alias("version")).unionByName(bad.select(F.lit("line").alias("type"), F.lit("").alias("category"), F.col("value").alias("name"), F.lit("").alias("version")))


def q_operations(spark, d):
    path = _folder(spark)
    used = view(spark, d, "edges").select("op").distinct().join(view(spark, d, "operations"), "op")
    param = lambda name: F.create_map(F.lit(name), F.create_map(F.lit("type"), F.lit("yesno")))
    own = used.select(F.col("op").alias("name"), "category", F.array("rule").alias("rules"), param("a").alias("mandatoryparameters"))
    child = used.where("op <> 'Donor'").select(F.concat(F.lit("My"), "op", F.lit("::"), "op").alias("name"), F.when(F.length("op") % 2 == 0, "Own").alias("category"), F.lit(None).cast("array<string>").alias("rules"), param("b").alias("mandatoryparameters"))
    # The dictionary of the operations in use is one JSON value.
    own.unionByName(child).agg(F.collect_list(F.struct("*")).alias("operations")).select(F.to_json(F.struct("operations")).alias("value")).write.text(path)
    o = source.read_operations(spark, path)
    return o.select("op", F.coalesce("parent", F.lit("-")).alias("parent"), "category", F.array_join("rules", ",").alias("rules"), F.array_join(F.array_sort(F.map_keys("mandatoryparameters")), ",").alias("params"))


def q_properties(spark, d):
    path, out = _folder(spark), _folder(spark)
    used = view(spark, d, "edges").select("op").distinct()
    one = used.select(F.concat(F.lit("has"), "op").alias("name"), F.col("op").alias("operation"), F.lit(None).cast("array<string>").alias("operations"), F.when(F.length("op") % 2 == 0, True).alias("node"))
    two = used.groupBy(F.concat(F.lit("len"), F.length("op")).alias("name")).agg(F.lit(None).cast("string").alias("operation"), F.array_sort(F.collect_list("op")).alias("operations"), F.lit(None).cast("boolean").alias("node"))
    one.unionByName(two).agg(F.collect_list(F.struct("*")).alias("properties")).select(F.to_json(F.struct("properties")).alias("value")).write.text(path)
    source.properties_to_csv(source.read_properties(spark, path), out)
    return spark.read.csv(out, schema="name string, level string, operations string, parameter string, value string, rule string, includedonors boolean").na.fill("")


def q_qtables(spark, d):
    path = _folder(spark)
    # Written as one file a medium, named by its label.
    v = spark.read.parquet(f"{d}/embeddings.parquet").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("a"), F.max_by("embedding", "vec_id").alias("b"))
    number = lambda x: F.floor(F.abs(x.cast("double")) * 100).cast("string")
    v = v.select("label", F.transform(F.concat("a", F.when(F.col("label") % 4 > 0, F.col("b")).otherwise(F.slice("b", 1, 9))), number).alias("n"))
    v.select(F.concat(F.lit("M"), F.col("label")).alias("file"), F.array_join("n", "\t").alias("value")).write.partitionBy("file").text(path)
    good, bad = source.read_qtables(spark, path, recursive=True)
    key = F.regexp_extract("path", "file=M([0-9]+)", 1).cast("long").alias("label")
    rows = good.select(key, F.array_join(F.slice("luma", 1, 3), ",").alias("luma"), F.array_join(F.slice("chroma", 62, 3), ",").alias("chroma"))
    return rows.unionByName(bad.select(key, F.concat(F.lit("size "), "n").alias("luma"), F.lit("").alias("chroma")))


#: Slices of time in which the events arrive, and files of a batch.
SLICES, FILES = 8, 16


def q_sessions(spark, d):
    """T1 over the events as a stream of files, run until all that is there has been read."""
    path, out = _folder(spark), _folder(spark)
    f = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("media_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").isin("error", "click").alias("changed"))
    # The files arrive a slice of time after the other and in any order within one, so no row is later than a slice is wide.
    first, last = f.agg(F.min("ts"), F.max("ts")).first()
    width = 1 if first is None else int((last - first).total_seconds()) // SLICES + 1
    start = lambda i: F.lit(first) + F.make_dt_interval(secs=F.lit(width * i))
    for i in range(SLICES if first is not None else 0):
        f.where((F.col("ts") >= start(i)) & (F.col("ts") < start(i + 1))).write.mode("append").parquet(path)
    # A last row far later lets the watermark pass every session.
    f.agg((F.max("ts") + F.make_dt_interval(F.lit(2), secs=F.lit(width))).alias("ts")).select(F.lit(-1).cast("long").alias("media_id"), "ts", F.lit(True).alias("changed")).write.mode("append").parquet(path)
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", FILES).parquet(path)
    query = streaming.change_sessions(stream.select(F.col("media_id").cast("long"), "ts", "changed"), "6 hours", f"{width} seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("media_id long, start timestamp, stop timestamp, frames long").parquet(out).select("media_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "frames")


def q_intake(spark, d):
    """Journals arrive as files, twice; those in the done list are not validated again."""
    path, done, report = _folder(spark), _folder(spark), _folder(spark)
    j = view(spark, d, "journals")
    names = j.where("project_id % 4 > 0").select("username")
    j.write.parquet(path)
    j.where("project_id % 3 = 0").write.mode("append").parquet(path)
    for checkpoint in (_folder(spark), _folder(spark)):  # the second run starts over and finds all done
        stream = spark.readStream.schema(j.schema).option("maxFilesPerTrigger", 1).parquet(path)
        streaming.intake(stream, "project_id", done, report, lambda b: rules.user_rules(b, names).dropDuplicates(["project_id"]), checkpoint).awaitTermination()
        path_done = spark.read.parquet(done)
    return spark.read.parquet(report).groupBy("project_id", "message").agg(F.count(F.lit(1)).alias("n")).join(path_done.select("project_id").distinct(), "project_id", "left_semi")


QUERIES = {
    "journal_edges": q_journal_edges, "journal_nodes": q_journal_nodes, "edges_csv": q_edges_csv, "nodes_csv": q_nodes_csv, "probes_csv": q_probes_csv, "probes_json": q_probes_json, "error_report": q_report,
    "software_list": q_software, "operation_dictionary": q_operations, "property_dictionary": q_properties, "quantization_tables": q_qtables, "change_sessions": q_sessions, "journal_intake": q_intake,
}

_NE = with_views("nodes", "edges")
_RANK = "row_number() OVER (PARTITION BY project_id ORDER BY n)"


def _probe_sql(body: str) -> str:
    from .lineage_queries import PSUM, PV, _sql

    return _sql(PSUM, body, *PV, "segments")


_KINDS = "CASE p_size % 7 WHEN 0 THEN ['image', 'video', 'zip'] WHEN 1 THEN ['image', 'video', 'audio', 'zip'] WHEN 2 THEN ['video', 'audio'] WHEN 3 THEN ['image'] WHEN 4 THEN [] ELSE ['video'] END"
_SW = "SELECT *, CASE p_size % 7 WHEN 0 THEN 'both' WHEN 1 THEN 'all' WHEN 2 THEN 'audio' WHEN 3 THEN 'IMAGE' WHEN 4 THEN 'bad' ELSE 'video' END AS kind, list_filter([CASE WHEN p_size % 2 = 0 THEN '1.0' END, CASE WHEN p_size % 4 = 0 THEN '2.0' END], lambda x: x IS NOT NULL) AS vs FROM part"

ORACLES = {
    "journal_edges": f"""{_NE}, e AS (SELECT e.*, b.r AS rb FROM edges e JOIN nodes b ON b.project_id = e.project_id AND b.node_id = e.dst)
SELECT project_id, src, dst, op FROM e WHERE NOT (project_id % 11 = 0 AND rb = 2) UNION ALL SELECT project_id, -1, -1, concat('errors ', count(*)) FROM e WHERE project_id % 11 = 0 AND rb = 2 GROUP BY 1""",
    "journal_nodes": f"{_NE} SELECT project_id, node_id, (r - 1)::INT AS pos, file, ctime::DATE::VARCHAR AS day FROM nodes",
    "edges_csv": f"{with_views('wide')} SELECT project_id, src, dst, op, coalesce(purpose, '') AS purpose, upper(media_type) AS kind FROM wide WHERE op <> 'Donor'",
    "nodes_csv": f"{_NE} SELECT project_id, node_id, 'interim' AS nodetype, '' AS filetype, file, code FROM nodes",
    "probes_csv": _probe_sql("""SELECT project_id, final, 'summary' AS kind, count(*) AS n, 0 AS frames FROM ps GROUP BY 1, 2
UNION ALL SELECT project_id, final, 'target_segment', count(*), sum(endframe)::BIGINT FROM ps JOIN segments s ON s.set_id = ps.dst GROUP BY 1, 2
UNION ALL SELECT project_id, final, 'donor_segment', count(*), sum(m[3])::BIGINT FROM ps JOIN (SELECT set_id, min(ROW(type, startframe, endframe)) AS m FROM segments GROUP BY 1) s ON s.set_id = ps.dst WHERE ps.dst % 3 = 0 GROUP BY 1, 2"""),
    "probes_json": _probe_sql("""SELECT project_id, src, dst, final, base, level, coalesce(n, 0)::INT AS segments, CASE WHEN dst % 3 = 0 THEN coalesce(m[3], -1) ELSE -1 END AS donor_end
FROM ps LEFT JOIN (SELECT set_id, count(*) AS n, min(ROW(type, startframe, endframe)) AS m FROM segments GROUP BY 1) s ON s.set_id = ps.dst"""),
    "software_list": f"""WITH p AS ({_SW}) SELECT unnest({_KINDS}) AS type, p_brand AS category, p_partkey::VARCHAR AS name, unnest_v AS version FROM (SELECT *, unnest(CASE WHEN len(vs) = 0 THEN ['-'] ELSE vs END) AS unnest_v FROM p WHERE p_size % 9 > 0 AND p_size % 7 <> 4)
UNION ALL SELECT unnest({_KINDS}), p_brand, vs[1], '-' FROM p WHERE p_size % 9 = 0 AND p_size % 7 <> 4 AND len(vs) = 1 UNION ALL SELECT unnest({_KINDS}), p_brand, vs[1], vs[2] FROM p WHERE p_size % 9 = 0 AND p_size % 7 <> 4 AND len(vs) = 2
UNION ALL SELECT 'line', '', concat_ws(',', kind, p_brand, CASE WHEN p_size % 9 > 0 THEN concat(' ', p_partkey) END, CASE WHEN len(vs) > 0 THEN array_to_string(vs, ',') END), '' FROM p WHERE p_size % 7 = 4 OR (p_size % 9 = 0 AND len(vs) = 0)""",
    "operation_dictionary": f"""{with_views('edges', 'operations')}, u AS (SELECT * FROM operations WHERE op IN (SELECT op FROM edges))
SELECT op, '-' AS parent, category, rule AS rules, 'a' AS params FROM u UNION ALL SELECT concat('My', op), op, CASE WHEN length(op) % 2 = 0 THEN 'Own' ELSE category END, rule, 'a,b' FROM u WHERE op <> 'Donor'""",
    "property_dictionary": f"""{_NE}, u AS (SELECT DISTINCT op FROM edges)
SELECT concat('has', op) AS name, CASE WHEN length(op) % 2 = 0 THEN 'node' ELSE 'project' END AS level, op AS operations, '' AS parameter, '' AS value, '' AS rule, false AS includedonors FROM u
UNION ALL SELECT concat('len', length(op)), 'project', string_agg(op, ' ' ORDER BY op), '', '', '', false FROM u GROUP BY length(op)""",
    "quantization_tables": """WITH v AS (SELECT label::BIGINT AS label, list_transform(arg_min(embedding, vec_id), lambda x: floor(abs(x::DOUBLE) * 100)::BIGINT) AS a, list_transform(arg_max(embedding, vec_id), lambda x: floor(abs(x::DOUBLE) * 100)::BIGINT) AS b FROM embeddings GROUP BY 1)
SELECT label, array_to_string(a[1:3], ',') AS luma, array_to_string(b[62:64], ',') AS chroma FROM v WHERE label % 4 > 0 UNION ALL SELECT label, 'size 73', '' FROM v WHERE label % 4 = 0""",
    "change_sessions": """WITH c AS (SELECT user_id AS media_id, ts::TIMESTAMP AS ts FROM events WHERE event_type IN ('error', 'click')), n AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw FROM c WINDOW w AS (PARTITION BY media_id ORDER BY ts)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY media_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM n) SELECT media_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS frames FROM s GROUP BY media_id, k""",
    "journal_intake": f"{with_views('journals')} SELECT project_id, concat('unknown user ', username) AS message, 1 AS n FROM journals WHERE project_id % 4 = 0",
}


def _report() -> str:
    from .lineage_queries import _NODE_MESSAGES, _sql

    return _sql(_NODE_MESSAGES, "SELECT project_id, severity, message, count(*) AS n FROM m GROUP BY 1, 2, 3")


ORACLES["error_report"] = _report()
