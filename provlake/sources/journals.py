"""Reading and writing journals, dictionaries, tables and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provlake.functions.scalars import path_value

LINK = T.StructType([T.StructField(n, t) for n, t in (("source", T.StringType()), ("target", T.StringType()), ("op", T.StringType()), ("description", T.StringType()), ("softwareName", T.StringType()), ("softwareVersion", T.StringType()), ("username", T.StringType()), ("maskname", T.StringType()), ("recordMaskInComposite", T.StringType()), ("arguments", T.MapType(T.StringType(), T.StringType())), ("semanticGroups", T.ArrayType(T.StringType())))])
NODE = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "file", "nodetype", "filetype", "ctime")])
GRAPH = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "projecttype", "username", "creator", "organization", "createtime", "updatetime", "igversion")] + [T.StructField("jt_upgrades", T.ArrayType(T.StringType()))])
JOURNAL = T.StructType([T.StructField("graph", GRAPH), T.StructField("nodes", T.ArrayType(NODE)), T.StructField("links", T.ArrayType(LINK))])


def read_journals(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """IO1: node-link JSON files (or one journal a line) as (journals, nodes, edges, errors). Link ends are ids or positions (an
    end that could be both is an id); an end that is neither is an error row."""
    raw = spark.read.schema(JOURNAL).json(path, multiLine=multi_line).withColumn("path", F.input_file_name())
    raw = raw.withColumn("project_id", F.coalesce("graph.name", "path"))
    journals = raw.select("project_id", "path", "graph.*")
    nodes = raw.select("project_id", F.posexplode("nodes").alias("pos", "n")).select("project_id", "pos", F.col("n.id").alias("node_id"), "n.file", "n.nodetype", "n.filetype", F.to_timestamp("n.ctime").alias("ctime"))
    links = raw.select("project_id", F.posexplode("links").alias("link_no", "l")).select("project_id", "link_no", "l.*")
    ids, places = nodes.select("project_id", F.col("node_id").alias("k"), "node_id", F.lit(0).alias("_r")), nodes.select("project_id", F.col("pos").cast("string").alias("k"), "node_id", F.lit(1).alias("_r"))
    keys = ids.unionByName(places).groupBy("project_id", "k").agg(F.min_by("node_id", F.struct("_r", "node_id")).alias("node_id"))
    edges = links.join(keys.toDF("project_id", "source", "src"), ["project_id", "source"], "left").join(keys.toDF("project_id", "target", "dst"), ["project_id", "target"], "left")
    bad = (F.col("src").isNull()) | (F.col("dst").isNull())
    errors = edges.where(bad).select("project_id", "link_no", F.lit("link end is not a node").alias("message"))
    return journals, nodes, edges.where(~bad).drop("source", "target"), errors


def edges_to_csv(edges: DataFrame, columns: dict[str, str | Column], path: str | None = None, where: Column | None = None) -> DataFrame:
    """IO4, E2: project_id, src, dst, op and chosen columns (dotted paths or Column functions), '' where absent; written if a path is given."""
    picked = [F.coalesce((_path(edges, c) if isinstance(c, str) else c).cast("string"), F.lit("")).alias(n) for n, c in columns.items()]
    out = (edges if where is None else edges.where(where)).select("project_id", "src", "dst", "op", *picked)
    if path:
        out.write.csv(path)
    return out


def nodes_to_csv(nodes: DataFrame, columns: dict[str, str | Column], path: str | None = None, where: Column | None = None) -> DataFrame:
    """IO5: project_id, node_id, nodetype, filetype, file and chosen columns."""
    picked = [F.coalesce((_path(nodes, c) if isinstance(c, str) else c).cast("string"), F.lit("")).alias(n) for n, c in columns.items()]
    out = (nodes if where is None else nodes.where(where)).select("project_id", "node_id", "nodetype", "filetype", "file", *picked)
    if path:
        out.write.csv(path)
    return out


def _path(df: DataFrame, path: str) -> Column:
    head, _, rest = path.partition(".")
    name, _, index = head.partition("[")
    column = F.col(name)
    if index:
        column = F.get(column, F.lit(int(index.rstrip("]"))))
    return path_value(column, rest) if rest else column


def probes_to_csv(probes: DataFrame, path: str | None = None) -> DataFrame:
    """IO6: one `summary` row a probe, then its donor and target segments (arrays donor_segments, target_segments), blanks where absent."""
    key = [c for c in ("project_id", "src", "dst", "final", "base", "donor_base", "level") if c in probes.columns]
    seg = ["type", "startframe", "endframe"]
    # All rows of a probe are told at once, so that probes are made once.
    row = lambda kind, *values: F.struct(F.lit(kind).alias("kind"), *(v.cast("string").alias(c) for c, v in zip(seg, values)))
    parts = lambda kind: F.coalesce(F.transform(f"{kind}s", lambda s: row(kind, *(s[c] for c in seg))), F.array())
    told = F.concat(F.array(row("summary", *[F.lit(None)] * 3)), parts("donor_segment"), parts("target_segment"))
    rows = probes.select(*key, F.explode(told).alias("_r")).select(*key, "_r.*")
    if path:
        rows.write.csv(path)
    return rows


def write_error_report(messages: DataFrame, path: str) -> None:
    """IO7: space-delimited rows with the pipe as quote."""
    messages.select("project_id", "severity", "start", "end", "module", "message").write.csv(path, sep=" ", quote="|")


def probes_to_json(probes: DataFrame) -> DataFrame:
    """IO8: one JSON text a probe."""
    return probes.select(F.to_json(F.struct(*probes.columns)).alias("value"))


def probes_from_json(text: DataFrame, schema: T.StructType) -> DataFrame:
    """IO8: the inverse of probes_to_json."""
    return text.select(F.from_json("value", schema).alias("p")).select("p.*")


# What a software list's type words stand for.
SOFTWARE_TYPES = {"both": ("image", "video", "zip"), "all": ("image", "video", "audio", "zip"), "audio": ("video", "audio"), "image": ("image",), "video": ("video",), "zip": ("zip",)}


def read_software(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """IO9: ragged rows type,category,name,version… as (software(type, category, name, version), bad lines)."""
    types = F.create_map(*[x for k, v in SOFTWARE_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = spark.read.text(path).where(F.trim("value") != "").withColumn("p", F.transform(F.split("value", ","), lambda x: F.trim(x)))
    rows = rows.withColumn("t", F.try_element_at(types, F.lower(F.get("p", F.lit(0)))))
    good = F.col("t").isNotNull() & (F.size("p") >= 3)
    versions = F.filter(F.slice("p", 4, F.greatest(F.size("p"), F.lit(1))), lambda v: v != "")
    out = rows.where(good).select(F.explode("t").alias("type"), F.get("p", F.lit(1)).alias("category"), F.get("p", F.lit(2)).alias("name"), F.explode_outer(versions).alias("version"))
    return out, rows.where(~good | F.col("t").isNull()).select("value")


OPERATION = T.StructType([T.StructField("name", T.StringType()), T.StructField("category", T.StringType()), T.StructField("generateMask", T.StringType()), T.StructField("deprecated", T.BooleanType()), T.StructField("rules", T.ArrayType(T.StringType())), T.StructField("transitions", T.ArrayType(T.StringType())), T.StructField("mandatoryparameters", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))), T.StructField("optionalparameters", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))])


def read_operations(spark: SparkSession, path: str) -> DataFrame:
    """IO10: the operation dictionary; `A::B` is A with the fields of B that A lacks, parameter maps merged."""
    raw = spark.read.schema(T.StructType([T.StructField("operations", T.ArrayType(OPERATION))])).json(path, multiLine=True).select(F.explode("operations").alias("o")).select("o.*")
    own = raw.withColumn("parent", F.nullif(F.regexp_extract("name", "::(.+)$", 1), F.lit(""))).withColumn("op", F.regexp_extract("name", "^(.+?)(::|$)", 1))
    parent = raw.select(F.col("name").alias("parent"), *[F.col(c).alias(f"_{c}") for c in raw.columns if c != "name"])
    j = own.join(parent, "parent", "left")
    cols = []
    for f in OPERATION.fields[1:]:
        a, b = F.col(f.name), F.col(f"_{f.name}")
        cols.append((_merged(a, b) if isinstance(f.dataType, T.MapType) else F.coalesce(a, b)).alias(f.name))
    return j.select("op", "parent", *cols)


def _merged(own: Column, parent: Column) -> Column:
    rest = F.map_filter(parent, lambda k, v: ~F.map_contains_key(own, k))
    return F.when(own.isNull(), parent).when(parent.isNull(), own).otherwise(F.map_concat(rest, own))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """IO11: the property dictionary (name, operations, parameter, value, rule, includedonors); one `operation` is a list of one."""
    p = T.StructType([T.StructField("name", T.StringType()), T.StructField("operation", T.StringType()), T.StructField("operations", T.ArrayType(T.StringType())), T.StructField("parameter", T.StringType()), T.StructField("value", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("node", T.BooleanType()), T.StructField("includedonors", T.BooleanType())])
    raw = spark.read.schema(T.StructType([T.StructField("properties", T.ArrayType(p))])).json(path, multiLine=True).select(F.explode("properties").alias("p")).select("p.*")
    one = F.when(F.col("operation").isNotNull(), F.array("operation")).otherwise(F.array().cast("array<string>"))
    return raw.withColumn("operations", F.coalesce("operations", one)).drop("operation").na.fill({"node": False, "includedonors": False})


def properties_to_csv(properties: DataFrame, path: str) -> None:
    """IO11: name, level (node or project), operations (blank-separated), parameter, value, rule, includedonors."""
    level = F.when(F.col("node"), "node").otherwise("project")
    properties.select("name", level.alias("level"), F.array_join("operations", " ").alias("operations"), "parameter", "value", "rule", "includedonors").write.csv(path)


def frame_hashes(frames: DataFrame) -> DataFrame:
    """IO12: (media_id, frame_no, hash)."""
    return frames.select("media_id", "frame_no", F.sha2("pixels", 256).alias("hash"))


def read_qtables(spark: SparkSession, path: str, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """IO13: texts of 16 rows by 8 numbers as (path, file, make, model, luma, chroma), and the files of another size (path, file, n)."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive).select(F.input_file_name().alias("path"), F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.transform(F.regexp_extract_all("value", F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int")).alias("n"))
    good = F.size("n") == 128
    parts = F.split("file", "-")
    return raw.where(good).select("path", "file", F.get(parts, F.lit(0)).alias("make"), F.get(parts, F.lit(1)).alias("model"), F.slice("n", 1, 64).alias("luma"), F.slice("n", 65, 64).alias("chroma")), raw.where(~good).select("path", "file", F.size("n").alias("n"))
