"""Validation rules: each is a function of the tables that returns messages (project_id, severity, start, end, module, message)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions.scalars import file_type, suffix, time_to_ms, valid_coordinates, valid_time
from provlake.functions.storage import picked, written

from . import lineage
from .segments import from_constraints

P = "project_id"
INFO, WARNING, ERROR, CRITICAL = 1, 2, 3, 4
#: Named rules that the operation dictionary may refer to.
REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = f
        return f

    return keep


def messages(df: DataFrame, severity: int, module: str, message: Column | str, start: str = "src", end: str = "dst") -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return df.select(P, F.lit(severity).alias("severity"), F.col(start).alias("start"), F.col(end).alias("end"), F.lit(module).alias("module"), text.alias("message"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def told(df: DataFrame, rules: list[tuple[Column, int, str, Column | str]], start: str = "src", end: str = "dst") -> DataFrame:
    """The messages of several rules (condition, severity, module, message) over the same rows, which are made once for all of them; a rule's
    message is told where its condition is true."""
    text = lambda m: F.lit(m) if isinstance(m, str) else m
    each = [F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(module).alias("module"), text(message).alias("message"))) for when, severity, module, message in rules]
    rows = df.select(P, F.col(start).alias("start"), F.col(end).alias("end"), F.explode(F.array_compact(F.array(*each))).alias("_m"))
    return rows.select(P, "_m.severity", "start", "end", "_m.module", "_m.message")


def graph_rules(nodes: DataFrame, edges: DataFrame, journals: DataFrame | None = None, current: str | None = None) -> DataFrame:
    """Isolated nodes, nodes with a donor as their only predecessor, parts apart from the rest, a journal's cycles (at the smallest node that
    lies on one), repeated final files; with journals (project_id, version, jt_upgrades) those of another version than the current one or
    not upgraded to their own, without a node."""
    # Both are read by every rule, and the degrees by three.
    nodes, edges = written(picked(nodes, P, "node_id", "file")), written(picked(edges, P, "src", "dst", "op"))
    d = written(lineage.degrees(nodes, edges))
    at = {"start": "node_id", "end": "node_id"}
    isolated = messages(d.where("n_in + n_out = 0"), ERROR, "graph", "is not connected to other nodes", **at)
    donor = messages(d.where("n_in = 1 and n_in_plain = 0"), ERROR, "graph", "has a donor but no other predecessor", **at)
    parts = written(lineage.components(nodes, edges))
    many = parts.groupBy(P).agg(F.min("component").alias("_main"), F.count_distinct("component").alias("_n")).where("_n > 1")
    apart = parts.where("component = node_id").join(many, P).where("component <> _main").select(P, "node_id")
    cycle = messages(lineage.cycle_nodes(nodes, edges).groupBy(P).agg(F.min("node_id").alias("node_id")), ERROR, "graph", "has a cycle", **at)
    finals = nodes.join(d.where("n_out = 0").select(P, "node_id"), [P, "node_id"], "left_semi")
    twice = finals.withColumn("_k", F.expr("count(*) over (partition by project_id, file)")).where("_k > 1")
    found = [isolated, donor, messages(apart, ERROR, "graph", "is part of a separate graph", **at), cycle, messages(twice, ERROR, "graph", "repeats another final file", **at)]
    if journals is not None:
        fresh = F.coalesce(F.array_contains("jt_upgrades", F.col("version")), F.lit(False)) & F.col("version").eqNullSafe(F.lit(current))
        found.append(messages(journals.where(~fresh).withColumn("node_id", F.lit(None).cast(nodes.schema["node_id"].dataType)), ERROR, "graph", "journal is not upgraded", **at))
    return union(found)


def node_rules(nodes: DataFrame, edges: DataFrame, listing: DataFrame | None = None, provenance: bool = False) -> DataFrame:
    """R2: bad characters in a file name, suffix not lower case, final not named by its MD5 or hidden by a proxy (where nodes have a
    proxyfile), more than one base, file not in the listing."""
    at = {"start": "node_id", "end": "node_id"}
    out = [
        messages(nodes.where(F.col("file").rlike(r"[^A-Za-z0-9_.\-/ ]")), ERROR, "node", "file name has bad characters", **at),
        messages(nodes.where(F.regexp_extract("file", r"\.([^./]+)$", 1) != suffix(F.col("file"))), WARNING, "node", "suffix is not lower case", **at),
    ]
    labels = lineage.label_nodes(nodes, edges)
    finals = nodes.join(labels.where("label = 'final'"), [P, "node_id"], "left_semi")
    out.append(messages(finals.where(~F.col("file").rlike(r"(^|/)[0-9a-f]{32}\.[^.]+$")), WARNING, "node", "final is not named by its MD5", **at))
    if "proxyfile" in nodes.columns:
        out.append(messages(finals.where("proxyfile is not null"), ERROR, "node", "final is hidden by a proxy", **at))
    if not provenance:
        bases = labels.where("label = 'base'").withColumn("_k", F.expr("count(*) over (partition by project_id)"))
        out.append(messages(bases.where("_k > 1"), ERROR, "node", "is one of several bases", **at))
    if listing is not None:
        out.append(messages(nodes.join(listing.select("file").distinct(), "file", "left_anti"), ERROR, "node", "file is missing", **at))
    return union(out)


def edge_dictionary_rules(edges: DataFrame, operations: DataFrame, software: DataFrame | None = None) -> DataFrame:
    """Operations that the dictionary lacks, recorded errors, software versions that are not approved."""
    out = [messages(edges.join(operations.select("op"), "op", "left_anti"), ERROR, "dictionary", F.concat(F.lit("unknown operation "), F.col("op")))]
    if "errors" in edges.columns:
        out.append(messages(edges.where(F.size("errors") > 0), ERROR, "dictionary", F.concat(F.lit("recorded: "), F.array_join("errors", "; "))))
    if software is not None:
        ok = software.select(F.col("name").alias("softwareName"), F.col("version").alias("softwareVersion")).distinct()
        out.append(messages(edges.where("softwareName is not null").join(ok, ["softwareName", "softwareVersion"], "left_anti"), WARNING, "dictionary", "version is not approved"))
    return union(out)


def version_approvals(edges: DataFrame, software: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """edges (softwareName, softwareVersion) with approved: the version, by the mapping (name, found, version: what a version text
    contains and stands for) if one fits, else by its first two numbers, is one of the software's (name, version)."""
    from provlake.functions.scalars import version_stem

    e = edges.withColumn("_v", version_stem(F.col("softwareVersion")))
    if mapping is not None:
        # A software's few entries are one list.
        known = mapping.groupBy(F.col("name").alias("softwareName")).agg(F.array_sort(F.collect_list(F.struct("found", "version"))).alias("_m"))
        e = e.join(known, "softwareName", "left")
        fits = F.get(F.filter("_m", lambda m: F.col("softwareVersion").contains(m.found)), F.lit(0)).version
        e = e.withColumn("_v", F.coalesce(fits, F.col("_v"))).drop("_m")
    ok = software.select(F.col("name").alias("softwareName"), version_stem(F.col("version")).alias("_v"), F.lit(True).alias("approved")).distinct()
    return e.join(ok, ["softwareName", "_v"], "left").withColumn("approved", F.coalesce("approved", F.lit(False))).drop("_v")


def mandatory_rules(edges: DataFrame, params: DataFrame) -> DataFrame:
    """Params (op, name, mandatory, source, needed_by, needed_value): arguments that an edge (arguments, src_type, inputmaskname) lacks.

    A mandatory one counts if its source is null or the type of the edge's source; an optional one if another argument (needed_by)
    has the value that requires it. `inputmaskname` is an attribute of the edge itself.
    """
    j = edges.join(params, "op")
    value = F.when(F.col("name") == "inputmaskname", F.col("inputmaskname")).otherwise(F.try_element_at("arguments", F.col("name")))
    lacks = j.where(F.coalesce(value, F.lit("")) == "")
    here = F.col("source").isNull() | (F.col("source") == F.col("src_type"))
    asked = F.coalesce(F.try_element_at("arguments", F.col("needed_by")) == F.col("needed_value"), F.lit(False))
    return messages(lacks.where(F.when(F.col("mandatory"), here).otherwise(asked)), ERROR, "mandatory", F.concat(F.lit("missing "), F.col("name")))


def argument_ok(kind: Column, value: Column) -> Column:
    """Does a value fit int[a:b], float[a:b], time, frame_or_time, yesno, coordinates or list:x,y?"""
    lo = F.regexp_extract(kind, r"\[(-?[\d.]+):", 1).try_cast("double")
    hi = F.regexp_extract(kind, r":(-?[\d.]+)\]", 1).try_cast("double")
    number = value.try_cast("double")
    inside = (lo.isNull() | (number >= lo)) & (hi.isNull() | (number <= hi))
    ok = (
        F.when(kind.startswith("int"), value.rlike(r"^-?\d+$") & inside)
        .when(kind.startswith("float"), number.isNotNull() & inside)
        .when(kind == "time", valid_time(value))
        .when(kind == "frame_or_time", valid_time(value) | value.rlike(r"^\d+$"))
        .when(kind == "yesno", F.lower(value).isin("yes", "no"))
        .when(kind == "coordinates", valid_coordinates(value))
        .when(kind.startswith("list:"), F.array_contains(F.split(F.substring(kind, F.lit(6), F.length(kind)), ","), value))
        .otherwise(True)
    )
    return F.coalesce(ok, F.lit(False))


def argument_rules(edges: DataFrame, params: DataFrame) -> DataFrame:
    """Params (op, name, type): arguments that are there but do not fit their type."""
    rows = edges.select(P, "src", "dst", "op", F.explode("arguments").alias("name", "_v")).join(params.select("op", "name", "type"), ["op", "name"])
    return messages(rows.where(~argument_ok(F.col("type"), F.col("_v"))), ERROR, "argument", F.concat(F.lit("invalid "), F.col("name")))


def _with_media(edges: DataFrame, media: DataFrame) -> DataFrame:
    cols = ("frames", "rate", "duration_ms")
    a = media.select(P, F.col("node_id").alias("src"), *(F.col(c).alias(f"a_{c}") for c in cols))
    b = media.select(P, F.col("node_id").alias("dst"), *(F.col(c).alias(f"b_{c}") for c in cols))
    return edges.join(a, [P, "src"]).join(b, [P, "dst"])


@register("length")
def length_rules(edges: DataFrame, media: DataFrame) -> DataFrame:
    """Frame counts against the operation: cuts must shorten, inserts lengthen, filters keep the length."""
    e = _with_media(edges, media)
    return union([
        messages(e.where("op = 'DeleteFrames' and b_frames >= a_frames"), ERROR, "length", "is not shorter than its source"),
        messages(e.where("op = 'InsertFrames' and b_frames <= a_frames"), ERROR, "length", "is not longer than its source"),
        messages(e.where("op in ('Blur', 'ColorColorBalance') and b_frames <> a_frames"), ERROR, "length", "length has changed"),
    ])


@register("media")
def media_rules(edges: DataFrame, media: DataFrame, tolerance_ms: float = 100) -> DataFrame:
    """Rate changed by other than a warp, rate kept by a warp, duration off by more than the tolerance though the frames agree."""
    e = _with_media(edges, media).where("op <> 'Donor'")
    return union([
        messages(e.where("op <> 'TimeWarp' and a_rate <> b_rate"), WARNING, "media", "frame rate has changed"),
        messages(e.where("op = 'TimeWarp' and a_rate = b_rate"), WARNING, "media", "frame rate is unchanged"),
        messages(e.where(F.col("op").isin("AddAudio", "AudioSample") & (F.abs(F.col("a_duration_ms") - F.col("b_duration_ms")) > tolerance_ms)), ERROR, "media", "duration differs"),
    ])


@register("time")
def time_rules(edges: DataFrame, bounds: DataFrame, recorded: DataFrame, tolerance: int = 1, compat: bool = False) -> DataFrame:
    """Entered start (end) frames against the recorded segments' least start (greatest end). compat: the start is never compared."""
    j = edges.join(bounds.select(F.col("set_id").alias("dst"), "startframe", "endframe"), "dst").join(recorded.select(F.col("set_id").alias("dst"), "start", "stop"), "dst")
    out = [
        messages(j.where("startframe > endframe"), ERROR, "time", "start is after end"),
        messages(j.where(F.abs(F.col("endframe") - F.col("stop")) > tolerance), WARNING, "time", "end differs from the detected end"),
    ]
    if not compat:
        out.append(messages(j.where(F.abs(F.col("startframe") - F.col("start")) > tolerance), WARNING, "time", "start differs from the detected start"))
    return union(out)


def _entered(name: str) -> Column:
    """The time argument whose name ends so, the first by name."""
    keys = F.array_sort(F.filter(F.map_keys("arguments"), lambda k: k.endswith(name)))
    return time_to_ms(F.try_element_at("arguments", F.get(keys, F.lit(0))))


@register("entered_times")
def entered_time_rules(edges: DataFrame, recorded: DataFrame, frames: int = 1, ms: float = 100.0, compat: bool = False) -> DataFrame:
    """Times that were entered (arguments that end with Start Time or End Time) against the recorded segments: of video in frames,
    of sound in milliseconds; a start without any segment. edges: project_id, src, dst, media_type, rate, arguments; recorded: dst, type, start
    and stop (the least and the greatest frame). Only edges of sound and video count. compat: the start is never compared.
    """
    timed = F.exists(F.map_keys("arguments"), lambda k: k.endswith("Start Time") | k.endswith("End Time"))
    e = edges.where("media_type in ('audio', 'video')").where(timed).withColumns({"_s": _entered("Start Time"), "_e": _entered("End Time")})
    bound = from_constraints(F.col("_s"), F.col("_e"), F.col("rate"))
    e = e.withColumns({"_b": bound}).withColumns({"_start": F.when(F.col("_s").isNotNull(), F.col("_b.startframe")), "_stop": F.when(F.col("_e").isNotNull(), F.col("_b.endframe"))})
    # An edge without any segment meets one row of nulls: one join for all rules.
    e = e.select(P, "src", "dst", "rate", F.col("_s").isNotNull().alias("_timed"), "_start", "_stop")
    found = recorded.where("dst is not null").select("dst", "type", "start", "stop", F.lit(True).alias("_found"))
    j = e.join(found, "dst", "left")
    off = lambda entered, found: F.when(F.col("type") == "audio", F.abs(F.col(entered) - F.col(found)) * 1000 / F.col("rate") > ms).otherwise(F.abs(F.col(entered) - F.col(found)) > frames)
    what = F.when(F.col("type") == "audio", "time").otherwise("frame")
    differs = lambda end: F.concat(F.lit(f"{end} "), what, F.lit(f" differs from the detected {end}"))
    out = [(F.col("_found").isNull() & F.col("_timed"), ERROR, "entered_times", "change masks are missing"), (off("_stop", "stop"), WARNING, "entered_times", differs("end"))]
    if not compat:
        out.append((off("_start", "start"), WARNING, "entered_times", differs("start")))
    return told(j, out)


@register("audio_time_format")
def audio_time_format_rules(edges: DataFrame) -> DataFrame:
    """Start Time and End Time of sound that count frames; the end is told first, and alone."""
    frames = lambda name: F.coalesce(time_to_ms(F.try_element_at("arguments", F.lit(name))).frames, F.lit(0)) > 1
    e = edges.withColumns({"_e": frames("End Time"), "_s": frames("Start Time")})
    return told(e, [(F.col("_e"), ERROR, "audio_time_format", "end time has a frame number"), (F.col("_s") & ~F.col("_e"), ERROR, "audio_time_format", "start time has a frame number")])


@register("donor")
def donor_rules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Paste operations without a donor edge into their result."""
    donors = edges.where("op = 'Donor'").select(P, "dst").distinct()
    return messages(edges.where("op in ('PasteSplice', 'PasteFrames')").join(donors, [P, "dst"], "left_anti"), ERROR, "donor", "donor is missing")


@register("type")
def type_rules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """File types that differ between an edge's ends, and outputs with another suffix than their operation's."""
    kinds = nodes.select(P, "node_id", file_type(F.col("file")).alias("k"), suffix(F.col("file")).alias("s"))
    e = edges.join(kinds.toDF(P, "src", "k0", "s0"), [P, "src"]).join(kinds.toDF(P, "dst", "k1", "s1"), [P, "dst"])
    return union([
        messages(e.where("op <> 'Donor' and not op like 'Output%' and k0 <> k1"), ERROR, "type", "file type has changed"),
        messages(e.where("op like 'Output%' and s1 <> lower(substring(op, 7))"), ERROR, "type", "suffix does not fit the output"),
    ])


@register("composite")
def composite_rules(edges: DataFrame, operations: DataFrame) -> DataFrame:
    """Localized edges that are left out of the composite; edges have recordMaskInComposite (yes/no) and empty_mask."""
    e = edges.join(operations.select("op", "scope"), "op").where("scope = 'localized'")
    return union([
        messages(e.where("coalesce(recordMaskInComposite, 'no') <> 'yes'"), WARNING, "composite", "is not in the composite"),
        messages(e.where("coalesce(empty_mask, 'no') = 'yes'"), ERROR, "composite", "mask is empty"),
    ])


def user_rules(journals: DataFrame, names: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Journals, and edges (username) where they are given, whose user is not in the list of names."""
    known = names.select("username").distinct()
    text = F.concat(F.lit("unknown user "), F.col("username"))
    bad = journals.join(known, "username", "left_anti").withColumn("_n", F.lit(None).cast("long"))
    found = messages(bad, ERROR, "user", text, "_n", "_n")
    if edges is None:
        return found
    return found.unionByName(messages(edges.where("username is not null").join(known, "username", "left_anti"), ERROR, "user", text))


def registry_rules(nodes: DataFrame, edges: DataFrame, registry: DataFrame) -> DataFrame:
    """Bases that the media registry (file, project_id) lacks, and finals that it holds for another journal."""
    at = {"start": "node_id", "end": "node_id"}
    n = nodes.join(lineage.label_nodes(nodes, edges), [P, "node_id"])
    bases = n.where("label = 'base'").join(registry.select("file").distinct(), "file", "left_anti")
    other = registry.select("file", F.col(P).alias("_q")).distinct()
    used = n.where("label = 'final'").join(other, "file").where(F.col("_q") != F.col(P)).dropDuplicates([P, "node_id"])
    return union([messages(bases, ERROR, "registry", "base is not registered", **at), messages(used, ERROR, "registry", "final is used in another journal", **at)])


def property_rules(journals: DataFrame, names: list[str]) -> DataFrame:
    """Mandatory properties (in props) that are missing or shorter than 3 characters."""
    rows = journals.select(P, F.explode(F.array(*map(F.lit, names))).alias("_k"), "props").where(F.length(F.coalesce(F.try_element_at("props", F.col("_k")), F.lit(""))) < 3)
    rows = rows.withColumn("_n", F.lit(None).cast("long"))
    return messages(rows, ERROR, "property", F.concat(F.lit("property "), F.col("_k")), "_n", "_n")


def run_rules(found: DataFrame, edges: DataFrame, rules: DataFrame, isolated: bool = False) -> DataFrame:
    """Of the messages those whose module an edge's operation names; rules (op, rule), where `donor:x` is left out if isolated."""
    named = rules.where(~F.col("rule").startswith("donor:")) if isolated else rules
    named = named.select("op", F.regexp_replace("rule", "^donor:", "").alias("module")).distinct()
    of = edges.join(named, "op").select(P, F.col("src").alias("start"), F.col("dst").alias("end"), "module").distinct()
    return found.join(of, [P, "start", "end", "module"], "left_semi")


def sort_messages(found: DataFrame) -> DataFrame:
    """Severity downward, then start, end, module, message."""
    return found.orderBy(F.col("severity").desc(), "start", "end", "module", "message")


def has_errors(found: DataFrame) -> DataFrame:
    """(project_id, has_error, n_error, n_warning)."""
    return found.groupBy(P).agg(F.bool_or(F.col("severity") >= ERROR).alias("has_error"), F.count_if(F.col("severity") >= ERROR).alias("n_error"), F.count_if(F.col("severity") == WARNING).alias("n_warning"))


def remove_messages(found: DataFrame, selector: Column) -> DataFrame:
    """All but the selected messages."""
    return found.where(~F.coalesce(selector, F.lit(False)))
