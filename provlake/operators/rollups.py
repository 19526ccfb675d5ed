"""Roll-ups over edges, finals and journals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions.storage import picked, written

from . import lineage
from .groups import expand_groups

P = "project_id"

# Operations that make up each yes/no property of a final node.
ROLLUPS = {
    "blur": ("Blur",),
    "color": ("ColorColorBalance",),
    "clone": ("PasteSampled",),
    "splice": ("PasteSplice",),
    "frames_removed": ("DeleteFrames",),
    "frames_added": ("InsertFrames", "PasteFrames"),
    "audio": ("AddAudio", "DeleteAudio", "AudioSample"),
    "resized": ("TransformResize", "TransformCrop"),
    "time_warp": ("TimeWarp",),
}
SELECTION = ("SelectRegion", "SelectRegionFromFrames", "SelectImageFromFrames")


def final_edges(nodes: DataFrame, edges: DataFrame, exclude_donor: bool = False) -> DataFrame:
    """(project_id, final, src, dst, op): the closure that all roll-ups of finals use."""
    edges = written(picked(edges, P, "src", "dst", "op"))
    finals = lineage.ends(nodes, edges)
    return lineage.ancestor_edges(edges, finals, exclude_donor).withColumnRenamed("seed", "final")


def rule_rollups(closure: DataFrame) -> DataFrame:
    """A3: one yes/no column for each property of a final node, in one aggregate."""
    return closure.groupBy(P, "final").agg(*(F.bool_or(F.col("op").isin(*ops)).alias(k) for k, ops in ROLLUPS.items()))


def _has(prop) -> Column:
    """Does an edge (op, arguments, semanticGroups, media_type) give the property? By semantic group, or by operation and, if one is
    named, the value of its parameter; only edges of the property's media type count."""
    hit = F.lit(False)
    if prop["semanticgroup"]:
        hit = F.coalesce(F.array_contains("semanticGroups", prop["description"]), F.lit(False))
    if prop["operations"]:
        by_op = F.col("op").isin(*prop["operations"])
        if prop["parameter"] is not None:
            by_op &= F.coalesce(F.try_element_at("arguments", F.lit(prop["parameter"])) == F.lit(prop["value"]), F.lit(False))
        hit |= by_op
    if prop["nodetype"] is not None:
        hit &= F.coalesce(F.col("media_type") == prop["nodetype"], F.lit(False))
    return hit


def final_node_properties(closure: DataFrame, properties: DataFrame) -> DataFrame:
    """A1: (project_id, final, name, value): does an edge above the final give the property?

    closure: project_id, final, is_plain (the edge lies on a path without donors), op, arguments, semanticGroups, media_type, and the
    yes/no columns that properties name as their rule. properties (the dictionary): name, description, operations, parameter, value,
    nodetype, semanticgroup, includedonors, rule. Properties without includedonors look at plain edges; a rule counts where the
    rest says no. All are one aggregate over the closure.
    """
    rows = properties.collect()  # a dictionary
    exprs = []
    for p in rows:
        hit = _has(p)
        if p["rule"] is not None:
            hit |= F.coalesce(F.col(p["rule"]), F.lit(False))
        exprs.append(F.bool_or(hit & (F.lit(True) if p["includedonors"] else F.col("is_plain"))).alias(p["name"]))
    wide = closure.groupBy(P, "final").agg(*exprs)
    return wide.unpivot([P, "final"], [p["name"] for p in rows], "name", "value")


def _reached_nodes(edges: DataFrame, finals: DataFrame, exclude_donor: bool = False) -> DataFrame:
    """(project_id, final, dst): the finals and what lies above them."""
    up = lineage.reach(edges.where("op <> 'Donor'") if exclude_donor else edges, finals, upward=True)
    return up.select(P, F.col("seed").alias("final"), F.col("node_id").alias("dst"))


def properties_of_finals(nodes: DataFrame, edges: DataFrame, properties: DataFrame) -> DataFrame:
    """A1: final_node_properties() from the edges themselves (project_id, src, dst, and what it asks of a closure but final and is_plain).

    Properties are told for each node's incoming edges first, in one row a node; only these rows meet the finals, not the edges.
    """
    rows = properties.collect()  # a dictionary
    links, plain = written(picked(edges, P, "src", "dst", "op")), F.col("op") != "Donor"
    hits = {p["name"]: _has(p) if p["rule"] is None else _has(p) | F.coalesce(F.col(p["rule"]), F.lit(False)) for p in rows}
    told = edges.groupBy(P, "dst").agg(*(F.bool_or(hits[p["name"]] & (F.lit(True) if p["includedonors"] else plain)).alias(p["name"]) for p in rows))
    finals = written(lineage.ends(nodes, links))
    by_plain = _reached_nodes(links, finals, True).withColumn("_plain", F.lit(True))
    up = _reached_nodes(links, finals).join(by_plain, [P, "final", "dst"], "left")
    on = F.coalesce("_plain", F.lit(False))
    wide = up.join(told, [P, "dst"]).groupBy(P, "final").agg(*(F.bool_or(F.col(p["name"]) & (F.lit(True) if p["includedonors"] else on)).alias(p["name"]) for p in rows))
    return wide.unpivot([P, "final"], [p["name"] for p in rows], "name", "value")


def rules_of_finals(nodes: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """A3: property_rules() from the edges themselves: links (project_id, src, dst) lead to the finals, edges (project_id, dst) carry what
    the rules ask for, which are told for each node's incoming edges first, in one row a node."""
    rules = rule_predicates("members" in edges.columns)
    told = edges.groupBy(P, "dst").agg(*(F.bool_or(c).alias(k) for k, c in rules.items()))
    up = _reached_nodes(links, lineage.ends(nodes, links))
    return up.join(told, [P, "dst"]).groupBy(P, "final").agg(*(F.bool_or(k).alias(k) for k in rules))


def project_properties(edges: DataFrame, properties: DataFrame) -> DataFrame:
    """A2: (project_id, name, value): does any edge of the journal give the property (see final_node_properties)?"""
    rows = properties.collect()  # a dictionary
    wide = edges.groupBy(P).agg(*(F.bool_or(_has(p)).alias(p["name"]) for p in rows))
    return wide.unpivot([P], [p["name"] for p in rows], "name", "value")


# Categories of other enhancements and the operations of these that do not count, edits of a video's place.
ENHANCEMENTS = ("AdditionalEffect", "Fill", "Transform", "Intensity", "Layer", "Filter", "CGI")
NO_ENHANCEMENTS = ("Blur", "Sharpening", "TransformResize", "TransformCrop", "TransformRotate", "TransformSeamCarving", "TransformWarp", "Normalization", "Contrast")
PLACED = ("PasteSampled", "PasteOverlay", "PasteImageSpliceToFrame")


def rule_predicates(grouped: bool = False) -> dict[str, Column]:
    """A3: yes/no rules over an edge (op, category, arguments, is_global: yes, no or null, media_type of its source, common_parent: its
    end's two predecessors share a base, is_gan; with `grouped` members, null but for groups: rules on categories look into these too)."""
    op, video = F.col("op"), F.coalesce(F.col("media_type") == "video", F.lit(False))
    arg = lambda k: F.coalesce(F.try_element_at("arguments", F.lit(k)), F.lit(""))
    added = (F.size(F.map_keys("arguments")) == 0) | (arg("purpose") == "add")
    common = F.coalesce("common_parent", F.lit(False))
    inside = lambda cond: F.coalesce(F.exists("members", cond), F.lit(False)) if grouped else F.lit(False)
    enhances = lambda name, category: F.coalesce(category.isin(*ENHANCEMENTS), F.lit(False)) & ~name.isin(*NO_ENHANCEMENTS)
    other = enhances(op, F.col("category")) | inside(lambda m: enhances(m.op, m.category))
    of = lambda name: F.coalesce(F.col("category") == name, F.lit(False)) | inside(lambda m: m.category == name)
    widely = F.coalesce(F.col("is_global"), F.lit("yes")) == "yes"
    return {
        "blur_local": (op == "Blur") & (F.coalesce(F.col("is_global"), F.lit("no")) == "no"),
        "histogram_global": (op == "Normalization") & widely,
        "contrast_global": (op == "Contrast") & widely,
        "color": of("Color"),
        "clone": ((op == "PasteSplice") & common) | ((op == "PasteSampled") & (arg("purpose") == "clone")),
        "spatial_clone": video & (((op == "PasteOverlay") & common & added) | ((op == "PasteSampled") & (arg("purpose") == "clone"))),
        "spatial_splice": video & (((op == "PasteOverlay") & ~common & added) | ((op == "PasteImageSpliceToFrame") & (arg("purpose") == "clone"))),
        "spatial_remove": video & op.isin(*PLACED) & (arg("purpose") == "remove"),
        "spatial_moving": video & op.isin(*PLACED) & (arg("motion mapping") == "yes"),
        "voice_overlay": (arg("voice") == "yes") & (arg("add type") == "overlay"),
        "voice_swap": (arg("voice") == "yes") & (arg("add type") == "replace"),
        "median_smoothing": (op == "Blur") & (arg("Blur Type") == "Median Smoothing"),
        "audio_activity": of("Audio"),
        "other_enhancement": F.coalesce(F.col("media_type") == "image", F.lit(False)) & other,
        "video_other_enhancement": video & other,
        "gan_component": F.col("is_gan"),
    }


def property_rules(closure: DataFrame) -> DataFrame:
    """A3: (project_id, final, and one yes/no column a rule): does any edge above the final meet the rule? In one aggregate."""
    return closure.groupBy(P, "final").agg(*(F.bool_or(c).alias(k) for k, c in rule_predicates("members" in closure.columns).items()))


def format_changes(finals: DataFrame, media: DataFrame) -> DataFrame:
    """A3: (project_id, final, base, reformatted, compressed): finals (project_id, final, base) by their files' metadata (project_id,
    node_id, mime, file_type, compression): MIME or file type differ; a JPEG, or a compression that is not uncompressed."""
    one = media.select(P, F.col("node_id").alias("base"), F.col("mime").alias("_m0"), F.col("file_type").alias("_t0"))
    two = media.select(P, F.col("node_id").alias("final"), F.col("mime").alias("_m1"), F.col("file_type").alias("_t1"), F.trim("compression").alias("_c"))
    j = finals.join(one, [P, "base"], "left").join(two, [P, "final"], "left")
    differs = F.coalesce(F.col("_m0") != F.col("_m1"), F.lit(False)) | F.coalesce(F.col("_t0") != F.col("_t1"), F.lit(False))
    packed = F.coalesce(F.lower("_t1") == "jpeg", F.lit(False)) | F.coalesce((F.col("_c") != "") & ~F.lower("_c").startswith("uncompressed"), F.lit(False))
    return j.select(P, "final", "base", differs.alias("reformatted"), packed.alias("compressed"))


def best_of(finals: DataFrame) -> DataFrame:
    """(project_id, count, category): the greatest manipulation count of a journal's finals (project_id, units), and its label."""
    best = finals.groupBy(P).agg(F.max("units").alias("count"))
    return best.withColumn("category", F.concat(F.lit("Unit-"), F.col("count").cast("string")))


def unit_count(closure: DataFrame, operations: DataFrame) -> DataFrame:
    """A4: (project_id, final, units, label): distinct operations but outputs, donors and selections; label Unit-n."""
    skip = operations.where(F.col("category").isin("Output", "Donor") | F.col("op").isin(*SELECTION)).select("op", F.lit(True).alias("_skip"))
    counted = closure.join(skip, "op", "left").groupBy(P, "final").agg(F.count_distinct(F.when(F.col("_skip").isNull(), F.col("op"))).alias("units"))
    return counted.withColumn("label", F.concat(F.lit("Unit-"), F.col("units").cast("string")))


def composite_size(closure: DataFrame) -> DataFrame:
    """A5: (project_id, final, size): the largest change size category of its edges ('' < small < medium < large)."""
    rank = F.when(F.col("size") == "large", 3).when(F.col("size") == "medium", 2).when(F.col("size") == "small", 1).otherwise(0)
    return closure.groupBy(P, "final").agg(F.max(rank).alias("_r")).select(P, "final", F.element_at(F.array(*map(F.lit, ("", "small", "medium", "large"))), F.col("_r") + 1).alias("size"))


def provenance(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, n_bases, is_provenance): distinct bases over all finals."""
    bases = lineage.terminal_base_tuples(nodes, edges)
    return bases.groupBy(P).agg(F.count_distinct("base").alias("n_bases")).withColumn("is_provenance", F.col("n_bases") > 1)


def edges_by_group(edges: DataFrame) -> DataFrame:
    """(project_id, group, n, edges): edges of each semantic group; a group's edges of one journal are one list."""
    g = edges.select(P, F.explode("semanticGroups").alias("group"), F.struct("src", "dst").alias("_e"))
    return g.groupBy(P, "group").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("_e")).alias("edges"))


def project_groups(edges: DataFrame) -> DataFrame:
    """(project_id, groups): the journal's distinct semantic groups, sorted."""
    return edges.select(P, F.explode("semanticGroups").alias("g")).groupBy(P).agg(F.array_sort(F.collect_set("g")).alias("groups"))


def collect_stats(nodes: DataFrame, type_col: str) -> DataFrame:
    """Media by type."""
    return nodes.groupBy(F.col(type_col).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def edge_bounds(segs: DataFrame) -> DataFrame:
    """(set_id, type, start, stop): least start and greatest end of each set and type."""
    return segs.groupBy("set_id", "type").agg(F.min("startframe").alias("start"), F.max("endframe").alias("stop"))


def packet_summary(diffs: DataFrame) -> DataFrame:
    """A10: (stream, key, total, n, mean) of numeric differences."""
    return diffs.groupBy("stream", "key").agg(F.sum("delta").alias("total"), F.count("delta").alias("n"), F.round(F.avg("delta"), 6).alias("mean"))


def generated_media(finals: DataFrame, nodes: DataFrame) -> DataFrame:
    """A3: (project_id, final, gan_generated, cgi_generated): what the base of a final says of itself; of several bases the smallest counts.

    finals: project_id, final, base. nodes: project_id, node_id, is_gan, cgi (yes, no or null, which is no).
    """
    first = finals.groupBy(P, "final").agg(F.min("base").alias("node_id")).join(nodes.select(P, "node_id", "is_gan", "cgi"), [P, "node_id"], "left")
    yes = lambda c: F.coalesce(F.col(c) == "yes", F.lit(False))
    return first.select(P, "final", yes("is_gan").alias("gan_generated"), yes("cgi").alias("cgi_generated"))


def combine_ops(groups: DataFrame, operations: DataFrame) -> DataFrame:
    """Groups (group_name, pos, op; a member may be a group) over operations (op, category, rule, transitions) to (group_name, categories,
    rules, first_op, last_op, transitions), lists sorted and distinct; a transition leads from a start of the first operation to an
    end of the last. Where operations have mandatory and optional (arrays of parameter names), their unions follow."""
    j = expand_groups(groups).where("not is_cycle").withColumnRenamed("path", "pos").join(operations, "op")
    named = [c for c in ("mandatory", "optional") if c in operations.columns]
    out = j.groupBy("group_name").agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in named), 
        F.array_sort(F.collect_set("category")).alias("categories"), F.array_sort(F.collect_set("rule")).alias("rules"),
        F.min_by(F.struct("op", "transitions"), "pos").alias("_f"), F.max_by(F.struct("op", "transitions"), "pos").alias("_l"),
    )
    side = lambda c, i: F.array_distinct(F.transform(c, lambda t: F.split_part(t, F.lit("."), F.lit(i))))
    led = F.flatten(F.transform(side(F.col("_f.transitions"), 1), lambda a: F.transform(side(F.col("_l.transitions"), 2), lambda b: F.concat_ws(".", a, b))))
    return out.select("group_name", "categories", "rules", F.col("_f.op").alias("first_op"), F.col("_l.op").alias("last_op"), F.array_sort(led).alias("transitions"), *named)


def create_time(nodes: DataFrame) -> DataFrame:
    """(project_id, createtime): the earliest node time."""
    return nodes.groupBy(P).agg(F.min("ctime").alias("createtime"))


def group_work(rows: DataFrame) -> DataFrame:
    """(project_id, n, items): a journal's work list in order of url and file."""
    return rows.groupBy(P).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("url", "file"))).alias("items"))
