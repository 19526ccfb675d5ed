"""Which edges and nodes a job looks at: inclusion predicates, donors, generated media, nodes that may be extended."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions.storage import written

from . import lineage

P = "project_id"

# Operations that change no place of their own, categories that are no local edit, operations of generated media.
NOT_LOCAL = ("TransformSeamCarving", "TransformCrop", "SelectCropFrames", "Donor", "TransformDownSample", "TransformReverse", "DeleteAudioSample")
NOT_LOCAL_WITH_POST = tuple(o for o in NOT_LOCAL if o != "SelectCropFrames")
NOT_LOCAL_CATEGORIES = ("Output", "AntiForensic", "PostProcessing", "Laundering", "TimeAlteration")
GAN_OPERATIONS = ("SynthesizeGAN", "AddCameraModel", "DeepFakeFaceSwap", "ErasureByGAN", "GANFill")


def argument(name: str) -> Column:
    """An edge's argument, null where it has none of that name."""
    return F.try_element_at("arguments", F.lit(name))


def is_yes(column: str) -> Column:
    return F.coalesce(F.col(column) == "yes", F.lit(False))


def edge_predicates(edges: DataFrame, operations: DataFrame) -> DataFrame:
    """Edges (op, record_mask, empty_mask, is_global: yes, no or null) with not_donor, not_donor_not_empty, composite, localized
    and localized_post; operations (op, category). An edge whose operation is not known has no category."""
    e = edges.join(operations.select("op", "category"), "op", "left")
    category = F.coalesce("category", F.lit(""))
    full = F.coalesce("empty_mask", F.lit("no")) == "no"
    local = lambda ops: ~F.col("op").isin(*ops) & full
    return e.withColumns(
        {
            "not_donor": F.col("op") != "Donor",
            "not_donor_not_empty": (F.col("op") != "Donor") & full,
            "composite": is_yes("record_mask"),
            "localized": (is_yes("record_mask") | (local(NOT_LOCAL) & ~is_yes("is_global"))) & ~category.isin(*NOT_LOCAL_CATEGORIES),
            "localized_post": is_yes("record_mask") | (local(NOT_LOCAL_WITH_POST) & ~category.isin("Output", "TimeAlteration")),
        }
    ).drop("category")


def eligible_for_donor() -> Column:
    """P5: a donor edge, or a sampled paste that clones and has an input mask (edges: op, inputmaskname, arguments)."""
    clone = (F.col("op") == "PasteSampled") & F.coalesce(argument("purpose") == "clone", F.lit(False))
    return (F.col("op") == "Donor") | (clone & (F.coalesce(F.length("inputmaskname"), F.lit(0)) > 0))


def is_gan(edges: DataFrame, software: DataFrame) -> DataFrame:
    """Edges (op, softwareName, arguments) with is_gan: a generating operation or software (name), or an argument that says so."""
    names = software.select(F.col("name").alias("softwareName")).distinct().withColumn("_gan", F.lit(True))
    says = ((F.col("op") == "ObjectCGI") & (F.coalesce(argument("isGAN"), F.lit("no")) == "yes")) | ((F.col("op") == "PasteSplice") & F.coalesce(argument("subject"), F.lit("no")).contains("gan"))
    found = F.col("op").isin(*GAN_OPERATIONS) | F.coalesce("_gan", F.lit(False)) | says
    return edges.join(names, "softwareName", "left").withColumn("is_gan", found).drop("_gan")


def ops_by_category(operations: DataFrame, source: str, target: str, deprecated: bool = False) -> DataFrame:
    """(category, ops): operations (op, category, transitions, deprecated) that lead from one media type to another, sorted."""
    fit = operations.where(F.array_contains("transitions", f"{source}.{target}"))
    if not deprecated:
        fit = fit.where(~F.coalesce("deprecated", F.lit(False)))
    # At most the dictionary's operations in a list.
    return fit.groupBy("category").agg(F.array_sort(F.collect_set("op")).alias("ops"))


def nodes_to_extend(nodes: DataFrame, edges: DataFrame, operations: DataFrame, rules: list[str]) -> DataFrame:
    """(project_id, node_id) of the nodes that a batch may extend.

    Rules: `+category:op` takes a node made by that operation, `+$category:op` one that it is applied to (an empty category fits
    all), `~category:op` leaves a node out that it made (an empty op fits all); basenode, finalnode, finalpng, outputop,
    antiforensicop, outputsourceop, antiforensicsourceop and donorpath widen the choice. Of several predecessors the largest counts.
    """
    nodes, edges = written(nodes.select(P, "node_id", "file")), written(edges.select(P, "src", "dst", "op"))
    plain = edges.where("op <> 'Donor'").join(operations.select("op", "category"), "op", "left")
    made = plain.groupBy(P, F.col("dst").alias("node_id")).agg(
        F.max_by(F.struct("op", "category"), "src").alias("made"), F.bool_or(F.col("category") == "Output").alias("from_output"), F.bool_or(F.col("category") == "AntiForensic").alias("from_hiding")
    )
    # At most the dictionary's operations in a list.
    used = plain.groupBy(P, F.col("src").alias("node_id")).agg(
        F.collect_set(F.struct("category", "op")).alias("used"), F.bool_or(F.col("category") == "Output").alias("to_output"), F.bool_or(F.col("category") == "AntiForensic").alias("to_hiding")
    )
    labels = lineage.label_nodes(nodes, edges)
    base = lineage.find_base(nodes, edges).join(labels.select(P, F.col("node_id").alias("base"), F.col("label").alias("base_label")), [P, "base"])
    n = nodes.join(labels, [P, "node_id"]).join(base.select(P, "node_id", "base_label"), [P, "node_id"], "left").join(made, [P, "node_id"], "left").join(used, [P, "node_id"], "left")
    n = n.join(edges.select(P, F.col("src").alias("node_id"), F.lit(True).alias("has_next")).distinct(), [P, "node_id"], "left")
    n = n.na.fill(False, ["from_output", "from_hiding", "to_output", "to_hiding", "has_next"])
    yes, no = F.lit(True), F.lit(False)
    top = F.col("label").isin("base", "donor")
    fits = lambda c, o, category, op: (yes if category == "" else c == category) & (yes if op == "" else o == op)

    def rule(text: str) -> tuple[str, str]:
        category, _, op = text.partition(":")
        return category, op

    def applied(category: str, op: str) -> Callable[[Column], Column]:
        return lambda u: fits(u.category, u.op, category, op)

    def any_of(parts: list[Column]) -> Column:
        return reduce(lambda a, b: a | b, parts, no)

    took = any_of([fits(F.col("made.category"), F.col("made.op"), *rule(r[1:])) for r in rules if r[0] == "+" and r[1] != "$"])
    took |= any_of([F.exists("used", applied(*rule(r[2:]))) for r in rules if r.startswith("+$")])
    took = ~top & F.coalesce(took, no)
    left = ~top & F.coalesce(any_of([fits(F.col("made.category"), F.col("made.op"), *rule(r[1:])) for r in rules if r[0] == "~"]), no)
    last = yes if "finalnode" in rules else F.lower("file").endswith("png") if "finalpng" in rules else no
    stop = ~top & ((F.col("from_output") & F.lit("outputop" not in rules)) | (F.col("from_hiding") & F.lit("antiforensicop" not in rules)))
    go = ~top & ((F.col("to_output") & F.lit("outputsourceop" in rules)) | (F.col("to_hiding") & F.lit("antiforensicsourceop" in rules)))
    inner = ~stop & (go | (~left & (yes if "basenode" in rules else ~top)))
    chosen = took | F.when(~F.col("has_next"), last).otherwise(inner)
    of_base = yes if "donorpath" in rules else F.coalesce(F.col("base_label") == "base", no)
    return n.where(of_base & chosen).select(P, "node_id")
