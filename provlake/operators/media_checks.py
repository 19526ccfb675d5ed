"""Rules on sizes, masks, metadata formats and tone histograms, and media segments of edges. Messages are as in `rules`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions.blocks import n_parts

from .rules import ERROR, WARNING, P, messages, register, union
from .segments import from_constraints

EDGE = [P, "src", "dst"]
#: Tones of a gray histogram; least lag-1 correlation of a change by levels.
TONES, LEAST_CORRELATION = 256, 0.9


@register("size_rules")
def size_rules(edges: DataFrame) -> DataFrame:
    """Edges carry src_w, src_h, dst_w, dst_h, op, interpolation, rotated ('yes' or other), orientation, dst_file, and for a
    paste mask pastemask (its name), mask_w, mask_h (null if the file is missing). Edges without sizes raise nothing."""
    same = (F.col("src_w") == F.col("dst_w")) & (F.col("src_h") == F.col("dst_h"))
    rotated = F.coalesce(F.col("rotated") == "yes", F.lit(False))
    turned = F.coalesce(F.col("orientation").rlike("270|90"), F.lit(False))
    grows = (F.col("dst_w") > F.col("src_w")) | (F.col("dst_h") > F.col("src_h"))
    shrinks = (F.col("dst_w") < F.col("src_w")) | (F.col("dst_h") < F.col("src_h"))
    stated = turned & rotated & same & (F.col("src_w") != F.col("src_h"))
    sign = lambda side: F.signum(F.col(f"{side}_w") - F.col(f"{side}_h"))
    unaligned = ~same & F.lower("dst_file").endswith("jpg") & ((F.col("dst_w") % 8 > 0) | (F.col("dst_h") % 8 > 0))
    pasted = F.col("pastemask").isNotNull()
    found = [
        messages(edges.where((F.col("op") == "TransformCrop") & grows), ERROR, "crop", "Crop cannot increase a dimension size of the image"),
        messages(edges.where(shrinks & F.col("interpolation").contains("none")), ERROR, "interpolation", F.concat("interpolation", F.lit(" interpolation is not permitted with a decrease in size"))),
        messages(edges.where(stated), ERROR, "rotation", "Image was not rotated as stated by the parameter Image Rotated"),
        messages(edges.where(~stated & ~rotated & (sign("src") != sign("dst"))), ERROR, "rotation", 'Image was rotated. Parameter Image Rotated is set to "no"'),
        messages(edges.where(unaligned), WARNING, "eight", "JPEG image size is not aligned to 8x8 pixels"),
        messages(edges.where(pasted & F.col("mask_w").isNull()), ERROR, "pastemask", "Pastemask file is missing"),
        messages(edges.where(pasted & ((F.col("mask_w") != F.col("src_w")) | (F.col("mask_h") != F.col("src_h")))), ERROR, "pastemask", "Pastemask image does not match the size of the source image"),
    ]
    return union(found)


@register("homography")
def homography_rules(edges: DataFrame) -> DataFrame:
    """Edges with `homography`, an array of three arrays of three numbers: one of another shape, one that mirrors or flattens (its
    determinant is not above 0), or one that carries a corner of the source (src_w, src_h) behind the picture. None raises nothing."""
    m = F.col("homography")
    whole = (F.size(m) == 3) & F.forall(m, lambda r: F.size(r) == 3)
    at = lambda i, j: F.get(F.get(m, F.lit(i)), F.lit(j))
    minor = lambda i, j: at(1, i) * at(2, j) - at(1, j) * at(2, i)
    det = at(0, 0) * minor(1, 2) - at(0, 1) * minor(0, 2) + at(0, 2) * minor(0, 1)
    depth = [at(2, 0) * x + at(2, 1) * y + at(2, 2) for x in (F.lit(0), F.col("src_w")) for y in (F.lit(0), F.col("src_h"))]
    behind = depth[0] <= 0
    for d in depth[1:]:
        behind |= d <= 0
    given = edges.where(m.isNotNull()).withColumns({"_whole": whole, "_det": F.when(whole, det), "_behind": F.when(whole, behind)})
    return union([
        messages(given.where("not _whole"), ERROR, "homography", "homography is not three by three"),
        messages(given.where("_det <= 0"), ERROR, "homography", "homography mirrors or flattens the image"),
        messages(given.where("_behind"), WARNING, "homography", "homography carries a corner behind the image"),
    ])


@register("png_size")
def png_size_rules(edges: DataFrame) -> DataFrame:
    """An output as PNG may differ from its source (a raw picture has a border) by one percent of a side, turned or not, else its size changed."""
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.01 * F.col(a)
    fits = (near("src_w", "dst_w") & near("src_h", "dst_h")) | (near("src_w", "dst_h") & near("src_h", "dst_w"))
    return messages(edges.where((F.col("op") == "OutputPng") & ~fits), ERROR, "png_size", "size of the image has changed by more than the border of a raw picture")


@register("mask_rules")
def mask_rules(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges carry maskname, inputmask, n_videomasks, generate, src_type, dst_type; files (project_id, file, width, height).

    A link needs its mask if it is about image or video and has no video masks; an input mask must be there and as large as
    the link mask, unless it is audio (width and height null). A file listed twice counts once.
    """
    # Dealt out by the rows that there are, so that a task's memory does not grow with the tables.
    n = n_parts(max(edges.count(), files.count()), edges.sparkSession)
    listed = files.repartition(n, P, "file").groupBy(P, "file").agg(F.max("width").alias("w"), F.max("height").alias("h"))
    side = lambda name, to: listed.select(P, F.col("file").alias(name), F.lit(True).alias(f"{to}_there"), F.col("w").alias(f"{to}_w"), F.col("h").alias(f"{to}_h"))
    seen = ["video", "image"]
    rows = edges.repartition(n, P, "maskname").join(side("maskname", "m"), [P, "maskname"], "left")
    rows = rows.repartition(n, P, "inputmask").join(side("inputmask", "i"), [P, "inputmask"], "left")
    visual = F.coalesce(F.col("src_type").isin(seen), F.lit(False)) | F.coalesce(F.col("dst_type").isin(seen), F.lit(False))
    needed = visual & ~F.coalesce(F.col("generate").isin("audio", "meta", "frames"), F.lit(False)) & (F.coalesce("n_videomasks", F.lit(0)) == 0)
    asked = F.coalesce(F.length("inputmask"), F.lit(0)) > 0
    return union(
        [
            messages(rows.where(needed & F.col("m_there").isNull()), ERROR, "Change Mask", "Link mask is missing. Recompute the link mask."),
            messages(rows.where(asked & F.col("i_there").isNull()), ERROR, "Input Mask", F.concat(F.lit("Input mask file "), "inputmask", F.lit(" is missing"))),
            messages(rows.where(asked & ((F.col("i_w") != F.col("m_w")) | (F.col("i_h") != F.col("m_h")))), ERROR, "Input Mask", "input mask name parameter has an invalid size"),
        ]
    )


@register("format_rules")
def format_rules(edges: DataFrame) -> DataFrame:
    """A date in `exifdiff` (map of key to struct(action, old, new)) that changed its format; one message for each key."""
    rows = edges.select(*EDGE, F.explode("exifdiff").alias("key", "d")).where(F.col("key").contains("Date") & (F.col("d.action") == "change"))
    shape = lambda c: F.regexp_replace(c, "[0-9a-zA-Z]", "x")
    rows = rows.where(shape(F.col("d.old")) != shape(F.col("d.new")))
    return messages(rows, WARNING, "metadate", F.concat(F.lit("Meta Data "), "key", F.lit(" Date Format Changed: "), "d.new"))


def stamp_mismatches(old: Column, new: Column) -> Column:
    """The date and time keys of both maps whose new value is not shaped as the old one: a digit for each digit, any letters for letters."""
    def pattern(value: Column) -> Column:
        # Quoted first, then letters: neither step adds a digit.
        quoted = F.regexp_replace(value, r"([^0-9A-Za-z])", r"\\$1")
        return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, "[A-Za-z]+", "[a-zA-Z]*"), "[0-9]", "[0-9]"), F.lit("$"))

    def bad(k: Column, v: Column) -> Column:
        return F.lower(k).rlike("date|time") & F.map_contains_key(old, k) & ~F.regexp_like(v, pattern(F.element_at(old, k)))

    return F.array_sort(F.map_keys(F.map_filter(new, bad)))


def levels_rule(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, correlation) of the histogram changes that look like curves, not levels: lag-1 correlation below 0.9.

    histograms: keys, tone 0..255, n_src, n_dst; a tone without a row counts 0. A change without variation raises nothing.
    """
    # At most 256 entries a key.
    held = histograms.groupBy(*keys, "tone").agg(F.sum(F.col("n_src") - F.col("n_dst")).alias("n")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("tone", "n"))).alias("m"))
    at = lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("double")
    pairs = held.select(*keys, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(TONES - 2).cast("long")), lambda i: F.struct(at(i).alias("x"), at(i + 1).alias("y")))).alias("p"))
    # Not corr(), which divides by zero where nothing varies.
    corr = F.try_divide(F.covar_pop("p.x", "p.y"), F.stddev_pop("p.x") * F.stddev_pop("p.y"))
    return pairs.groupBy(*keys).agg(corr.alias("correlation")).where(F.col("correlation") < LEAST_CORRELATION)


def edge_segments(edges: DataFrame, recorded: DataFrame, media: DataFrame, finals: DataFrame, types: list[str]) -> DataFrame:
    """The segments of each edge: recorded ones of the wanted types; for an edge without any recorded segment the user's times
    over the source's stream, or, where the source has none, over that of the final medium it reaches.

    edges: EDGE, start and stop struct(ms, frames) (null: from the first frame, to the last). recorded: EDGE, type, startframe,
    endframe. media: project_id, node_id, type, rate, frames. finals: project_id, node_id, final_id, one row a node.
    """
    keyed = recorded.select(*EDGE, "type", "startframe", "endframe")
    kept = keyed.where(F.col("type").isin(types)).join(edges.select(EDGE), EDGE, "left_semi").withColumn("origin", F.lit("recorded"))
    bare = edges.join(keyed.select(EDGE), EDGE, "left_anti")
    streams = media.where(F.col("type").isin(types)).select(P, "node_id", "type", "rate", "frames")
    first = F.struct(F.lit(0.0).alias("ms"), F.lit(1).cast("long").alias("frames"))

    def over(rows: DataFrame, origin: str) -> DataFrame:
        cut = from_constraints(F.coalesce("start", first), F.col("stop"), F.col("rate"))
        rows = rows.withColumn("_cut", cut)
        return rows.select(*EDGE, "type", F.col("_cut.startframe").alias("startframe"), F.least(F.when(F.col("stop").isNotNull(), F.col("_cut.endframe")), "frames").alias("endframe"), F.lit(origin).alias("origin"))

    own = bare.join(streams.withColumnRenamed("node_id", "src"), [P, "src"])
    lost = bare.join(streams.select(P, F.col("node_id").alias("src")), [P, "src"], "left_anti").join(finals.withColumnRenamed("node_id", "src"), [P, "src"])
    far = lost.join(streams.withColumnRenamed("node_id", "final_id"), [P, "final_id"])
    return union([kept.select(*EDGE, "type", "startframe", "endframe", "origin"), over(own, "source"), over(far, "final")])
