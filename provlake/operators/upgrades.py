"""Upgrades of old journals as one ordered program of edge rewrites: each fix is a set of column expressions that apply where the
journal needs it, and sees what the fixes before it have made. All edges of all journals are upgraded in one projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import needed_fixes

P = "project_id"

# Operations and arguments by their later names.
OLD_OPS = {
    "ColorBlendDissolve": "Blend", "ColorBlendMultiply": "Blend", "ColorColorBalance": "ColorBalance", "ColorMatchColor": "ColorMatch",
    "ColorReplaceColor": "ColorReplace", "IntensityHardlight": "BlendHardlight", "IntensitySoftlight": "BlendSoftlight",
}
MODES = {"ColorBlendDissolve": "Dissolve", "ColorBlendMultiply": "Multiply"}
VIDEO_OPS = {"AudioPan": "AudioAmplify", "SelectFromFrames": "SelectRegionFromFrames", "ColorInterpolation": "ColorLUT", "SelectRemoveFromFrames": "ContentAwareFill"}
VIDEO_ARGUMENTS = {"chroma key insertion": "key insertion", "Left": "Left Pan", "Right": "Right Pan"}
INSERTION_TIMES = {"Insertion Start Time": "Start Time", "Insertion End Time": "End Time"}
COPY_TIMES = {"Copy Start Time": "Start Time", "Copy End Time": "End Time"}
NEVER_IN_COMPOSITE = ("Output", "AntiForensic", "Laundering")


def _renamed(names: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.col("op")), F.col("op"))


def _moved(arguments: Column, names: dict[str, str]) -> Column:
    """Arguments under their new names; what stood there goes."""
    old, new = (F.array(*map(F.lit, x)) for x in (names.keys(), names.values()))
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    held = F.map_filter(arguments, lambda k, v: F.array_contains(old, k))
    target = F.map_keys(F.transform_keys(held, lambda k, v: F.element_at(table, k)))
    rest = F.map_filter(arguments, lambda k, v: ~F.array_contains(old, k) & ~(F.array_contains(new, k) & F.array_contains(target, k)))
    return F.map_concat(rest, F.transform_keys(held, lambda k, v: F.element_at(table, k)))


def _set(arguments: Column, **values: Column | str) -> Column:
    """Arguments with some set; underscores in the names stand for blanks, null values set nothing."""
    given = {k.replace("_", " "): F.lit(v) if isinstance(v, str) else v for k, v in values.items()}
    made = F.map_filter(F.create_map(*(x for k, v in given.items() for x in (F.lit(k), v.cast("string")))), lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(arguments, lambda k, v: ~F.map_contains_key(made, k)), made)


def old_ops() -> dict[str, Column]:
    mode = F.try_element_at(F.create_map(*(F.lit(x) for pair in MODES.items() for x in pair)), F.col("op"))
    return {"op": _renamed(OLD_OPS), "arguments": _set(F.col("arguments"), mode=mode)}


def insertion_times() -> dict[str, Column]:
    return {"arguments": _moved(F.col("arguments"), INSERTION_TIMES)}


def video_ops() -> dict[str, Column]:
    ours = F.col("op").isin(*VIDEO_OPS)
    args = _moved(F.col("arguments"), VIDEO_ARGUMENTS)
    args = F.when(F.col("op") == "SelectRemoveFromFrames", _set(args, purpose="remove")).otherwise(args)
    return {"op": _renamed(VIDEO_OPS), "arguments": F.when(ours, args).otherwise(F.col("arguments"))}


def copy_times() -> dict[str, Column]:
    return {"arguments": _moved(F.col("arguments"), COPY_TIMES)}


def composite_flags() -> dict[str, Column]:
    flag = F.when(F.col("category").isin(*NEVER_IN_COMPOSITE), "no").when(F.col("recordMaskInComposite") == "true", "yes").otherwise(F.col("recordMaskInComposite"))
    return {"recordMaskInComposite": flag}


def time_strings() -> dict[str, Column]:
    """h:m:s:frames to h:m:s.micros by the source's frame rate; without a rate frames go."""
    part = lambda v, i: F.get(F.split(v, ":"), F.lit(i)).cast("double")
    micros = lambda v: (F.floor(part(v, 0) * 3600e6 + part(v, 1) * 60e6 + part(v, 2) * 1e6 + 0.5) + F.coalesce(F.floor(part(v, 3) * 1000.0 / F.col("rate")) * 1000, F.lit(0))).cast("long")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")

    def text(us: Column) -> Column:
        seconds = F.floor(us / 1_000_000).cast("long")
        return F.concat(two(F.floor(seconds / 3600).cast("long")), F.lit(":"), two((F.floor(seconds / 60) % 60).cast("long")), F.lit(":"), two(seconds % 60), F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0"))

    old = lambda k, v: k.contains("Time") & v.rlike(r"^\d+:\d+:\d+(\.\d+)?:\d+$")
    return {"arguments": F.transform_values("arguments", lambda k, v: F.when(old(k, v), text(micros(v))).otherwise(v))}


def nested(flat: Column) -> Column:
    """A map with keys 'stream:key' (further colons and what follows them go) as a map of maps; keys without a colon go, later ones win."""
    parts = lambda k: F.split(k, ":")
    rows = F.filter(F.map_entries(flat), lambda x: F.size(parts(x.key)) > 1)
    streams = F.array_distinct(F.transform(rows, lambda x: F.get(parts(x.key), F.lit(0))))
    none = F.create_map().cast("map<string,string>")

    def one(stream: Column) -> Column:
        mine = F.filter(rows, lambda x: F.get(parts(x.key), F.lit(0)) == stream)
        put = lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != F.get(parts(x.key), F.lit(1))), F.create_map(F.get(parts(x.key), F.lit(1)), x.value))
        return F.aggregate(mine, none, put)

    return F.map_from_arrays(streams, F.transform(streams, one))


def metadata_and_software() -> dict[str, Column]:
    """Flat metadata differences nest; an empty name of software, or none at all, takes the journal's most used one."""
    empty = F.lower(F.coalesce("softwareName", F.lit(""))).isin("", "no software")
    name = F.when(F.col("op") == "Recapture", "Off Camera").when(empty & (F.col("op") != "Donor"), F.coalesce("_used", "softwareName")).otherwise(F.col("softwareName"))
    return {"metadatadiff": F.when(F.col("flatdiff").isNotNull(), nested(F.col("flatdiff"))).otherwise(F.col("metadatadiff")), "softwareName": name}


def content_aware() -> dict[str, Column]:
    op, args, video = F.col("op"), F.col("arguments"), F.col("filetype") == "video"
    scale = op == "TransformContentAwareScale"
    lens = F.when(F.coalesce(F.try_element_at("arguments", F.lit("Lens Distortion Applied")), F.lit("")) == "", "no")
    new = F.when(scale & ~video, _set(args, inputmasktype="keep", apply_mask="yes")).when(op == "TransformSeamCarving", _set(args, inputmasktype="color", apply_mask="no"))
    new = new.when(op == "OutputPng", _set(args, Lens_Distortion_Applied=lens)).otherwise(args)
    return {"op": F.when(video & (scale | (op == "ContentAwareFill")), "PasteSampled").when(scale, "TransformSeamCarving").otherwise(op), "arguments": new}


def manipulation_size() -> dict[str, Column]:
    """A local change said to be large is measured again: the ratio times the mask's pixels."""
    total = F.col("change_ratio") * F.col("mask_pixels")
    again = (F.coalesce("global", F.lit("yes")) == "no") & (F.col("change_ratio") > 0) & (F.coalesce("change_category", F.lit("large")) == "large") & F.col("mask_pixels").isNotNull()
    size = F.when(total < 2500, "small").when(total < 10000, "medium").otherwise("large")
    return {"change_category": F.when(again, size).otherwise(F.col("change_category"))}


def local_flags() -> dict[str, Column]:
    local = F.coalesce("local_analysis", F.lit(False)) | F.col("op").contains("Color")
    return {"global": F.when((F.col("global") == "yes") & local, "no").otherwise(F.col("global"))}


def blur_arguments() -> dict[str, Column]:
    """Radius and angle as the description tells them, else as they are, else 0."""
    said = F.coalesce("description", F.lit(""))
    found = lambda pattern, group: F.nullif(F.regexp_extract(said, pattern, group), F.lit(""))
    motion = F.coalesce(F.try_element_at("arguments", F.lit("Blur Type")), F.lit("")) == "Motion"
    held = lambda k: F.coalesce(F.try_element_at("arguments", F.lit(k)), F.lit("0"))
    both = r"angle (\d{2}) and distance (\d{1,2})"
    radius = F.coalesce(F.when(motion, found(both, 2)).otherwise(found(r"radius of (\d) pixels?", 1)), held("Blur Radius"))
    angle = F.coalesce(F.when(motion, found(both, 1)), held("Blur Angle"))
    return {"arguments": F.when(F.col("op").startswith("Blur"), _set(F.col("arguments"), Blur_Radius=radius, Blur_Angle=angle)).otherwise(F.col("arguments"))}


#: The versions, in order, with the fixes of each.
FIXES: dict[str, list[Callable[[], dict[str, Column]]]] = {
    "0.3.1115": [old_ops],
    "04.0720.b0ec584b4e": [insertion_times],
    "04.0810.546e996a36": [video_ops],
    "04.0810.9381e76724": [copy_times],
    "0.4.1115.32eabae8e6": [composite_flags],
    "0.5.0822.b3f4049a83": [time_strings],
    "0.5.0918.b14aff2910": [metadata_and_software],
    "0.5.1210.5ca3e81782": [content_aware],
    "0.6.0531.ce60889744": [manipulation_size, local_flags, blur_arguments],
}
#: What a fix may read, null where edges have no such column.
COLUMNS = {
    "op": "string", "arguments": "map<string,string>", "description": "string", "recordMaskInComposite": "string", "global": "string", "change_category": "string", "change_ratio": "double", "mask_pixels": "bigint",
    "softwareName": "string", "filetype": "string", "rate": "double", "category": "string", "local_analysis": "boolean", "flatdiff": "map<string,string>", "metadatadiff": "map<string,map<string,string>>",
}


def upgraded(edges: DataFrame, journals: DataFrame) -> DataFrame:
    """M1 to M8 in order: edges (project_id, and of COLUMNS what there is) after the fixes that their journal (project_id, jt_upgrades) lacks, and
    `applied`, the versions of these."""
    needed = needed_fixes(journals, list(FIXES)).groupBy(P).agg(F.array_sort(F.collect_list(F.struct("pos", "fix"))).alias("l")).select(P, F.col("l.fix").alias("applied"))
    given = {c: F.lit(None).cast(kind) for c, kind in COLUMNS.items() if c not in edges.columns}
    out = edges.withColumns(given).withColumn("arguments", F.coalesce("arguments", F.create_map().cast("map<string,string>")))
    used = out.where("lower(coalesce(softwareName, '')) not in ('', 'no software')").groupBy(P, "softwareName").agg(F.count(F.lit(1)).alias("_n"))
    used = used.groupBy(P).agg(F.min_by("softwareName", F.struct(-F.col("_n"), "softwareName")).alias("_used"))
    out = out.join(needed, P, "left").join(used, P, "left")
    for version, fixes in FIXES.items():
        asked = F.coalesce(F.array_contains("applied", version), F.lit(False))
        for fix in fixes:
            out = out.withColumns({c: F.when(asked, new).otherwise(F.col(c)) for c, new in fix().items()})
    return out.drop("_used", *(c for c in given if c not in ("metadatadiff",)))
