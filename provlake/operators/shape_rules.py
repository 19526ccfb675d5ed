"""Rules on changed sizes, EXIF turns, homographies, raw and compressed sources. Messages are as in `rules`.

A change of size is recorded on an edge as text `(x, y)`; edges without one raise nothing. The texts of messages are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions.scalars import exif_dimensions, file_type, suffix

from .rules import ERROR, WARNING, P, messages, register, union

#: Suffixes of raw pictures that converters may resize; fixed values.
RESIZING_RAWS = ("arw", "nef", "cr2", "dng")

#: EXIF file types that are not raw pictures; fixed values.
NOT_RAW = (
    "AA AAX ACR AI AIT AFM ACFM AMFM PDF PS AVI APE ASF BMP DIB BPG PNG JPEG GIF DIVX DOC DOCX DV EXV F4V F4A F4P F4B EXR HDR FLV FPF FLAC FLA FFF IDML "
    "J2C JPC JP2 JPF J2K JPX JPM JPE JPG LA LFP MP4 MP3 M2TS MTS M2T TS M4A M4B M4P M4V MAX MOV QT O PAC MIFF MIF MIE JNG MNG PPT PPS QIF QTI QTIF "
    "RIF RIFF SWF VOB TTF TTC SEQ WEBM WEBP"
).split()


def size_change(text: Column) -> Column:
    """struct(x, y) of '(x, y)'; null for null and for other text."""
    part = lambda i: F.regexp_extract(text, r"^\(\s*(-?\d+)L?\s*,\s*(-?\d+)L?\s*\)$", i).try_cast("int")
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("x"), part(2).alias("y")))


def _turned(orientation: Column) -> Column:
    """Whether an orientation, as text, turns a picture by a quarter."""
    return F.coalesce(orientation.rlike("270|90"), F.lit(False))


def _lies_alike() -> Column:
    """Whether source and result are both wide, both high or both square."""
    return F.signum(F.col("src_w") - F.col("src_h")) == F.signum(F.col("dst_w") - F.col("dst_h"))


@register("shape")
def shape_rules(edges: DataFrame) -> DataFrame:
    """Edges carry shape_change ('(x, y)'), approach, orientation, video_diff (map of a video's changed metadata), src_w, src_h, dst_w, dst_h.

    size_changed: the size must change. size_kept: it must not, but in a crop. size_exif: it may only with an orientation (of the
    picture, else of the video's first key, by name, that holds `rotate` after its first letter); a quarter turn must then show.
    """
    keys = F.array_sort(F.filter(F.map_keys("video_diff"), lambda k: F.instr(k, "rotate") > 1))
    turn = F.coalesce("orientation", F.try_element_at("video_diff", F.get(keys, F.lit(0))))
    e = edges.withColumns({"_c": size_change(F.col("shape_change")), "_o": turn})
    changed = (F.col("_c.x") != 0) | (F.col("_c.y") != 0)
    return union([
        messages(e.where("_c is not null").where(~changed), ERROR, "size_changed", "operation should change the size of the image"),
        messages(e.where(changed & (F.coalesce("approach", F.lit("")) != "Crop")), ERROR, "size_kept", "operation is not permitted to change the size of the image"),
        messages(e.where(changed & _turned(F.col("_o")) & _lies_alike()), ERROR, "size_exif", "Rotation not applied"),
        messages(e.where(changed & F.col("_o").isNull()), WARNING, "size_exif", "operation changed the size of the image"),
    ])


@register("png_exif")
def png_exif_rules(edges: DataFrame, crop: bool = False) -> DataFrame:
    """A conversion to PNG against its source's EXIF; one message an edge, the first that holds.

    edges: src_w, src_h, dst_w, dst_h, src_file, raw (boolean), exif (map), orientation, rotated and distortion (yes or other), location
    ('(rows, columns)' that a border takes, null: none). A quarter turn must be stated, recorded and done. The size must then be the
    source's or one that EXIF gives (turned); raw pictures may lose 65 pixels, at least 1.5 percent of a side, twice that under a lens
    correction. crop: cropped and autofocus sizes count as well.
    """
    rotated = F.coalesce(F.col("rotated") == "yes", F.lit(False))
    recorded = F.col("orientation").isNotNull()
    expected = rotated & _turned(F.col("orientation"))
    allowed = F.ceil(F.greatest(F.lit(0.015), 65.0 / F.col("src_h"), 65.0 / F.col("src_w")) * 10000.0) / 10000.0
    allowed = allowed * F.when(F.col("distortion") == "yes", 2.0).otherwise(1.0)
    resizing = F.coalesce(F.col("raw"), F.lit(False)) | F.coalesce(suffix(F.col("src_file")).isin(*RESIZING_RAWS), F.lit(False))
    border = size_change(F.col("location"))
    rows, columns = (F.coalesce(border[k], F.lit(0)) * 2 for k in ("x", "y"))
    pair = lambda h, w: F.struct(h.cast("long").alias("h"), w.cast("long").alias("w"))
    exif = lambda all_, less: F.transform(exif_dimensions(F.col("exif"), all_), lambda s: pair(s.height - less[0], s.width - less[1]))
    none = F.array().cast("array<struct<h:bigint,w:bigint>>")
    sizes = F.concat(F.array(pair(F.col("src_h"), F.col("src_w"))), F.coalesce(exif(False, (rows, columns)), none), F.coalesce(exif(crop, (F.lit(0), F.lit(0))), none))
    e = edges.withColumns({"_expected": expected, "_allowed": allowed, "_resizing": resizing, "_sizes": sizes})

    def fits(s: Column) -> Column:
        h, w = F.when(F.col("_expected"), s.w).otherwise(s.h), F.when(F.col("_expected"), s.h).otherwise(s.w)
        near = F.col("_resizing") & ((h - F.col("dst_h") <= F.col("_allowed") * h) | (w - F.col("dst_w") <= F.col("_allowed") * w))
        return near | ((h == F.col("dst_h")) & (w == F.col("dst_w")))

    text = (
        F.when(~expected & ~_lies_alike(), "Image rotated; Exif does not indicate rotation")
        .when(expected & _lies_alike(), "Image not rotated; Exif indicates rotation")
        .when(rotated & ~recorded, "No orientation metadata indicating rotation; split into two operations")
        .when(~rotated & recorded, "Exif indicates rotation; operation settings differ.")
        .when(~F.exists("_sizes", fits), "operation is not permitted to change the size of the image")
    )
    told = e.withColumn("_text", text).where("_text is not null")
    warn = F.col("_text").startswith("Exif indicates")
    return union([messages(told.where(~warn), ERROR, "png_exif", F.col("_text")), messages(told.where(warn), WARNING, "png_exif", F.col("_text"))])


def _let(value: Column, f) -> Column:
    """f of a value that is computed once: an expression that is used twice would be written out twice."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _cross(a: Column, b: Column) -> Column:
    return F.struct((a.y * b.z - a.z * b.y).alias("x"), (a.z * b.x - a.x * b.z).alias("y"), (a.x * b.y - a.y * b.x).alias("z"))


@register("homography_lines")
def homography_line_rules(edges: DataFrame, compat: bool = False) -> DataFrame:
    """Edges with `matrix` (two or three rows of three; two stand for an affine one) whose picture (src_w, src_h) folds: opposite
    sides meet within it. Sides that stay parallel never meet. compat: parallel sides count as an error."""
    at = lambda i, j: F.get(F.get("matrix", F.lit(i)), F.lit(j))
    rows = [[at(i, j) if i < 2 else F.coalesce(at(i, j), F.lit(float(j == 2))) for j in range(3)] for i in range(3)]
    w, h, zero = F.col("src_w").cast("double"), F.col("src_h").cast("double"), F.lit(0.0)
    corner = lambda x, y: F.struct(*((r[0] * x + r[1] * y + r[2]).alias(n) for r, n in zip(rows, "xyz")))

    def meets(p: Column) -> Column:
        inside = F.try_divide(p.y, p.z).between(0, h) & F.try_divide(p.x, p.z).between(0, w)
        return F.coalesce(inside, F.lit(False)) | ((p.z == 0) if compat else F.lit(False))

    def folds(c: Column) -> Column:
        left_right, top_low = (_let(F.struct(_cross(a, b).alias("a"), _cross(d, e).alias("b")), lambda s: _cross(s.a, s.b)) for a, b, d, e in ((c.ll, c.ul, c.lr, c.ur), (c.ul, c.ur, c.ll, c.lr)))
        return _let(left_right, meets) | _let(top_low, meets)

    corners = F.struct(corner(zero, zero).alias("ll"), corner(zero, h).alias("ul"), corner(w, zero).alias("lr"), corner(w, h).alias("ur"))
    bad = edges.where("matrix is not null").where(_let(corners, folds))
    return messages(bad, ERROR, "homography_lines", "Homography appears to be erroneous.  Adjust Homography parameters.")


@register("sources")
def source_rules(edges: DataFrame, nodes: DataFrame, streams: DataFrame) -> DataFrame:
    """Sources that must be raw (raw_source) or uncompressed (uncompressed).

    nodes: project_id, node_id, file (null: there is none), exif_type; streams: project_id, node_id, pos, type, codec, profile, vfr (boolean),
    one row a stream. WAV and PNG files, sound and archives are uncompressed, other pictures are not; of other media the first video stream
    decides: raw, or H.264 of the profile that keeps all samples at a constant rate; media without video pass, media without streams do not.
    """
    video = F.struct("pos", F.lower(F.coalesce("codec", F.lit("raw"))).alias("codec"), F.lower(F.coalesce("profile", F.lit("na"))).alias("profile"), F.coalesce("vfr", F.lit(False)).alias("vfr"))
    first = streams.groupBy(P, "node_id").agg(F.min(F.when(F.col("type") == "video", video)).alias("_v"), F.lit(True).alias("_streams"))
    kept = F.col("_v.codec").contains("raw") | (F.col("_v.codec").rlike(r"h\.?264") & (F.col("_v.profile") == "high 4:4:4 predictive") & ~F.col("_v.vfr"))
    kind = file_type(F.col("file"))
    plain = (
        F.when(F.coalesce(F.col("exif_type").isin("WAV", "PNG"), F.lit(False)) | F.coalesce(kind.isin("audio", "zip"), F.lit(False)), True)
        .when(kind == "image", False)
        .when(F.col("_streams").isNull(), False)
        .otherwise(F.coalesce(kept, F.lit(True)))
    )
    n = nodes.join(first, [P, "node_id"], "left").select(P, F.col("node_id").alias("src"), "exif_type", (F.col("file").isNotNull() & ~plain).alias("_packed"))
    e = edges.join(n, [P, "src"])
    return union([
        messages(e.where(F.col("exif_type").isin(*NOT_RAW)), ERROR, "raw_source", "Only raw images permitted for this operation"),
        messages(e.where("_packed"), WARNING, "uncompressed", "Starting node appears to be compressed"),
    ])
