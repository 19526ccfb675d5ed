"""Rules over recorded differences, durations, donors, streams and composite flags. Messages are as in `rules`; the module names the rule.

Edges carry project_id, src, dst, op, arguments (map) and, where a rule says so, metadatadiff (map of stream to map of key to
struct(action, old, new)), segments and flags. Every rule looks at all edges it is given; run_rules() keeps what operations name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions.scalars import file_type, suffix

from .edge_sets import argument, is_yes
from .rules import ERROR, WARNING, P, messages, register, told, union

# Streams that are not sound, suffixes that an output operation may have beside its own name.
NOT_SOUND = ("video", "unknown", "data")
OUTPUT_SUFFIXES = {"jpg": ("jpg", "jpeg"), "tif": ("tif", "tiff"), "mp4": ("mp4", "mpeg", "mpg"), "nitf": ("ntf", "nitf"), "m4": ("m4a", "m4v"), "heic": ("heic", "heif")}


def recorded(stream: str, key: str) -> Column:
    """struct(action, old, new) of a stream's key, null if it did not differ."""
    return F.try_element_at(F.try_element_at("metadatadiff", F.lit(stream)), F.lit(key))


def sound_difference() -> Column:
    """Old less new duration of the first sound stream, by name, whose duration changed; 0 if none did."""
    streams = F.array_sort(F.filter(F.map_keys("metadatadiff"), lambda s: ~s.isin(*NOT_SOUND)))
    changes = F.transform(streams, lambda s: F.try_element_at(F.element_at("metadatadiff", s), F.lit("duration")))
    first = F.get(F.filter(changes, lambda d: d.action == "change"), F.lit(0))
    return F.coalesce(first.old.cast("double") - first.new.cast("double"), F.lit(0.0))


@register("recorded_lengths")
def recorded_length_rules(edges: DataFrame) -> DataFrame:
    """Lengths, durations, sample rate and resolution by what the recorded difference says."""
    frames = recorded("video", "nb_frames")
    change = frames.action == "change"
    old, new = frames.old.cast("long"), frames.new.cast("long")
    changed = F.coalesce(change, F.lit(False)) | recorded("video", "duration").isNotNull()
    shorter_not = frames.isNull() | (change & (old < new))
    longer_not = frames.isNull() | (change & (old > new))
    add = F.coalesce(argument("add type"), F.lit(""))
    sound = F.round(sound_difference(), 6)
    rates = F.exists(F.map_values("metadatadiff"), lambda s: F.coalesce(F.try_element_at(s, F.lit("sample_rate")).action == "change", F.lit(False)))
    size = F.split(F.lower(argument("resolution")), "x")
    fits = lambda key, i: F.coalesce(recorded("video", key).new != F.get(size, F.lit(i)), F.lit(False)) & (F.size(size) >= 2)
    e = edges.withColumns({"_changed": changed, "_short": shorter_not, "_long": longer_not, "_add": add, "_sound": sound, "_rates": rates, "_w": fits("width", 0), "_h": fits("height", 1), "_size": F.size(size)})
    video, over = "Length of video {}", F.col("_add").isin("replace", "overlay")
    strict = F.abs("_sound") > 0.001
    return told(
        e,
        [
            (F.col("_changed"), ERROR, "duration", video.format("has changed")),
            (F.col("_changed"), WARNING, "length_same", video.format("has changed")),
            (F.col("_short"), ERROR, "length_smaller", video.format("is not shorter")),
            (F.col("_long"), ERROR, "length_bigger", video.format("is not longer")),
            (~over & F.col("_long"), ERROR, "length_same_or_bigger", video.format("is not longer")),
            (over & F.col("_changed"), WARNING, "length_same_or_bigger", video.format("has changed")),
            (F.expr("_sound >= 0"), ERROR, "audio_bigger", "Audio is not longer in duration"),
            (F.expr("_sound <= 0.001"), ERROR, "audio_smaller", "Audio is not shorter in duration"),
            (strict, ERROR, "audio_strict", "Audio duration does not match"),
            (F.expr("floor(abs(_sound)) <> 0"), ERROR, "audio_loose", "Audio duration does not match"),
            ((F.col("_add") == "insert") & (F.col("_sound") >= 0), ERROR, "audio_same_or_longer", "Audio is not longer in duration"),
            ((F.col("_add") != "insert") & strict, ERROR, "audio_same_or_longer", "Audio duration does not match"),
            (F.col("_rates"), ERROR, "sample_rate", "Sample rate changed"),
            (F.expr("_size = 1"), ERROR, "resolution", "resolution is not in correct format"),
            (F.col("_w"), WARNING, "resolution", "resolution width does not match video"),
            (F.col("_h"), WARNING, "resolution", "resolution height does not match video"),
        ],
    )


@register("media_amounts")
def amount_rules(edges: DataFrame, media: DataFrame, segments: DataFrame) -> DataFrame:
    """Amounts that were cut, pasted, cropped or given by a donor against the media on both sides.

    media: project_id, node_id, type (video or audio), rate, frames, duration_ms. segments: project_id, src, dst, type, frames:
    what an edge records, donor edges included. Edges: op, arguments, given_frames (end less start as the user entered them).
    """
    ends = lambda at, n: media.select(P, F.col("node_id").alias(at), "type", F.col("rate").alias(f"rate{n}"), F.col("frames").alias(f"frames{n}"), F.col("duration_ms").alias(f"ms{n}"))
    plain = edges.where("op <> 'Donor'")
    both = plain.join(ends("src", 0), [P, "src"]).join(ends("dst", 1), [P, "dst", "type"])
    sums = segments.groupBy(P, "src", "dst", "type").agg(F.sum("frames").alias("_sum"))
    j = both.join(sums, [P, "src", "dst", "type"], "left").withColumn("_sum", F.coalesce("_sum", F.lit(0)))
    lost, gained = F.col("frames0") - F.col("frames1"), F.col("frames1") - F.col("frames0")
    video, sound = F.col("type") == "video", F.col("type") == "audio"
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    cut = (lost != F.col("_sum")) & (video | (F.abs(lost - F.col("_sum")) > F.col("rate0") * 0.1))
    replace = F.coalesce(argument("add type") == "replace", F.lit(False))
    stretched = F.coalesce(argument("Filter Type").isin("Frequency Stretch", "Time Stretch"), F.lit(False))
    # Rounded, so that a difference of just 100 ms is not more by what binary fractions lose.
    long = sound & ~stretched & (F.round(F.abs(F.col("ms0") - F.col("ms1")), 6) > 100)
    overlay = F.coalesce(argument("add type").isin("overlay", "replace"), F.lit(False))
    insert = F.coalesce(argument("add type"), F.lit("insert")) == "insert"
    donors = segments.join(edges.where("op = 'Donor'").select(P, "src", "dst"), [P, "src", "dst"]).select(P, "dst", "type", F.col("frames").alias("_donor"))
    own = segments.join(plain.select(P, "src", "dst"), [P, "src", "dst"])
    differ = own.join(donors, [P, "dst", "type"]).where("_donor <> frames").select(P, "src", "dst").distinct()
    return union(
        [
            messages(j.where(cut & video), ERROR, "cut_amount", text("Actual amount of frames of cut video is ", lost)),
            messages(j.where(cut & sound), ERROR, "cut_amount", text("Actual amount of cut time in milliseconds is ", F.round(lost * 1000.0 / F.col("rate0")).cast("long"))),
            messages(j.where(video & replace & (gained > 0)), ERROR, "paste_amount", "Replacement may not increase the video beyond the size of the donor"),
            messages(j.where(video & ~replace & (gained != F.col("_sum"))), ERROR, "paste_amount", text("Pasted frames are not the increase: ", gained, " added, ", F.col("_sum"), " recorded")),
            messages(j.where(video & (F.abs(F.col("frames1") - F.col("given_frames")) > 1)), ERROR, "crop_length", text("Actual amount of frames of cropped video is ", F.col("frames1"))),
            messages(j.where(long), ERROR, "audio_duration", "Duration of media changed"),
            messages(j.where(long & overlay), ERROR, "overlay_duration", "Duration of media changed"),
            messages(j.where(sound & insert & ~long), ERROR, "audio_add", "Length did not change though an insert is applied"),
            messages(j.where(F.abs(F.col("rate0") - F.col("rate1")) > 0.001), WARNING, "rate_changed", "Frame rate changed between nodes"),
            messages(j.where(F.abs(F.col("rate0") - F.col("rate1")) <= 0.001), ERROR, "rate_unchanged", "Frame rate did not change between nodes"),
            messages(differ, ERROR, "donor_times", "Mismatch number of frames"),
        ]
    )


@register("donor_paths")
def donor_path_rules(edges: DataFrame, selections: dict[str, DataFrame]) -> DataFrame:
    """A donor that is missing, and a donor path without the selection that it needs.

    selections: for SelectRegion and SelectRegionFromFrames the nodes (project_id, node_id) with such an edge above them. A blend
    needs no region; sound taken directly from the computer needs no donor.
    """
    donor = edges.where("op = 'Donor'").groupBy(P, "dst").agg(F.min("src").alias("_donor"))
    e = edges.where("op <> 'Donor'").join(donor, [P, "dst"], "left")
    lost = F.col("_donor").isNull()
    out = [
        messages(e.where(lost), ERROR, "donor", "donor image/video missing"),
        messages(e.where(lost & (F.coalesce(argument("Direct from PC"), F.lit("no")) != "yes")), ERROR, "donor_audio", "donor image/video missing"),
    ]
    for op, above in selections.items():
        has = above.select(P, F.col("node_id").alias("_donor")).distinct()
        bare = e.where(~lost).join(has, [P, "_donor"], "left_anti")
        if op == "SelectRegion":
            bare = bare.where(F.coalesce(argument("purpose"), F.lit("")) != "blend")
        out += [messages(e.where(lost), ERROR, op, "donor image missing"), messages(bare, WARNING, op, f"{op} missing on path to donor")]
    return union(out)


@register("streams")
def stream_rules(edges: DataFrame, nodes: DataFrame, streams: DataFrame) -> DataFrame:
    """File types, suffixes and streams on both sides. nodes: project_id, node_id, file; streams: project_id, node_id, type, one row a stream."""
    counts = streams.groupBy(P, "node_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "video").alias("v"), F.count_if(F.col("type") == "audio").alias("a"))
    n = nodes.join(counts, [P, "node_id"], "left").na.fill(0, ["n", "v", "a"]).select(P, "node_id", file_type(F.col("file")).alias("k"), suffix(F.col("file")).alias("s"), "n", "v", "a")
    e = edges.where("op <> 'Donor'").join(n.toDF(P, "src", "k0", "s0", "n0", "v0", "a0"), [P, "src"]).join(n.toDF(P, "dst", "k1", "s1", "n1", "v1", "a1"), [P, "dst"])
    donor = edges.where("op = 'Donor'").join(n.toDF(P, "src", "kd", "_s", "_n", "_v", "_a"), [P, "src"]).groupBy(P, "dst").agg(F.bool_and(F.col("kd").isNotNull()).alias("_there"), F.collect_set("kd").alias("_kinds"))
    d = e.join(donor, [P, "dst"], "left")
    moves, changed = (F.col("k0") != "image") & (F.col("k1") != "image"), ~F.col("k0").eqNullSafe(F.col("k1"))
    named = F.lower(F.regexp_extract("op", "put([^:]*)", 1))
    allowed = F.array(named)
    for name, fit in OUTPUT_SUFFIXES.items():
        allowed = F.when(named == name, F.array(*map(F.lit, fit))).otherwise(allowed)
    wrong = (F.col("op").startswith("Output")) & ~F.array_contains(allowed, F.col("s1"))
    text = F.concat(F.lit("Output file extension "), F.upper("s1"), F.lit(" doesn't match operation allowed extensions: "), F.array_join(allowed, ", "))
    streams_text = "change in the number of streams occurred"
    return union(
        [
            messages(e.where(changed), ERROR, "type_change", "operation not permitted to change the type of image or video file"),
            messages(d.where(changed & F.col("_there").isNull()), ERROR, "type_change_donor", "donor image missing"),
            messages(d.where(changed & F.exists("_kinds", lambda k: k != F.col("k1"))), ERROR, "type_change_donor", "operation not permitted to change the type of image or video file"),
            messages(e.where("s0 <> s1"), ERROR, "suffix", "File type changed"),
            messages(e.where(F.coalesce(F.col("k1"), F.lit("")) != "audio"), ERROR, "audio_output", "Expecting Audio file type"),
            messages(e.where(wrong), ERROR, "output_type", text),
            messages(e.where(moves & (F.col("n0") > F.col("n1"))), WARNING, "channel_loss", streams_text),
            messages(e.where(moves & (F.col("n0") != F.col("n1"))), WARNING, "same_channels", streams_text),
            messages(e.where(moves & (F.col("n0") == 0) & (F.col("n1") == 0)), ERROR, "same_channels", "streams are not detected or missing"),
            messages(e.where("v1 = 0"), ERROR, "has_video", "video channel missing in file"),
            messages(e.where("a1 = 0"), ERROR, "has_audio", "audio channel not present"),
            messages(e.where("v0 <> v1"), ERROR, "video_kept", "Video is missing from audio sample"),
        ]
    )


@register("composite_flags")
def composite_flag_rules(edges: DataFrame, operations: DataFrame) -> DataFrame:
    """Edges (record_mask, is_global, empty_mask, inputmaskname, arguments, dst_type, n_videomasks) that should be in the
    composite, have an empty mask, an input mask without need, or a video without masks; operations (op, category)."""
    e = edges.where("op <> 'Donor'").join(operations.select("op", "category"), "op", "left")
    outside = ~is_yes("is_global") & ~is_yes("record_mask")
    exempt = F.coalesce(F.col("category").isin("Output", "AntiForensic", "Laundering", "PostProcessing"), F.lit(False))
    sampled = F.coalesce(argument("purpose").isin("clone", "stacking"), F.lit(False))
    return union(
        [
            messages(e.where(outside), ERROR, "local", "Operation link appears affect local area in the image and should be included in the composite mask"),
            messages(e.where(outside & ~exempt), WARNING, "local_warn", "Operation link appears to affect local area in the image; should be included in the composite mask"),
            messages(e.where(is_yes("empty_mask")), ERROR, "empty", "An empty change mask indicating an manipulation did not occur."),
            messages(e.where(~sampled & F.col("inputmaskname").isNotNull()), WARNING, "sampled_input_mask", "Un-needed input mask."),
            messages(e.where((F.col("dst_type") == "video") & (F.coalesce("n_videomasks", F.lit(0)) == 0)), ERROR, "video_masks", "Edge missing video masks"),
        ]
    )
