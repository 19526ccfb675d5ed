"""Interval algebra over video frames and audio samples, one set of segments (set_id) per row group.

Segment columns: set_id, seg_no, type, rate, startframe, endframe (both inclusive, from 1), error; times are milliseconds
from 0, and an end time is the start of the last frame. Bounds: set_id, startframe, endframe. Rows of another type pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions.blocks import in_blocks, last_known, n_parts, ranked

from . import transforms

KEYS = ["set_id", "type"]


def frame_of(ms: Column, rate: Column) -> Column:
    """Rounded to 6 places first, so that a time that came from a frame gives that frame again."""
    return F.floor(F.round(ms * rate / 1000, 6)).cast("long") + 1


def time_of(frame: Column, rate: Column) -> Column:
    return (frame - 1) * 1000 / rate


def complete_segments(segs: DataFrame) -> DataFrame:
    """Fill startframe, endframe, starttime, endtime, frames and rate where one of them is missing but follows from others.

    The rate follows from frames and times only where it is null: (end - start frame) over the seconds between.
    """
    rate = F.coalesce("rate", (F.col("endframe") - F.col("startframe")) * 1000 / F.nullif(F.col("endtime") - F.col("starttime"), F.lit(0.0)))
    out = segs.withColumn("rate", rate)
    out = out.withColumns({f"{e}frame": F.coalesce(f"{e}frame", frame_of(F.col(f"{e}time"), F.col("rate"))) for e in ("start", "end")})
    out = out.withColumns({f"{e}time": F.coalesce(f"{e}time", time_of(F.col(f"{e}frame"), F.col("rate"))) for e in ("start", "end")})
    return out.withColumn("frames", F.col("endframe") - F.col("startframe") + 1)


def recalc_frames(segs: DataFrame) -> DataFrame:
    """Frames from times."""
    out = segs.withColumns({f"{e}frame": frame_of(F.col(f"{e}time"), F.col("rate")) for e in ("start", "end")})
    return out.withColumn("frames", F.col("endframe") - F.col("startframe") + 1)


def recalc_times(segs: DataFrame) -> DataFrame:
    """Times from frames."""
    return segs.withColumns({f"{e}time": time_of(F.col(f"{e}frame"), F.col("rate")) for e in ("start", "end")}).withColumn("frames", F.col("endframe") - F.col("startframe") + 1)


def from_constraints(start: Column, stop: Column, rate: Column) -> Column:
    """S3: struct(startframe, endframe) from struct(ms, frames) constraints: frames after the time count on from its frame."""
    one = lambda c: F.when(c.ms > 0, frame_of(c.ms, rate) + c.frames).otherwise(F.greatest(c.frames, F.lit(1)))
    return F.struct(one(start).alias("startframe"), one(stop).alias("endframe"))


def _cut(segs: DataFrame, bounds: DataFrame, type_: str | None) -> DataFrame:
    """segs with the bound's frames as _b, _e where a bound applies."""
    out = segs.join(bounds.select("set_id", F.col("startframe").alias("_b"), F.col("endframe").alias("_e")), "set_id", "left")
    if type_ is not None:
        out = out.withColumns({c: F.when(F.col("type") == type_, F.col(c)) for c in ("_b", "_e")})
    return out


def _parts(out: DataFrame, left: Column, right: Column, columns: list[str], keep: Column | None = None) -> DataFrame:
    """One row for each non-empty part of a segment; a segment without a bound stays as it is."""
    whole = F.struct(F.col("startframe").alias("s"), F.col("endframe").alias("e"), F.lit(0).alias("k"))
    parts = F.when(F.col("_b").isNull(), F.array(whole)).otherwise(F.filter(F.array(left, right), lambda p: p.s <= p.e))
    out = out.withColumn("_p", F.explode(parts))
    return out.select(*[F.col(f"_p.{'s' if c == 'startframe' else 'e'}").alias(c) if c in ("startframe", "endframe") else c for c in columns])


def _struct(s: Column, e: Column, k: int) -> Column:
    return F.struct(s.alias("s"), e.alias("e"), F.lit(k).alias("k"))


def drop_frames(segs: DataFrame, bounds: DataFrame, keep_time: bool = False, type_: str | None = None) -> DataFrame:
    """Remove the bound's frames, one bound for each set; what follows slides back, unless keep_time punches a hole.

    A segment over the bound splits; one inside it vanishes. Sets without a bound and other types pass.
    """
    n = F.lit(0).cast("long") if keep_time else F.col("_e") - F.col("_b") + 1
    left = _struct(F.col("startframe"), F.least("endframe", F.col("_b") - 1), 0)
    right = _struct(F.greatest("startframe", F.col("_e") + 1) - n, F.col("endframe") - n, 1)
    return _parts(_cut(segs, bounds, type_), left, right, segs.columns)


def insert_frames(segs: DataFrame, bounds: DataFrame, type_: str | None = None) -> DataFrame:
    """Make room for the bound's frames: a segment over the bound's start splits there, what follows slides forward."""
    n = F.col("_e") - F.col("_b") + 1
    left = _struct(F.col("startframe"), F.least("endframe", F.col("_b") - 1), 0)
    right = _struct(F.greatest("startframe", F.col("_b")) + n, F.col("endframe") + n, 1)
    return _parts(_cut(segs, bounds, type_), left, right, segs.columns)


def crop_frames(segs: DataFrame, bounds: DataFrame, type_: str | None = None) -> DataFrame:
    """Keep what lies in the bound, renumbered so that its first frame is 1."""
    inside = _struct(F.greatest("startframe", "_b") - F.col("_b") + 1, F.least("endframe", "_e") - F.col("_b") + 1, 0)
    return _parts(_cut(segs, bounds, type_), inside, _struct(F.lit(1).cast("long"), F.lit(0).cast("long"), 1), segs.columns)


def apply_bounds(segs: DataFrame, bounds: DataFrame, insert: bool = False) -> DataFrame:
    """S4, S5 with several bounds (bound_no orders them), each in the frames that the one before has left.

    One row holds a set's ordered bounds; each segment folds over them, so a set of any number of segments stays spread.
    """
    lists = bounds.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("bound_no", F.col("startframe").alias("b"), F.col("endframe").alias("e")))).alias("_bounds"))
    start = F.array(F.struct(F.col("startframe").alias("s"), F.col("endframe").alias("e")))

    def step(acc: Column, b: Column) -> Column:
        n = b.e - b.b + 1
        tail = (lambda p: F.struct((F.greatest(p.s, b.b) + n).alias("s"), (p.e + n).alias("e"))) if insert else (lambda p: F.struct((F.greatest(p.s, b.e + 1) - n).alias("s"), (p.e - n).alias("e")))
        cut = F.transform(acc, lambda p: F.array(F.struct(p.s.alias("s"), F.least(p.e, b.b - 1).alias("e")), tail(p)))
        return F.filter(F.flatten(cut), lambda p: p.s <= p.e)

    out = segs.join(lists, "set_id", "left")
    done = F.aggregate(F.coalesce("_bounds", F.array().cast(lists.schema["_bounds"].dataType)), start, step)
    out = out.withColumn("_p", F.explode(done))
    return out.select(*[F.col("_p.s").alias(c) if c == "startframe" else F.col("_p.e").alias(c) if c == "endframe" else F.col(c) for c in segs.columns])


def intersect_segments(a: DataFrame, b: DataFrame, bucket: int = 256) -> DataFrame:
    """Overlaps of two segment tables: same set and type, rate of the first.

    Segments meet in the buckets of frames that they cover, and count in the one where the later of both starts, so that a long
    stream's pairs are not all formed.
    """
    place = lambda frame: F.floor(frame / bucket)
    covers = F.explode(F.sequence(place(F.col("startframe")), place(F.col("endframe"))))
    some = a.where("startframe <= endframe").withColumn("_k", covers)
    other = b.where("startframe <= endframe").withColumn("_k", covers).select("set_id", "type", "_k", F.col("seg_no").alias("other_no"), F.col("startframe").alias("_s"), F.col("endframe").alias("_e"))
    hit = some.join(other, [*KEYS, "_k"]).where((F.col("startframe") <= F.col("_e")) & (F.col("_s") <= F.col("endframe")) & (F.col("_k") == place(F.greatest("startframe", "_s"))))
    return hit.select("set_id", "type", "rate", "seg_no", "other_no", F.greatest("startframe", "_s").alias("startframe"), F.least("endframe", "_e").alias("endframe"))


def subtract_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """B without what a covers, and a itself, as (set_id, type, startframe, endframe).

    Kept as the reference's test has it: a row of b that starts inside a row of a and ends after it goes whole. A row of b
    folds over the rows of a in its set, in order.
    """
    rows = a.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct(F.col("startframe").alias("s"), F.col("endframe").alias("e")))).alias("_a"))
    start = F.array(F.struct(F.col("startframe").alias("s"), F.col("endframe").alias("e")))

    def step(acc: Column, x: Column) -> Column:
        def one(p: Column) -> Column:
            clear = (p.e < x.s) | (p.s > x.e)
            before = F.struct(p.s.alias("s"), F.least(p.e, x.s - 1).alias("e"))
            after = F.struct((x.e + 1).alias("s"), p.e.alias("e"))
            empty = F.array().cast("array<struct<s:bigint,e:bigint>>")
            return F.when(clear, F.array(p)).when(p.s >= x.s, empty).otherwise(F.filter(F.array(before, after), lambda q: q.s <= q.e))

        return F.flatten(F.transform(acc, one))

    cut = b.join(rows, KEYS, "left")
    cut = cut.withColumn("_p", F.explode(F.when(F.col("_a").isNull(), start).otherwise(F.aggregate("_a", start, step))))
    rest = cut.select(*KEYS, F.col("_p.s").alias("startframe"), F.col("_p.e").alias("endframe"))
    return a.select(*KEYS, "startframe", "endframe").unionByName(rest)


def reverse_segments(segs: DataFrame, bounds: DataFrame, type_: str | None = None) -> DataFrame:
    """Mirror inside the bound; what lies outside stays, and segments split at the bound."""
    out = _cut(segs, bounds, type_)
    lo, hi = F.greatest("startframe", "_b"), F.least("endframe", "_e")
    parts = F.array(
        _struct(F.col("startframe"), F.least("endframe", F.col("_b") - 1), 0),
        F.when(lo <= hi, _struct(F.col("_b") + F.col("_e") - hi, F.col("_b") + F.col("_e") - lo, 1)).otherwise(_struct(F.lit(1).cast("long"), F.lit(0).cast("long"), 1)),
        _struct(F.greatest("startframe", F.col("_e") + 1), F.col("endframe"), 2),
    )
    whole = F.array(_struct(F.col("startframe"), F.col("endframe"), 0))
    out = out.withColumn("_p", F.explode(F.when(F.col("_b").isNull(), whole).otherwise(F.filter(parts, lambda p: p.s <= p.e))))
    return out.select(*[F.col("_p.s").alias(c) if c == "startframe" else F.col("_p.e").alias(c) if c == "endframe" else F.col(c) for c in segs.columns])


def warp_segments(segs: DataFrame, src: DataFrame, dst: DataFrame, inverse: bool = False) -> DataFrame:
    """Scale frames from one medium to another (set_id, frames, rate, duration_ms), clamp to the target's end, add the error in ms.

    inverse carries from the target back to the source. Sets whose media do not differ stay as they are.
    """
    if inverse:
        src, dst = dst, src
    one = src.select("set_id", F.col("frames").alias("_f0"), F.col("rate").alias("_r0"))
    two = dst.select("set_id", F.col("frames").alias("_f1"), F.col("rate").alias("_r1"))
    out = segs.join(one, "set_id").join(two, "set_id")
    scale = F.col("_f1") / F.col("_f0")
    moved = (F.col("_f0") != F.col("_f1")) | (F.col("_r0") != F.col("_r1"))
    exact = (F.col("startframe") - 1) * scale + 1
    start = F.least(F.greatest(F.round(exact), F.lit(1)), F.col("_f1")).cast("long")
    end = F.least(F.greatest(F.round(F.col("endframe") * scale), start), F.col("_f1")).cast("long")
    # Both parts in whole microseconds, so that the sum does not depend on how doubles round.
    micros = lambda ms: F.floor(ms * 1e6 + 0.5)
    gap = F.floor(F.abs(exact - F.round(exact)) * 1e9 / F.col("_r1") + 0.5)
    new = {
        "startframe": F.when(moved, start).otherwise(F.col("startframe")),
        "endframe": F.when(moved, end).otherwise(F.col("endframe")),
        "rate": F.when(moved, F.col("_r1")).otherwise(F.col("rate")),
        "error": F.when(moved, (micros(F.col("error")) + gap) / 1e6).otherwise(F.col("error")),
    }
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in segs.columns])


def segment_span(segs: DataFrame) -> DataFrame:
    """The last frame and the sorted types of each set."""
    return segs.groupBy("set_id").agg(F.max("endframe").alias("last_frame"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def clamp_to_end(segs: DataFrame, media: DataFrame) -> DataFrame:
    """Cut segments at their stream's last frame (set_id, frames); those beyond it go, sets without a stream stay."""
    out = segs.join(media.select("set_id", F.col("frames").alias("_last")), "set_id", "left")
    out = out.where(F.col("_last").isNull() | (F.col("startframe") <= F.col("_last")))
    return out.withColumn("endframe", F.coalesce(F.least("endframe", "_last"), F.col("endframe"))).select(segs.columns)


def entire_stream(media: DataFrame, types: list[str] | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """One segment over each stream (set_id, type, channel, rate, frames) of the wanted types at a constant rate; with bounds (set_id,
    start, stop: struct(ms, frames), null: open) over the part of it that they leave, none if nothing is left. seg_no numbers a set's streams."""
    m = media if types is None else media.where(F.col("type").isin(types))
    m = m.withColumn("seg_no", F.expr("cast(row_number() over (partition by set_id order by type, channel) as bigint)"))
    one = F.struct(F.lit(0.0).alias("ms"), F.lit(1).cast("long").alias("frames"))
    if bounds is not None:
        m = m.join(bounds.select("set_id", F.col("start").alias("_s"), F.col("stop").alias("_e")), "set_id", "left")
        cut = from_constraints(F.coalesce("_s", one), F.col("_e"), F.col("rate"))
        m = m.withColumn("_cut", cut).withColumns({"startframe": F.col("_cut.startframe"), "endframe": F.least(F.when(F.col("_e").isNotNull(), F.col("_cut.endframe")), "frames")})
    else:
        m = m.withColumns({"startframe": F.lit(1).cast("long"), "endframe": F.col("frames")})
    times = {f"{e}time": F.round(time_of(F.col(f"{e}frame"), F.col("rate")), 6) for e in ("start", "end")}
    return m.where("startframe <= endframe").withColumns(times).select("set_id", "seg_no", "type", "channel", "rate", "startframe", "endframe", "starttime", "endtime")


#: Changes of sound that have a bound, in the order in which they apply.
AUDIO_OPS = ("DeleteAudio", "InsertAudio", "AddAudio")


def apply_audio_op(segs: DataFrame, bounds: DataFrame, op: Column | str = "op") -> DataFrame:
    """Bounds carry `op`: DropAudio removes all audio; DeleteAudio cuts and slides; InsertAudio makes room; AddAudio punches a hole. Video passes."""
    op = F.col(op) if isinstance(op, str) else op
    kind = bounds.withColumn("_op", op)
    # One row a set says whether its sound goes and which bounds it has, so segments meet the bounds in one join.
    bound = F.struct(F.col("startframe").alias("b"), F.col("endframe").alias("e"))
    lists = kind.groupBy("set_id").agg(F.bool_or(F.col("_op") == "DropAudio").alias("_none"), *(F.collect_list(F.when(F.col("_op") == k, bound)).alias(f"_{k}") for k in AUDIO_OPS))
    out = segs.join(lists, "set_id", "left").where((F.col("type") != "audio") | ~F.coalesce("_none", F.lit(False)))
    for k in AUDIO_OPS:
        # As by a left join: a segment comes once for each bound, once without one if there is none.
        own = F.explode_outer(F.when(F.col("type") == "audio", F.col(f"_{k}")))
        out = out.withColumn("_x", own)
        n = F.col("_x.e") - F.col("_x.b") + 1
        gone = {"DeleteAudio": n, "InsertAudio": -n, "AddAudio": F.lit(0).cast("long")}[k]
        after = F.col("_x.b") if k == "InsertAudio" else F.col("_x.e") + 1
        left = _struct(F.col("startframe"), F.least("endframe", F.col("_x.b") - 1), 0)
        right = _struct(F.greatest("startframe", after) - gone, F.col("endframe") - gone, 1)
        whole = _struct(F.col("startframe"), F.col("endframe"), 0)
        out = out.withColumn("_p", F.explode(F.when(F.col("_x").isNull() | F.col("_x.b").isNull(), F.array(whole)).otherwise(F.filter(F.array(left, right), lambda p: p.s <= p.e))))
        out = out.withColumns({"startframe": F.col("_p.s"), "endframe": F.col("_p.e")}).drop("_p", "_x")
    return out.select(segs.columns)


def apply_frame_op(segs: DataFrame, bounds: DataFrame, donor: bool = False) -> DataFrame:
    """Segments after the operation of their set's bound, by its program; with `donor` before it, by the inverse.

    bounds: set_id, op, media_type, and as far as they apply startframe, endframe, add_type, to_start and to_end (where a copy was
    taken), from_frames and to_frames. In the donor direction what a copy laid over goes and what it was taken from is given
    back, as segment 0, once for each set and type. Sets without a bound pass.
    """
    edges = transforms.compiled(bounds.withColumnsRenamed({"startframe": "b_start", "endframe": "b_end"}))
    program = transforms.inverse(F.col("program")) if donor else F.col("program")
    out = segs.join(edges.select("set_id", program.alias("_program")), "set_id", "left")
    parts = transforms.run(F.coalesce("_program", F.array().cast(transforms.PROGRAM)), F.col("type"), F.col("seg_no"), F.col("startframe"), F.col("endframe"))
    out = out.withColumn("_p", F.explode(parts)).withColumn("_given", F.col("_p.n") == 0)
    own = {"seg_no": F.col("_p.n"), "startframe": F.col("_p.s"), "endframe": F.col("_p.e")}
    moved = out.select(*(own[c].alias(c) if c in own else F.col(c) for c in segs.columns), "_given")
    kept = moved.where("not _given").drop("_given")
    if not donor:
        return kept
    return kept.unionByName(moved.where("_given").drop("_given").dropDuplicates(["set_id", "type", "startframe", "endframe"]))


def mask_at(mask_frames: DataFrame, ms: Column) -> DataFrame:
    """Of each segment the mask frame nearest at or before a time, else the first."""
    rank = F.struct((F.col("time_ms") > ms).alias("late"), F.abs(F.col("time_ms") - ms).alias("d"), "frame_no")
    cols = [c for c in mask_frames.columns if c != "segment_id"]
    return mask_frames.groupBy("segment_id").agg(F.min_by(F.struct(*cols), rank).alias("_r")).select("segment_id", "_r.*")


def resample_mask_frames(mask_frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """Mask frames of a segment spread over `wanted` (segment_id, frames): every n-th goes or comes twice, the last fills up."""
    have = ranked(mask_frames, ["segment_id"], "frame_no").join(wanted.select("segment_id", F.col("frames").alias("_m")), "segment_id")
    lo, hi = F.ceil((F.col("_i") - 1) * F.col("_m") / F.col("_n")), F.ceil(F.col("_i") * F.col("_m") / F.col("_n")) - 1
    return have.where(lo <= hi).withColumn("new_no", F.explode(F.sequence(lo + 1, hi + 1))).drop("_i", "_n", "_m")


def match_segments(expected: DataFrame, actual: DataFrame, tolerance: int = 0) -> DataFrame:
    """(set_id, type, startframe, status): matched, differs (end frame off by more than the tolerance), missing or unexpected."""
    a = expected.groupBy(*KEYS, "startframe").agg(F.max("endframe").alias("_x"))
    b = actual.groupBy(*KEYS, "startframe").agg(F.max("endframe").alias("_y"))
    status = F.when(F.col("_y").isNull(), "missing").when(F.col("_x").isNull(), "unexpected").when(F.abs(F.col("_x") - F.col("_y")) > tolerance, "differs").otherwise("matched")
    return a.join(b, [*KEYS, "startframe"], "full_outer").select(*KEYS, "startframe", status.alias("status"))


def audio_to_video(segs: DataFrame, frames: DataFrame) -> DataFrame:
    """As-of: the first video frame at or after each segment's time (set_id, ms); segs (set_id, seg_no, ms), frames (set_id, frame_no, time_ms)."""
    rows = segs.select("set_id", F.col("ms").alias("t"), F.lit(0).alias("_k"), "seg_no", F.lit(None).cast("long").alias("frame_no"))
    rows = rows.unionByName(frames.select("set_id", F.col("time_ms").alias("t"), F.lit(1).alias("_k"), F.lit(None).cast("long").alias("seg_no"), "frame_no"))
    found = last_known(in_blocks(rows, "t"), ["set_id"], ["t", "_k", "frame_no"], {}, {"frame": "frame_no"})
    return found.where("_k = 0").select("set_id", "seg_no", F.col("frame").alias("frame_no"))


def position_segments(positions: DataFrame, start: float, end: float, fps: float) -> DataFrame:
    """(set_id, pos_no, begin_ms, end_ms): each position's part up to one frame before the next, clipped to [start, end]; positions carry ms and duration_ms."""
    nxt = F.expr("lead(ms) over (partition by set_id order by ms, pos_no)")
    stop = F.least(F.col("ms") + F.col("duration_ms"), F.coalesce(nxt - 1000.0 / fps, F.lit(end)), F.lit(end))
    return positions.withColumn("end_ms", stop).withColumn("begin_ms", F.greatest("ms", F.lit(start))).where("begin_ms <= end_ms").select("set_id", "pos_no", "begin_ms", "end_ms")


def seed_segments(segs: DataFrame) -> DataFrame:
    """Where a cut or a crop shows in what is left, by `op`: the frame before the cut and the cut's first; or the whole remaining stream.

    segs carry frames, starttime and rate; rows of another op go.
    """
    step = 1000.0 / F.col("rate")
    cut, early = F.col("op") == "cut", F.col("startframe") - 1 < 0
    rows = segs.where(F.col("op").isin("cut", "crop"))
    return rows.withColumns(
        {
            "startframe": F.when(~cut | early, F.lit(1)).otherwise(F.col("startframe") - 1).cast("long"),
            "endframe": F.when(cut, F.col("startframe")).otherwise(F.col("frames") - 1).cast("long"),
            "endtime": F.when(cut, F.col("starttime")).otherwise(F.col("starttime") + step * (F.col("frames") - 1)),
            "starttime": F.when(~cut | early, F.lit(0.0)).otherwise(F.col("starttime") - step),
        }
    )


def snap_to_frames(segs: DataFrame, frames: DataFrame) -> DataFrame:
    """Starts and ends moved to the last frame at or before them, for a variable rate.

    segs: set_id, seg_no (unique in the set), starttime, endtime, error. frames: set_id, frame_no from 1, time_ms. A time after which
    no frame comes stays, its frame null; before the first frame it is frame 0 at 0 ms. The error grows by the distance from the start, or
    if only the end was moved from the end, to the next frame.
    """
    hits = segs.select("set_id", "seg_no", "error", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("starttime").alias("t")), F.struct(F.lit(1).alias("end"), F.col("endtime").alias("t")))).alias("h")).select("set_id", "seg_no", "error", "h.*")
    none = lambda kind: F.lit(None).cast(kind)
    rows = hits.select("set_id", "seg_no", "error", "end", "t", F.lit(1).alias("_k"), none("long").alias("frame_no"), none("double").alias("time_ms"))
    rows = rows.unionByName(frames.select("set_id", none("long").alias("seg_no"), none("double").alias("error"), none("int").alias("end"), F.col("time_ms").alias("t"), F.lit(0).alias("_k"), "frame_no", "time_ms"))
    rows = last_known(in_blocks(rows, "t"), ["set_id"], ["t", "_k", "frame_no"], {"_frame": "frame_no", "_last": "time_ms"}, {"_next": "time_ms"}).where("_k = 1")
    moved = F.col("_next").isNotNull()
    pick = lambda e, c: F.max(F.when(F.col("end") == e, c))
    at = {"frame": F.when(moved, F.coalesce("_frame", F.lit(0).cast("long"))), "time": F.when(moved, F.coalesce("_last", F.lit(0.0))), "gap": F.col("_next") - F.col("t")}
    own = [pick(0, F.col("t")).alias("_s"), pick(1, F.col("t")).alias("_e"), F.max("error").alias("error")]
    out = rows.repartition(n_parts(2 * segs.count(), segs.sparkSession), "set_id", "seg_no").groupBy("set_id", "seg_no").agg(*own, *(pick(e, c).alias(f"{side}{name}") for name, c in at.items() for e, side in enumerate(("start", "end"))))
    return out.select(
        "set_id", "seg_no", "startframe", "endframe", F.coalesce("starttime", "_s").alias("starttime"), F.coalesce("endtime", "_e").alias("endtime"),
        (F.coalesce("error", F.lit(0.0)) + F.coalesce("startgap", "endgap", F.lit(0.0))).alias("error"),
    )
