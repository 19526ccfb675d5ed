"""Differences of stream and frame metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.functions.scalars import map_diff


def stream_ids(streams: DataFrame) -> DataFrame:
    """F8: streams (file, stream_pos, codec_type, channel_layout) with `stream`: video, or an audio layout, numbered from its second on."""
    name = F.when(F.col("codec_type") == "audio", F.coalesce("channel_layout", F.lit("audio"))).otherwise(F.col("codec_type"))
    out = streams.withColumn("_s", name).withColumn("_k", F.expr("row_number() over (partition by file, _s order by stream_pos)"))
    return out.withColumn("stream", F.when(F.col("_k") == 1, F.col("_s")).otherwise(F.concat("_s", (F.col("_k") - 1).cast("string")))).drop("_s", "_k")


def stream_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """F8: (file, stream, diff) for streams (file, stream, meta map) of two versions; a lost or new stream counts as empty on the other side."""
    none = F.create_map().cast("map<string,string>")
    j = a.select("file", "stream", F.col("meta").alias("_a")).join(b.select("file", "stream", F.col("meta").alias("_b")), ["file", "stream"], "full_outer")
    return j.select("file", "stream", map_diff(F.coalesce("_a", none), F.coalesce("_b", none)).alias("diff")).where(F.size("diff") > 0)


def packet_diff(a: DataFrame, b: DataFrame, step: float = 0.0) -> DataFrame:
    """frames (media_id, stream, time_ms, meta map; one row a time) aligned by time: (media_id, stream, time_ms, action, n, diff).

    Frames at equal times are one; of the rest, in order of time, two neighbours from different sides less than `step` apart are
    one too, from the first on (time_ms is the first's). Pairs that differ are changes. What is left is an add or a delete; frames
    after the other side's last are one row, at the first of them, with their number n and no diff.
    """
    keys = ["media_id", "stream"]
    none = F.create_map().cast("map<string,string>")
    j = a.select(*keys, "time_ms", F.col("meta").alias("_a")).join(b.select(*keys, "time_ms", F.col("meta").alias("_b")), [*keys, "time_ms"], "full_outer")
    last = j.groupBy(*keys).agg(F.max(F.when(F.col("_a").isNotNull(), F.col("time_ms"))).alias("_la"), F.max(F.when(F.col("_b").isNotNull(), F.col("time_ms"))).alias("_lb"))
    by = "over (partition by media_id, stream order by time_ms)"
    rest = j.where("_a is null or _b is null").withColumn("_side", F.col("_a").isNull())
    # A chain: each frame from the other side than the one before, and less than a step later. Its frames pair off in order.
    rest = rest.withColumn("_new", F.expr(f"case when _side <> lag(_side) {by} and time_ms - lag(time_ms) {by} < {step} then 0 else 1 end"))
    rest = rest.withColumn("_chain", F.expr("sum(_new) over (partition by media_id, stream order by time_ms rows unbounded preceding)"))
    rest = rest.withColumn("_pair", F.expr("floor((row_number() over (partition by media_id, stream, _chain order by time_ms) - 1) / 2)"))
    pairs = rest.groupBy(*keys, "_chain", "_pair").agg(F.min("time_ms").alias("time_ms"), F.first("_a", True).alias("_a"), F.first("_b", True).alias("_b"))
    whole = j.where("_a is not null and _b is not null").unionByName(pairs.select(*keys, "time_ms", "_a", "_b")).join(last, keys)
    action = F.when(F.col("_a").isNull(), "add").when(F.col("_b").isNull(), "delete").otherwise("change")
    tail = (F.col("_a").isNull() & (F.col("time_ms") > F.coalesce("_la", F.lit(-1)))) | (F.col("_b").isNull() & (F.col("time_ms") > F.coalesce("_lb", F.lit(-1))))
    rows = whole.withColumns({"action": action, "_tail": tail})
    inner = rows.where("not _tail").select(*keys, "time_ms", "action", F.lit(1).cast("long").alias("n"), map_diff(F.coalesce("_a", none), F.coalesce("_b", none)).alias("diff"))
    inner = inner.where((F.col("action") != "change") | (F.size("diff") > 0))
    ends = rows.where("_tail").groupBy(*keys, "action").agg(F.min("time_ms").alias("time_ms"), F.count(F.lit(1)).alias("n"))
    return inner.unionByName(ends.withColumn("diff", F.lit(None).cast(inner.schema["diff"].dataType)))


def diff_rows(df: DataFrame, diff: str) -> DataFrame:
    """one row for each key of a diff: (…, key, action, old, new)."""
    rest = [c for c in df.columns if c != diff]
    return df.select(*rest, F.explode(diff).alias("key", "_v")).select(*rest, "key", "_v.action", "_v.old", "_v.new")


def rate_change(edges: DataFrame) -> DataFrame:
    """edges (metadatadiff: map of key to struct(action, old, new)) with the frames, milliseconds and rate on both sides."""
    at = lambda k, side: F.try_element_at("metadatadiff", F.lit(k)).getField(side).try_cast("double")
    return edges.withColumns({
        "old_frames": at("nb_frames", "old"), "new_frames": at("nb_frames", "new"), "old_ms": at("duration", "old") * 1000, "new_ms": at("duration", "new") * 1000,
        "rate": F.coalesce(at("r_frame_rate", "new"), at("r_frame_rate", "old")),
    })
