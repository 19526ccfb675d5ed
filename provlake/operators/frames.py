"""Windows over frames and samples: change ranges, silence, differences, averages, duplicate frames, best pairs; pixel statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions.blocks import in_blocks, previous, ranked, running_sums
from provlake.functions.storage import written


def islands(df: DataFrame, keys: list[str], order: str, flag: Column, step: int = 1) -> DataFrame:
    """(keys, start, stop, n): runs of rows with the flag whose order numbers are at most `step` apart.

    Runs are found in blocks of order numbers first; only runs, not rows, meet over the borders of blocks.
    """
    by = ", ".join(keys)

    def merged(rows: DataFrame, within: str, start: str, stop: str, n: Column) -> DataFrame:
        over = f"over (partition by {within} order by {start})"
        rows = rows.withColumn("_new", F.expr(f"case when {start} - lag({stop}) {over} <= {step} then 0 else 1 end"))
        rows = rows.withColumn("_run", F.expr(f"sum(_new) over (partition by {within} order by {start} rows unbounded preceding)"))
        return rows.groupBy(*within.split(", "), "_run").agg(F.min(start).alias("_start"), F.max(stop).alias("_stop"), n.alias("_n"))

    parts = merged(in_blocks(df.where(flag), order), f"{by}, _block", order, order, F.count(F.lit(1)))
    parts = parts.select(*keys, F.col("_start").alias("_s"), F.col("_stop").alias("_e"), F.col("_n").alias("_m"))
    return merged(parts, by, "_s", "_e", F.sum("_m")).select(*keys, F.col("_start").alias("start"), F.col("_stop").alias("stop"), F.col("_n").alias("n"))


def change_ranges(frames: DataFrame) -> DataFrame:
    """Consecutive changed frames of a medium as one segment (media_id, startframe, endframe, frames)."""
    out = islands(frames, ["media_id"], "frame_no", F.col("changed"))
    return out.select("media_id", F.col("start").alias("startframe"), F.col("stop").alias("endframe"), F.col("n").alias("frames"))


def cut_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Runs of frames (media_id, frame_no, hash) of a whose hash b lacks: (media_id, startframe, endframe, frames)."""
    lost = a.join(b.select("media_id", "hash").distinct(), ["media_id", "hash"], "left_anti").withColumn("changed", F.lit(True))
    return change_ranges(lost)


def silences(samples: DataFrame, least: int, threshold: int) -> DataFrame:
    """(media_id, start, stop, n): runs of n windows of `least` samples, numbered one by one, that all stay within the threshold.

    Windows that are quiet follow one another in a run of quiet samples, so only runs of at least one window are looked for.
    """
    quiet = islands(samples, ["media_id"], "sample_no", F.abs("value") <= threshold)
    return quiet.where(F.col("n") >= least).withColumn("n", F.col("n") - least + 1)


def silence_pairs(ranges: DataFrame, least: int, most: int) -> DataFrame:
    """Pairs of silences whose outer extent lies within [least, most] samples.

    The second starts at most `most` samples after the first, so each first meets only the two buckets of starts that it can reach.
    """
    bucket = max(most, 1)
    a = ranges.select("media_id", F.col("start").alias("start_a"), F.col("stop").alias("stop_a"), F.explode(F.array(F.floor(F.col("start") / bucket), F.floor(F.col("start") / bucket) + 1)).alias("_k"))
    b = ranges.select("media_id", F.col("start").alias("start_b"), F.col("stop").alias("stop_b"), F.floor(F.col("start") / bucket).alias("_k"))
    return a.join(b, ["media_id", "_k"]).where("start_b > stop_a").where((F.col("stop_b") - F.col("start_a")).between(least, most)).drop("_k")


def audio_changes(a: DataFrame, b: DataFrame, window: int = 32, threshold: float = 3, gap: int = 44_100) -> DataFrame:
    """(media_id, start, stop, n): where the moving average of the sample difference passes the threshold; a gap starts a new range."""
    diff = a.join(b.select("media_id", "sample_no", F.col("value").alias("_v")), ["media_id", "sample_no"]).withColumn("_d", F.abs(F.col("value") - F.col("_v")))
    return islands(_averaged(diff, "_d", "_avg", window), ["media_id"], "sample_no", F.col("_avg") > threshold, gap)


def _averaged(samples: DataFrame, value: str, out: str, n: int) -> DataFrame:
    """samples with the mean of each sample and of those among the n - 1 order numbers before it, for a window of any length.

    A sample enters the running sum at its number and leaves it n later, so the work does not grow with the window.
    """
    number = F.col("sample_no")
    enter = samples.withColumns({"_at": number, "_v": F.col(value), "_c": F.lit(1).cast("long"), "_own": F.lit(True)})
    leave = samples.withColumns({"_at": number + n, "_v": -F.col(value), "_c": F.lit(-1).cast("long"), "_own": F.lit(False)})
    both = running_sums(in_blocks(enter.unionByName(leave), "_at"), ["media_id"], "_at, _own", {"_s": "_v", "_k": "_c"})
    return both.where("_own").withColumn(out, F.col("_s") / F.col("_k")).select(*samples.columns, out)


def moving_average(samples: DataFrame, n: int) -> DataFrame:
    """Mean of each sample and the n - 1 before it."""
    return _averaged(samples, "value", "mean", n).withColumn("mean", F.round("mean", 6))


def equalize(histogram: DataFrame, levels: int = 256) -> DataFrame:
    """(media_id, value, n) to the value each grey level has after equalising by the cumulative distribution."""
    out = histogram.withColumn("_c", F.expr("sum(n) over (partition by media_id order by value)")).withColumn("_t", F.expr("sum(n) over (partition by media_id)"))
    return out.select("media_id", "value", F.floor(F.col("_c") * (levels - 1) / F.col("_t")).cast("long").alias("equalized"))


def time_bounds(frames: DataFrame, start_ms: float, start_frames: int, stop_ms: float, stop_frames: int) -> DataFrame:
    """(media_id, startframe, endframe): the frame that is `frames` frames after a time, for start and stop."""
    late = {"_a": F.col("time_ms") > start_ms, "_z": F.col("time_ms") > stop_ms}
    rows = in_blocks(frames, "frame_no").withColumns({k: c.cast("int") for k, c in late.items()})
    out = running_sums(rows, ["media_id"], "frame_no", {f"{k}r": k for k in late})
    first = F.min(F.when(F.col("_ar") >= max(start_frames, 1), F.col("frame_no")))
    last = F.min(F.when(F.col("_zr") >= max(stop_frames, 1), F.col("frame_no")))
    return out.groupBy("media_id").agg(first.alias("startframe"), last.alias("endframe"))


def std_of_difference(a: Column, b: Column) -> Column:
    """Population standard deviation of the element-wise difference of two arrays of doubles."""
    d = F.zip_with(a, b, lambda x, y: (x - y).cast("double"))
    n = F.size(d)
    mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / n
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)


def drop_duplicate_frames(frames: DataFrame, threshold: int) -> DataFrame:
    """Frames (media_id, frame_no, gray array) whose rounded std of the difference to the frame read before passes the threshold; first frames stay."""
    prev = previous(frames, ["media_id"], "frame_no", "gray", "_p")
    return prev.where(F.col("_p").isNull() | (F.round(std_of_difference(F.col("gray"), F.col("_p"))) > threshold)).drop("_p")


def neighbour_diffs(frames: DataFrame, first: int) -> DataFrame:
    """(media_id, mean, std) of the std of neighbouring histogram differences over the first frames."""
    prev = previous(frames.where(F.col("frame_no") <= first), ["media_id"], "frame_no", "gray", "_p")
    d = prev.where("_p is not null").withColumn("_d", std_of_difference(F.col("gray"), F.col("_p")))
    return d.groupBy("media_id").agg(F.round(F.avg("_d"), 4).alias("mean"), F.round(F.stddev_pop("_d"), 4).alias("std"))


#: Stretches of a frame whose means bound differences from below, and pairs of tiles of a medium that are searched first.
PARTS, FIRST_PAIRS = 4, 8
#: Frames that are sent to a search together, and of these the rows of one matrix product.
TILE, ROWS = 4096, 256


def _summaries(f: DataFrame) -> DataFrame:
    """(media_id, _b, least, most: the range of each stretch's mean about the frame's mean, of the block's frames)."""
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda t, x: t + x.cast("double")) / F.size(c)
    cut = lambda j: F.floor(F.size("gray") * j / PARTS).cast("int")
    rows = f.withColumn("_mean", mean(F.col("gray")))
    share = [F.sqrt((cut(j + 1) - cut(j)) / F.size("gray")) for j in range(PARTS)]
    parts = [F.when(cut(j + 1) > cut(j), share[j] * (mean(F.slice("gray", cut(j) + 1, F.greatest(cut(j + 1) - cut(j), F.lit(1)))) - F.col("_mean"))).otherwise(0.0) for j in range(PARTS)]
    rows = rows.select("media_id", "_b", *(c.alias(f"_p{j}") for j, c in enumerate(parts)))
    of = lambda agg: F.array(*(agg(f"_p{j}") for j in range(PARTS)))
    return rows.groupBy("media_id", "_b").agg(of(F.min).alias("least"), of(F.max).alias("most"))


def block_pairs(frames: DataFrame) -> DataFrame:
    """(media_id, _a, _b, bound): all pairs of a medium's blocks, from one row a block, with a bound that no std of a difference of their
    frames falls below: the distance of their boxes of stretch means, which are a projection of the frames."""
    s = written(_summaries(frames))
    side = lambda x: s.select("media_id", F.col("_b").alias(f"_{x}"), F.col("least").alias(f"lo_{x}"), F.col("most").alias(f"hi_{x}"))
    pairs = side("a").join(side("b"), "media_id").where("_a <= _b")
    gaps = F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return pairs.select("media_id", "_a", "_b", F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda t, x: t + x * x)).alias("bound"))


def best_frame_pairs(frames: DataFrame, distance: int, offset: int = 0, k: int = 50, block: int = 256) -> DataFrame:
    """(media_id, frame_a, frame_b, score): of all pairs at least `distance` apart the k with the lowest std of difference.

    Frames are cut into blocks, whose bounds are found for all pairs of blocks, and blocks are put together in tiles of TILE frames. Pairs
    of tiles are the work: dealt by (medium, a, b), each gets the frames of its two tiles and keeps its own k best. The pairs with the least
    bounds are searched first; what their k-th score rules out by its bound is not searched at all, and in what is searched only pairs of
    frames within that score are looked at one by one.
    """
    f = written(frames.where(F.col("frame_no") > offset).select("media_id", "frame_no", F.col("gray").cast("array<double>").alias("gray")).withColumn("_b", F.floor(F.col("frame_no") / block)))
    tile = lambda b: F.floor(F.col(b) / max(TILE // block, 1))
    bounds = block_pairs(f).groupBy("media_id", tile("_a").alias("_a"), tile("_b").alias("_b")).agg(F.min("bound").alias("bound"))
    pairs = written(bounds.withColumn("_k", F.expr("row_number() over (partition by media_id order by bound, _b - _a, _a)")))
    f = f.withColumn("_t", tile("_b")).drop("_b")

    def best(key: tuple, rows: pa.Table) -> pa.Table:
        m, a, b, most = (x.as_py() for x in key)
        number, of = rows.column("frame_no").to_numpy(), rows.column("_t").to_numpy()
        flat = rows.column("gray").combine_chunks()
        gray = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
        gray = gray - gray.mean(1, keepdims=True)
        sides = [np.flatnonzero(of == t) for t in (a, b)]
        i, j, score = _least_pairs(*((number[x], gray[x]) for x in sides), distance, k, np.inf if most is None else most)
        return pa.table({"media_id": pa.array([m] * len(i), pa.int64()), "frame_a": pa.array(i, pa.int64()), "frame_b": pa.array(j, pa.int64()), "score": pa.array(score, pa.int64())})

    def searched(work: DataFrame) -> DataFrame:
        # A tile against itself is sent once.
        sent = work.select("media_id", "_a", "_b", "_most", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_t")).join(f, ["media_id", "_t"])
        found = sent.groupBy("media_id", "_a", "_b", "_most").applyInArrow(best, "media_id long, frame_a long, frame_b long, score long")
        return found.withColumn("_k", F.expr("row_number() over (partition by media_id order by score, frame_a, frame_b)")).where(F.col("_k") <= k)

    first = written(searched(pairs.where(F.col("_k") <= FIRST_PAIRS).withColumn("_most", F.lit(None).cast("long"))))
    reach = first.where(F.col("_k") == k).select("media_id", F.col("score").alias("_most"))
    # A score is the std in thousandths, rounded down.
    rest = pairs.where(F.col("_k") > FIRST_PAIRS).join(reach, "media_id", "left").where(F.col("_most").isNull() | (F.floor(F.col("bound") * 1000 - 1e-6) <= F.col("_most")))
    both = first.drop("_k").unionByName(searched(rest).drop("_k"))
    return both.withColumn("_k", F.expr("row_number() over (partition by media_id order by score, frame_a, frame_b)")).where(F.col("_k") <= k).drop("_k")


def _least_pairs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], distance: int, k: int, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frames of a, frames of b, scores) of the k least pairs at least `distance` apart, by score, then numbers, of those that score `most` or
    less. a, b: frame numbers, and frames less their means."""
    (na, ga), (nb, gb) = (tuple(x[np.argsort(n, kind="stable")] for x in (n, g)) for n, g in (a, b))
    found = (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8"))
    if not len(na) or not len(nb):
        return found
    va, vb, size = (ga**2).mean(1), (gb**2).mean(1), ga.shape[1]
    # The products round, by so much at most; scores are told from the frames themselves.
    slack = 4 * size * np.finfo("f8").eps * (va.max() + vb.max())
    told = lambda square: np.floor(np.sqrt(np.maximum(square, 0)) * 1000 + 1e-9)
    for at in range(0, len(na), ROWS):
        rows = slice(at, at + ROWS)
        least = np.searchsorted(nb, na[rows][0] + distance)
        if least == len(nb):
            break
        # var(a - b) = var(a) + var(b) - 2 cov(a, b): one matrix product for some rows.
        squares = ga[rows] @ (gb[least:].T * (-2 / size))
        squares += va[rows, None]
        squares += vb[None, least:]
        if nb[least] - na[rows][-1] < distance:
            squares[nb[None, least:] - na[rows, None] < distance] = np.inf
        if most == np.inf and squares.size > k:
            most = told(np.partition(squares, k - 1, axis=None)[k - 1] + slack)
        i, j = np.nonzero((squares <= ((most + 1) / 1000) ** 2 + slack) & (squares < np.inf))
        if len(i) > k:
            # By the greatest score that each may have, then numbers, which ascend: what comes after the k-th at its least score goes.
            high, low = told(squares[i, j] + slack), told(squares[i, j] - slack)
            last = np.argsort(high, kind="stable")[k - 1]
            kept = (low < high[last]) | ((low == high[last]) & (np.arange(len(i)) <= last))
            i, j = i[kept], j[kept]
        i, j = i + at, j + least
        score = np.concatenate([np.zeros(0), *(told(((ga[i[x : x + TILE]] - gb[j[x : x + TILE]]) ** 2).mean(1)) for x in range(0, len(i), TILE))]).astype("i8")
        every = [np.concatenate(x) for x in zip(found, (na[i], nb[j], score))]
        order = np.lexsort((every[1], every[0], every[2]))[:k]
        found = tuple(x[order] for x in every)
        if len(order) == k:
            most = min(most, found[2][-1])
    keep = found[2] <= most
    return tuple(x[keep] for x in found)


# --- pixels: one row a picture; bytes stay out of shuffles -----------------------------------------------------------


def _per_row(df: DataFrame, inputs: list[str], out: str, f) -> DataFrame:
    """df with columns `out` (a DDL list) that f computes from the inputs of a row."""
    extra = df.sparkSession.createDataFrame([], out).schema
    schema = type(extra)([*df.schema.fields, *extra.fields])
    at = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [f(*r) for r in zip(*(b.column(i).to_pylist() for i in at))]
            new = [pa.array([r[k] for r in rows], _ARROW[x.dataType.typeName()]) for k, x in enumerate(extra)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[x.name for x in schema])

    return df.mapInArrow(run, schema)


_ARROW = {"binary": pa.binary(), "double": pa.float64(), "long": pa.int64(), "boolean": pa.bool_(), "integer": pa.int32()}


def diff_mask(pairs: DataFrame, tolerance: float) -> DataFrame:
    """Pairs (a, b: bytes of equal shape) with mask (0 changed, 255 unchanged), changed (count), psnr (null if equal) and local_psnr,
    that of the changed pixels alone (0 if there is none)."""
    def one(a: bytes, b: bytes) -> tuple:
        x, y = np.frombuffer(a, "u1").astype("i4"), np.frombuffer(b, "u1").astype("i4")
        hit = np.abs(x - y) > tolerance * 255
        mse = float(((x - y) ** 2).mean()) if len(x) else 0.0
        near = float(((x - y)[hit] ** 2).mean()) if hit.any() else 0.0
        of = lambda m: float(20 * np.log10(255 / np.sqrt(m)))
        return np.where(hit, 0, 255).astype("u1").tobytes(), int(hit.sum()), None if mse == 0 else of(mse), 0.0 if near == 0 else of(near)

    return _per_row(pairs, ["a", "b"], "mask binary, changed long, psnr double, local_psnr double", one)


def change_stats(changed: Column, total: Column) -> Column:
    """struct(ratio, category small/medium/large by pixels, global) from counts."""
    ratio = changed / total
    return F.struct(F.round(ratio, 6).alias("ratio"), F.when(changed < 2500, "small").when(changed < 10000, "medium").otherwise("large").alias("category"), (ratio > 0.75).alias("is_global"))


def histograms(frames: DataFrame) -> DataFrame:
    """(media_id, frame_no, value, n): how often each byte of `pixels` occurs, counted a picture at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                n = np.bincount(np.frombuffer(b.column(2)[i].as_py() or b"", "u1"), minlength=256)
                at = np.flatnonzero(n)
                ids = [pa.repeat(b.column(k)[i], len(at)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["media_id", "frame_no", "value", "n"])

    return frames.select(F.col("media_id").cast("long"), F.col("frame_no").cast("long"), "pixels").mapInArrow(count, "media_id long, frame_no long, value int, n long")


def first_minimum(histogram: DataFrame, smoothing: int = 3, least: int = 0, most: int = 255, gain: int = 0, bins: int = 256) -> DataFrame:
    """(media_id, threshold): the first value where the smoothed histogram (media_id, value below `bins`, n) is lower than on either side.

    Smoothed is the mean of `smoothing` values from each on. Without such a value, or with one in the upper half, `least`; else the value
    between least and most. The gain is added to either.
    """
    counts = histogram.groupBy("media_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("value").cast("int").alias("k"), F.col("n").cast("double").alias("v")))).alias("_m"))
    at = lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))
    flat = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: at(i.cast("int")))
    counts = counts.withColumn("_h", flat)
    if smoothing > 0:
        # Sums do as well as means, and are exact.
        sums = F.transform(F.sequence(F.lit(1), F.lit(bins - smoothing + 1)), lambda i: F.aggregate(F.slice("_h", i, smoothing), F.lit(0.0), lambda a, x: a + x))
        counts = counts.withColumn("_s", sums)
        s = lambda i: F.get("_s", i)
        lows = F.filter(F.sequence(F.lit(1), F.lit(bins - smoothing - 1)), lambda i: (s(i) < s(i - 1)) & (s(i) < s(i + 1)))
        low = F.get(lows, F.lit(0))
    else:
        low = F.lit(None).cast("int")
    found = F.when(low.isNull() | (low > bins // 2), F.lit(least)).otherwise(F.greatest(F.lit(least), F.least(low, F.lit(most))))
    return counts.select("media_id", (found + gain).alias("threshold"))


def otsu(histogram: DataFrame) -> DataFrame:
    """(media_id, threshold): the value that parts a histogram (media_id, value, n) with the largest variance between classes, the least on ties."""
    h = histogram.withColumns({
        "_w0": F.expr("sum(n) over (partition by media_id order by value)"), "_s0": F.expr("sum(n * value) over (partition by media_id order by value)"),
        "_w": F.expr("sum(n) over (partition by media_id)"), "_s": F.expr("sum(n * value) over (partition by media_id)"),
    })
    m0, m1 = F.col("_s0") / F.col("_w0"), (F.col("_s") - F.col("_s0")) / F.nullif(F.col("_w") - F.col("_w0"), F.lit(0))
    between = F.round(F.col("_w0") * (F.col("_w") - F.col("_w0")) * (m0 - m1) * (m0 - m1), 4)
    return h.withColumn("_v", between).where("_v is not null").groupBy("media_id").agg(F.min_by("value", F.struct(-F.col("_v"), "value")).alias("threshold"))


def bitplanes(mask_frames: DataFrame, bits: DataFrame) -> DataFrame:
    """(group_id, frame_no, plane, pixels): OR of 1 << ((bit - 1) % 8) over changed pixels (0) into byte plane (bit - 1) / 8."""
    rows = mask_frames.join(bits.select("probe_id", "group_id", "bit_number"), "probe_id").withColumn("plane", F.floor((F.col("bit_number") - 1) / 8).cast("int"))

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            for bit, px in zip(b.column("bit_number").to_pylist(), b.column("pixels").to_pylist()):
                part = np.where(np.frombuffer(px, "u1") == 0, 1 << ((bit - 1) % 8), 0).astype("u1")
                out = part if out is None else out | part
        yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], t) for k, t in zip(key, (pa.int64(), pa.int64(), pa.int32()))] + [pa.array([out.tobytes()], pa.binary())], names=["group_id", "frame_no", "plane", "pixels"])

    return rows.select("group_id", "frame_no", "plane", "bit_number", "pixels").groupBy("group_id", "frame_no", "plane").applyInArrow(merge, "group_id long, frame_no long, plane int, pixels binary")


def last_bitplanes(mask_frames: DataFrame, bits: DataFrame) -> DataFrame:
    """B9, use last: (group_id, frame_no, plane, pixels): each byte plane holds the bit of its last probe (the largest probe_no, then bit) alone."""
    rows = mask_frames.join(bits.select("probe_id", "group_id", "bit_number", "probe_no"), "probe_id").withColumn("plane", F.floor((F.col("bit_number") - 1) / 8).cast("int"))
    last = rows.groupBy("group_id", "frame_no", "plane").agg(F.max_by(F.struct("bit_number", F.col("pixels").alias("mask")), F.struct("probe_no", "bit_number")).alias("_l")).select("group_id", "frame_no", "plane", "_l.*")

    def one(bit: int, mask: bytes) -> tuple:
        return (np.where(np.frombuffer(mask, "u1") == 0, 1 << ((bit - 1) % 8), 0).astype("u1").tobytes(),)

    return _per_row(last, ["bit_number", "mask"], "pixels binary", one).drop("bit_number", "mask")


def compare_masks(pairs: DataFrame) -> DataFrame:
    """Pairs (expected, actual) with `same`: differing pixels are at most 5 % of the expected changed ones."""
    def one(a: bytes, b: bytes) -> tuple:
        x, y = np.frombuffer(a, "u1"), np.frombuffer(b, "u1")
        return (len(x) == len(y) and int((x != y).sum()) <= 0.05 * int((x == 0).sum()),)

    return _per_row(pairs, ["expected", "actual"], "same boolean", one)


def mean_image(frames: DataFrame, sample: int) -> DataFrame:
    """(media_id, pixels array<double>): mean over every n/sample-th of n frames, rounded down: at least `sample` frames, all where there are fewer."""
    n = ranked(frames, ["media_id"], "frame_no")
    step = F.greatest(F.floor(F.col("_n") / sample), F.lit(1))
    kept = n.where((F.col("_i") - 1) % step == 0).select("media_id", F.posexplode("gray").alias("_p", "_v"))
    means = kept.groupBy("media_id", "_p").agg(F.round(F.avg("_v"), 6).alias("_m"))
    return means.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias("pixels"))


def median_image(frames: DataFrame, sample: int) -> DataFrame:
    """(media_id, pixels array<double>): median of each pixel over an even sample of at most `sample` aligned frames."""
    n = ranked(frames, ["media_id"], "frame_no")
    step = F.greatest(F.ceil(F.col("_n") / sample), F.lit(1))
    kept = n.where((F.col("_i") - 1) % step == 0).select("media_id", F.posexplode("gray").alias("_p", "_v"))
    medians = kept.groupBy("media_id", "_p").agg(F.median("_v").alias("_m"))
    return medians.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias("pixels"))


def mask_transform(masks: DataFrame, step: str) -> DataFrame:
    """Masks (height, width, pixels: one byte a pixel) with `pixels` changed, without interpolation.

    step: horizontal or vertical (flip), invert, or crop:top,left,height,width (height and width follow; what lies outside goes).
    """
    name, _, numbers = step.partition(":")
    box = tuple(map(int, numbers.split(","))) if numbers else ()

    def one(height: int, width: int, pixels: bytes) -> tuple:
        m = np.frombuffer(pixels, "u1").reshape(height, width)
        if name == "crop":
            m = m[box[0] : box[0] + box[2], box[1] : box[1] + box[3]]
        else:
            m = {"horizontal": m[:, ::-1], "vertical": m[::-1], "invert": 255 - m}[name]
        return m.shape[0], m.shape[1], m.tobytes()

    out = _per_row(masks, ["height", "width", "pixels"], "_h integer, _w integer, _px binary", one)
    return out.select(*(F.col({"height": "_h", "width": "_w", "pixels": "_px"}.get(c, c)).alias(c) for c in masks.columns))


def merge_masks(masks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pixels): union of masks of equal shape: a pixel is changed (0) where any of them is."""
    return _fold(masks, keys, "pixels", lambda px, _: np.frombuffer(px, "u1"), np.minimum)


def _fold(df: DataFrame, keys: list[str], column: str, read, merge) -> DataFrame:
    """(keys, column): byte arrays of a group merged pair by pair, first within each task, then over the cluster."""
    kinds = {f.name: f.dataType for f in df.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k].simpleString()}" for k in keys), f"`{column}` binary"])
    arrow = [_ARROW_TYPES[kinds[k].typeName()] for k in keys]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, px in zip(*(c.to_pylist() for c in b.columns)):
                new, old = read(px, key), held.get(tuple(key))
                held[tuple(key)] = new if old is None else merge(old, new)
            # A bounded number of pictures in memory.
            if sum(v.nbytes for v in held.values()) > 1 << 26:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    def out(held: dict[tuple, np.ndarray]) -> pa.RecordBatch:
        cols = list(zip(*held)) if keys else []
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, arrow)), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=[*keys, column])

    def over(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for px in b.column(column).to_pylist():
                new = np.frombuffer(px, "u1")
                total = new if total is None else merge(total, new)
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], t) for k, t in zip(key, arrow)), pa.array([total.tobytes()], pa.binary())], names=[*keys, column])

    return df.select(*keys, column).mapInArrow(within, schema).groupBy(*keys).applyInArrow(over, schema)


_ARROW_TYPES = {**_ARROW, "bigint": pa.int64(), "string": pa.string()}


def color_composite(masks: DataFrame) -> DataFrame:
    """(project_id, final, pixels, changed, ratio, category, is_global): masks (project_id, final, probe_no below 2**32, color
    'r g b', pixels: 0 changed) in their colours, a later probe over an earlier one, as one RGB picture on white for each final."""

    def read(px: bytes, _: tuple) -> np.ndarray:
        return np.frombuffer(px, "u1")

    def paint(no: int, color: str, px: bytes) -> tuple:
        # Seven bytes a pixel: the probe's number (0: none), then its colour.
        m, rgb = np.frombuffer(px, "u1") == 0, [int(x) for x in color.split()]
        cell = np.frombuffer(int(no).to_bytes(4, "big") + bytes(rgb), "u1")
        return (np.where(m[:, None], cell, np.array([0, 0, 0, 0, 255, 255, 255], "u1")).tobytes(),)

    def later(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = a.reshape(-1, 7), b.reshape(-1, 7)
        no = lambda v: v[:, :4].astype("i8") @ np.array([1 << 24, 1 << 16, 1 << 8, 1])
        return np.where((no(x) >= no(y))[:, None], x, y).reshape(-1)

    painted = _per_row(masks.withColumn("probe_no", F.col("probe_no").cast("long")), ["probe_no", "color", "pixels"], "cells binary", paint)
    whole = _fold(painted, ["project_id", "final"], "cells", read, later)

    def finish(cells: bytes) -> tuple:
        v = np.frombuffer(cells, "u1").reshape(-1, 7)
        return v[:, 4:].tobytes(), int(v[:, :4].any(1).sum()), len(v)

    out = _per_row(whole, ["cells"], "pixels binary, changed long, total long", finish)
    return out.withColumn("_s", change_stats(F.col("changed"), F.col("total"))).select("project_id", "final", "pixels", "changed", "_s.ratio", "_s.category", "_s.is_global")


def moved_pixels(pairs: DataFrame) -> DataFrame:
    """Pairs (mask, inputmask: changed pixels above 0) with mismatch, the share of the mask that the input mask does not explain, and
    bad (above 5 %); an empty mask has no mismatch."""

    def one(mask: bytes, other: bytes) -> tuple:
        m, i = np.frombuffer(mask, "u1") > 0, np.frombuffer(other, "u1") > 0
        size = int(m.sum())
        share = abs(int((m & ~i).sum()) - int((i & ~m).sum())) / size if size else 0.0
        return round(share, 6), share > 0.05

    return _per_row(pairs, ["mask", "inputmask"], "mismatch double, bad boolean", one)


def crop_side_effects(masks: DataFrame) -> DataFrame:
    """Masks (height, width, pixels, top, left, box_height, box_width) with dirty: changed pixels (not 255) inside the kept box."""

    def one(height: int, width: int, pixels: bytes, top: int, left: int, h: int, w: int) -> tuple:
        m = np.frombuffer(pixels, "u1").reshape(height, width)[top : top + h, left : left + w]
        return (int((m != 255).sum()),)

    return _per_row(masks, ["height", "width", "pixels", "top", "left", "box_height", "box_width"], "dirty long", one)


def added_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Runs of frames of b whose hash a lacks: what was added."""
    return cut_ranges(b, a)
