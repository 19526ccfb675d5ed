"""Shards of nearly equal size by sampled splitters.

Records are ordered by (group, order, row). Size-weighted samples of these keys give quantile boundaries of many more ranges
than there are shards; a splitter stands at the start of its group, so that a group stays in one range. Ranges that turn
out overfull once they have been measured are subdivided by samples of their own, now within the group too. Shards are runs of
ranges whose ends come nearest to the even shares of all bytes.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unused

#: Ranges for each shard at least, and records in a range about (more ranges are made of more records than that).
RANGES, RANGE_ROWS = 256, 1 << 20
#: Samples for each range, and times the mean mass of a range that one may hold before it is subdivided.
SAMPLES, FULL = 8, 2.0
#: Stands for null among the groups and the orders, before every other value.
LEAST = -(1 << 63)
_KEY = "struct<g:bigint,o:bigint,r:bigint>"


def text_size(text: Column) -> Column:
    """UTF-8 bytes (none of a null text), and one for the record itself."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_group(text: Column) -> Column:
    """A number that equal texts share. Texts that share one by chance are a group too, which breaks no law."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _literal(values: list, kind: str) -> Column:
    """The values as one constant array."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def range_of(key: Column, splitters: list[tuple[int, int, int]]) -> Column:
    """How many of the ascending splitters are at or below the key: a binary search in a fold over its steps."""
    if not splitters:
        return F.lit(0)
    array, top = _literal([dict(zip("gor", k)) for k in splitters], _KEY), len(splitters)
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(top.bit_length()))))
    go = lambda at, step: F.when((at + step <= top) & (F.get(array, at + step - 1) <= key), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), go)


def _quantiles(samples: list[tuple[tuple[int, int, int], float]], parts: int) -> list[tuple[int, int, int]]:
    """Splitters that cut the weighted samples into parts of even weight."""
    samples = sorted(samples)
    total, at, out = sum(w for _, w in samples), 0.0, []
    for key, w in samples:
        if at and int(at / total * parts) < int((at + w) / total * parts):
            out.append(key)
        at += w
    return out


def _ends(bytes_: list[int], shards: int) -> list[int]:
    """For each shard the number of ranges up to its end: where the running sum comes nearest to its share."""
    sums, out = [0, *accumulate(bytes_)], []
    for k in range(1, shards + 1):
        goal = sums[-1] * k / shards
        i = min(bisect_left(sums, goal), len(sums) - 1)
        out.append(i - 1 if i and goal - sums[i - 1] < sums[i] - goal else i)
    return [*out[:-1], len(bytes_)]


def splitters(keyed: DataFrame, shards: int, total: int, rows: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Ascending splitters for a written table of (_key, _size), and (range, bytes, rows) of the ranges that are not empty.

    Rounds go on until no range is overfull, or none that is holds a key to cut at (one record outweighs the rest).

    What comes to the driver is bounded by the number of ranges, max(RANGES * shards, rows / RANGE_ROWS): about SAMPLES keys
    for each, and the measure of each.
    """
    want = max(RANGES * shards, rows // RANGE_ROWS)
    # A record weighs by its size and by being one, so that neither many bytes nor many small records overfill a range.
    mass = (F.col("_size") / F.lit(float(total)) + F.lit(1.0 / rows)) / 2
    cuts: list[tuple[int, int, int]] = []
    inside, round_, masses = keyed, 0, {}
    while True:
        draw = F.xxhash64("_key", F.lit(round_)).bitwiseAND((1 << 53) - 1).cast("double") / float(1 << 53)
        chance = F.least(F.lit(1.0), mass * (want * SAMPLES))
        drawn = inside.withColumn("_weight", mass / chance).where(draw < chance)
        if not round_:
            found = _quantiles([((r.g, LEAST, -1), r["_weight"]) for r in drawn.select("_key.g", "_weight").collect()], want)
        else:
            found, samples = list(cuts), {}
            for r in drawn.select("_range", "_key.*", "_weight").collect():
                samples.setdefault(r["_range"], []).append(((r.g, r.o, r.r), r["_weight"]))
            for k, held in samples.items():
                found += _quantiles(held, max(2, round(masses[k] * want)))
        found = sorted({*cuts, *found})
        if round_ and len(found) == len(cuts):
            return cuts, sizes
        cuts, round_ = found, round_ + 1
        held = keyed.withColumn("_range", range_of(F.col("_key"), cuts))
        measured = held.groupBy("_range").agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        sizes = sorted((r["_range"], r.b, r.n) for r in measured)
        masses = {k: (b / total + n / rows) / 2 for k, b, n in sizes if n > 1}
        full = [k for k, m in masses.items() if m * want > FULL]
        if not full:
            return cuts, sizes
        inside = held.where(F.get(_literal([k in full for k in range(len(cuts) + 1)], "boolean"), F.col("_range")))


def place(records: DataFrame, shards: int = 8, size: str = "size", group: str = "group", order: str = "doc_id") -> DataFrame:
    """records with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard): sizes of the shards nearly equal.

    size: a positive integer; group, order: integers, or null. Records of a group follow one another in order (nulls first)
    and share a shard unless they straddle an end of one; records alike in both may change places. A shard
    differs from its share by no more than its largest record and one range at each end. Each record has a row, null
    groups and repeated records too; an empty table gives none. Added names that are taken have underscores before them.
    """
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(LEAST))
    key = F.struct(number(group).alias("g"), number(order).alias("o"), F.monotonically_increasing_id().alias("r"))
    keyed = materialize(records.select(F.struct("*").alias("record"), key.alias("_key"), F.col(size).cast("long").alias("_size")), "records")
    rows, total = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    cuts, sizes = splitters(keyed, shards, total, rows) if rows else ([], [])
    ends = _ends([b for _, b, _ in sizes], shards)
    # Of each range its shard, and the rows of that shard before it.
    homes, before, at = [0] * (len(cuts) + 1), [0] * (len(cuts) + 1), [0] * shards
    for i, (k, _, n) in enumerate(sizes):
        homes[k] = home = next(j for j, e in enumerate(ends) if i < e)
        before[k] = at[home]
        at[home] += n
    look = lambda values, kind: F.get(_literal(values, kind), F.col("_range"))
    held = keyed.withColumn("_range", range_of(F.col("_key"), cuts))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_key")) - 1
    shard, slot = unused(records, "shard", "slot")
    return held.withColumn("_slot", look(before, "bigint") + within).select("record.*", look(homes, "int").alias(shard), F.col("_slot").alias(slot))


def shard_documents(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with `shard` and `slot`: groups are equal texts, sizes as text_size() gives them; null texts are a group with the empty ones."""
    size, group = unused(docs, "size", "group")
    sized = docs.withColumn(size, text_size(F.col(text))).withColumn(group, text_group(F.col(text)))
    return place(sized, shards, size, group, doc_id).drop(size, group)


def write_shards(docs: DataFrame, folder: str, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the documents as Parquet under folder/shard=K, each file a stretch of slots in order."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard, slot = unused(docs, "shard", "slot")
    placed = shard_documents(docs, shards, doc_id, text)
    placed.repartitionByRange(max(n, shards), shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(folder)
