"""Donor masks as pictures: each donor edge's mask carried back over the edges above it to every base.

Pictures are kept once, by the hash of their shape and bytes; what travels from node to node is the hash. In each round every
distinct pair of a mask and a step is computed once, however many edges and paths ask for it. Pixels: 0 selected, 255 not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions.storage import Rounds, written

from . import lineage
from .frames import merge_masks

P = "project_id"
_STORE = "hash string, height int, width int, pixels binary"


def picture_hash(height: Column | str, width: Column | str, pixels: Column | str) -> Column:
    return F.sha2(F.concat_ws(":", F.col(height) if isinstance(height, str) else height, F.col(width) if isinstance(width, str) else width, F.hex(pixels)), 256)


def undo(height: int, width: int, pixels: bytes, step: str, own: bytes | None) -> tuple[int, int, bytes]:
    """A mask before an edge's step, given the one after it.

    step: horizontal or vertical (flips), turn:quarters (clockwise, as the edge turned the picture), crop:top,left,height,width (box and
    size of the source: the mask moves back into a picture of that size), cover (what the edge's own mask covers comes from elsewhere and is not
    selected; an own mask of another shape covers nothing), or any other, which leaves the mask as it is.
    """
    m = np.frombuffer(pixels, "u1").reshape(height, width)
    name, _, rest = step.partition(":")
    if name == "horizontal":
        m = m[:, ::-1]
    elif name == "vertical":
        m = m[::-1]
    elif name == "turn":
        m = np.rot90(m, int(rest))
    elif name == "crop":
        top, left, h, w = map(int, rest.split(","))
        out = np.full((h, w), 255, "u1")
        part = m[: max(0, h - top), : max(0, w - left)]
        out[top : top + part.shape[0], left : left + part.shape[1]] = part
        m = out
    elif name == "cover" and own is not None and len(own) == m.size:
        m = np.where(np.frombuffer(own, "u1").reshape(m.shape) == 0, 255, m)
    return m.shape[0], m.shape[1], m.astype("u1").tobytes()


def _computed(wanted: DataFrame) -> DataFrame:
    """wanted (hash, step, own_hash, height, width, pixels, own) with the picture before the step: its shape and pixels, and whether it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [undo(*r) for r in zip(*(b.column(i).to_pylist() for i in range(3, 6)), b.column(1).to_pylist(), b.column(6).to_pylist())]
            full = pa.array([0 in px for _, _, px in out], pa.bool_())
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *cols, full], names=["hash", "step", "own_hash", "height", "width", "pixels", "full"])

    return wanted.mapInArrow(run, "hash string, step string, own_hash string, height int, width int, pixels binary, full boolean")


def donor_masks(nodes: DataFrame, edges: DataFrame, masks: DataFrame, own_masks: DataFrame | None = None) -> DataFrame:
    """B2: (project_id, src, dst, base, height, width, pixels): the mask of each donor edge at every base above it.

    nodes: project_id, node_id, and media_type where there is one. edges: project_id, src, dst, op, step (what the edge did, see undo()). masks:
    project_id, src, dst, height, width, pixels of the donor edges; own_masks the same of edges whose step is cover. A branch ends where nothing is
    selected any more. Masks that meet in a base by several paths become one: of pictures (and unknown media) all that any selects,
    apart by shape; of a video the one whose path comes first by its nodes.
    """
    lit = F.lit(None).cast("string")
    store = lambda df: df.select(P, "src", "dst", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "pixels").withColumn("hash", picture_hash("height", "width", "pixels"))
    first = written(store(masks).join(edges.where("op = 'Donor'").select(P, "src", "dst"), [P, "src", "dst"], "left_semi"))
    own = written(store(own_masks)) if own_masks is not None else None
    plain = edges.where("op <> 'Donor'").select(P, "src", "dst", F.coalesce("step", F.lit("none")).alias("step"))
    steps = plain.join(own.select(P, "src", "dst", F.col("hash").alias("own_hash")), [P, "src", "dst"], "left") if own is not None else plain.withColumn("own_hash", lit)
    steps = written(steps.select(P, F.col("dst").alias("at"), F.col("src").alias("_to"), "step", F.when(F.col("step") == "cover", F.col("own_hash")).alias("own_hash")))
    pictures = Rounds(first.where(F.instr(F.hex("pixels"), "00") > 0).select("hash", "height", "width", "pixels").dropDuplicates(["hash"]))
    extra = written(own.select(F.col("hash").alias("own_hash"), F.col("pixels").alias("own")).dropDuplicates(["own_hash"])) if own is not None else None
    # Of the paths by which the same mask reaches a node, the first speaks for all.
    keys = [P, "src", "dst", "at", "hash"]
    start = first.join(pictures.last.select("hash"), "hash", "left_semi").select(P, "src", "dst", F.col("src").alias("at"), "hash", F.array("src").alias("path"))
    frontier = Rounds(start)
    while not frontier.last.isEmpty():
        moved = written(frontier.last.join(steps, [P, "at"]))
        wanted = moved.select("hash", "step", "own_hash").distinct().join(pictures.all(), "hash")
        wanted = wanted.join(extra, "own_hash", "left") if extra is not None else wanted.withColumn("own", F.lit(None).cast("binary"))
        made = _computed(wanted.select("hash", "step", "own_hash", "height", "width", "pixels", "own")).where("full")
        made = written(made.withColumn("to_hash", picture_hash("height", "width", "pixels")))
        new = made.select(F.col("to_hash").alias("hash"), "height", "width", "pixels").dropDuplicates(["hash"])
        pictures.add(new.join(pictures.all().select("hash"), "hash", "left_anti"))
        link = made.select(F.col("hash").alias("_h"), F.col("step").alias("_s"), F.col("own_hash").alias("_o"), "to_hash")
        same = (F.col("hash") == F.col("_h")) & (F.col("step") == F.col("_s")) & F.col("own_hash").eqNullSafe(F.col("_o"))
        went = moved.join(link, same).select(P, "src", "dst", F.col("_to").alias("at"), F.col("to_hash").alias("hash"), F.array_append("path", F.col("_to")).alias("path"))
        frontier.add(went.groupBy(*keys).agg(F.min("path").alias("path")))
    tops = lineage.tops(nodes, edges).withColumnRenamed("node_id", "at")
    kind = nodes.select(P, F.col("node_id").alias("at"), (F.col("media_type") if "media_type" in nodes.columns else lit).alias("media_type"))
    ended = frontier.all().join(tops, [P, "at"], "left_semi").join(kind, [P, "at"], "left").groupBy(*keys, "media_type").agg(F.min("path").alias("path"))
    ended = written(ended.withColumnRenamed("at", "base"))
    by = [P, "src", "dst", "base"]
    video = F.coalesce(F.col("media_type") == "video", F.lit(False))
    one = ended.where(video).groupBy(*by).agg(F.min_by("hash", "path").alias("hash"))
    kept = one.join(pictures.all(), "hash").select(*by, "height", "width", "pixels")
    drawn = ended.where(~video).join(pictures.all(), "hash").select(*by, "height", "width", "pixels")
    return kept.unionByName(merge_masks(drawn, [*by, "height", "width"]))
