"""Probes: each localized edge's segments carried along all later edges to every final medium."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provlake.functions.blocks import dealt
from provlake.functions.storage import Rounds, picked, written

from . import lineage, transforms
from .transforms import register_transform  # noqa: F401

P = "project_id"
SEG = ["type", "startframe", "endframe"]

def is_localized(operations: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """The edges of localized operations."""
    ops = operations.where("scope = 'localized'").select("op")
    return lambda edges: edges.join(ops, "op", "left_semi")


def probe_summary(nodes: DataFrame, edges: DataFrame, operations: DataFrame, ways: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row for each localized edge and final medium that it reaches: base and level of its source (the first by level, then id).
    ways: the finals_and_bases() of the same tables, where they are at hand."""
    edges = written(picked(edges, P, "src", "dst", "op"))
    return _completed(is_localized(operations)(edges), ways or finals_and_bases(nodes, edges))


def finals_and_bases(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(project_id, dst, final): the finals that each node reaches; (project_id, src, base, level): the first base of each node."""
    nodes, edges = written(picked(nodes, P, "node_id")), written(picked(edges, P, "src", "dst", "op"))
    finals = lineage.terminals(nodes, edges).select(P, F.col("node_id").alias("dst"), "final")
    return finals, lineage.nearest_bases(nodes, edges).withColumnRenamed("node_id", "src")


def _completed(some: DataFrame, ways: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row for each of some edges and each final that it reaches, with the first base of its source."""
    finals, bases = ways
    return some.select(P, "src", "dst", "op").join(finals, [P, "dst"]).join(bases, [P, "src"], "left").select(P, "src", "dst", "op", "final", "base", "level")


def _programs(edges: DataFrame, bounds: DataFrame, media: DataFrame | None) -> DataFrame:
    """The edges that are not donors with their programs, in place of what these are compiled from. Only edges whose operation has a program for
    their medium, and one that needs bounds or lengths, are joined with these."""
    plain = edges.where("op <> 'Donor'")
    bounds = bounds.withColumnsRenamed({"set_id": "dst", "startframe": "b_start", "endframe": "b_end"})
    bounds = bounds.select("dst", *(c for c in ("b_start", "b_end", "to_start", "to_end") if c in bounds.columns))
    needs: dict[tuple[bool, bool], list[str]] = {}
    for op, by_media in transforms.PROGRAMS.items():
        for kind, steps in by_media.items():
            verbs = {verb for verb, _ in steps}
            needs.setdefault((bool(verbs - {"rerate", "drop"}), "rerate" in verbs and media is not None), []).append(f"{op}|{kind}")
    needs.pop((False, False), None)
    kind = F.col("media_type") if "media_type" in edges.columns else F.lit(None).cast("string")
    among = lambda keys: F.coalesce(F.concat("op", F.lit("|"), kind).isin(*keys), F.lit(False))
    parts = [plain.where(~among([key for keys in needs.values() for key in keys]))]
    for (bounded, rated), keys in needs.items():
        out = plain.where(among(keys))
        if bounded:
            out = out.join(bounds, "dst", "left")
        if rated:
            for end, name in (("src", "from_frames"), ("dst", "to_frames")):
                out = out.join(media.select(P, F.col("node_id").alias(end), F.col("frames").alias(name)), [P, end], "left")
        parts.append(out)
    return reduce(DataFrame.unionByName, (transforms.compiled(x).drop("op") for x in parts))


def _walked(seeds: DataFrame, segments: DataFrame, steps: DataFrame, own: str) -> DataFrame:
    """What the segments of seeds (project_id, src, dst, at, _end; set_id: their dst) become on their way over steps (project_id, at, _to, program, _end), where
    it arrives at an end, which no step leaves. Steps are dealt out once for all rounds.

    In journals where no two steps share their `own` node (at or _to), a seed has one way to each end. Its row walks without its segments and gathers the
    programs on the way, which the segments pass at last: no round moves these. In other journals ways may meet again, and equal parts go on once.
    """
    segments = segments.withColumnRenamed("set_id", "dst").select("dst", F.col("seg_no").cast("long"), "type", *(F.col(c).cast("long") for c in SEG[1:]))
    with dealt(steps, P, "at") as steps:
        meeting = written(steps.groupBy(P, own).count().where("count > 1").select(P).distinct())
        if meeting.isEmpty():
            return _gathered(seeds, segments, steps)
        apart = _gathered(seeds.join(meeting, P, "left_anti"), segments, steps)
        return apart.unionByName(_carried(seeds.join(meeting, P, "left_semi"), segments, steps))


def _gathered(seeds: DataFrame, segments: DataFrame, steps: DataFrame) -> DataFrame:
    """_walked() where ways do not meet."""
    rounds = Rounds(seeds.select(P, "src", "dst", "at", F.array().cast(f"array<{transforms.PROGRAM}>").alias("programs"), "_end"))
    programs = F.when(F.size("program") > 0, F.array_append("programs", F.col("program"))).otherwise(F.col("programs"))
    while not rounds.last.isEmpty():
        moved = rounds.last.where("not _end").drop("_end").join(steps, [P, "at"])
        rounds.add(moved.select(P, "src", "dst", F.col("_to").alias("at"), programs.alias("programs"), "_end"))
    parts = transforms.run_all(F.col("programs"), F.col("type"), F.col("seg_no"), F.col("startframe"), F.col("endframe"))
    out = rounds.all().where("_end").join(segments, "dst").select(P, "src", "dst", "at", "type", F.explode(parts).alias("_p"))
    return out.select(P, "src", "dst", "at", F.col("_p.n").alias("seg_no"), "type", F.col("_p.s").alias("startframe"), F.col("_p.e").alias("endframe")).distinct()


def _carried(seeds: DataFrame, segments: DataFrame, steps: DataFrame) -> DataFrame:
    """_walked() where ways may meet."""
    keys = [P, "src", "dst", "at", "seg_no", *SEG, "_end"]
    rounds = Rounds(seeds.join(segments, "dst").select(*keys).distinct())
    parts = transforms.run(F.col("program"), F.col("type"), F.col("seg_no"), F.col("startframe"), F.col("endframe"))
    while not rounds.last.isEmpty():
        moved = rounds.last.where("not _end").drop("_end").join(steps, [P, "at"]).withColumn("_p", F.explode(parts))
        rounds.add(moved.select(P, "src", "dst", F.col("_to").alias("at"), F.col("_p.n").alias("seg_no"), "type", F.col("_p.s").alias("startframe"), F.col("_p.e").alias("endframe"), "_end").distinct())
    return rounds.all().where("_end").drop("_end").distinct()


def marked(rows: DataFrame, ends: DataFrame, node: str) -> DataFrame:
    """rows with `_end`: is their node one of the ends (project_id, at; each once)?"""
    return rows.join(ends.select(P, F.col("at").alias(node), F.lit(True).alias("_end")), [P, node], "left").withColumn("_end", F.coalesce("_end", F.lit(False)))


def generate_probes(
    edges: DataFrame, segments: DataFrame, bounds: DataFrame, include: Callable[[DataFrame], DataFrame],
    processors: Sequence[Callable[[DataFrame], DataFrame]] = (), media: DataFrame | None = None,
) -> DataFrame:
    """B1: (project_id, src, dst, final, seg_no, type, startframe, endframe): segments of each included edge at every final.

    edges: op, and media_type (of the source) and add_type where there are such columns. segments: set_id is the edge's dst; bounds (set_id, startframe,
    endframe) are the frames that an edge cuts, adds or lays over, to_start and to_end those that a copy was taken from; media
    (project_id, node_id, frames) gives the lengths for changes of rate. E3: `include` picks the edges, `processors` are applied to the
    probes in order. Edges other than donors are followed, each by its program (E4); a probe whose segments are all cut away
    ends. Equal parts of several paths count once.
    """
    steps = written(_programs(edges, bounds, media).select(P, F.col("src").alias("at"), F.col("dst").alias("_to"), "program"))
    marks = include(edges).select(P, "src", "dst").distinct()
    # Ends: where a seed or a step arrives and no step goes on.
    arrived = steps.select(P, F.col("_to").alias("at")).unionByName(marks.select(P, F.col("dst").alias("at"))).distinct()
    ends = written(arrived.join(steps.select(P, "at"), [P, "at"], "left_anti"))
    seeds = marked(marks.withColumn("at", F.col("dst")), ends, "at")
    out = _walked(seeds, segments, marked(steps, ends, "_to"), "_to").withColumnRenamed("at", "final").select(P, "src", "dst", "final", "seg_no", *SEG)
    return reduce(lambda df, f: f(df), processors, out)


def construct_donors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """B2: (project_id, dst, donor_base): bases above each donor edge, each once."""
    return lineage.donor_base_tuples(nodes, edges).select(P, F.col("donor_dst").alias("dst"), F.col("base").alias("donor_base")).distinct()


def donor_segments(nodes: DataFrame, edges: DataFrame, segments: DataFrame, bounds: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """B2: (project_id, src, dst, base, seg_no, type, startframe, endframe): the segments of each donor edge (set_id: its dst), carried back over the
    edges above its source to every base by the inverse of their programs; tables as for generate_probes(). Frames that an edge laid over are
    taken out, and those that it took them from belong to the donor, as segment 0. A branch ends where all is cut away; equal parts
    of several paths count once."""
    tops = lineage.tops(nodes, edges).distinct().withColumnRenamed("node_id", "at")
    # Tops are told for donors and steps at once.
    edges = written(marked(picked(edges, P, "src", "dst", "op", *(c for c in ("media_type", "add_type") if c in edges.columns)), tops, "src"))
    donors = edges.where("op = 'Donor'").select(P, "src", "dst", F.col("src").alias("at"), "_end")
    steps = _programs(edges, bounds, media).select(P, F.col("dst").alias("at"), F.col("src").alias("_to"), transforms.inverse(F.col("program")).alias("program"), "_end")
    return _walked(donors, segments, steps, "at").withColumnRenamed("at", "base").select(P, "src", "dst", "base", "seg_no", *SEG)


def attach_donors(probes: DataFrame, donors: DataFrame) -> DataFrame:
    """Probes with one row for each donor base of their edge's end, else null."""
    return probes.join(donors, [P, "dst"], "left")


def order_probes(probes: DataFrame) -> DataFrame:
    """Final, level, edge: `probe_no` counts them in each journal."""
    return probes.withColumn("probe_no", F.expr("cast(row_number() over (partition by project_id order by final, level, src, dst) as bigint)"))


def designate(probes: DataFrame, qa: DataFrame | None = None) -> DataFrame:
    """Designation: what QA says, else spatial-temporal, spatial, temporal or detect by has_mask and has_segments."""
    kind = F.when(F.col("has_mask") & F.col("has_segments"), "spatial-temporal").when(F.col("has_mask"), "spatial").when(F.col("has_segments"), "temporal").otherwise("detect")
    if qa is None:
        return probes.withColumn("designation", kind)
    return probes.join(qa.select(P, "src", "dst", F.col("designation").alias("_d")), [P, "src", "dst"], "left").withColumn("designation", F.coalesce("_d", kind)).drop("_d")


def drop_nonspatial_files(probes: DataFrame) -> DataFrame:
    """Mask file names go where the designation is not spatial."""
    return probes.withColumn("maskname", F.when(F.col("designation").startswith("spatial"), F.col("maskname")))


def assign_bits(probes: DataFrame) -> DataFrame:
    """Probes (project_id, base, shape, src, dst, mask_hash, probe_no) with group_id and bit_number.

    A group is a journal's base and mask shape; equal (edge, mask) share a bit, numbered by first appearance. Probe numbers are unique in their
    journal, which deals the rows out once for all windows. Probes with a null among the key columns are in no group.
    """
    group, bit = [P, "base", "shape"], [P, "base", "shape", "src", "dst", "mask_hash"]
    by = lambda keys, order="": f"over (partition by {', '.join(keys)} {order})"
    out = probes.where(" and ".join(f"{c} is not null" for c in bit)).withColumn("_first", F.expr(f"min(probe_no) {by(bit)}"))
    out = out.withColumns({"bit_number": F.expr(f"cast(dense_rank() {by(group, 'order by _first')} as bigint)"), "_g": F.expr(f"min(_first) {by(group)}")})
    return out.withColumn("group_id", F.expr(f"cast(dense_rank() {by([P], 'order by _g')} as bigint)")).drop("_first", "_g")


def assign_video_bits(probes: DataFrame, key: list[str]) -> DataFrame:
    """Bit numbers in sequence within each journal's group of equal key columns."""
    by = ", ".join([P, *key])
    return probes.withColumn("bit_number", F.expr(f"cast(row_number() over (partition by {by} order by probe_no) as bigint)"))


def assign_colors(edges: DataFrame) -> DataFrame:
    """(project_id, src, dst, color): edges of a journal spread evenly over the 24-bit range, as 'r g b'.

    Where all edges of a journal have a colour (linkcolor, if there is such a column) and no two the same, these stay.
    """
    own = F.col("linkcolor") if "linkcolor" in edges.columns else F.lit(None).cast("string")
    e = edges.withColumn("_i", F.expr("row_number() over (partition by project_id order by src, dst)")).withColumn("_own", own)
    counts = e.groupBy(P).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("_own").alias("_d"))
    e = e.join(counts, P)
    c = F.floor(F.col("_i") * 16777215 / (F.col("_n") + 1)).cast("long")
    spread = F.concat_ws(" ", F.floor(c / 65536).cast("long"), F.pmod(F.floor(c / 256), F.lit(256)).cast("long"), F.pmod(c, F.lit(256)))
    return e.select(P, "src", "dst", F.when(F.col("_d") == F.col("_n"), F.col("_own")).otherwise(spread).alias("color"))


def extend_detect_probes(probes: DataFrame, nodes: DataFrame, edges: DataFrame, detect: Column, ways: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows for detect-only edges without a probe: each final and base of theirs. ways: as in probe_summary()."""
    edges = written(picked(edges, P, "src", "dst", "op"))
    free = edges.where(detect).select(P, "src", "dst", "op").join(probes.select(P, "src", "dst").distinct(), [P, "src", "dst"], "left_anti")
    return _completed(free, ways or finals_and_bases(nodes, edges))
