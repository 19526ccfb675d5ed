"""Lineage over the edges of all journals at once: reach, bases, finals, components, cycles, paths and labels.

Tables carry project_id; edges have src, dst and op. Loops advance all journals by one level, keep what they have seen
once, and stop when no journal advances. Donor edges are those of operation `Donor`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.functions.blocks import dealt
from provlake.functions.storage import Rounds, picked, written

P = "project_id"


def _plain(edges: DataFrame, exclude_donor: bool) -> DataFrame:
    return edges.where("op <> 'Donor'") if exclude_donor else edges


def reach(edges: DataFrame, seeds: DataFrame, upward: bool = False) -> DataFrame:
    """(project_id, seed, node_id, depth): every node that seeds reach, each once at its least depth, seeds at 0 included.

    seeds has project_id and node_id. Cycles end by themselves, as no node is visited twice from one seed.
    """
    return _spread(edges, seeds.select(P, F.col("node_id").alias("seed"), "node_id"), upward)


def reached(edges: DataFrame, seeds: DataFrame, upward: bool = False) -> DataFrame:
    """(project_id, node_id) of all nodes that any of the seeds reaches, the seeds included: one frontier for all of them, so each node and
    edge is looked at once, however many seeds there are."""
    return _spread(edges, seeds.select(P, F.lit(0).cast("long").alias("seed"), "node_id"), upward).select(P, "node_id")


def _spread(edges: DataFrame, seeds: DataFrame, upward: bool) -> DataFrame:
    here, there = ("dst", "src") if upward else ("src", "dst")
    steps = edges.select(P, F.col(here).alias("node_id"), F.col(there).alias("_next")).distinct()
    rounds = Rounds(seeds.distinct().withColumn("depth", F.lit(0)))
    with dealt(steps, P, "node_id") as steps:
        while not rounds.last.isEmpty():
            # Distinct by the keys of the join that follows, so that both share one exchange. A row without a seed or node leads nowhere.
            found = rounds.last.join(steps, [P, "node_id"]).select(P, "seed", F.col("_next").alias("node_id")).distinct()
            new = found.join(rounds.all().select(P, "seed", "node_id"), [P, "seed", "node_id"], "left_anti")
            rounds.add(new.withColumn("depth", F.lit(rounds.count)))
    return rounds.all()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes' keys with n_in, n_out, n_in_plain and n_out_plain (donor edges left out)."""
    plain = (F.col("op") != "Donor").cast("long")
    ends = edges.select(P, F.col("dst").alias("node_id"), F.lit(1).alias("i"), F.lit(0).alias("o"), plain.alias("ip"), F.lit(0).cast("long").alias("op_"))
    ends = ends.unionByName(edges.select(P, F.col("src").alias("node_id"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0).cast("long").alias("ip"), plain.alias("op_")))
    sums = ends.groupBy(P, "node_id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.sum("ip").alias("n_in_plain"), F.sum("op_").alias("n_out_plain"))
    return nodes.select(P, "node_id").join(sums, [P, "node_id"], "left").na.fill(0)


def base_paths(nodes: DataFrame, edges: DataFrame, exclude_donor: bool = True) -> DataFrame:
    """G1: (project_id, node_id, base, level, path) for every path upward to a node without predecessors.

    A node whose only predecessors are donors yields no base if donors are left out. Cycles end a path.
    """
    steps = written(_plain(edges, exclude_donor).select(P, F.col("dst").alias("at"), F.col("src").alias("_up")))
    rounds = Rounds(nodes.select(P, "node_id", F.col("node_id").alias("at"), F.array("node_id").alias("path")))
    while not rounds.last.isEmpty():
        up = rounds.last.join(steps, [P, "at"]).where(~F.expr("array_contains(path, _up)"))
        rounds.add(up.select(P, "node_id", F.col("_up").alias("at"), F.array_append("path", F.col("_up")).alias("path")))
    ended = rounds.all().join(tops(nodes, edges).withColumnRenamed("node_id", "at"), [P, "at"], "left_semi")
    return ended.select(P, "node_id", F.col("at").alias("base"), (F.size("path") - 1).cast("long").alias("level"), "path")


def tops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, node_id) of the nodes without any predecessor."""
    return nodes.select(P, "node_id").join(edges.select(P, F.col("dst").alias("node_id")), [P, "node_id"], "left_anti")


def ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, node_id) of the nodes without any successor."""
    return nodes.select(P, "node_id").join(edges.select(P, F.col("src").alias("node_id")), [P, "node_id"], "left_anti")


def nearest_bases(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, node_id, base, level): the first base of each node by level, then id, along edges that are not donors.

    From all bases downward at once, one level a round: a node is reached at its least level first, by the smallest base of
    the parents that were reached in the round before. No path is listed.
    """
    steps = _plain(edges, True).select(P, F.col("src").alias("node_id"), F.col("dst").alias("_to"))
    rounds = Rounds(tops(nodes, edges).distinct().select(P, "node_id", F.col("node_id").alias("base"), F.lit(0).cast("long").alias("level")))
    with dealt(steps, P, "node_id") as steps:
        while not rounds.last.isEmpty():
            found = rounds.last.join(steps, [P, "node_id"]).groupBy(P, F.col("_to").alias("node_id")).agg(F.min("base").alias("base"), (F.min("level") + 1).alias("level"))
            rounds.add(found.join(rounds.all().select(P, "node_id"), [P, "node_id"], "left_anti"))
    return rounds.all()


def bases(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, node_id, base): every base above each node, once, along edges that are not donors."""
    return reach(_plain(edges, True), tops(nodes, edges)).select(P, "node_id", F.col("seed").alias("base"))


def find_base(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, node_id, base): follow the first (smallest) predecessor that is not a donor, by pointer doubling.

    A node without one is its own base; nodes on a cycle have none.
    """
    parent = _plain(edges, True).groupBy(P, F.col("dst").alias("node_id")).agg(F.min("src").alias("up"))
    at = written(nodes.select(P, "node_id").join(parent, [P, "node_id"], "left").select(P, "node_id", F.coalesce("up", "node_id").alias("base")))
    rounds = 0
    while rounds < 63:
        up = at.select(P, F.col("node_id").alias("base"), F.col("base").alias("_far"))
        after = written(at.join(up, [P, "base"]).select(P, "node_id", F.col("_far").alias("base")))
        moved = after.join(at, [P, "node_id", "base"], "left_anti").isEmpty()
        at, rounds = after, rounds + 1
        if moved:
            break
    roots = nodes.select(P, F.col("node_id").alias("base")).join(parent.select(P, F.col("node_id").alias("base")), [P, "base"], "left_anti")
    return at.join(roots, [P, "base"], "left_semi").select(P, "node_id", "base")


def terminals(nodes: DataFrame, edges: DataFrame, exclude_donor: bool = True) -> DataFrame:
    """(project_id, node_id, final): nodes without successors that each node reaches, each once."""
    nodes, edges = written(picked(nodes, P, "node_id")), written(picked(edges, P, "src", "dst", "op"))
    # Upward from the ends: what reaches none of them is not looked at.
    found = reach(_plain(edges, exclude_donor), ends(nodes, edges), upward=True)
    return found.select(P, "node_id", F.col("seed").alias("final"))


def ancestor_edges(edges: DataFrame, seeds: DataFrame, exclude_donor: bool = False) -> DataFrame:
    """(project_id, seed, src, dst, op): all edges among a node and its ancestors that lead upward from it."""
    plain = _plain(written(picked(edges, P, "src", "dst", "op")), exclude_donor)
    up = reach(plain, seeds, upward=True)
    return up.select(P, "seed", F.col("node_id").alias("dst")).join(plain.select(P, "src", "dst", "op"), [P, "dst"]).select(P, "seed", "src", "dst", "op")


def donor_base_tuples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, donor_src, donor_dst, base): the bases above each donor edge's start."""
    edges = written(picked(edges, P, "src", "dst", "op"))
    donors = edges.where("op = 'Donor'").select(P, F.col("src").alias("donor_src"), F.col("dst").alias("donor_dst"))
    return donors.join(bases(nodes, edges).withColumnRenamed("node_id", "donor_src"), [P, "donor_src"]).select(P, "donor_src", "donor_dst", "base")


def terminal_base_tuples(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, final, base)."""
    edges = written(picked(edges, P, "src", "dst", "op"))
    return bases(nodes, edges).join(ends(nodes, edges), [P, "node_id"], "left_semi").withColumnRenamed("node_id", "final")


def has_ancestor_op(nodes: DataFrame, edges: DataFrame, op: str) -> DataFrame:
    """Nodes with an edge of this operation among their ancestors' edges: everything downstream of such an edge."""
    heads = edges.where(F.col("op") == op).select(P, F.col("dst").alias("node_id")).distinct()
    return reached(edges, heads)


def common_parent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, node_id, same): do the two smallest predecessors share a base? Only nodes with two or more."""
    base = find_base(nodes, edges)
    ranked = edges.select(P, "dst", "src").withColumn("k", F.expr("row_number() over (partition by project_id, dst order by src)")).where("k <= 2")
    with_base = ranked.join(base.select(P, F.col("node_id").alias("src"), "base"), [P, "src"], "left")
    return with_base.groupBy(P, F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), (F.min("base") == F.max("base")).alias("same")).where("n = 2").drop("n")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, node_id, component): the smallest node reachable when directions are ignored.

    By random contraction: in each round a node goes over into the one of least hash among itself and its neighbours, with another seed each
    round, so nodes and links shrink by a share each round, chains and stars alike. The rounds' maps are then followed from the last back.
    """
    pair = lambda a, b: (F.least(a, b).alias("_a"), F.greatest(a, b).alias("_b"))
    left = written(edges.where("src <> dst").select(P, *pair("src", "dst")).distinct())
    maps: list[DataFrame] = []
    while not left.isEmpty():
        hashed = lambda c: F.xxhash64(F.lit(len(maps)), F.col(c))  # noqa: B023, E731
        side = lambda one, other: left.select(P, F.col(one).alias("node_id"), F.col(other).alias("_n"), hashed(other).alias("_h"))  # noqa: B023, E731
        near = side("_a", "_b").unionByName(side("_b", "_a")).groupBy(P, "node_id").agg(F.min_by("_n", "_h").alias("_n"), F.min("_h").alias("_h"))
        into = written(near.select(P, "node_id", F.when(hashed("node_id") <= F.col("_h"), F.col("node_id")).otherwise(F.col("_n")).alias("_to")))
        of = lambda end: into.select(P, F.col("node_id").alias(end), F.col("_to").alias(f"_to{end}"))  # noqa: B023, E731
        left = written(left.join(of("_a"), [P, "_a"]).join(of("_b"), [P, "_b"]).where("_to_a <> _to_b").select(P, *pair("_to_a", "_to_b")).distinct())
        maps.append(into)
    own = nodes.select(P, "node_id").distinct()
    if not maps:
        return own.withColumn("component", F.col("node_id"))
    root = maps.pop()
    while maps:
        into = maps.pop()
        root = written(into.join(root.select(P, F.col("node_id").alias("_to"), F.col("_to").alias("_far")), [P, "_to"], "left").select(P, "node_id", F.coalesce("_far", "_to").alias("_to")))
    rooted = written(own.join(root, [P, "node_id"], "left"))
    least = rooted.where("_to is not null").groupBy(P, "_to").agg(F.min("node_id").alias("component"))
    return rooted.join(least, [P, "_to"], "left").select(P, "node_id", F.coalesce("component", "node_id").alias("component"))


def cycle_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, node_id) of the nodes that lie on a cycle, not of those between two cycles.

    Strong components by colour: after a trim of both ends each node takes the smallest node that reaches it; what reaches that node
    back within its colour is its component, and leaves. Every round settles at least one component of each journal.
    """
    left = _trimmed(written(edges.select(P, "src", "dst").distinct()))
    loops = left.where("src = dst").select(P, F.col("src").alias("node_id"))
    found = [loops]
    while not left.isEmpty():
        color = _least_above(left)
        of = lambda end: color.select(P, F.col("node_id").alias(end), F.col("color").alias(f"_{end}"))
        alike = written(left.join(of("src"), [P, "src"]).join(of("dst"), [P, "dst"]).where("_src = _dst").select(P, "src", "dst"))
        back = written(reached(alike, color.where("node_id = color"), upward=True))
        # A component of one node is on no cycle but its own.
        inner = alike.join(back.withColumnRenamed("node_id", "src"), [P, "src"], "left_semi").join(back.withColumnRenamed("node_id", "dst"), [P, "dst"], "left_semi")
        found.append(written(inner.where("src <> dst").select(P, F.col("src").alias("node_id")).distinct()))
        rest = left.join(back.withColumnRenamed("node_id", "src"), [P, "src"], "left_anti").join(back.withColumnRenamed("node_id", "dst"), [P, "dst"], "left_anti")
        left = _trimmed(written(rest))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _trimmed(left: DataFrame) -> DataFrame:
    """The edges without those that a node without predecessors or successors ends: layer by layer while a layer takes a fourth of what is left
    or more, so that all layers together cost no more than four of the first."""
    n = left.count()
    while n:
        ins, outs = left.select(P, F.col("dst").alias("src")), left.select(P, F.col("src").alias("dst"))
        left = written(left.join(ins, [P, "src"], "left_semi").join(outs, [P, "dst"], "left_semi"))
        before, n = n, left.count()
        if n > before * 3 / 4:
            break
    return left


def _least_above(edges: DataFrame) -> DataFrame:
    """(project_id, node_id, color): the smallest node from which each node is reached, itself included. Colours jump to their colour's
    colour, so rounds grow with the logarithm of a path's length."""
    color = written(edges.select(P, F.col("src").alias("node_id")).unionByName(edges.select(P, F.col("dst").alias("node_id"))).distinct().withColumn("color", F.col("node_id")))
    while True:
        sent = color.withColumnRenamed("node_id", "src").join(edges, [P, "src"]).select(P, F.col("dst").alias("node_id"), "color")
        far = color.select(P, F.col("node_id").alias("color"), F.col("color").alias("_far"))
        jumped = color.join(far, [P, "color"]).select(P, "node_id", F.col("_far").alias("color"))
        after = written(jumped.unionByName(sent).groupBy(P, "node_id").agg(F.min("color").alias("color")))
        if after.join(color, [P, "node_id", "color"], "left_anti").isEmpty():
            return after
        color = after


def label_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, node_id, label): base (no predecessor), final (no successor), donor (only donor edges lead out), else interim."""
    d = degrees(nodes, edges)
    label = F.when((F.col("n_in") == 0) & (F.col("n_out_plain") == 0) & (F.col("n_out") > 0), "donor").when(F.col("n_in") == 0, "base").when(F.col("n_out") == 0, "final").otherwise("interim")
    return d.select(P, "node_id", label.alias("label"))


def subgraph(nodes: DataFrame, edges: DataFrame, keep: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes in `keep` (project_id, node_id) and the edges between them."""
    keep = keep.select(P, "node_id").distinct()
    inner = edges.join(keep.withColumnRenamed("node_id", "src"), [P, "src"], "left_semi").join(keep.withColumnRenamed("node_id", "dst"), [P, "dst"], "left_semi")
    return nodes.join(keep, [P, "node_id"], "left_semi"), inner


def qa_invalidate(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(project_id, src, dst): links up- and downstream of changed links (project_id, src, dst), whose QA mark must be reset."""
    edges = written(picked(edges, P, "src", "dst"))
    up = reached(edges, changed.select(P, F.col("src").alias("node_id")), upward=True).withColumnRenamed("node_id", "dst")
    down = reached(edges, changed.select(P, F.col("dst").alias("node_id"))).withColumnRenamed("node_id", "src")
    hit = edges.join(up, [P, "dst"], "left_semi").select(P, "src", "dst").unionByName(edges.join(down, [P, "src"], "left_semi").select(P, "src", "dst"))
    return hit.unionByName(changed.select(P, "src", "dst")).distinct()


def paths_to_finals(nodes: DataFrame, edges: DataFrame, cond: str = "false") -> DataFrame:
    """(project_id, node_id, final, path, hit): all paths to nodes without successors; hit: an edge on it meets `cond`."""
    steps = written(edges.select(P, F.col("src").alias("at"), F.col("dst").alias("_to"), F.coalesce(F.expr(cond), F.lit(False)).alias("_c")))
    rounds = Rounds(nodes.select(P, "node_id", F.col("node_id").alias("at"), F.array("node_id").alias("path"), F.lit(False).alias("hit")))
    while not rounds.last.isEmpty():
        down = rounds.last.join(steps, [P, "at"]).where(~F.expr("array_contains(path, _to)"))
        rounds.add(down.select(P, "node_id", F.col("_to").alias("at"), F.array_append("path", F.col("_to")).alias("path"), (F.col("hit") | F.col("_c")).alias("hit")))
    last = rounds.all().join(steps.select(P, "at"), [P, "at"], "left_anti")
    return last.select(P, "node_id", F.col("at").alias("final"), "path", "hit")
