"""A Merkle manifest of a dataset: leaves hash the rows' fields, every two nodes of a level hash to one, a root per group and one over all.

Rows of a group are numbered in order by range partitions and their counts. A level's nodes live on the rows of their first
leaves, so all levels of a block of 2 ** BITS rows share one sorted window: at level j, lead and lag by 2 ** j give a node's
sibling, masked by its slot and by the run's length, and the first child's row hashes the parent. Going back down, lag by
2 ** j hands a parent's path of siblings to its second child. Block tops are the leaves of the next round, so no window
holds more than a block, however large a group is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unused

#: Levels of a block.
BITS = 6


def field(value: Column) -> Column:
    """A field of a leaf: `-` if null, else its UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with `pos` (from 0 within the group, nulls first in group and order) and `n`, the group's rows.

    Range partitions of a sorted written table: the place in a partition comes with the scan, the rows before it from one
    count for each partition and group. `order` must tell all rows apart, so that a group or an id of any size is split.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = [F.col(c).asc_nulls_first() for c in (group, *order)]
    place = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(n, *key).sortWithinPartitions(*key).withColumn("_place", place)
    dealt = materialize(dealt.withColumn("_part", F.shiftright("_place", 33)), "numbered")
    counts = dealt.groupBy("_part", group).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    # One row for each partition and group in it.
    before = Window.partitionBy(group).orderBy("_part")
    counts = counts.withColumn("_before", F.sum("_rows").over(before) - F.col("_rows")).withColumn("n", F.sum("_rows").over(Window.partitionBy(group)))
    counts = counts.withColumnsRenamed({"_part": "_p", group: "_g"})
    joined = dealt.join(counts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("pos", F.col("_place") - F.col("_first") + F.col("_before")).drop("_place", "_part", "_p", "_g", "_first", "_rows", "_before")


def climb(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """nodes(grp, pos, n, digest, ...) with `path` and `top`: the siblings from the node to its group's last node, and that node.

    A step of the path is `<` or `>` and the sibling that stands to the left or right, or `=` for a node that is hashed
    alone. pos runs from 0 to n - 1 in each group; the path of a group of one is empty.
    """
    block = F.shiftright("pos", bits)
    w = Window.partitionBy("grp", "_block").orderBy("pos")
    out = nodes.withColumn("_block", block).withColumn("_d0", F.col("digest"))
    starts = lambda j: F.col("pos") % (1 << j) == 0  # noqa: E731  the row of a node's first leaf
    second = lambda j: F.shiftright("pos", j) % 2 == 1
    runs = lambda j: F.col("n") > (1 << j)  # noqa: E731  the level has more than one node
    for j in range(bits):
        here, step = F.col(f"_d{j}"), 1 << j
        right = F.when(F.col("pos") + step < F.col("n"), F.lead(here, step).over(w))
        sibling = F.when(runs(j) & starts(j), F.when(second(j), F.concat(F.lit("<"), F.lag(here, step).over(w))).otherwise(F.coalesce(F.concat(F.lit(">"), right), F.lit("="))))
        out = out.withColumn(f"_s{j}", sibling)
        parent = F.when(starts(j + 1), F.when(runs(j), F.sha2(F.concat(here, F.substr(f"_s{j}", F.lit(2))), 256)).otherwise(here))
        out = out.withColumn(f"_d{j + 1}", parent)
    steps = F.array().cast("array<string>")
    out = out.withColumn("_path", F.when(starts(bits), steps))
    for j in reversed(range(bits)):
        handed = F.when(second(j), F.lag("_path", 1 << j).over(w)).otherwise(F.col("_path"))
        own = F.when(F.col(f"_s{j}").isNotNull(), F.array(f"_s{j}")).otherwise(steps)
        out = out.withColumn("_path", F.when(starts(j), F.concat(own, handed)))
    inner = [c for c in out.columns if c[:2] in ("_d", "_s") and c[2:].isdigit() and c != f"_d{bits}"]
    return out.drop(*inner).withColumnRenamed(f"_d{bits}", "_top")


def tree(nodes: DataFrame, bits: int = BITS, above: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """nodes(grp, pos, n, digest, ...) with `path` and `subroot`, by rounds of blocks; grp is not null.

    above: adds to the groups' (grp, subroot) columns, of which `outer` is a path that goes on from the subroot. They are joined where a group is
    one block, and come down block by block, so no join deals rows by group alone.
    """
    kept, rounds = [], nodes
    while True:
        climbed = materialize(climb(rounds, bits), "blocks")
        kept.append(climbed)
        heads = climbed.where(F.col("_top").isNotNull())
        if not climbed.where(F.col("n") > (1 << bits)).head(1):
            break
        # A group that is done goes on as one node.
        count = F.shiftright(F.col("n") + ((1 << bits) - 1), bits)
        rounds = heads.select("grp", F.col("_block").alias("pos"), count.alias("n"), F.col("_top").alias("digest"))
    last = kept.pop()
    tops = last.where(F.col("_top").isNotNull()).select("grp", F.col("_top").alias("subroot"))
    tops = above(tops) if above else tops.withColumn("outer", F.array().cast("array<string>"))
    done = last.join(tops, "grp").withColumn("path", F.concat("_path", "outer")).drop("_path", "_block", "_top", "outer")
    more = [c for c in tops.columns if c not in ("grp", "outer")]
    while kept:
        upper = done.select("grp", F.col("pos").alias("_block"), F.col("path").alias("_above"), *more)
        joined = kept.pop().join(upper, ["grp", "_block"])
        done = joined.withColumn("path", F.concat("_path", "_above")).drop("_path", "_above", "_block", "_top")
    return done


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path of siblings give."""
    rest = lambda s: F.substr(s, F.lit(2))
    return F.aggregate(path, leaf, lambda at, s: F.sha2(F.when(s.startswith("<"), F.concat(rest(s), at)).otherwise(F.concat(at, rest(s))), 256))


def siblings(path: Column) -> Column:
    """The digests of a path's siblings, concatenated in its order."""
    return F.array_join(F.transform(path, lambda s: F.substr(s, F.lit(2))), "")


def manifest(leaves: DataFrame, group: str, order: str, leaf: str = "leaf", bits: int = BITS) -> DataFrame:
    """leaves with `path` (siblings up to the root, see climb()), `subroot` and `root` (with underscores before names that are taken).

    Leaves stand in ascending `order` within their group (nulls first; ties by leaf, so rows alike in every field may change
    places without a change of any digest but their paths). Groups stand in ascending byte order, null first; a null group is
    a group of its own. Other columns stay. An empty table gives no rows.
    """
    # A null group stands before every text, the empty one too.
    name = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))
    held = leaves.select(F.struct("*").alias("row"), name.alias("grp"), F.col(order).alias("key"), F.col(leaf).alias("digest"), F.monotonically_increasing_id().alias("tie"))

    def over_all(tops: DataFrame) -> DataFrame:
        named = materialize(tops.select("grp", F.col("subroot").alias("digest"), F.lit(0).alias("all")), "subroots")
        top = numbered(named, "all", "grp").select(F.col("grp").alias("of"), "pos", "n", "digest", F.lit("all").alias("grp"))
        return tree(top, bits).select(F.col("of").alias("grp"), F.col("digest").alias("subroot"), F.col("path").alias("outer"), F.col("subroot").alias("root"))

    inner = tree(numbered(materialize(held, "leaves"), "grp", "key", "digest", "tie"), bits, over_all)
    path, subroot, root = unused(leaves, "path", "subroot", "root")
    return inner.select("row.*", F.col("path").alias(path), F.col("subroot").alias(subroot), F.col("root").alias(root))


def document_manifest(docs: DataFrame, tampered: Column | None = None, bits: int = BITS) -> DataFrame:
    """Rows (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one for each row of docs.

    A leaf hashes doc_id, source, lang, n_chars and text; lang is the group and doc_id the order. folded_root is what the
    row's path makes of its leaf, computed with n_chars + 1 where `tampered` is true (by default where 7 divides the CRC-32 of
    the id's text; never for a null id). A null n_chars stays null, so such a row verifies. Null, empty and very long
    texts, null ids and langs are leaves like any other, repeated rows one leaf each; an empty table gives no rows.
    """
    if tampered is None:
        tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    hashed = lambda chars: leaf_hash(F.col("doc_id"), F.col("source"), F.col("lang"), chars, F.col("text"))
    bad = F.when(tampered, hashed(F.col("n_chars").cast("long") + 1))
    leaves = docs.select("doc_id", "lang", hashed(F.col("n_chars").cast("long")).alias("leaf"), bad.alias("bad"))
    out = manifest(leaves, "lang", "doc_id", bits=bits)
    folded = fold(F.coalesce("bad", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
