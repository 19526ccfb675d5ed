"""Operation groups whose members may be groups themselves, expanded in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.functions.storage import Rounds, written


def expand_groups(groups: DataFrame) -> DataFrame:
    """(group_name, path, op, is_cycle): the operations of each group in order of `path`, the positions that lead to them.

    groups: group_name, pos, op, which may be a group's name. A member that is a group already open above it is not opened again:
    it stays as one row with is_cycle.
    """
    members = written(groups.select(F.col("group_name").alias("_g"), F.col("pos").alias("_pos"), F.col("op").alias("_op")))
    names = members.select(F.col("_g").alias("op")).distinct()
    cycle = F.array_contains("above", F.col("op"))
    rounds = Rounds(groups.select("group_name", F.array("pos").alias("path"), "op", F.array("group_name").alias("above")))
    while not rounds.last.isEmpty():
        inner = rounds.last.where(~cycle).join(members, F.col("op") == F.col("_g"))
        rounds.add(inner.select("group_name", F.array_append("path", F.col("_pos")).alias("path"), F.col("_op").alias("op"), F.array_append("above", F.col("_g")).alias("above")))
    out = rounds.all().withColumn("is_cycle", cycle)
    return out.where("is_cycle").unionByName(out.where("not is_cycle").join(names, "op", "left_anti")).select("group_name", "path", "op", "is_cycle")


def group_members(groups: DataFrame, operations: DataFrame) -> DataFrame:
    """(op, members array<struct<op, category>>): a group's name and its known operations in order, for rules that look into groups.

    The list is as long as the dictionary makes a group.
    """
    known = expand_groups(groups).where("not is_cycle").join(operations.select("op", "category"), "op")
    listed = known.groupBy("group_name").agg(F.array_sort(F.collect_list(F.struct("path", "op", "category"))).alias("l"))
    return listed.select(F.col("group_name").alias("op"), F.transform("l", lambda x: F.struct(x.op.alias("op"), x.category.alias("category"))).alias("members"))
