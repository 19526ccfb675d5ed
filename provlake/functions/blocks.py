"""Order-dependent work on long groups in two passes: each block is summed up in one row, what the blocks before it carry is found
from those rows, and windows then run within blocks. No task sorts or scans the whole of a group."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import written

#: Order numbers in a block.
BLOCK = 1 << 16
#: Rows in a part that one task sorts or puts together.
PART = 1 << 18


def n_parts(rows: int, spark: SparkSession) -> int:
    """Parts of PART rows or so; at least the session's."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // PART + 1)


def in_parts(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt out by the keys in as many parts as its rows need, so that a task's memory does not grow with the table."""
    return df.repartition(n_parts(df.count(), df.sparkSession), *keys)


@contextmanager
def dealt(df: DataFrame, *keys: str) -> Iterator[DataFrame]:
    """df dealt out by the keys and kept by the executors while a loop lasts, whose rounds join it by these keys without another exchange."""
    df = written(df)
    out = in_parts(df, *keys).persist()
    try:
        yield out
    finally:
        out.unpersist()


def in_blocks(df: DataFrame, order: str | Column) -> DataFrame:
    """df with `_block`, the block of each row by its order number or time."""
    return df.withColumn("_block", F.floor((F.col(order) if isinstance(order, str) else order) / BLOCK))


def _joined(rows: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of their block's one row; null keys meet too."""
    named = blocks.withColumnsRenamed({k: f"_of_{k}" for k in [*keys, "_block"]})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, "_block"]]
    return rows.join(named, same, "left").drop(*(f"_of_{k}" for k in [*keys, "_block"]))


def _over(keys: list[str], order: str, *more: str) -> str:
    return f"over (partition by {', '.join([*keys, *more])} order by {order} rows between unbounded preceding and"


def running_sums(rows: DataFrame, keys: list[str], order: str, sums: dict[str, str]) -> DataFrame:
    """rows (with `_block`) and for each name the sum of a column up to and with the row, in the order given (SQL, blocks ascending)."""
    parts = rows.groupBy(*keys, "_block").agg(*(F.sum(c).alias(f"{name}_0") for name, c in sums.items()))
    parts = parts.withColumns({f"{name}_0": F.expr(f"coalesce(sum({name}_0) {_over(keys, '_block')} 1 preceding), 0)") for name in sums})
    local = _over(keys, order, "_block")
    return _joined(rows, parts, keys).withColumns({name: F.expr(f"{name}_0 + coalesce(sum({c}) {local} current row), 0)") for name, c in sums.items()}).drop(*(f"{name}_0" for name in sums))


def ranked(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """rows with `_i`, their number from 1 in order within the keys, and `_n`, how many there are."""
    blocked = in_blocks(rows, order)
    parts = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_i0"))
    every = f"over (partition by {', '.join(keys)})"
    parts = parts.withColumns({"_n": F.expr(f"sum(_i0) {every}"), "_i0": F.expr(f"coalesce(sum(_i0) {_over(keys, '_block')} 1 preceding), 0)")})
    number = F.expr(f"row_number() over (partition by {', '.join([*keys, '_block'])} order by {order})")
    return _joined(blocked, parts, keys).withColumn("_i", F.col("_i0") + number).drop("_i0", "_block")


def previous(rows: DataFrame, keys: list[str], order: str, column: str, out: str) -> DataFrame:
    """rows with the column of the row before, null for the first of the keys."""
    blocked = in_blocks(rows, order)
    last = blocked.groupBy(*keys, "_block").agg(F.max_by(F.struct(F.col(column).alias("v")), order).alias("_l"))
    last = last.withColumn("_l", F.expr(f"lag(_l) over (partition by {', '.join(keys)} order by _block)"))
    local = F.expr(f"lag(struct({column} as v)) over (partition by {', '.join([*keys, '_block'])} order by {order})")
    return _joined(blocked, last, keys).withColumn("_v", F.coalesce(local, "_l")).withColumn(out, F.col("_v.v")).drop("_l", "_v", "_block")


def last_known(rows: DataFrame, keys: list[str], order: list[str], before: dict[str, str], after: dict[str, str] | None = None) -> DataFrame:
    """rows (with `_block`) and for each name of `before` the last value of a column that is not null up to and with the row, for each of `after`
    the first from the row on. order: columns that tell rows apart, the blocks' first; each dict names a column once.

    What the blocks before (after) a block carry joins its rows as one row more, so that both ways share one exchange of the rows.
    """
    after = after or {}
    place = F.struct(*order)
    ways = ((0, "asc", F.max_by, before), (2, "desc", F.min_by, after))
    told = [pick(c, F.when(F.col(c).isNotNull(), place)).alias(f"_{side}_{c}") for side, _, pick, columns in ways for c in columns.values()]
    parts = rows.groupBy(*keys, "_block").agg(*told)
    out = rows.withColumn("_side", F.lit(1))
    for side, way, _, columns in ways:
        if columns:
            carried = {c: F.expr(f"last(_{side}_{c}, true) {_over(keys, f'_block {way}')} 1 preceding)").alias(c) for c in columns.values()}
            out = out.unionByName(parts.select(*keys, "_block", *carried.values(), F.lit(side).alias("_side")), allowMissingColumns=True)
    # Dealt out by the rows that there are, which the blocks' rows do not add much to.
    out = out.repartition(n_parts(rows.count(), rows.sparkSession), *keys, "_block")
    for _, way, _, columns in ways:
        # A growing frame in either direction, which is linear; a shrinking one would be summed anew for each row.
        local = _over(keys, ", ".join(f"{c} {way}" for c in ["_side", *order]), "_block")
        out = out.withColumns({name: F.expr(f"last({c}, true) {local} current row)") for name, c in columns.items()})
    return out.where("_side = 1").drop("_side")
