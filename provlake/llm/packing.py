"""Best-fit-decreasing packing: segment-tree search over capacities, packed id matrices, and bound-certified repacking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused
from .tokens import END, default_path, encoder, ids_crc32

CAPACITY = 4096
#: Tokens that a task packs at once when it writes id matrices.
BLOCK_TOKENS = 1 << 23
#: Pieces that one group packs; steps of the rounding functions among the bounds.
GROUP_PIECES, STEPS = 30_000, 100


class CapacityTree:
    """Segment tree over free capacities 0..n: open bins by what they have left; finds the least that is enough."""

    def __init__(self, n: int) -> None:
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, free: int, bin_: int) -> None:
        self.bins[free].append(bin_)
        i = free + self.size
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (free, bin) with the smallest free capacity of at least `least`."""
        count, i = self.count, least + self.size
        if not count[i]:
            # Up to the first ancestor with something to its right, then down to its leftmost leaf.
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i *= 2
                if not count[i]:
                    i += 1
        free = i - self.size
        while i:
            count[i] -= 1
            i >>= 1
        return free, self.bins[free].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins. Equal lengths keep their order."""
    tree, bins = CapacityTree(capacity), 0
    bin_of, offset = np.zeros(len(lengths), "i8"), np.zeros(len(lengths), "i8")
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        found = tree.take(n)
        if found is None:
            found, bins = (capacity, bins), bins + 1
        free, b = found
        bin_of[i], offset[i] = b, capacity - free
        if free > n:
            tree.add(free - n, b)
    return bin_of, offset, bins


def dual_feasible_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The least number of bins that any packing needs, by dual-feasible functions.

    For each threshold k up to half the capacity, items above capacity - k count as whole bins, items below k as nothing,
    the rest by length; k = 0 gives the sum of lengths over the capacity. For each number of steps k an item of x bins counts as
    x where (k + 1) x is whole, else as floor((k + 1) x) / k: of items above a third, two fill a bin. The best of all counts.
    """
    return _bound(np.bincount(lengths, minlength=capacity + 1).astype("i8"), capacity)


def counted_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """The same from the number of items of each length."""
    count = np.zeros(capacity + 1, "i8")
    for length, n in counts.items():
        count[length] = n
    return _bound(count, capacity)


def _bound(count: np.ndarray, capacity: int) -> int:
    size = count * np.arange(capacity + 1)
    sums, counts = np.concatenate(([0], np.cumsum(size))), np.concatenate(([0], np.cumsum(count)))
    k = np.arange(capacity // 2 + 1)
    large = counts[capacity + 1] - counts[capacity - k + 1]
    middle = sums[capacity - k + 1] - sums[k]
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, STEPS + 1):
        times = np.arange(capacity + 1) * (k + 1)
        whole = times % capacity == 0
        # In parts of k * capacity, so that no rounding can raise the bound.
        parts = capacity * int((count * (times // capacity))[~whole].sum()) + k * int(size[whole].sum())
        best = max(best, -(-parts // (k * capacity)))
    return best


# --- token pieces ---------------------------------------------------------------------------------------------------


def _pieces(ids: np.ndarray, capacity: int) -> list[np.ndarray]:
    return [ids[i : i + capacity] for i in range(0, len(ids), capacity)]


def token_pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, ids: bool = False) -> DataFrame:
    """Rows (row, doc_id, piece, start, length, ids_crc32): each text's ids and the end id, cut only where longer than the capacity.

    `row` numbers the pieces of a task and tells repeated rows and null ids apart. A null text is empty. With `ids` also
    input_ids (binary, little-endian unsigned 16-bit ids).
    """
    path, with_ids = tokenizer or default_path(), ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(path), TaskContext.get().partitionId() << 36
        for b in batches:
            rows: list[tuple] = []
            for k, ids in enumerate(enc.encode_all(b.column(1).to_pylist())):
                for p, part in enumerate(_pieces(np.append(ids, np.uint16(END)), capacity)):
                    rows.append((k, p, p * capacity, len(part), ids_crc32(part), part.astype("<u2").tobytes() if with_ids else None))
            k, p, start, length, crc, data = (list(c) for c in zip(*rows)) if rows else ([],) * 6
            at = np.arange(row, row + len(k))
            row += len(k)
            out = [pa.array(at), b.column(0).take(pa.array(k, pa.int64())), pa.array(p, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*out, pa.array(data, pa.binary())], [*names, "input_ids"]) if with_ids else pa.RecordBatch.from_arrays(out, names)

    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long" + (", input_ids binary" if ids else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


# --- packing by length over the cluster -----------------------------------------------------------------------------


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """pieces (row unique, length 1..capacity, other columns) with sequence_id and offset, in as few sequences as it can,
    and two figures of the whole table: n_sequences and bound, the dual-feasible bound on any packing's number of sequences.

    Pieces are dealt into groups of about `group_pieces` in order of length, one to each group in turn, so that no group gets
    more long pieces than its share; each group is packed best-fit decreasing. Full sequences are settled. While the number
    of sequences is above the bound and there are several groups, the pieces of all other sequences are dealt anew into fewer
    groups and packed again; a round counts only if it lowers the number. When a round gains nothing, only sequences that are
    half empty or more, of which a group leaves one at most, go on in the same way. It ends when the bound is met, one group
    held all that was left, or again nothing was gained.
    """
    columns = pieces.columns
    sequence, offset, fill, group = unused(pieces, "sequence_id", "offset", "fill", "group")
    if (sequence, offset) != ("sequence_id", "offset"):
        raise ValueError("pieces must not have the columns sequence_id and offset")
    schema = pieces.withColumns({sequence: F.lit(0).cast("long"), offset: F.lit(0).cast("long"), fill: F.lit(0).cast("long")}).schema
    # At most `capacity` rows.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    bound = counted_bound(counts, capacity)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop(columns=group).sort_values("row", ignore_index=True)
        lengths, row = frame["length"].to_numpy(), frame["row"].to_numpy()
        bins, at, n = best_fit_decreasing(lengths, capacity)
        # A sequence takes the number of the piece at its start, which no other sequence holds.
        first = np.zeros(n, "i8")
        first[bins[at == 0]] = row[at == 0]
        frame[sequence], frame[offset] = first[bins], at
        frame[fill] = np.bincount(bins, lengths, n).astype("i8")[bins]
        return frame

    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = [pieces.where(F.col("length") == capacity).withColumns({sequence: F.col("row"), offset: F.lit(0).cast("long")})]
    settled, pool, current = counts.get(capacity, 0), pieces.where(F.col("length") < capacity), None
    left, open_, keep, turn = sum(counts.values()) - settled, 0, capacity, 0
    while left:
        groups = -(-left // group_pieces)
        # The row's place in its range partition; each partition starts with another group.
        place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + F.xxhash64(F.spark_partition_id(), F.lit(turn)).bitwiseAND(0xFFFFFFFF)
        ordered = pool.repartitionByRange(n, "length", F.xxhash64("row", F.lit(turn)), "row").sortWithinPartitions("length", F.xxhash64("row", F.lit(turn)), "row")
        after = materialize(ordered.withColumn(group, F.pmod(place, F.lit(groups))).groupBy(group).applyInPandas(pack, schema), "packed")
        number, turn = after.where(F.col(offset) == 0).count(), turn + 1
        gain = current is None or number < open_
        if gain:
            current, open_ = after, number
        if settled + open_ <= bound or groups == 1 or (not gain and keep < capacity):
            break
        if not gain:
            keep = capacity // 2 + 1
        done = F.col(fill) >= keep
        moved = current.agg(F.count_if(done & (F.col(offset) == 0)).alias("sequences"), F.count_if(done).alias("pieces")).first()
        parts.append(current.where(done).drop(fill))
        current = current.where(~done)
        settled, open_, left = settled + moved["sequences"], open_ - moved["sequences"], left - moved["pieces"]
        pool = current.select(columns)
    if current is not None:
        parts.append(current.drop(fill))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({"n_sequences": F.lit(settled + open_).cast("long"), "bound": F.lit(bound).cast("long")})


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, n_sequences, bound (see pack_pieces).

    With `ids` also input_ids: the piece's ids as little-endian unsigned 16-bit numbers. Every row of docs gives at least one
    piece, repeated rows and null ids included; a null text is empty and holds the end id alone. No document is cut needlessly.
    """
    pieces = materialize(token_pieces(docs, doc_id, text, capacity, tokenizer, ids), "pieces")
    packed = pack_pieces(pieces.select("row", "length"), capacity)
    return pieces.join(packed.drop("length"), "row").drop("row")


# --- packed id matrices ---------------------------------------------------------------------------------------------


def packed_matrices(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Rows of packed id matrices, built where the documents are read, without a shuffle.

    Each task packs its documents best-fit decreasing in blocks of about BLOCK_TOKENS tokens. One row is one sequence:
    sequence_id, n_tokens, input_ids (binary, capacity little-endian unsigned 16-bit ids, zero-padded), cu_seqlens (array
    of cumulative segment lengths, from 0), position_resets (array of the places where position ids start again), doc_ids,
    pieces (arrays, one entry a segment). Documents longer than the capacity are cut into pieces and nothing is dropped:
    the segments of a document in order of `pieces` are its ids. Null texts hold only the end id.
    """
    path = tokenizer or default_path()

    def flush(held: list[tuple[int | None, int, np.ndarray]], number: int) -> pa.RecordBatch:
        lengths = np.array([len(h[2]) for h in held], "i8")
        bins, offset, n = best_fit_decreasing(lengths, capacity)
        matrix = np.zeros((n, capacity), "<u2")
        order = np.lexsort((offset, bins))
        for i in order.tolist():
            matrix[bins[i], offset[i] : offset[i] + lengths[i]] = held[i][2]
        counts = np.bincount(bins, minlength=n)
        at = np.concatenate(([0], np.cumsum(counts))).astype("i4")
        starts = offset[order].astype("i4")
        totals = np.bincount(bins, lengths, n).astype("i4")
        cu = np.insert(starts, at[1:], totals)
        lists = lambda values, ends, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(number, number + n)),
                pa.array(totals),
                pa.array([r.tobytes() for r in matrix], pa.binary()),
                lists(cu, at + np.arange(n + 1, dtype="i4"), pa.int32()),
                lists(starts, at, pa.int32()),
                lists([held[i][0] for i in order.tolist()], at, pa.int64()),
                lists([held[i][1] for i in order.tolist()], at, pa.int32()),
            ],
            names=["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "position_resets", "doc_ids", "pieces"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number = encoder(path), TaskContext.get().partitionId() << 36
        held, tokens = [], 0
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode_all(b.column(1).to_pylist())):
                parts = _pieces(np.append(ids, np.uint16(END)), capacity)
                held += [(doc, p, part) for p, part in enumerate(parts)]
                tokens += len(ids) + 1
                if tokens >= BLOCK_TOKENS:
                    out = flush(held, number)
                    number += len(out)
                    held, tokens = [], 0
                    for i in range(0, len(out), 256):
                        yield out[i : i + 256]
        if held:
            out = flush(held, number)
            for i in range(0, len(out), 256):
                yield out[i : i + 256]

    schema = "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def write_packed(matrices: DataFrame, path: str) -> None:
    """Write packed rows as Parquet; input_ids come out as fixed-width little-endian rows of a matrix."""
    matrices.write.mode("errorifexists").parquet(path)
