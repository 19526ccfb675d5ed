"""Repeated passages through a sparse suffix array over all documents.

Of a document's word suffixes those are retained that start where a 25-word hash is the least of 26 neighbours, so any 50
words in a row, wherever they stand, retain a suffix at the same place. A retained suffix is the hash of its first 25
words, 16-bit hashes of the next 25 and of the 25 before. All retained suffixes are sorted over the cluster; neighbours in
that order are compared, and a common start is extended right and left word by word. As a maximal repeat that went 26 or
more words beyond a suffix would hold another retained one, the 25 words on each side are enough.

A neighbour shares the longest continuation, not the longest text before the suffix. So where other rows share the head
too, each of the 26 windows of 50 words that hold it is hashed, and a window that two documents hold is a passage. Any 50
words that repeat are such a window of a suffix retained in both places, so none is missed. All rows that hold a window
share its head and stand together; only heads that go over the end of a batch send their windows over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Words in a row that make a passage; words of a suffix's hash; words of context on each side.
MIN_WORDS, HEAD = 50, 25
SIDE = MIN_WORDS - HEAD
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd, and so with an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit value over all its bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    """The first n powers of base modulo 2**64, kept for the next call."""
    if len(_kept.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, "u8")
        out[0] = 1
        _kept[base] = np.multiply.accumulate(out)
    return _kept[base][:n]


def _gram_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[begin:end] wherever they stand: differences of a polynomial's prefix sums, shifted to a common place."""
    sums = np.concatenate((np.zeros(1, "u8"), np.cumsum(values * _powers(BASE, len(values)), dtype="u8")))
    return _mix((sums[end] - sums[begin]) * _powers(INVERSE, len(values) + 1)[begin] + (end - begin).astype("u8"))


#: Bytes of text that are hashed at once.
BLOCK = 1 << 21


def suffixes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the retained suffixes of all texts: text number, position in words, head hash, and SIDE 16-bit hashes of the words to the left (nearest first) and to the right."""
    data = np.frombuffer(b" ".join(texts), "u1")
    space = np.concatenate(([True], _SPACE[data], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    begin = edge[::2]
    words = _gram_hashes(data.astype("u8") + np.uint64(1), begin, edge[1::2])
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    doc = np.searchsorted(first, begin, "right") - 1
    n = len(words) - HEAD + 1
    if n < SIDE + 1:
        none = np.zeros(0, "i8")
        return none, none, none.view("u8"), np.zeros((0, SIDE), ">u2"), np.zeros((0, SIDE), ">u2")
    heads = _gram_hashes(words, np.arange(n), np.arange(n) + HEAD)
    # The choice depends on a window's words alone; of equal hashes the last one counts.
    rank = (heads & ~np.uint64(0xFFFFFF)) | (np.uint64(0xFFFFFF) - (np.arange(n, dtype="u8") & np.uint64(0xFFFFFF)))
    windows = np.lib.stride_tricks.sliding_window_view(rank, SIDE + 1)
    inside = np.flatnonzero(doc[: len(windows)] == doc[MIN_WORDS - 1 :])
    at = np.unique(inside + windows[inside].argmin(1))
    small = np.maximum(words >> np.uint64(48), np.uint64(1)).astype(">u2")
    side = np.arange(SIDE)

    def around(place: np.ndarray) -> np.ndarray:
        """Zeros, which equal nothing, beyond the text's ends."""
        ok = (place >= 0) & (place < len(small))
        place = np.where(ok, place, 0)
        return np.where(ok & (doc[place] == doc[at][:, None]), small[place], 0).astype(">u2")

    start = np.searchsorted(doc, doc[at])
    return doc[at], at - start, heads[at], around(at[:, None] - 1 - side), around(at[:, None] + HEAD + side)


def _emit_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, numbers, texts = b.column(0), b.column(2), [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
        sums = np.cumsum([len(t) + 1 for t in texts]) // BLOCK
        for block in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sums)) + 1):
            doc, at, heads, left, right = suffixes([texts[i] for i in block])
            of = pa.array(block[doc])
            yield pa.RecordBatch.from_arrays([pa.array(heads.view("i8")), _binary(right), _binary(left), ids.take(of), pa.array(at, pa.int32()), numbers.take(of)], names=[*KEYS, "row"])


KEYS = ("head", "right", "left", "doc_id", "at")
SUFFIX = "head long, right binary, left binary, doc_id long, at int, row long"
#: Spans have no head; windows have the window's hash as head.
FOUND = f"{SUFFIX}, stop int"


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    data = pa.py_buffer(np.ascontiguousarray(rows).tobytes())
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, data]).cast(pa.binary())


def _sides(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u2").reshape(-1, SIDE)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words in a row that are equal from the first on."""
    return np.logical_and.accumulate((a == b) & (a != 0), axis=1).sum(1)


def _windows(head: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix and r = 0..SIDE the hash of the window of MIN_WORDS words that ends r words after the head, and whether the text holds it."""
    n, sums = len(head), []
    for side, base in ((left, BASE), (right, INVERSE)):
        sums.append(np.concatenate((np.zeros((n, 1), "u8"), np.cumsum(_mix(side.astype("u8")) * _powers(base, SIDE + 1)[1:], axis=1, dtype="u8")), axis=1))
    r = np.arange(SIDE + 1)
    hashes = _mix(_mix(_mix(sums[0])[:, ::-1] + sums[1]) + head.view("u8")[:, None] + r.astype("u8"))
    there = [np.concatenate((np.ones((n, 1), bool), side != 0), axis=1) for side in (left, right)]
    return hashes.view("i8"), there[0][:, ::-1] & there[1]


#: Suffixes whose windows are hashed at once.
WINDOW_ROWS = 1 << 14


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each sorted suffix with its nearest neighbours of other documents, before and after it, that share its head.

    Yields (doc_id, at, row, stop) for passages, other columns null, and the windows (hash as head, doc_id, at, row, stop) of heads that
    other batches or partitions may hold too; at is null if the batch itself has settled the window's rows.
    """
    schema = pa.schema([("head", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("doc_id", pa.int64()), ("at", pa.int32()), ("row", pa.int64())])
    carry, done = schema.empty_table(), 0  # done: rows of carry that have had their turn

    def turn(t: pa.Table, lo: int, hi: int) -> Iterator[pa.RecordBatch]:
        if hi <= lo:
            return
        t = t.combine_chunks()
        head, at, row_no = t["head"].to_numpy(), t["at"].to_numpy(), t["row"].to_numpy()
        doc, known = t["doc_id"].fill_null(-(1 << 63)).to_numpy(), t["doc_id"].is_valid().to_numpy()
        n = len(head)
        new = np.concatenate(([True], (head[1:] != head[:-1]) | (doc[1:] != doc[:-1])))
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        ends = np.append(np.flatnonzero(new)[1:], n)
        stop = ends[np.cumsum(new) - 1]
        rows = np.arange(lo, hi)
        left, right = _sides(t["left"]), _sides(t["right"])
        begin_, stop_ = np.full(n, 1 << 30), np.full(n, -1)
        # The most words after the head that a row of another document shares, -1 if none has the head; words shared with each neighbour.
        most, shared = np.full(n, -1), []
        for other in (start[rows] - 1, stop[rows]):
            ok = (other >= 0) & (other < n)
            most[rows[~ok]] = SIDE  # beyond the partition
            mine, its = rows[ok], other[ok]
            same = head[mine] == head[its]
            mine, its = mine[same], its[same]
            before, after = _common(left[mine], left[its]), _common(right[mine], right[its])
            most[mine] = np.maximum(most[mine], after)
            shared.append((mine, before, after))
            long = before + HEAD + after >= MIN_WORDS
            np.minimum.at(begin_, mine[long], at[mine[long]] - before[long])
            np.maximum.at(stop_, mine[long], at[mine[long]] + HEAD + after[long])
        for a in range(lo, hi, WINDOW_ROWS):
            yield from windows(a, min(a + WINDOW_ROWS, hi), head, at, row_no, doc, known, left, right, most, shared, begin_, stop_)
        hit = np.flatnonzero(stop_ >= 0)
        if len(hit):
            yield rows_of(None, doc[hit], known[hit], pa.array(begin_[hit], pa.int32()), row_no[hit], stop_[hit])

    def rows_of(head: np.ndarray | None, doc: np.ndarray, known: np.ndarray, at: pa.Array, row_no: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(doc))
        first = none.cast(pa.int64()) if head is None else pa.array(head)
        return pa.RecordBatch.from_arrays([first, none.cast(pa.binary()), none.cast(pa.binary()), pa.array(doc, mask=~known), at, pa.array(row_no), pa.array(stop, pa.int32())], names=[*KEYS, "row", "stop"])

    def windows(lo: int, hi: int, head, at, row_no, doc, known, left, right, most, shared, begin_, stop_) -> Iterator[pa.RecordBatch]:
        """Widen begin_ and stop_ of the rows lo..hi by the windows that documents among them share; yield the windows of heads that may go on elsewhere."""
        here = head[lo:hi]
        group = np.cumsum(np.concatenate(([0], here[1:] != here[:-1])))
        whole = np.ones(group[-1] + 1, bool)
        whole[0] &= lo > 0 and head[lo - 1] != head[lo]
        whole[-1] &= hi < len(head) and head[hi] != head[hi - 1]
        # Of a head with two rows or none in another document nothing is left to compare.
        rest = np.flatnonzero((most[lo:hi] >= 0) & ((np.bincount(group) > 2) | ~whole)[group])
        if not len(rest):
            return
        hashes, valid = _windows(here[rest], left[lo + rest], right[lo + rest])
        r = np.arange(SIDE + 1)
        valid &= r <= most[lo + rest][:, None]
        seen, where = np.zeros_like(valid), np.full(hi - lo, -1)
        where[rest] = np.arange(len(rest))
        for mine, before, after in shared:
            ours = (mine >= lo) & (mine < hi)
            ours[ours] = where[mine[ours] - lo] >= 0
            seen[where[mine[ours] - lo]] |= (SIDE - r <= before[ours][:, None]) & (r <= after[ours][:, None])
        # A whole head whose rows the neighbours settle needs no more.
        open_ = ~whole
        open_[group[rest[(valid & ~seen).any(1)]]] = True
        row, r = np.nonzero(valid & open_[group[rest]][:, None])
        if not len(row):
            return
        key, row, met = hashes[row, r], lo + rest[row], seen[row, r]
        order = np.lexsort((doc[row], key))
        key, row, r, met = key[order], row[order], r[order], met[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        ends = np.append(new[1:], len(key)) - 1
        several = doc[row[new]] != doc[row[ends]]
        many = np.repeat(several, ends - new + 1)
        np.minimum.at(begin_, row[many], at[row[many]] - (SIDE - r[many]))
        np.maximum.at(stop_, row[many], at[row[many]] + HEAD + r[many])
        # What is settled here still speaks for its least and greatest document.
        told = ~many
        told[new[several]] = told[ends[several]] = True
        told &= ~whole[group[row - lo]]
        if told.any():
            row, r, key, met = row[told], r[told], key[told], (many | met)[told]
            yield rows_of(key, doc[row], known[row], pa.array(at[row] - (SIDE - r), pa.int32(), mask=met), row_no[row], at[row] + HEAD + r)

    def runs(t: pa.Table) -> np.ndarray:
        head, doc = t["head"].to_numpy(), t["doc_id"].fill_null(-(1 << 63)).to_numpy()
        return np.append(np.flatnonzero(np.concatenate(([True], (head[1:] != head[:-1]) | (doc[1:] != doc[:-1])))), len(head))

    for b in batches:
        if not len(b):
            continue
        t = pa.concat_tables([carry, pa.Table.from_batches([b]).cast(schema)])
        last = int(runs(t)[-2])
        yield from turn(t, done, last)
        keep = max(last - 1, 0)
        carry, done = t[keep:], max(last, done) - keep
    yield from turn(carry, done, len(carry))


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, start_word, end_word, n_words): the passages of 50 or more words that other documents hold too.

    Words are separated by ASCII white space and compared byte by byte; positions count words from 0, the end exclusive;
    overlapping and touching passages of a document are one row. Documents without such a passage, null and shorter texts
    have no row. Rows that share an id, and all rows without an id, count as one document each, so that what repeats only
    inside it is not reported; each row's passages are its own, in the words of its text. Boundaries rest on 16-bit word hashes: one in 65,536 may lie a word too far,
    so that 49 words which many documents share may count as 50 in some.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row")).mapInArrow(_emit_suffixes, SUFFIX)
    ordered = rows.repartitionByRange(n, *KEYS).sortWithinPartitions(*KEYS)
    found = materialize(ordered.mapInArrow(_compare, FOUND), "suffixes")
    windows = found.where("head is not null").select("head", "doc_id", "at", "row", "stop")
    # A missing id is a document of its own.
    named = F.coalesce("doc_id", F.lit(-(1 << 63)))
    common = windows.groupBy("head").agg(F.min(named).alias("_least"), F.max(named).alias("_most")).where("_least < _most").select("head")
    windows = windows.where("at is not null").join(common, "head").select("doc_id", "at", "row", "stop")
    spans = found.where("head is null").select("doc_id", "at", "row", "stop").unionByName(windows)
    spans = spans.withColumn("reach", F.expr("max(stop) over (partition by row order by at, stop rows between unbounded preceding and 1 preceding)"))
    spans = spans.withColumn("island", F.expr("sum(case when at <= reach then 0 else 1 end) over (partition by row order by at, stop rows unbounded preceding)"))
    merged = spans.groupBy("row", "island").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("start_word"), F.max("stop").alias("end_word"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
