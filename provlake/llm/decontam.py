"""Benchmark decontamination by pigeonhole edit matching.

A test item within k edits of a passage has, cut into k + 1 pieces, at least one piece that the passage holds unchanged.
Exact piece hits come from one automaton over all pieces; around each hit Myers' bit-parallel distance verifies the item.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed for each character of an item, and characters of items in one automaton.
ERROR_RATE, BLOCK_CHARS = 0.05, 1 << 23
#: Items shorter than this match as whole words only, since short strings stand inside words by chance.
SHORT = 40
#: Items shorter than this (an answer, a name) are no evidence for drop_contaminated(), whose parameter it is.
LEAST_CHARS = 20


def normalize(text: str | None) -> str:
    """Lower case, white space runs as one blank."""
    return " ".join((text or "").lower().split())


def budget(item: str) -> int:
    return int(len(item) * ERROR_RATE)


def pieces(item: str) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of even length."""
    n = budget(item) + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern_bits: dict[str, int], m: int, text: str, limit: int, anchored: bool = False, ends: Callable[[int], bool] | None = None) -> tuple[int, int] | None:
    """(distance, end) of the best match of a pattern anywhere in text, or with `anchored` from its start on, among the ends that
    `ends` allows; the earliest end on ties, None above limit."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, None
    for j, c in enumerate(text):
        eq = pattern_bits.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & mask, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # An anchored match pays for each character of the text before the pattern begins.
        ph, mh = (ph << 1 | anchored) & mask, (mh << 1) & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score <= limit and (best is None or score < best[0]) and (ends is None or ends(j + 1)):
            best = (score, j + 1)
    return best


def bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def edge(text: str, at: int) -> bool:
    """Does no word run over this place?"""
    return not (text[at - 1 : at].isalnum() and text[at : at + 1].isalnum()) if at else True


class Matcher:
    """All items of one block, ready for any number of texts; those of `least` characters or more are evidence."""

    def __init__(self, items: list[tuple[int, str]], least: int = 0) -> None:
        self.items, self.least = [(i, n) for i, t in items if (n := normalize(t))], least
        self.bits = [(bits(t), bits(t[::-1])) for _, t in self.items]
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.items):
            for at, piece in pieces(t):
                where.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def hits(self, text: str) -> dict[int, list[tuple[int, int, int]]]:
        """For each item the hits of its pieces, in order: where the item would begin, where the piece does, where it ends."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        if self.items:
            for last, (n, places) in self.automaton.iter(text):
                for k, at in places:
                    found.setdefault(k, []).append((last + 1 - n - at, last + 1 - n, last + 1))
        return {k: sorted(v) for k, v in found.items()}

    def best(self, k: int, text: str, hits: list[tuple[int, int, int]], lo: int, hi: int) -> tuple[int, int, int] | None:
        """(distance, end, start) of the best match of item k in text[lo:hi]: the least distance, of these the earliest end, of these
        the shortest. Every match has a piece unchanged, so the hits inside lead to it."""
        t, best, tried = self.items[k][1], None, set()
        m, limit = len(t), budget(t)
        step = max(1, limit)
        for begin, a, z in hits:
            if a < lo or z > hi:
                continue
            if m < SHORT:
                for start in range(max(lo, begin - limit), min(begin + limit, hi) + 1):
                    if start not in tried and edge(text, start):
                        tried.add(start)
                        found = myers(self.bits[k][0], m, text[start : min(hi, start + m + limit)], limit, True, lambda j: edge(text, start + j))  # noqa: B023
                        if found and (best is None or (found[0], start + found[1], -start) < (*best[:2], -best[2])):
                            best = (found[0], start + found[1], start)
                continue
            if begin // step in tried:
                continue
            # One window serves all hits that lie within a few characters of one diagonal.
            tried.add(begin // step)
            left = max(lo, begin - 2 * step - limit)
            found = myers(self.bits[k][0], m, text[left : min(hi, begin + m + 2 * step + limit)], limit)
            if found and (best is None or (found[0], left + found[1]) < best[:2]):
                best = (found[0], left + found[1], -1)
                if not found[0]:
                    break
        if best and best[2] < 0:
            d, end, _ = best
            back = myers(self.bits[k][1], m, text[max(lo, end - m - d) : end][::-1], d, anchored=True)
            best = (d, end, end - back[1])
        return best

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, distance) of all matches, in normalized characters: of each item the best match in the text, then those
        in what lies before and after it, so no two of an item overlap."""
        text, out = normalize(text), []
        for k, hits in self.hits(text).items():
            parts = [(0, len(text))]
            while parts:
                lo, hi = parts.pop()
                if found := self.best(k, text, hits, lo, hi):
                    d, end, start = found
                    out.append((self.items[k][0], start, end, d))
                    parts += [(lo, start), (end, hi)]
        return sorted(out)

    def evidence(self, text: str | None) -> bool:
        """Does the text hold an item that is evidence?"""
        text = normalize(text)
        return any(len(self.items[k][1]) >= self.least and self.best(k, text, hits, 0, len(text)) for k, hits in self.hits(text).items())


#: The last block's matcher, kept by a worker process between tasks.
_kept: dict[str, Matcher] = {}


def _matcher(key: str, items: list[tuple[int, str]], least: int = 0) -> Matcher:
    if key not in _kept:
        _kept.clear()
        _kept[key] = Matcher(items, least)
    return _kept[key]


def _blocks(benchmark: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about BLOCK_CHARS characters, an empty one if there is none."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("t")).where("t is not null")
    block, chars, none = [], 0, True
    for r in items.toLocalIterator():
        block.append((r.item_id, r.t))
        chars += len(r.t)
        if chars >= BLOCK_CHARS:
            yield block
            block, chars, none = [], 0, False
    if block or none:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, start, end, distance): the matches of every item in every text, within 5 % edits.

    Positions are in the normalized text (lower case, single blanks). An item's best match comes first, then the best ones before
    and after it, so its matches do not overlap; those of different items may. Items under SHORT characters begin and end
    at the edges of words. Texts and items that are null or empty, and items longer than a text and its edits, match nothing.
    Repeated rows are matched each. The items are a stated query set: they are read in blocks of about BLOCK_CHARS characters,
    one pass over the documents for each, so no block grows with the benchmark.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, start int, end int, distance int"

    def search(block: list[tuple[int, str]]) -> DataFrame:
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, shared.value)
            for b in batches:
                out = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in matcher.matches(t)]
                cols = list(zip(*out)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "start", "end", "distance"])

        return rows.mapInArrow(run, schema)

    found = [search(block) for block in _blocks(benchmark, item_id, item_text)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs without the rows whose text holds an item of least_chars characters or more, within 5 % edits.

    Shorter items, such as one word, are found by contaminated() but are no evidence against a document; short_items() tells how
    many a benchmark has. Each row is judged by
    its own text alone, whatever its id: a filter without a shuffle, one for each block of items. Null and empty texts stay.
    """
    spark, at = docs.sparkSession, docs.columns.index(text)

    def without(rows: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, shared.value, least_chars)
            for b in batches:
                yield b.filter(pa.array([not matcher.evidence(t) for t in b.column(at).to_pylist()], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    out = docs
    for block in _blocks(benchmark, item_id, item_text):
        out = without(out, block)
    return out


def short_items(benchmark: DataFrame, item_text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row (items, short): the items with a text, and those that drop_contaminated() takes for no evidence."""
    size = F.length(F.trim(F.regexp_replace(F.lower(item_text), r"\s+", " ")))
    return benchmark.where(F.length(F.trim(item_text)) > 0).agg(F.count(F.lit(1)).alias("items"), F.count_if(size < least_chars).alias("short"))
