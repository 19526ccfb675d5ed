"""Phrase collocations from a weighted de Bruijn graph over words, one graph for each language.

Nodes are the three-word phrases, edges the four-word phrases that overlap in them; an edge weighs its occurrences. Only
edges are counted over the corpus, and the last three, two and one words of every piece. Shorter counts are flows: a phrase occurs
as often as the phrases that it begins, and once more for each piece that ends with it. Chains of edges whose nodes have no other
flow are compacted to paths, which hold the counts of their inner nodes.

A first pass counts hashes of word pairs: a pair under the least count is part of no candidate, so pieces break between its words.
The others are marked in a bit table of fixed size; what it marks by mistake, or counts with another pair, costs rows, not results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Least count of a phrase, percentage of a phrase's count at which a longer one replaces it, phrases kept for each language.
LEAST, REPLACED, TOP = 30, 80, 2000
#: Bytes of texts that are counted at once, and the binary logarithm of the bits of the pair table.
SLICE_BYTES, TABLE_BITS = 1 << 23, 26
NONE = "und"
#: The contract's delimiters, all but the first mapped to it; no word holds one.
_MARK = b"."
_TABLE = bytes.maketrans(b",;:!?\n\x0b\x0c\r", _MARK * 9)
_SCHEMA = "lang string, pair string, third string, next string, c long"
_NAMES = ["lang", "pair", "third", "next", "c"]


def tokens(texts: list[str | None]) -> pa.DictionaryArray:
    """The words of all texts in a row, with a mark at every delimiter and between texts."""
    data = b" . ".join((t or "").encode("utf-8", "surrogatepass") for t in texts)
    return pa.array(data.lower().translate(_TABLE).replace(_MARK, b" . ").split(), pa.binary()).dictionary_encode()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.DictionaryArray]]:
    """(lang, tokens) of about SLICE_BYTES of texts at a time, apart by language; rows are (lang, text)."""
    held, size = {}, 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            held.setdefault(NONE if lang is None else lang, []).append(text)
            size += len(text or "")
            if size >= SLICE_BYTES:
                yield from ((k, tokens(v)) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, tokens(v)) for k, v in held.items())


def _hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], "u8")


def _mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashed words."""
    h = first * np.uint64(0x9E3779B97F4A7C15) + second
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted pair hashes (null, key, c), and each language's words (lang, null, c)."""
    for lang, found in slices(batches):
        words, ids = found.dictionary.to_pylist(), found.indices.to_numpy()
        good = np.array([w != _MARK for w in words], bool)[ids]
        at = np.flatnonzero(good[1:] & good[:-1])
        h = _hashes(lang, words)
        keys, counts = np.unique(_mixed(h[ids[at]], h[ids[at + 1]]), return_counts=True)
        langs = pa.concat_arrays([pa.array([lang], pa.string()), pa.nulls(len(keys), pa.string())])
        keys = pa.concat_arrays([pa.nulls(1, pa.int64()), pa.array(keys.view("i8"))])
        yield pa.RecordBatch.from_arrays([langs, keys, pa.array(np.append(good.sum(), counts).astype("i8"))], names=["lang", "key", "c"])


def pair_table(keys: DataFrame) -> np.ndarray:
    """A bit for each place of a (key); 2 ** TABLE_BITS bits, whatever the corpus."""
    place = F.shiftrightunsigned("key", 64 - TABLE_BITS)
    bit = F.expr("shiftleft(1L, cast(place % 32 as int))")
    found = keys.select(place.alias("place")).groupBy(F.shiftright("place", 5).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 5), "u4")
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype("u4")
    return table


def _grams(ids: np.ndarray, run: np.ndarray, size: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct phrases of four words, and phrases of 3, 2 and 1 that end a run of words: (first place, length, count).

    ids: word numbers under `most`; run: how many words of the same piece follow each place, itself included.
    """
    firsts, lengths, counts = [], [], []
    two = ids[:-1].astype("u8") * np.uint64(most) + ids[1:].astype("u8") if len(ids) > 1 else np.zeros(0, "u8")
    for n in range(size, 0, -1):
        at = np.flatnonzero(run >= n if n == size else run == n)
        if not len(at):
            continue
        if n <= 2 or most < 1 << 16:
            key = (two[at] if n > 1 else ids[at].astype("u8")) if n <= 2 else two[at]
            if n == 3:
                key = key * np.uint64(most) + ids[at + 2].astype("u8")
            elif n == 4:
                key = key * np.uint64(most) * np.uint64(most) + two[at + 2]
        else:
            # Too many words for one number: pairs are numbered first.
            _, left = np.unique(two[at], return_inverse=True)
            _, right = np.unique(two[at + n - 2], return_inverse=True)
            key = left.astype("u8") * np.uint64(len(at)) + right.astype("u8")
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        firsts.append(at[first])
        lengths.append(np.full(len(first), n))
        counts.append(count)
    if not firsts:
        return tuple(np.zeros(0, "i8") for _ in range(3))
    return np.concatenate(firsts), np.concatenate(lengths), np.concatenate(counts)


def edges_of(lang: str, found: pa.DictionaryArray, table: np.ndarray | None = None) -> pa.RecordBatch:
    """Counted edges (pair, third, next) and ends of runs, whose missing words are null; a run breaks at marks and between the words of
    an unmarked pair."""
    words, ids = found.dictionary.to_pylist(), found.indices.to_numpy()
    good = np.array([w != _MARK for w in words], bool)
    there = good[ids]
    goes_on = there[:-1] & there[1:]
    if table is not None and len(ids):
        h = _hashes(lang, words)
        place = (_mixed(h[ids[:-1]], h[ids[1:]]) >> np.uint64(64 - TABLE_BITS)).astype("i8")
        goes_on &= (table[place >> 5] >> (place & 31).astype("u4")) & 1 == 1
    # The last place of each place's run.
    ends = np.flatnonzero(~np.append(goes_on, False))
    run = np.where(there, ends[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids)) + 1, 0)
    # Numbers of the good words alone, so that four of them fit one number more often.
    number = np.cumsum(good) - 1
    firsts, lengths, counts = _grams(number[ids], run, 4, max(1, int(good.sum())))
    text = found.dictionary.cast(pa.string())
    word = lambda k: text.take(pa.array(ids[np.minimum(firsts + k, len(ids) - 1)], mask=lengths <= k))
    first, second = word(0), word(1)
    pair = pc.coalesce(pc.binary_join_element_wise(first, second, " "), first)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(firsts), pa.string()), pair, word(2), word(3), pa.array(counts.astype("i8"))], names=_NAMES)


class _Runs:
    """Sums over runs of equal keys in sorted rows; the last run waits for the rows to come."""

    def __init__(self, keys: int) -> None:
        self.keys, self.last = keys, None

    def push(self, columns: list[pa.Array], counts: np.ndarray, ended: bool = False) -> tuple[list[pa.Array], np.ndarray]:
        if self.last is not None:
            columns = [pa.concat_arrays([a, b]) for a, b in zip(self.last[0], columns)] if len(counts) else self.last[0]
            counts = np.concatenate((self.last[1], counts))
            self.last = None
        if not len(counts):
            return columns, counts
        new = np.zeros(len(counts), bool)
        new[0] = True
        for c in columns:
            a, b = c[1:], c[:-1]
            same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) & b.is_null().to_numpy(zero_copy_only=False))
            new[1:] |= ~same
        at = np.flatnonzero(new)
        sums = np.add.reduceat(counts, at)
        columns = [c.take(pa.array(at)) for c in columns]
        if not ended:
            self.last = ([c[-1:] for c in columns], sums[-1:])
            columns, sums = [c[:-1] for c in columns], sums[:-1]
        return columns, sums


def _flows(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sorted counts of edges and ends to: edges and nodes of the least count or more, and what each pair of words begins here."""
    edges, nodes, pairs = _Runs(4), _Runs(3), _Runs(2)

    def step(columns: list[pa.Array], counts: np.ndarray, ended: bool) -> Iterator[pa.RecordBatch]:
        out = []
        columns, counts = edges.push(columns, counts, ended)
        out.append((columns, counts, counts >= least, 3))
        columns, counts = nodes.push(columns[:3], counts, ended)
        out.append((columns, counts, counts >= least, 2))
        columns, counts = pairs.push(columns[:2], counts, ended)
        out.append((columns, counts, np.ones(len(counts), bool), 1))
        for columns, counts, kept, told in out:
            # Sums of rows that have no such word belong to shorter phrases.
            kept = kept & columns[told].is_valid().to_numpy(zero_copy_only=False)
            if kept.any():
                at = pa.array(np.flatnonzero(kept))
                held = [c.take(at) for c in columns]
                held += [pa.nulls(len(at), pa.string()) for _ in range(4 - len(held))]
                yield pa.RecordBatch.from_arrays([*held, pa.array(counts[kept])], names=_NAMES)

    for b in batches:
        yield from step([b.column(i) for i in range(4)], b.column(4).to_numpy(), False)
    none = [pa.array([], pa.string())] * 4
    yield from step(none, np.zeros(0, "i8"), True)


def _phrase(*columns: str) -> Column:
    return F.concat_ws(" ", *columns)


class Graph:
    """The frequent part of the graph as written tables: sizes(lang, n), the words of each language; edges(lang, pair, third, next, c),
    nodes(lang, pair, third, c), and pairs and singles (lang, phrase, c), all of the least count or more."""

    def __init__(self, docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST) -> None:
        spark = docs.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
        counted = rows.mapInArrow(_pairs, "lang string, key long, c long").groupBy("lang", "key").agg(F.sum("c").alias("c"))
        counted = materialize(counted.where((F.col("c") >= least) | F.col("key").isNull()), "pair-counts")
        self.sizes = counted.where("key is null").select("lang", F.col("c").alias("n"))
        table = spark.sparkContext.broadcast(pair_table(counted.where("key is not null")))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for k, found in slices(batches):
                yield edges_of(k, found, table.value)

        # Nodes are dealt whole, so that edges and nodes need one exchange; what a pair of words begins is summed in parts.
        dealt = rows.mapInArrow(count, _SCHEMA).repartition(n, "lang", "pair", "third").sortWithinPartitions("lang", "pair", "third", "next")
        self.flows = materialize(dealt.mapInArrow(lambda b: _flows(b, least), _SCHEMA), "flows")
        self.edges = self.flows.where("next is not null")
        self.nodes = self.flows.where("third is not null and next is null").drop("next")
        begun = self.flows.where("third is null").groupBy("lang", F.col("pair").alias("phrase")).agg(F.sum("c").alias("c"))
        begun = materialize(begun, "begun")
        # Two words hold a blank; what is one word ended a piece.
        self.pairs = begun.where((F.col("c") >= least) & F.col("phrase").contains(" "))
        singles = begun.groupBy("lang", F.substring_index("phrase", " ", 1).alias("phrase")).agg(F.sum("c").alias("c"))
        self.singles = materialize(singles.where(F.col("c") >= least), "singles")


def compact(graph: Graph) -> DataFrame:
    """Paths (lang, words, c): the edges along unary nodes as one, words in order; every edge of the graph is in one path.

    A node is unary if one edge brings all its occurrences and one edge takes them all on. No cycle is made of such nodes, as
    pieces end. A path is a stretch of one piece, so no longer than the longest text. Pointers double in each round.
    """
    edge = materialize(graph.edges.withColumn("id", F.monotonically_increasing_id()), "edges")
    second = F.substring_index("pair", " ", -1)
    into = edge.select("lang", _phrase(second, "third").alias("pair"), F.col("next").alias("third"), "c", F.col("id").alias("before"))
    unary = into.join(graph.nodes, ["lang", "pair", "third", "c"])
    found = edge.join(unary, ["lang", "pair", "third", "c"], "left").select("id", F.coalesce("before", "id").alias("at"), F.when(F.col("before").isNull(), 0).otherwise(1).alias("steps"))
    state = materialize(found, "pointers")
    while True:
        ahead = state.where("steps > 0").select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"))
        moved = state.join(ahead, "at", "left").select("id", F.coalesce("_at", "at").alias("at"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.col("_at").isNotNull().alias("went"))
        after = materialize(moved, "pointers")
        discard(state)
        if not after.where("went").head(1):
            break
        state = after.drop("went")
        state._written_at = after._written_at
    placed = edge.join(after.select("id", "at", "steps"), "id")
    word = F.struct("steps", F.when(F.col("steps") == 0, _phrase("pair", "third", "next")).otherwise(F.col("next")).alias("w"))
    grouped = placed.groupBy("lang", "at").agg(F.first("c").alias("c"), F.array_sort(F.collect_list(word)).alias("l"))
    return materialize(grouped.select("lang", F.split(F.array_join("l.w", " "), " ").alias("words"), "c"), "paths")


def _inside(words: Column, n: int, skip: int = 0) -> Column:
    """The phrases of n words within a path, but `skip` at either end."""
    last = F.size(words) - n + 1 - skip
    first = 1 + skip
    return F.when(last >= first, F.transform(F.sequence(F.lit(first), last), lambda i: F.array_join(F.slice(words, i, n), " ")))


def phrase_counts(graph: Graph, paths: DataFrame) -> DataFrame:
    """(lang, phrase, k, c) for every phrase of k = 1 to 4 words of the least count or more.

    Four words, and three at a path's inner nodes, have the path's count; other nodes their flow.
    """
    inside = lambda k, skip: paths.select("lang", F.explode(_inside(F.col("words"), k, skip)).alias("phrase"), F.lit(k).alias("k"), "c")
    inner = inside(3, 1)
    junctions = graph.nodes.select("lang", _phrase("pair", "third").alias("phrase"), F.lit(3).alias("k"), "c").join(inner.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    return inside(4, 0).unionByName(inner).unionByName(junctions).unionByName(graph.pairs.select("lang", "phrase", F.lit(2).alias("k"), "c")).unionByName(graph.singles.select("lang", "phrase", F.lit(1).alias("k"), "c"))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to 4 words.

    A null lang is `und`, a null text empty; repeated rows count each; ties are ordered by the phrase's bytes. A language without a
    phrase of the least count has no row, nor has an empty table. Other columns are ignored.
    """
    graph = Graph(docs, lang, text, least)
    counts = materialize(phrase_counts(graph, compact(graph)), "phrases")
    big = lambda c: F.col(c).cast("decimal(38,0)")
    # What a phrase holds is replaced by it if it occurs nearly as often.
    part = F.col("phrase")
    words = F.split(part, " ")
    held = F.flatten(F.array(*(F.coalesce(F.when(F.col("k") > n, _inside(words, n)), F.array().cast("array<string>")) for n in (2, 3))))
    longest = counts.where("k > 2").select("lang", F.explode(held).alias("phrase"), "c").groupBy("lang", "phrase").agg(F.max("c").alias("longer"))
    kept = counts.where("k > 1").join(longest, ["lang", "phrase"], "left").where(F.coalesce(big("longer") * 100 < big("c") * REPLACED, F.lit(True)))
    candidates = materialize(kept.select("lang", "phrase", "k", F.col("c").alias("a")), "candidates")
    # Each cut's two parts look up their counts.
    cut = lambda n: F.struct(F.lit(n).alias("cut"), F.array_join(F.slice(words, F.lit(1), F.lit(n)), " ").alias("l"), F.array_join(F.slice(words, F.lit(n + 1), F.greatest(F.col("k") - n, F.lit(0))), " ").alias("r"))
    cuts = candidates.withColumn("s", F.explode(F.filter(F.array(*(cut(n) for n in (1, 2, 3))), lambda s: s.cut < F.col("k")))).select("lang", "phrase", "a", "s.*")
    side = lambda s: counts.select("lang", F.col("phrase").alias(s), F.col("c").alias(f"f{s}"))
    looked = cuts.join(side("l"), ["lang", "l"]).join(side("r"), ["lang", "r"])
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(fl as decimal(19,0)) + fr)")
    best = looked.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", F.col("fl").alias("l"), F.col("fr").alias("r"))).alias("b"))
    order = Window.partitionBy("lang").orderBy(F.col("b.score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(graph.sizes, "lang").select("lang", "rank", "phrase", "a", "b.l", "b.r", "n", "b.score")
