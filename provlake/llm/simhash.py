"""SimHash near-duplicates: 64-bit fingerprints linked at a small Hamming distance through BK-trees.

Two fingerprints within distance 2 agree on at least two of four 16-bit blocks. Each pair of blocks is one index, each of
its values a shard: a shard's BK-tree (children keyed by their Hamming distance to the parent) is built in the task that
also holds the shard's queries, which follow only edges within the radius. So no tree travels to every executor, whatever
the corpus holds. A shard above SHARD_MAX fingerprints is split by the bits that it leaves free: in three parts, of which two
fingerprints within distance 2 share one at least, so that the smaller shards link all that the large one would.

keep_one() goes further, as a corpus should not hold a text twice with a few words changed: texts whose five-word shingles have
a Jaccard similarity of 0.8 or more are linked too. Candidates are fingerprints of 13 differing bits at most (a cosine of 0.8)
of documents that share four minima in a row of their five-word shingles' hashes; a link counts only if the shingles say so,
by the least SKETCH hashes of either text: exact up to that many shingles, within about 0.025 above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, unused
from .components import components

RADIUS = 2
SHINGLE = 3
#: Similarity of near copies for keep_one(), and the distance of fingerprints that are candidates.
SIMILARITY = 0.8
NEAR = math.floor(64 / math.pi * math.acos(SIMILARITY))
#: Bins of the shingles' minima, and bins in a band: at a similarity of 0.8 one of the bands agrees in 98 of 100 pairs.
BINS, BAND = 32, 4
#: Shingle hashes in a text's sketch.
SKETCH = 256
#: Fingerprints in a shard that one BK-tree takes.
SHARD_MAX = 4096
SEED = 42


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; of the whole sequence where it is shorter; none of an empty text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    hash_ = xxhash.xxh64_intdigest
    return np.array([hash_(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], "<u8")


def majority(values: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the values; zero without values."""
    counts = np.zeros(64, "i8")
    for i in range(0, len(values), 65536):
        counts += np.unpackbits(values[i : i + 65536].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int.from_bytes(np.packbits(counts * 2 > len(values), bitorder="little").tobytes(), "little")


def simhash(text: str | None) -> int:
    """Fingerprint of one text: a bit is 1 if it is set in over half the XXH64 of the word shingles."""
    return majority(shingle_hashes(text))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def five_words(values: np.ndarray) -> np.ndarray:
    """The distinct five-word shingles' hashes in order, from the hashes of three-word shingles; of shorter texts those that there are."""
    # Words i..i+4 are the shingles at i and at i+2.
    return np.unique(_mix(values[:-2] * np.uint64(3) + values[2:]) if len(values) > 2 else values)


def sketch(five: np.ndarray) -> np.ndarray:
    """The least SKETCH hashes, their upper halves."""
    return np.unique((five[:SKETCH] >> np.uint64(32)).astype("u4"))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of shingles by their sketches."""
    both = np.sort(np.concatenate((a, b)))
    twice = both[1:] == both[:-1]
    least = both[np.concatenate(([True], ~twice))]
    if max(len(a), len(b)) < SKETCH:
        return float(twice.sum() / max(1, len(least)))
    # Only what either sketch would hold counts.
    last = least[: min(SKETCH, len(least))][-1]
    return float((both[1:][twice] <= last).sum() / (least <= last).sum())


def bands(five: np.ndarray) -> np.ndarray:
    """Keys of the bands of BAND minima over the hashes of five-word shingles; none of an empty text."""
    if not len(five):
        return np.zeros(0, "i8")
    bin_ = (five >> np.uint64(64 - int(math.log2(BINS)))).astype("i8")
    first = np.flatnonzero(np.concatenate(([True], bin_[1:] != bin_[:-1])))
    # An empty bin takes the minimum of the next that is not, marked by the distance.
    at = np.searchsorted(bin_[first], np.arange(BINS))
    source = bin_[first][at % len(first)]
    minima = _mix(five[first][at % len(first)] + ((source - np.arange(BINS)) % BINS).astype("u8"))
    odd = (np.arange(BAND, dtype="u8") * np.uint64(2) + np.uint64(3)) ** np.uint64(5)
    keys = (minima.reshape(-1, BAND) * odd).sum(1, dtype="u8")
    return _mix(keys + np.arange(BINS // BAND, dtype="u8")).view("i8")


def with_fingerprint(docs: DataFrame, text: str, out: str = "fp") -> DataFrame:
    """docs with one more column: the fingerprint of `text` as a signed 64-bit integer."""
    schema = docs.withColumn(out, F.lit(0).cast("long")).schema
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t) for t in b.column(at).to_pylist()], "u8").view("i8")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def near(self, x: int, radius: int) -> list[int]:
        """The nodes within the radius of x."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            v, children = todo.pop()
            d = (v ^ x).bit_count()
            if d <= radius:
                found.append(v)
            if len(children) > 2 * radius + 1:
                todo += [children[e] for e in range(max(0, d - radius), d + radius + 1) if e in children]
            else:
                todo += [c for e, c in children.items() if d - radius <= e <= d + radius]
        return found

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        v, children = self.root
        while (d := (v ^ x).bit_count()) and d in children:
            v, children = children[d]
        if d:
            children[d] = (x, {})


def _joined(links: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of the links those that join what no link before them has joined."""
    head, out = {}, []

    def root(v: int) -> int:
        head.setdefault(v, v)
        while head[v] != v:
            head[v] = v = head[head[v]]
        return v

    for x, y in links:
        if (a := root(x)) != (b := root(y)):
            head[a] = b
            out.append((x, y))
    return out


def shard_links(members: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join all members which a chain of steps within the radius joins: at most one for each member and group."""
    tree = BKTree()

    def near() -> Iterator[tuple[int, int]]:
        for x in members:
            yield from ((x, y) for y in tree.near(x, radius))
            tree.add(x)

    return _joined(near())


def similar_links(fps: np.ndarray, sketches: list[np.ndarray], radius: int = NEAR) -> list[tuple[int, int]]:
    """Links that join all texts which a chain of pairs within the radius and of SIMILARITY by their sketches joins.

    A text is compared with every one before it but those that it is joined with already; texts of one fingerprint are.
    """
    group, out = np.unique(fps, return_inverse=True)[1], []
    for i in range(1, len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= radius)
        near = near[group[near] != group[i]]
        while len(near):
            j, near = near[0], near[1:]
            if jaccard(sketches[i], sketches[j]) >= SIMILARITY:
                out.append((int(fps[i]), int(fps[j])))
                group[group == group[j]] = group[i]
                near = near[group[near] != group[i]]
    return out


def _shards(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """The other columns of each shard of two rows or more; rows come sorted by the first `keys` columns, a shard may go on in the next batch."""
    key, parts, n = None, [], 0
    for b in batches:
        told = list(zip(*(c.to_pylist() for c in b.columns[:keys])))
        rest = [c.to_numpy(zero_copy_only=False) for c in b.columns[keys:]]
        starts = [i for i in range(len(told)) if i == 0 or told[i] != told[i - 1]]
        for i, j in zip(starts, [*starts[1:], len(told)]):
            if told[i] != key:
                if n > 1:
                    yield [np.concatenate(c) for c in zip(*parts)]
                key, parts, n = told[i], [], 0
            parts.append([c[i:j] for c in rest])
            n += j - i
    if n > 1:
        yield [np.concatenate(c) for c in zip(*parts)]


def _link_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the shards (mask, value) of rows (mask, value, fp)."""
    yield from _links_batches(shard_links(fps.view("u8").tolist()) for (fps,) in _shards(batches, 2))


def _link_similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the shards (mask, value, low, high) of rows (mask, value, low, high, fp, sketch)."""
    yield from _links_batches(similar_links(fps.view("u8"), [np.frombuffer(h, "<u4") for h in held]) for fps, held in _shards(batches, 4))


def _links_batches(shards: Iterator[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    out = []
    for links in shards:
        out += links
        if len(out) > 50_000:
            yield _links_batch(out)
            out = []
    yield _links_batch(out)


def _links_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(links, "u8").reshape(-1, 2).view("i8")
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _thirds(mask: int) -> list[int]:
    """The mask with each third of its free bits added."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k :: RADIUS + 1]) for k in range(RADIUS + 1)]


def _linked(shards: DataFrame) -> DataFrame:
    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = shards.select("mask", "value", "fp").repartition(n, "mask", "value").sortWithinPartitions("mask", "value", "fp")
    return ordered.mapInArrow(_link_shards, "a long, b long")


def _similar(shards: DataFrame, shard_max: int) -> DataFrame:
    """Links of shards (mask, value, n rows) of rows (fp, sketch). Those above shard_max are dealt out in blocks, a task for every two of them."""
    count = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = shards.withColumn("blocks", F.ceil(F.col("n") / shard_max)).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks"))
    pairs = blocks.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).where("blocks = 1 or own <> other")
    key = ["mask", "value", "low", "high"]
    dealt = pairs.select("mask", "value", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp", "sketch")
    return dealt.repartition(count, *key).sortWithinPartitions(*key, "fp").mapInArrow(_link_similar, "a long, b long")


def near_links(fps: DataFrame, shard_max: int = SHARD_MAX) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` (one row each), enough for all components at RADIUS."""
    masks = [(0xFFFF << 16 * x) | (0xFFFF << 16 * y) for x, y in combinations(range(4), 2)]
    shard = lambda m: F.struct(F.lit(_signed(m)).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("value"))
    rows, out = fps.select("fp", F.explode(F.array(*map(shard, masks))).alias("s")).select("fp", "s.mask", "s.value"), None
    while True:
        sizes = materialize(rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shards")
        # Where no more bits are free than the radius has, all members are within it of each other.
        last = F.col("mask").isin(*(_signed(m) for m in masks if 64 - m.bit_count() <= RADIUS))
        small = rows.join(sizes.where((F.col("n") <= shard_max) | last).select("mask", "value"), ["mask", "value"], "left_semi")
        links = _linked(small)
        out = links if out is None else out.unionByName(links)
        large = sizes.where((F.col("n") > shard_max) & ~last).select("mask", "value")
        # At most six masks, and three for each of these in every further round.
        crowded = {r["mask"] for r in large.select("mask").distinct().collect()}
        if not crowded:
            return out.distinct()
        masks = sorted({t for m in masks if _signed(m) in crowded for t in _thirds(m)})
        finer = F.explode(F.filter(F.array(*(F.lit(_signed(m)).cast("long") for m in masks)), lambda m: m.bitwiseAND(F.col("mask")) == F.col("mask")))
        split = rows.join(large, ["mask", "value"], "left_semi").select("fp", finer.alias("mask"))
        rows = materialize(split.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))).distinct(), "split")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_max: int = SHARD_MAX) -> DataFrame:
    """One row (doc_id, fingerprint, component_id) for each input row.

    component_id is the smallest doc_id that a chain of fingerprints within distance 2 reaches, itself included. Null and
    empty texts have fingerprint zero and are linked like any other; repeated rows stay; a null id gets the component of
    its fingerprint, null if that holds no id. Ids are integers.
    """
    marked = with_fingerprint(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text").select("doc_id", "fp")
    marked = materialize(marked, "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(near_links(fps.select("fp"), shard_max))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = materialize(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    classes = materialize(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "classes")
    return marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, text) to (doc_id, digest, fp, bands, sketch)."""
    for b in batches:
        fps, keys, sketches = [], [], []
        for t in b.column(2).to_pylist():
            values = shingle_hashes(t)
            five = five_words(values)
            fps.append(majority(values))
            keys.append(bands(five))
            sketches.append(sketch(five).tobytes())
        ends = np.cumsum([0, *map(len, keys)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
        fps = pa.array(np.array(fps, "u8").view("i8"), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps, lists, pa.array(sketches, pa.binary())], names=["doc_id", "digest", "fp", "bands", "sketch"])


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_max: int = SHARD_MAX) -> DataFrame:
    """docs without near-duplicates: one row of each group stays.

    A group is what chains of links join: fingerprints within distance 2, and texts of SIMILARITY or more by their five-word shingles
    among documents that share a band, each compared with all others there that no link has joined it with yet. Texts of one
    fingerprint are one group, and each of them is compared. The row that stays is the one with the smallest id (null ids last), of these the one with the least hash of all its columns, so the result is
    the same in every run; of rows that are alike in every column one stays. Null and empty texts are one group. Each row is
    judged by its own text: where rows share an id but not their text, they are different documents.
    """
    (digest,) = unused(docs, "digest")
    named = docs.withColumn(digest, F.sha2(F.to_json(F.struct("*")), 256))
    rows = named.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(digest).alias("digest"), F.col(text).alias("text"))
    marked = materialize(rows.mapInArrow(_marked, "doc_id long, digest string, fp long, bands array<long>, sketch binary"), "fingerprints")
    texts = materialize(marked.groupBy("fp", "bands", "sketch").agg(F.min("digest").alias("digest")), "texts")
    shards = texts.select("digest", F.posexplode("bands").alias("mask", "value"))
    shared = materialize(shards.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    # Only texts that share a band send their sketches.
    candidates = shards.join(shared, ["mask", "value"]).join(texts.select("digest", "fp", "sketch"), "digest")
    links = near_links(texts.select("fp").distinct()).unionByName(_similar(candidates, shard_max))
    roots = components(links).withColumnRenamed("node", "fp")
    classed = marked.select("doc_id", "digest", "fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = classed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest")).alias("f"))
    kept = materialize(first.select(F.col("f.digest").alias(digest)), "kept")
    # Equal rows are put together before they are dealt out.
    return named.dropDuplicates([digest]).join(kept, digest, "left_semi").select(docs.columns)
