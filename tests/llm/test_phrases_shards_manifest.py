"""Phrases, shards and the manifest against plain Python on small tables with nulls, empty and long texts, ties, repeated rows and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from provlake.llm import collocations, manifest, queries, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, slot int, path string, root int, n string, pos int, grp string, row int, record int, c int, word string"


def docs(spark, rows):
    """Rows (id, text, lang); further columns clash with the operators' own names."""
    return spark.createDataFrame([(i, t, g, "s" if t else None, len(t) if t else None, "z", "x", 1, "p", 2, "n", 3, "g", 4, 5, 6, "w") for i, t, g in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    word = lambda: rng.choice(["an", "The", "ou", "ER", "st", "é", "ing", "x.y", "a,b"]) + rng.choice(["", "", "s", "q"])
    text = lambda n: rng.choice([" ", "\t", "  "]).join(word() for _ in range(n))
    passage = " ".join(f"w{i}" for i in range(40))
    out = [(i, text(rng.randint(0, 60)), rng.choice(["en", "fr", None])) for i in range(90)]
    out += [(100 + i, f"{text(3)} {passage}. {passage} {text(2)}", "en") for i in range(6)]
    out += [(200, None, "en"), (201, "", None), (202, " \n..", "de"), (200, None, "en"), (None, out[5][1], "fr"), (None, out[5][1], "fr"), (203, text(5000), "fr"), (204, "a b a b a b a b a b", ""), (3, "other text", "en")]
    return out


def phrases(rows, least, top):
    texts = defaultdict(list)
    for _, t, g in rows:
        texts["und" if g is None else g].append(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for lang, held in texts.items():
        f, n = Counter(), 0
        for w in (re.findall(r"[^\x20\x09]+", p) for t in held for p in re.split(r"[.,;:!?\x0A-\x0D]", t)):
            n += len(w)
            f.update(tuple(w[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + k] for p, a in found.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 80 * f[p[i : i + k]]}
        best = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(3, 2000), (2, 7)])
def test_phrases(spark, corpus, least, top):
    got = sorted(tuple(r) for r in collocations.collocations(docs(spark, corpus).repartition(3), least=least, top=top).collect())
    assert got == phrases(corpus, least, top) and len(got) > 15


def test_phrases_in_small_slices(spark, corpus, monkeypatch):
    """Counts of an edge meet from many slices."""
    want = phrases(corpus, 3, 2000)
    graph = lambda: collocations.Graph(docs(spark, corpus), least=3)
    held = graph()
    paths = {(r.lang, " ".join(r.words)): r.c for r in collocations.compact(held).collect()}
    assert paths["en", " ".join(f"w{i}" for i in range(40))] == 12  # forty words, 37 edges, one path
    batches = [b for b in docs(spark, corpus).select("lang", "text").toArrow().to_batches()]
    monkeypatch.setattr(collocations, "SLICE_BYTES", 200)
    total = Counter()
    for lang, found in (x for b in batches for x in collocations.slices([b])):
        for r in collocations.edges_of(lang, found).to_pylist():
            total[r["lang"], r["pair"], r["third"], r["next"]] += r["c"]
    edges = {(r.lang, r.pair, r.third, r.next): r.c for r in held.edges.collect()}
    assert edges == {k: c for k, c in total.items() if k[3] is not None and c >= 3}
    # What flows out of a node and what ends there is how often it occurs.
    flow = Counter()
    for (lang, pair, third, _), c in total.items():
        flow[lang, pair, third] += c
    assert {(r.lang, r.pair, r.third): r.c for r in held.nodes.collect()} == {k: c for k, c in flow.items() if k[2] is not None and c >= 3}
    assert want


def test_counts_of_words_follow_from_the_flow(spark, corpus):
    graph = collocations.Graph(docs(spark, corpus), least=2)
    words = Counter()
    for _, t, g in corpus:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words.update(("und" if g is None else g, w) for w in re.findall(r"[^\x20\x09]+", re.sub(r"[.,;:!?\x0A-\x0D]", " ", low)))
    assert {(r.lang, r.phrase): r.c for r in graph.singles.collect()} == {k: c for k, c in words.items() if c >= 2}
    sizes = Counter()
    for (lang, _), c in words.items():
        sizes[lang] += c
    assert {r.lang: r.n for r in graph.sizes.collect() if r.n} == sizes


def test_many_words_in_a_slice():
    """Over 2 ** 16 words pairs are numbered first; the counts are the same."""
    text = " ".join(f"u{i}" for i in range(70_000)) + " . a b c d . a b c d a b c"
    rows = collocations.edges_of("en", collocations.tokens([text])).to_pylist()
    got = {" ".join(x for x in (r["pair"], r["third"], r["next"]) if x): r["c"] for r in rows}
    assert got["a b c d"] == 2 and got["b c d a"] == 1 and got["a b c"] == 1 and got["u7 u8 u9 u10"] == 1 and len(got) == 70_000 + 5 + 5


# --- shards ---


def sharded(rows, shards=8):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards))
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    return by


def test_shards_of_documents(spark, corpus):
    table = docs(spark, corpus)
    out = sharding.shard_documents(table.repartition(3))
    assert out.columns == [*table.columns, "_shard", "_slot"]
    rows = out.select("doc_id", "text", F.col("_shard").alias("shard"), F.col("_slot").alias("slot")).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((i, t) for i, t, _ in corpus)
    size = lambda t: len((t or "").encode()) + 1
    share, most = sum(size(t) for _, t, _ in corpus) / 8, max(size(t) for _, t, _ in corpus)
    assert all(abs(sum(size(r.text) for r in v) - share) <= most for v in sharded(rows).values())


@pytest.mark.parametrize("hot", ["copies", "empty", "none", "repeats"])
def test_shards_with_a_hot_group(spark, hot):
    """A third of the rows in one group, by bytes or by rows: shares stay even, ranges small, other groups whole."""
    n = 6000
    kinds = {"copies": (n, "x" * 90), "empty": (n, ""), "none": (0, ""), "repeats": (n, "y" * 90)}
    many, text = kinds[hot]
    rows = [(i, f"text {i // 3} " * 5) for i in range(2 * n)] + [(None if hot == "repeats" else 2 * n + i, text) for i in range(many)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard_documents(table).collect()
    by, groups = sharded(got), defaultdict(set)
    sizes = [sum(len(r.text) + 1 for r in v) for _, v in sorted(by.items())]
    assert len(got) == len(rows) and max(sizes) < 1.03 * min(sizes)
    for r in got:
        groups[r.text].add(r.shard)
    split = [t for t, s in groups.items() if len(s) > 1]
    assert len(split) <= 7
    keyed = sharding.materialize(table.select(F.struct(sharding.text_group(F.col("text")).alias("g"), F.coalesce("doc_id", F.lit(-1)).alias("o"), F.monotonically_increasing_id().alias("r")).alias("_key"), sharding.text_size(F.col("text")).alias("_size")), "t")
    _, measured = sharding.splitters(keyed, 8, sum(sizes), len(rows))
    assert max(b / sum(sizes) + k / len(rows) for _, b, k in measured) / 2 <= sharding.FULL / (8 * sharding.RANGES)


def test_shards_odd_tables(spark, tmp_path):
    assert sharding.shard_documents(docs(spark, []).limit(0)).count() == 0
    one = sharding.shard_documents(docs(spark, [(1, "x", "en")])).collect()
    assert [(r["_shard"], r["_slot"]) for r in one] == [(one[0]["_shard"], 0)]
    table = spark.createDataFrame([(i, f"t{i}" * 20) for i in range(500)], "doc_id long, text string")
    sharding.write_shards(table, f"{tmp_path}/out", 3)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert {r.doc_id: r.text for r in back.collect()} == {i: f"t{i}" * 20 for i in range(500)} and len(sharded(back.collect(), 3)) == 3


# --- manifest ---


def proofs(rows, group, order, leaf):
    """(row number, path, subroot, root) by plain lists."""
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
        return out

    def path(tree, at):
        out = []
        for nodes in tree[:-1]:
            other = at ^ 1
            out.append(("<" if other < at else ">") + nodes[other] if other < len(nodes) else "=")
            at //= 2
        return out

    groups = defaultdict(list)
    for r in rows:
        groups[group(r)].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    held = {g: sorted(groups[g], key=lambda r: (order(r) is not None, order(r) or 0, leaf(r))) for g in names}
    trees = {g: levels([leaf(r) for r in held[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    for g in names:
        for i, r in enumerate(held[g]):
            yield r, path(trees[g], i) + path(top, names.index(g)), trees[g][-1][0], top[-1][0]


@pytest.mark.parametrize("bits", [2, 6])
def test_manifest(spark, corpus, bits):
    table = docs(spark, corpus)
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: h("".join(map(field, (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text))))
    want = []
    for r, path, subroot, root in proofs(table.collect(), lambda r: r.lang, lambda r: r.doc_id, leaf):
        at = leaf(r, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0)
        for s in path:
            at = h(s[1:] + at if s[0] == "<" else at + s[1:])
        want.append((r.doc_id, leaf(r), subroot, root, h("".join(s[1:] for s in path)), at, at == root))
    got = [tuple(r) for r in manifest.document_manifest(table.repartition(3), bits=bits).collect()]
    assert Counter(got) == Counter(want)
    assert {x[-1] for x in want} == {True, False}


def test_manifest_of_any_table(spark):
    """Columns with the names of the operator's own, groups of every height, a single leaf."""
    rows = [(g, i, f"{g}{i}", 7, "a") for g, n in (("a", 1), ("b", 2), ("c", 5), ("d", 16), ("e", 17), ("f", 70)) for i in range(n)]
    out = manifest.manifest(spark.createDataFrame(rows, "g string, i int, leaf string, path int, root string"), "g", "i", bits=2)
    assert out.columns == ["g", "i", "leaf", "path", "root", "_path", "subroot", "_root"]
    got = {r.leaf: (r["_path"], r.subroot, r["_root"]) for r in out.collect()}
    assert got == {r[2]: (p, s, t) for r, p, s, t in proofs(rows, lambda r: r[0], lambda r: r[1], lambda r: r[2])}
    alone = manifest.manifest(spark.createDataFrame([(None, None, "x")], "g string, i int, leaf string"), "g", "i").first()
    assert (alone.path, alone.subroot, alone.root) == ([], "x", "x")


def test_empty_tables(spark):
    empty = docs(spark, []).limit(0)
    assert collocations.collocations(empty).count() == sharding.shard_documents(empty).count() == manifest.document_manifest(empty).count() == 0


def test_registered(spark):
    """The shards' query as registered, over its whole table."""
    rows = queries.QUERIES["op12_sampled_shards"](spark, "/root/testdata/sf0.01").collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts.items()}
    sizes = [sum(r.size for r in v) for v in sharded(rows).values()]
    assert len(sizes) == 8 and max(sizes) < 1.05 * min(sizes) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
