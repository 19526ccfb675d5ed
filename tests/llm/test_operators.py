"""Each corpus operator against plain Python on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from provlake.llm import decontam, langid, merkle, packing, pii, queries, secret_scan, simhash, suffix_dedup, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, blob string, path string, row long, fp string"
LABELS = "doc_id long, quality int, toxic int"


def docs(spark, rows):
    """Rows (id, text[, lang]); further columns clash with the operators' own names."""
    return spark.createDataFrame([(i, t, *(r or [None]), "s", None, "b", "p", 1, "f") for i, t, *r in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["an", "the", "ou", "er", "st", "ing"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(60)
    out = [(i, text(rng.randint(1, 120))) for i in range(60)]
    out += [(60 + i, f"{text(20)} {shared} {text(15)}") for i in range(6)]
    out += [(70, out[3][1]), (71, out[3][1] + " more"), (72, None), (73, ""), (74, "  \n"), (72, None), (None, out[5][1]), (75, text(6000)), (3, out[3][1])]
    return out


def test_empty_tables(spark):
    d = docs(spark, []).limit(0)
    labels = spark.createDataFrame([], LABELS)
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        secret_scan.scan(d, "doc_id")[0], suffix_dedup.repeated_passages(d), simhash.near_duplicates(d), packing.packed_matrices(d), merkle.fingerprint_edits(d),
        toxicity.score_toxicity(d, labels), pii.find_pii(d), decontam.contaminated(d, items), packing.pack_documents(d), langid.identify(d),
        simhash.keep_one(d), pii.redact(d), decontam.drop_contaminated(d, items), langid.keep_known(d),
    ):
        assert out.count() == 0


# --- 1 ---


def secrets(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    t = t or ""
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_secrets(spark):
    texts = [None, "", 'é token = "0123456789abcdef0123" x', "secret: token: abcdefghijklmn", "AKIAABCDEFGHIJKLMN AKIAAB", "API_KEY='abcdefghijkl' " * 700, "password=short passwd:longenough123"]
    d = docs(spark, [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[2])])
    found, ledger = secret_scan.scan(d, "doc_id")
    got = Counter((r.path, ",".join(f"{f.kind}:{f.start}:{f.end}" for f in r.findings)) for r in found.collect())
    assert got == Counter([(i, secrets(t)) for i, t in enumerate(texts)] + [(2, secrets(texts[2])), (None, secrets(texts[2]))])
    assert ledger.count() == len({t or "" for t in texts})


def test_ledger_scans_only_the_unseen(spark, tmp_path):
    first = docs(spark, [(1, "token=abcdefghijklmn"), (2, "x")])
    _, ledger = secret_scan.scan(first, "doc_id")
    versions = docs(spark, [(1, "x"), (2, "token=abcdefghijklmn"), (3, "new secret=0123456789abcd")])
    found, new = secret_scan.scan(versions, "doc_id", ledger=ledger)
    assert new.count() == 1 and {r.path: len(r.findings) for r in found.collect()} == {1: 0, 2: 1, 3: 1}
    other = (*secret_scan.RULES, secret_scan.Rule("long", "[a-z]{20,}", 0, 20))
    assert secret_scan.scan(first, "doc_id", ledger=ledger, rules=other)[1].count() == 2
    # The same against a ledger that is kept, and again, when all has been seen.
    folder = f"{tmp_path}/ledger"
    for rows, total in ((first, 2), (versions, 3), (versions, 3)):
        found = {r.path: len(r.findings) for r in secret_scan.scan_into(rows, "doc_id", folder).collect()}
        assert spark.read.parquet(folder).count() == total
    assert found == {1: 0, 2: 1, 3: 1}


def test_a_ledger_may_hold_a_blob_twice(spark):
    table = docs(spark, [(1, "token=abcdefghijklmn"), (2, "x")])
    _, ledger = secret_scan.scan(table, "doc_id")
    found, new = secret_scan.scan(table, "doc_id", ledger=ledger.unionByName(ledger))
    assert new.count() == 0 and sorted((r.path, len(r.findings)) for r in found.collect()) == [(1, 1), (2, 0)]


def test_more_secrets(spark):
    jwt = "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK"
    texts = {"pem": "é -----BEGIN RSA PRIVATE KEY-----", "jwt": f"x {jwt}", "prefixed": "ghp_" + "a1B2" * 9, "address": "see ftp://bob:pa55@host"}
    got = {r.path: [(f.kind, f.start, f.end) for f in r.findings] for r in secret_scan.scan(spark.createDataFrame(list(texts.items()), "id string, text string"), "id")[0].collect()}
    assert got == {"pem": [("pem", 2, 33)], "jwt": [("jwt", 2, 2 + len(jwt))], "prefixed": [("prefixed", 0, 40)], "address": [("address", 4, 19)]}


# --- 2 ---


def repeated(rows, least=50):
    owners, words = defaultdict(set), []
    for i, t in rows:
        w = (t or "").split()
        words.append((i, w))
        for a in range(len(w) - least + 1):
            owners[tuple(w[a : a + least])].add(i)
    out = set()
    for i, w in words:
        spans = []
        for a in range(len(w) - least + 1):
            if len(owners[tuple(w[a : a + least])]) > 1:
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = a + least
                else:
                    spans.append([a, a + least])
        out |= {(i, a, b) for a, b in spans}
    return out


def test_passages_of_rows_that_share_an_id(spark):
    """Texts without an id, or with one id, keep passages of their own: never a span over both texts' words."""
    words = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    rows = [(None, f"{words('a', 60)} {words('x', 60)}"), (None, f"{words('y', 40)} {words('b', 60)}"), (1, words("a", 60)), (2, words("b", 60)), (3, words("c", 55)), (3, f"{words('z', 9)} {words('d', 55)}"), (4, f"{words('c', 55)} {words('d', 55)}")]
    got = sorted((r.doc_id or 0, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(docs(spark, rows).repartition(3)).collect())
    assert got == [(0, 0, 60), (0, 40, 100), (1, 0, 60), (2, 0, 60), (3, 0, 55), (3, 9, 64), (4, 0, 110)]


def test_repeated_passages(spark, corpus):
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(docs(spark, corpus).repartition(5)).collect()}
    assert got == repeated(corpus) and len(got) > 6


@pytest.mark.parametrize("batch", [10_000, 40])
def test_short_matches_around_a_common_line(spark, batch):
    """Lines of 25-48 words in many documents; two of these share more words before a line, 50-60 in all."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    lines = [words(rng.randint(36, 48)) for _ in range(12)]
    texts = [[w for line in lines for w in [*words(30), *line]] + words(30) for _ in range(60)]
    for line in lines:
        passage = words(rng.randint(50, 60) - len(line)) + line
        for _ in range(2):
            texts.append(words(40) + passage + words(40))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, " ".join(words(5) + texts[60])), (None, " ".join(words(9) + texts[60]))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(docs(spark, rows).repartition(5)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # Rows without an id count as one document, and their passages are one row.
    want = {x for x in repeated(rows) if x[0] is not None}
    assert {x for x in got if x[0] is not None} == want and len(want) == 24


@pytest.mark.parametrize("partitions", [3, 23])
def test_passages_over_partition_borders(spark, partitions):
    """Few heads over many partitions: one line repeated within a document and by many rows without an id, and random sharers."""
    rng = random.Random(partitions)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    line, pool = words(60), [words(30) for _ in range(4)]
    texts = [(i, " ".join(w for _ in range(rng.randint(1, 6)) for w in [*words(rng.choice([0, 3, 9])), *rng.choice(pool), *rng.choice(pool)[: rng.randint(10, 30)]])) for i in range(60)]
    texts += [(100, " ".join(line * 40)), (101, " ".join(words(3) + line[5:58])), (102, " ".join(line[:55] + words(5)))] + [(None, " ".join(line)) for _ in range(30)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        got = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(docs(spark, texts).repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = repeated(texts)
    assert got == want and len(want) > 20


# --- 3 ---


def fingerprint(t):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(rows):
    fps = [fingerprint(t) for _, t in rows]
    head = list(range(len(rows)))

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                head[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return Counter((d, f"{fps[i]:016x}", ids[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("shard_max", [simhash.SHARD_MAX, 1])
def test_near_duplicates(spark, corpus, shard_max):
    rows = corpus + [(100 + i, " ".join(["a b c d e f g h i j k l"] * 9 + ["x%d" % (i // 3)])) for i in range(9)]
    got = simhash.near_duplicates(docs(spark, rows), shard_max=shard_max).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == linked(rows)


def test_shards_link_what_a_chain_links():
    chain = [0, 1, 3, 7, 15, 31, 0xFFF << 40]
    heads = {x: x for x in chain}
    for a, b in simhash.shard_links(chain):
        assert (a ^ b).bit_count() <= 2
        heads = {k: heads[b] if v == heads[a] else v for k, v in heads.items()}
    assert len(set(heads.values())) == 2


def similar(a, b):
    """Jaccard similarity of the five-word shingles."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in (a, b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_sketches():
    rng = random.Random(3)
    for n, change in ((100, 1), (100, 10), (200, 4), (900, 20), (900, 3), (3000, 60)):
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        other = ["new" if rng.randrange(n) < change else w for w in words]
        a, b = (simhash.sketch(simhash.five_words(simhash.shingle_hashes(" ".join(w)))) for w in (words, other))
        want = similar(" ".join(words), " ".join(other))
        assert simhash.jaccard(a, b) == pytest.approx(want, abs=1e-9 if n < 250 else 0.12)


def test_keep_one_leaves_texts_of_a_template(spark):
    """Half of the words are a template's; texts of 0.3 or so are not copies, those of one word changed are."""
    rng = random.Random(2)
    template = [f"t{i}" for i in range(60)]
    own = lambda k: [f"o{k}x{i}" for i in range(60)]
    rows = [(k, " ".join([*template, *own(k)])) for k in range(1500)]
    rows += [(5000 + k, " ".join([*template, *own(k)][:-1] + ["last"])) for k in range(0, 1500, 50)]
    rng.shuffle(rows)
    kept = {r.doc_id for r in simhash.keep_one(docs(spark, rows)).collect()}
    assert set(range(1500)) == kept


def test_keep_one(spark, corpus):
    rng = random.Random(8)
    long = [f"w{rng.randrange(900)}" for _ in range(150)]
    changed = [set(range(k, k + 3)) for k in (0, 1, 2, 3, 4, 5)]
    edited = lambda k: " ".join("new" if i in changed[k] else w for i, w in enumerate(long))
    # Rows that share an id: one text has a copy with a smaller id, the other is of its own.
    rows = corpus + [(200 + i, edited(i)) for i in range(6)] + [(302, corpus[7][1]), (305, corpus[7][1]), (305, "a text of its own " * 9), (None, "nameless text here"), (None, "nameless text here")]
    d = docs(spark, rows).withColumn("digest", F.lit("x"))
    kept = simhash.keep_one(d)
    fps = [fingerprint(t) for _, t in rows]
    keys = [set(enumerate(simhash.bands(simhash.five_words(simhash.shingle_hashes(t))).tolist())) for _, t in rows]
    head = list(range(len(rows)))

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (n := (fps[i] ^ fps[j]).bit_count()) <= 2 or (n <= simhash.NEAR and keys[i] & keys[j] and similar(rows[i][1], rows[j][1]) >= 0.8):
                head[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (k, t) in enumerate(rows):
        groups[root(i)].append((k is None, k or 0, t or ""))
    want = Counter(None if g[0] else g[1] for g in map(min, groups.values()))
    got = kept.collect()
    assert kept.columns == d.columns and Counter(r.doc_id for r in got) == want
    assert sum(r.doc_id in range(200, 206) for r in got) == 1 and [r.text for r in got if r.doc_id == 305] == ["a text of its own " * 9]


def test_large_shards_split_in_thirds():
    for m in (0xFFFFFFFF, 0xFFFF0000FFFF0000):
        parts = simhash._thirds(m)
        assert all(p & m == m for p in parts) and parts[0] | parts[1] | parts[2] == (1 << 64) - 1
        assert all((parts[i] & ~m) & (parts[j] & ~m) == 0 for i in range(3) for j in range(i))


# --- 4 and 9 ---


def ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokens.default_path()).encode(text or "", add_special_tokens=False).ids, tokens.END]


def test_word_encoder_equals_the_tokenizer():
    rng, enc = random.Random(3), tokens.encoder(tokens.default_path())
    letters = "abcXYZ 's'TÉéßäºª²½0123!?.,;<|>\n\t \x00İΣς́中日😀\x1cœŒ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    assert [a.tolist() for a in enc.encode_all(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_matrices_round_trip(spark, corpus):
    unique = {i: t for i, t in corpus if i is not None}
    rows = packing.packed_matrices(docs(spark, unique.items())).collect()
    parts = defaultdict(dict)
    for r in rows:
        m = np.frombuffer(r.input_ids, "<u2")
        assert len(m) == packing.CAPACITY and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
        for a, b, d, p in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.pieces):
            parts[d][p] = m[a:b].tolist()
    assert {d: sum((p[k] for k in sorted(p)), []) for d, p in parts.items()} == {d: ids(t) for d, t in unique.items()}


def test_packed_pieces(spark, corpus):
    rows = packing.pack_documents(docs(spark, corpus)).collect()
    want = Counter()
    for d, t in corpus:
        x = ids(t)
        want.update((d, k, a, len(x[a : a + 4096]), zlib.crc32(np.array(x[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(x), 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_places(rows)


def check_places(rows, capacity=4096):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= capacity
    return len(at)


def test_exchange_between_groups(spark):
    rng = random.Random(5)
    lengths = [rng.randint(1, 100) for _ in range(3000)]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "row long, length long")
    n = check_places(packing.pack_pieces(pieces, capacity=100, group_pieces=200).collect(), 100)
    assert n <= packing.dual_feasible_bound(np.array(lengths), 100) + 4


def test_many_groups_meet_the_bound(spark):
    """Token lengths as texts have them, many groups; then lengths that never fill a sequence, and one length alone."""
    rng = np.random.default_rng(3)
    cases = [np.clip(rng.lognormal(5.5, 1.2, 9000), 1, 4096).astype(int), rng.integers(1400, 4096, 3000), np.full(2500, 1500), np.full(10, 4096)]
    for lengths, slack in zip(cases, (1, 6, 0, 0)):
        pieces = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths.tolist())], "row long, length long, full string")
        rows = packing.pack_pieces(pieces, group_pieces=1000).collect()
        n = check_places(rows)
        assert len(rows) == len(lengths) and {(r.n_sequences, r.bound) for r in rows} == {(n, packing.dual_feasible_bound(lengths))} and n <= rows[0].bound + slack
    assert packing.pack_pieces(pieces.limit(0)).count() == 0


def test_bound_and_best_fit():
    rng = random.Random(1)
    for _ in range(60):
        x = np.array([rng.randint(1, 30) for _ in range(rng.randint(1, 9))])
        bins, offset, n = packing.best_fit_decreasing(x, 30)
        assert packing.dual_feasible_bound(x, 30) <= n and np.bincount(bins, x).max() <= 30
    assert packing.dual_feasible_bound(np.array([16, 16, 16]), 30) == 3
    assert packing.dual_feasible_bound(np.array([11] * 9), 30) == 5
    tree = packing.CapacityTree(8)
    for f in (3, 5, 8):
        tree.add(f, f)
    assert [tree.take(k) for k in (4, 4, 4, 1)] == [(5, 5), (8, 8), None, (3, 3)]


# --- 5 ---


def test_edits(spark, corpus):
    unique = sorted((i, t or "") for i, t in {i: t for i, t in corpus if i is not None}.items())
    got = {r.doc_id: r for r in merkle.fingerprint_edits(docs(spark, unique)).collect()}
    assert len(got) == len(unique)
    for k, (i, t) in enumerate(unique):
        n = len(t) // 4
        edited = t[: len(t) - n] + unique[(k + 1) % len(unique)][1][:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited) and 0 <= r.near_next <= 1 and (r.near_edited == 1) == (t == edited)
    assert got[70].fingerprint == got[3].fingerprint
    assert merkle.fingerprint_edits(docs(spark, corpus)).count() == len(corpus)


def test_difference_is_located(spark):
    a = "\n".join(f"line {i}, with some words." + "\n" * (i % 7 == 0) for i in range(40))
    at = a.index("line 20,")
    edits = [a.replace("line 20,", "line x,"), "one line before all.\n" + a, a[:at] + "two.\nlines.\n" + a[at:], a, a + " more", a[: at + 3], "", a.replace("words", "wörds")]
    rows = [(i, a, e) for i, e in enumerate(edits)] + [(8, "", "new"), (9, "", "")]
    d = merkle.with_tree(merkle.with_tree(spark.createDataFrame(rows, "i int, a string, b string"), "a", "a"), "b", "b")
    got = {r.i: r for r in merkle.with_edit_place(d, "a", "b", "a").collect()}
    assert [got[i].edit_start for i in (0, 1, 2, 3, 4, 5, 6, 8, 9)] == [at, 0, at, None, len(a), at, 0, 0, None]
    assert len(got[0].a_sections) > 5 and got[3].edit_sections == 0 and got[0].edit_sections == 1
    # An insertion changes the section that it is in, two at most, and no other.
    assert 1 <= got[1].edit_sections <= 2 and 1 <= got[2].edit_sections <= 2


def test_likeness_is_that_of_the_fingerprints(spark, corpus):
    """Computed again from the two strings; the same leaves in another order are alike, not equal."""
    rows = [(i, t) for i, t in corpus if i is not None] + [(900, "one.two.three."), (901, "two.one.three.")]
    got = {r.doc_id: r for r in merkle.fingerprint_edits(docs(spark, list({i: (i, t) for i, t in rows}.values()))).collect()}

    def like(a, b):
        (ra, _, la), (rb, _, lb) = (x.split(":") for x in (a, b))
        la, lb = (set(filter(None, x.split("."))) for x in (la, lb))
        most = max(len(la), len(lb))
        return 1.0 if ra == rb else 0.0 if not most else round(min(len(la & lb) / most, most / (most + 1)), 6)

    ids = sorted(got)
    for i, after in zip(ids, [*ids[1:], ids[0]]):
        assert got[i].near_edited == pytest.approx(like(got[i].fingerprint, got[i].edited_fingerprint), abs=1e-6)
        assert got[i].near_next == pytest.approx(like(got[i].fingerprint, got[after].fingerprint), abs=1e-6)
    assert got[900].near_next == 0.75 and got[900].fingerprint != got[901].fingerprint


# --- 6 ---


def test_segments_by_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        x = [rng.choice([-1.0, -1.0, 2.0, 1.0, -3.0]) for _ in range(rng.randint(1, 12))]
        found = toxicity.maximal_segments(list(enumerate(x)), 0.0)
        best = max((sum(x[a:b]) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=0)
        assert (max((s for *_, s in found), default=0) == pytest.approx(best)) if best > 0 else not found
        assert all(b1 <= a2 for (_, b1, _), (a2, _, _) in zip(found, found[1:]))


def test_extreme_value_parameters():
    rng = np.random.default_rng(1)
    lam, k, sizes = 0.7, 0.03, rng.integers(20, 400, 4000)
    tops = np.maximum(0, (np.log(k * sizes) - np.log(-np.log(rng.random(4000)))) / lam)
    assert toxicity.fit_k(tops, sizes, lam) == pytest.approx(k, rel=0.05)
    likelihood = lambda x: sum(np.log(x * n) - x * n * np.exp(-lam * t) if t > 0 else -x * n for t, n in zip(tops, sizes))
    best = toxicity.fit_k(tops, sizes, lam)
    assert likelihood(best) > max(likelihood(best * 0.97), likelihood(best * 1.03))
    s, w = np.array([-1.0, 2.0]), np.array([3.0, 1.0])
    x = toxicity.solve_lambda(s, w)
    assert x > 0 and (w / 4 * np.exp(x * s)).sum() == pytest.approx(1)
    assert toxicity.solve_lambda(np.array([1.0]), np.array([1.0])) == 1.0


def test_evidence_by_hand():
    scorer = toxicity.Scorer({"bad$": 3.0, "good": -1.0}, lam=1.0, k=0.1)
    text = "bad bad goodness " + "word " * 100 + "bad ½ bad"
    found = scorer.passages(text)
    assert [(b, e) for b, e, _ in found] == [(0, 2), (103, 105)]
    assert [x for *_, x in found] == pytest.approx([6 - np.log(0.1 * 105)] * 2)
    assert scorer.evidence(found) == pytest.approx(np.log(1 + 2 * np.exp(6) / 10.5)) and scorer.evidence([]) == 0


def test_toxicity(spark):
    rng = random.Random(4)
    good, bad = [f"word{chr(97 + i)}" for i in range(26)], ["vile", "scum", "trash"]
    words = [[rng.choice(good) for _ in range(40)] for _ in range(400)]
    toxic = [int(i % 4 == 0) for i in range(400)]
    for w, t in zip(words, toxic):
        if t:
            w[5:8] = rng.choices(bad, k=3)
    d = docs(spark, [(i, " ".join(w)) for i, w in enumerate(words)] + [(900, None), (901, ""), (None, "vile scum")])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(5, 1, None), (None, 1, 1)], LABELS)
    rows = toxicity.score_toxicity(d, labels).collect()
    assert len(rows) == 403 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert sum(r.predicted == toxic[r.doc_id] for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 400) / sum(r.held_out and r.doc_id is not None and r.doc_id < 400 for r in rows) > 0.95
    assert [r.predicted for r in rows if r.doc_id in (900, 901)] == [0, 0]


# --- 7 ---


def test_pii(spark):
    texts = ["a@b.c_d@e.f x", "256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0004", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567. +12", "é IBAN DE89 3704 0044 0532 0130 00 ok", None, "", "9" * 30_000, "x" * 50_000 + "@y.zz", "a@" + "b." * 9000 + "c", "1 " * 9000, "mail me: q@r.st " * 600]
    rows = pii.find_pii(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    got = [[(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.pii] for r in rows]
    assert got[0] == [("email", "a@b.c"), ("email", "_d@e.f")]
    assert got[1] == [("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("ip", "001.002.003.0004")]
    assert got[2] == [("card", "4111 1111 1111 1111")] and got[3] == [("phone", "+1 (555) 123-4567")]
    assert got[4] == [("iban", "DE89 3704 0044 0532 0130 00")] and got[5] == got[6] == got[7] == got[10] == []
    assert got[8] == [("email", texts[8])] and got[9] == [("email", texts[9])] and len(got[11]) == 600
    assert rows[11].pii[0].score > 0.9 and rows[0].pii[0].score == 0.9


def test_accounts_beside_other_tokens(spark):
    de, gb, fr = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"
    texts = [f"{de} BIC COBADEFF", f"é {de} 2024 paid", f"{de.replace(' ', '')} {gb} {fr}", f"IBAN AB12 CD34 {de}", f"{gb}X {de}1", f"{de} " + "A1 " * 40, "AB12 " * 3000]
    rows = pii.find_pii(docs(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    got = [[texts[r.doc_id][s.start : s.end] for s in r.pii if s.kind == "iban"] for r in rows]
    assert got[:6] == [[de], [de], [de.replace(" ", ""), gb, fr], [de], [], [de]]
    assert pii.redact(docs(spark, [(1, texts[1])])).first().text == "é [IBAN] 2024 paid"


def test_checksum_alone_decides_on_accounts(spark):
    d = docs(spark, [(1, "x DE89370400440532013000"), (2, "iban DE89370400440532013000")])
    score = lambda t: {r.doc_id: [s.score for s in r.pii] for r in pii.find_pii(d, threshold=t).collect()}
    assert score(0.5) == {1: [0.5], 2: [0.75]} and score(0.6) == {1: [], 2: [0.75]}


def test_accounts_and_scores_against_sql(spark, tmp_path):
    import duckdb

    from provlake.llm import oracles

    de, gb = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    texts = [f"{de} BIC COBADEFF", f"iban: {de} 2024 paid", f"{gb} {de}x", "DE88370400440532013000", f"my bank {gb}X", f"Konto\n{gb}\n4111 1111 1111 1111", "visa card 4111-1111-1111-1111, tel +1 (555) 123-4567", "host 1.2.3.4 mail a@b.cc", None, ""]
    d = docs(spark, list(enumerate(texts)) + [(None, texts[0])])
    d.select("doc_id", "text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op7_pii(spark, str(tmp_path)).toPandas()
    want = con.execute(oracles.ORACLES["op7_pii"]).df()
    rows = lambda f: sorted(map(str, f[sorted(f.columns)].fillna({"doc_id": -1}).astype({"doc_id": int}).astype(str).itertuples(index=False)))
    assert rows(got) == rows(want)
    assert [s.count("iban") for s in got.sort_values("doc_id").spans[:6]] == [1, 1, 2, 0, 0, 1]
    assert got.sort_values("doc_id").scores[1] == "0.750" and got.sort_values("doc_id").scores[6] == "0.900,0.850"


def test_redact_many_spans(spark):
    text = "".join(f"é mail a{i}@b.cc, " for i in range(700)) + "x" * 3000 + " +1 555 123 4567 end"
    d = docs(spark, [(1, text), (2, "4111 1111 1111 1111@x.yy and 1.2.3.4@b.cc")]).withColumns({"pii": F.lit("keep"), "_pii_spans": F.lit(1)})
    got = {r.doc_id: r for r in pii.redact(d).collect()}
    assert got[1].text == "é mail [EMAIL], " * 700 + "x" * 3000 + " [PHONE] end" and got[1].pii == "keep"
    assert got[2].text == "[CARD] and [IP]"


def test_redact(spark):
    d = docs(spark, [(1, "é a@b.cc, +1 555 123 4567; 4111111111111111!"), (2, None), (3, "clean"), (3, "clean")])
    out = pii.redact(d)
    assert out.columns == d.columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, "é [EMAIL], [PHONE]; [CARD]!"), (2, ""), (3, "clean"), (3, "clean")]
    assert {r.doc_id: r.text for r in out.collect()}[2] is None


# --- 8 ---


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_contaminated(spark, corpus):
    rng = random.Random(9)
    items = [(i, t[:300]) for i, t in corpus if t and len(t) > 150 and i is not None and i < 60][:5]
    rows = [r for r in corpus if not r[1] or len(r[1]) < 5000]
    for k, (i, t) in enumerate(items):
        for edits in (0, 3, 40):
            s = list(t)
            for _ in range(edits):
                s[rng.randrange(len(s))] = rng.choice("abxyz ")
            rows.append((200 + 10 * k + edits // 3, "some text. " + "".join(s).upper() + "\n end"))
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "short")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.distance) for r in decontam.contaminated(docs(spark, rows), bench).collect())
    want = Counter()
    for d, t in rows:
        for i, p in items:
            p = decontam.normalize(p)
            if (n := distance(p, decontam.normalize(t))) <= decontam.budget(p):
                want[(d, i, n)] += 1
    assert got == want and sum(want.values()) > 9
    # Rows are judged one by one, also where they share an id or have none, and whatever their columns are called.
    d = docs(spark, [*rows, (200, "clean words"), (None, items[0][1])]).withColumns({"_row": F.lit(1), "_bad": F.lit(2), "pii": F.lit(3)})
    kept = decontam.drop_contaminated(d, bench)
    texts = {t for d_, t in rows if any(distance(decontam.normalize(p), decontam.normalize(t)) <= decontam.budget(decontam.normalize(p)) for _, p in items)}
    assert kept.columns == d.columns and Counter(r.doc_id for r in kept.collect()) == Counter([d_ for d_, t in rows if t not in texts] + [200])


def test_places_of_matches_by_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        item = "".join(rng.choice("abcd ") for _ in range(60)).strip() + "z"
        edited = list(decontam.normalize(item))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(edited))
            edited[k : k + 1] = rng.choice([[], ["x"], [edited[k], "y"]])
        text = decontam.normalize("".join(rng.choice("abcd ") for _ in range(40)) + "".join(edited) + "".join(rng.choice("abcd ") for _ in range(40)))
        p = decontam.normalize(item)
        best = min(((whole(p, text[a:b]), b, b - a) for a in range(len(text)) for b in range(a + 50, min(a + 68, len(text)) + 1)), default=None)
        got = decontam.Matcher([(1, item)]).matches(text)
        assert [(d, e, e - s) for _, s, e, d in got] == ([best] if best and best[0] <= decontam.budget(p) else [])


def whole(p, t):
    row = list(range(len(t) + 1))
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_short_items(spark):
    bench = spark.createDataFrame([(1, "What is  2+2?"), (2, "cat")], "item_id long, text string")
    d = docs(spark, [(1, "so WHAT is 2+2? four"), (2, "concatenate what is 2+22"), (3, "a Cat."), (4, None), (5, "what is 2+3?")])
    got = {(r.doc_id, r.item_id, r.start, r.end, r.distance) for r in decontam.contaminated(d, bench).collect()}
    assert got == {(1, 1, 3, 15, 0), (3, 2, 2, 5, 0)}
    assert decontam.drop_contaminated(d, bench).count() == 5


def test_all_places_by_brute_force():
    """The best match, then the best ones before and after it; items on either side of SHORT, with their edits."""
    rng = random.Random(12)
    for round_ in range(40):
        n = rng.choice([22, 30, 44])
        item = " ".join("".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(n))[:n].strip() + "z"
        parts = []
        for _ in range(rng.randint(0, 3)):
            s = list(item)
            for _ in range(rng.randint(0, 2)):
                k = rng.randrange(len(s))
                s[k : k + 1] = rng.choice([[], ["x"], [s[k], "y"]])
            parts += ["".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))), "".join(s)]
        text, p = decontam.normalize(rng.choice([" ", "", ". "]).join([*parts, "end"])), decontam.normalize(item)
        limit, short, want = int(len(p) * 0.05), len(p) < 40, []
        edge = lambda i: i in (0, len(text)) or not (text[i - 1].isalnum() and text[i].isalnum())
        todo = [(0, len(text))]
        while todo:
            lo, hi = todo.pop()
            spans = ((a, b) for a in range(lo, hi) for b in range(max(a + 1, a + len(p) - limit), min(a + len(p) + limit, hi) + 1) if not short or edge(a) and edge(b))
            best = min(((whole(p, text[a:b]), b, b - a) for a, b in spans), default=None)
            if best and best[0] <= limit:
                d, b, size = best
                want.append((1, b - size, b, d))
                todo += [(lo, b - size), (b, hi)]
        assert decontam.Matcher([(1, item)]).matches(text) == sorted(want), (round_, item, text)


def test_items_of_any_length_are_evidence(spark):
    """36 characters, word for word twice or with one edit; an item longer than the text; two items on one place; a very long text."""
    item = "is a whale a fish or is it a mammal?"
    bench = spark.createDataFrame([(1, item), (2, f"so {item} it is asked"), (3, item), (4, "no text of the table is as long as this " * 20), (5, "nineteen characters")], "item_id long, text string")
    texts = [f"{item} and again: {item}", item.replace("fish", "fisk"), "nineteen characters", "a whale", None, "", f"{'other words ' * 9000}{item}"]
    d = docs(spark, list(enumerate(texts)))
    got = sorted((r.doc_id, r.item_id, r.start, r.distance) for r in decontam.contaminated(d, bench).collect())
    assert got == [(0, 1, 0, 0), (0, 1, 48, 0), (0, 3, 0, 0), (0, 3, 48, 0), (1, 1, 0, 1), (1, 3, 0, 1), (2, 5, 0, 0), (6, 1, 108_000, 0), (6, 3, 108_000, 0)]
    assert sorted(r.doc_id for r in decontam.drop_contaminated(d, bench).collect()) == [2, 3, 4, 5]
    assert sorted(r.doc_id for r in decontam.drop_contaminated(d, bench, least_chars=37).collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert decontam.short_items(bench).first() == (5, 1)


# --- 10 ---


def test_forward_sums_all_segmentations():
    pieces = {"▁a": 0, "a": 1, "b": 2, "ab": 3, "▁ab": 4, "▁": 5}
    p = np.array([[0.1, 0.2, 0.3, 0.15, 0.05, 0.2]])
    m = langid.Model(["x"], pieces, p, np.zeros(1))

    @lru_cache(None)
    def total(t):
        return 1.0 if not t else sum(p[0][i] * total(t[len(k) :]) for k, i in pieces.items() if t.startswith(k))

    got = m.words(["abab", "ab" * 90, "a", "ab" * 300])[:, 0]
    assert got == pytest.approx([np.log(total("▁" + w)) for w in ("abab", "ab" * 90, "a")] + [m.long_word("▁" + "ab" * 300)[0]])
    assert m.long_word("▁" + "ab" * 90)[0] == pytest.approx(got[1]) and m.long_word("▁abab")[0] == pytest.approx(got[0])


def test_expected_pieces_by_enumeration():
    pieces = {"▁a": 0, "a": 1, "b": 2, "ab": 3, "▁ab": 4, "▁": 5}
    p = np.array([[0.5] * 6, [0.1, 0.2, 0.3, 0.15, 0.05, 0.2]])
    m = langid.Model(["w", "x"], pieces, p, np.zeros(2))

    def ways(t):
        if not t:
            yield []
        for k in pieces:
            if t.startswith(k):
                yield from ([k, *rest] for rest in ways(t[len(k) :]))

    want = np.zeros(6)
    for word, weight in (("abab", 3), ("ba", 2), ("ab", 1)):
        found = list(ways("▁" + word))
        share = np.array([np.prod([p[1][pieces[k]] for k in w]) for w in found])
        for w, x in zip(found, share / share.sum()):
            for k in w:
                want[pieces[k]] += weight * x
    assert m.expected(["abab", "ba", "ab"], [3, 2, 1], 1) == pytest.approx(want)
    # A word of any length counts: as many letters as pieces cover.
    long = m.expected(["ab" * 200], [1], 1)
    assert (long * [2, 1, 1, 2, 3, 1]).sum() == pytest.approx(401)


def test_no_letter_is_undetermined():
    m = langid.Model(["en"], {"a": 0}, np.array([[1.0]]), np.zeros(1))
    assert [m.score(t)[0] for t in ("½ ² ¾", "123_", "", None, "ª", "中")] == ["und"] * 4 + ["en"] * 2


def test_languages(spark):
    rng = random.Random(6)
    stems = {"en": ["the", "ing", "tion", "and"], "fr": ["eau", "ment", "oui", "les"], "de": ["ung", "keit", "sch", "der"]}
    rows = [(i, " ".join(rng.choice(stems[k]) + rng.choice(stems[k]) for _ in range(30)), k) for i, k in enumerate(list(stems) * 60)]
    d = docs(spark, rows + [(500, None, "en"), (501, "123 !!", "fr"), (502, "the", None), (None, "the and", "en")])
    got = {r.doc_id: r for r in langid.identify(d).collect()}
    assert len(got) == 184 and got[500].lang_pred == got[501].lang_pred == "und" and got[502].lang_pred == "en"
    held = [i for i, _, k in rows if got[i].held_out]
    assert all(got[i].lang_pred == rows[i][2] for i in held) and all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_known(d)
    clash = d.withColumns({"lang_pred": F.lit(1), "lang_score": F.lit("x")})
    assert langid.keep_known(clash).columns == clash.columns and langid.keep_known(clash).count() == 182
    assert kept.columns == d.columns and {500, 501}.isdisjoint(r.doc_id for r in kept.collect()) and kept.count() == 182


def test_queries_are_thirteen():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
