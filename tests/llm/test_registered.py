"""The registered queries as they are, over whole small tables, against plain Python; packing and segments against the naive methods."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_operators import check_places, ids, linked, repeated

from provlake.llm import decontam, packing, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def test_op2(spark, rows):
    assert {(r.doc_id, r.start_word, r.end_word) for r in run(spark, "op2_suffix_array_dedup")} == repeated(rows)


def test_op3(spark, rows):
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in run(spark, "op3_simhash_bk_tree")) == linked(rows)


def test_op4_and_op9(spark, rows):
    want = Counter()
    whole = {i: ids(t) for i, t in rows}
    for d, x in whole.items():
        want.update((d, k, a, len(x[a : a + 4096]), zlib.crc32(np.array(x[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(x), 4096)))
    packed = run(spark, "op9_best_fit_packing")
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    assert check_places(packed) == packed[0].n_sequences >= packed[0].bound
    parts = defaultdict(dict)
    for r in run(spark, "op4_packed_matrices"):
        m = np.frombuffer(r.input_ids, "<u2")
        for a, b, d, p in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.pieces):
            parts[d][p] = m[a:b].tolist()
    assert {d: sum((p[k] for k in sorted(p)), []) for d, p in parts.items()} == whole


def test_op6_and_op10(spark, rows):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in rows}
    toxic = run(spark, "op6_toxic_segments")
    assert {r.doc_id: r.held_out for r in toxic} == held and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in toxic)
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    told = run(spark, "op10_language_id")
    assert {r.doc_id: r.held_out for r in told} == held and all(0 <= r.score <= 1 for r in told)
    assert sum(r.lang_pred == langs[r.doc_id] for r in told if r.held_out) >= 0.95 * sum(held.values())


def test_op8(spark, rows):
    """Every item over every whole text, without pieces."""
    items = [(r.item_id, decontam.normalize(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = defaultdict(list)
    for r in run(spark, "op8_decontaminate"):
        found[r.doc_id, r.item_id].append((r.distance, r.end))
    for d, t in rows:
        text = decontam.normalize(t)
        for i, item in items:
            # A match within the budget holds at least one of these, whatever is edited.
            if item and any(p in text for _, p in decontam.pieces(item)):
                best = decontam.myers(decontam.bits(item), len(item), text, decontam.budget(item))
                assert best == min(found[d, i], default=None), (d, i)
            else:
                assert not found[d, i]


def test_best_fit_is_the_naive_one():
    rng = random.Random(8)
    for _ in range(60):
        lengths = np.array([rng.randint(1, 100) for _ in range(rng.randint(0, 150))], "i8")
        free = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [k for k, f in enumerate(free) if f >= n]
            if fits:
                free[min(fits, key=free.__getitem__)] -= n
            else:
                free.append(100 - n)
        bin_of, offset, bins = packing.best_fit_decreasing(lengths, 100)
        loads = np.bincount(bin_of, lengths, minlength=bins).astype(int) if len(lengths) else np.zeros(0, int)
        assert bins == len(free) and sorted(100 - loads) == sorted(free)
        for b in range(bins):
            mine = np.flatnonzero(bin_of == b)
            at = mine[np.argsort(offset[mine])]
            assert offset[at].tolist() == [0, *np.cumsum(lengths[at])[:-1].tolist()]


def test_all_maximal_segments_by_definition():
    """The best stretch, then those of what lies before and after it, as long as their sum is above zero."""
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 30)
        scores = [(i, rng.uniform(-1, 1)) for i in range(n) if rng.random() < 0.7]
        full = [dict(scores).get(i, toxicity.DRIFT) for i in range(n)]
        want, todo = set(), [(0, n)]
        while todo:
            lo, hi = todo.pop()
            best = max(((sum(full[a:b]), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
            if best[0] > 0:
                want.add(best[1:])
                todo += [(lo, best[1]), (best[2], hi)]
        got = toxicity.maximal_segments(scores)
        assert {(b, e) for b, e, _ in got} == want
        assert all(s == pytest.approx(sum(full[b:e])) for b, e, s in got)
