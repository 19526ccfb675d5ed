"""no link between texts of a band's shard is left out."""

import random
from itertools import combinations

import numpy as np
import pytest
from test_operators import docs, similar

from provlake.llm import simhash


def test_a_text_is_linked_with_one_that_is_linked_already():
    """The second is like the first, the third like the second alone."""
    a, b, c = (np.arange(k, k + 100, dtype="u4") for k in (0, 10, 20))
    assert simhash.jaccard(a, b) >= 0.8 > simhash.jaccard(a, c)
    links = simhash.similar_links(np.array([1, 2, 4], "u8"), [a, b, c])
    assert {frozenset(x) for x in links} == {frozenset((1, 2)), frozenset((2, 4))}


def test_texts_of_one_fingerprint_are_all_compared():
    a, b, c = (np.arange(k, k + 100, dtype="u4") for k in (0, 500, 510))
    assert simhash.similar_links(np.array([1, 1, 2], "u8"), [a, b, c]) == [(2, 1)]


@pytest.mark.parametrize("shard_max", [simhash.SHARD_MAX, 3])
def test_keep_one_joins_chains(spark, shard_max):
    """Chains of texts, each three words off the one before: groups are those of brute force over all that share a band."""
    rng, rows = random.Random(5), []
    for c in range(40):
        words = [f"c{c}w{i}" for i in range(150)]
        for k in range(6):
            rows.append((c * 10 + k, " ".join(words)))
            for i in range(3):
                words[7 + 20 * i + 3 * k + 60 * (k % 2)] = f"n{k}x{i}"
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    values = [simhash.shingle_hashes(t) for _, t in rows]
    fps, keys = [simhash.majority(v) for v in values], [set(enumerate(simhash.bands(simhash.five_words(v)).tolist())) for v in values]
    head = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        n = (fps[i] ^ fps[j]).bit_count()
        if n <= 2 or (n <= simhash.NEAR and keys[i] & keys[j] and similar(rows[i][1], rows[j][1]) >= 0.8):
            head = [head[j] if h == head[i] else h for h in head]
    want = {min(k for k, h in enumerate(head) if h == g) for g in set(head)}
    assert {r.doc_id for r in simhash.keep_one(docs(spark, rows), shard_max=shard_max).collect()} == want
