"""Work that is dealt out in parts of a bounded size, and what it finds."""

import pytest

from provlake.functions import blocks
from provlake.operators import catalog, lineage


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(blocks, "PART", 10)


def test_list_check_in_small_parts(spark, small_parts):
    """100 names go to 11 parts or more; repeats and a null name count once, names on both sides not."""
    sheet = spark.createDataFrame([(f"a{i % 50}",) for i in range(60)] + [(None,)], "file string")
    folder = spark.createDataFrame([(f"a{i}",) for i in range(25, 65)], "file string")
    out = catalog.list_check(sheet, folder)
    assert out.rdd.getNumPartitions() >= 11
    assert {(r.file, r.side) for r in out.collect()} == {(f"a{i}", "sheet") for i in range(25)} | {(f"a{i}", "folder") for i in range(50, 65)} | {(None, "sheet")}
    assert out.count() == 41


def test_pick_paired_deals_out_a_common_beginning(spark, small_parts):
    """names of one beginning are dealt out in shares, and the first pair by position wins."""
    files = spark.createDataFrame([(f"ab{i}",) for i in range(200)] + [("x",)], "file string")
    pairs = spark.createDataFrame([(2, "ab", "late"), (1, "ab", "early"), (0, "ab7", "first"), (3, "c", "none")], "pos int, prefix string, to string")
    out = catalog.pick_paired(files, pairs)
    assert "_share" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.file: r.to for r in out.collect()}
    assert got == {f"ab{i}": "first" if str(i).startswith("7") else "early" for i in range(200)}


def test_components_of_long_chains(spark):
    """F8: labels of chains, of a cycle and of nodes without edges; a round's plan joins no labels of the round before."""
    nodes = spark.createDataFrame([(1, i) for i in range(40)] + [(2, i) for i in range(5)], "project_id long, node_id long")
    links = [(1, (i * 7) % 30, ((i + 1) * 7) % 30) for i in range(29)] + [(1, 30, 31), (1, 31, 32), (1, 32, 30), (2, 4, 1)]
    edges = spark.createDataFrame(links, "project_id long, src long, dst long")
    got = {(r.project_id, r.node_id): r.component for r in lineage.components(nodes, edges).collect()}
    want = {(1, i): 0 for i in range(30)} | {(1, i): 30 for i in (30, 31, 32)} | {(1, i): i for i in range(33, 40)} | {(2, i): i for i in range(4)} | {(2, 4): 1}
    assert got == want
