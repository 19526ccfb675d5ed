"""Corpus queries with SQL against DuckDB, and the pipeline's stages, on the smallest tables."""

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from provlake.llm import oracles, queries, simhash, tokens

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want, got = con.execute(oracles.ORACLES[name]).df().astype(str), queries.QUERIES[name](spark, SF).toPandas().astype(str)
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert want[columns].sort_values(columns, ignore_index=True).equals(got[columns].sort_values(columns, ignore_index=True))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.materialize(out, name)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    assert docs.where(r"text rlike '@[a-z0-9]+[.]example'").count() == 0
    rows = corpus_pipeline.run(spark, SF).collect()
    # The ids of all pieces are those of the redacted texts, and sequences have no gap.
    enc, kept = tokens.encoder(tokens.default_path()), {r.doc_id: r.text for r in docs.collect()}
    parts, places = defaultdict(dict), defaultdict(list)
    for r in rows:
        parts[r.doc_id][r.piece] = np.frombuffer(r.input_ids, "<u2").tolist()
        places[r.sequence_id].append((r.offset, r.length))
    assert {d: sum((p[k] for k in sorted(p)), []) for d, p in parts.items()} == {d: [*enc.encode(t).tolist(), tokens.END] for d, t in kept.items()}
    for found in places.values():
        ends = np.cumsum([n for _, n in sorted(found)])
        assert [o for o, _ in sorted(found)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert rows[0].bound <= rows[0].n_sequences == len(places)


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty texts, repeated rows and extra columns whose names clash with those that the stages make."""
    odd = "doc_id long, text string, lang string, source string, n_chars long, lang_pred int, lang_score int, digest int, fp int, pii int, _row int, row int"
    word = "the word and some other words of the text, "
    rows = [(1, word * 4, "en"), (1, word * 4, "en"), (2, word * 4 + "more", "en"), (None, None, None), (3, "", "en"), (None, "der und das ist nicht wahr, " * 5, "de"), (None, "der und das ist nicht wahr, " * 5, "de"), (4, "mail a@b.cc und dann nichts mehr als das, das ist wahr", "de")]
    rows += [(i, f"{word} number {i} of a row that is another", "en") for i in range(10, 40)] + [(i, f"das ist der Text {i} und noch ein anderer, nicht wahr", "de") for i in range(40, 70)]
    docs = spark.createDataFrame([(*r, None, None, 1, 1, 1, 1, 1, 1, 1) for r in rows], odd)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, SF)
            assert name == "pack" or out.columns == docs.columns, name
            n = out.count()
            assert n == 0 if table is not docs else 0 < n <= docs.count(), name
    kept = simhash.keep_one(docs).collect()
    assert Counter(r.doc_id for r in kept)[1] == 1 and sum(r.doc_id is None for r in kept) <= 2
