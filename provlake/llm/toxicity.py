"""Toxicity: maximum-scoring segments of token log-odds.

Log-odds of tokens in toxic against other labelled texts, with an informative Dirichlet prior from all of them, score each
token: a word, or where the word is too rare to tell its longest telling beginning of 8 to 3 letters. A token that tells nothing
costs a little, so the expected score is below zero. A linear-time scan finds every maximal segment. Under the extreme-value
law for such scores, a segment of score s in a text of n tokens is met by chance K * n * exp(-lambda * s) times; lambda comes
from the distribution of scores over the clean training texts' words, K from the best segment of each clean training text. A
text's evidence is that of its significant segments together, and a logistic curve fitted on the training rows maps it to 0..1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, held_out

#: Labelled documents that the model is fitted on at most. The tokens that it keeps are those of this sample that tell.
TRAIN_DOCS = 20_000
#: Weight of the prior in tokens, least |z| of a word and of a beginning that score, score of any other token, largest score.
PRIOR, LEAST_Z, LEAST_STEM_Z, DRIFT, TOP = 5_000.0, 3.5, 5.0, -0.05, 6.0
#: A segment counts if fewer than this many are expected by chance.
E_VALUE = 1.0
#: Letters of the beginnings that stand for rare words, longest first; words that a worker remembers.
STEMS, WORDS_KEPT = (8, 7, 6, 5, 4, 3), 500_000
_TOKEN = regex.compile(WORD)


def maximal_segments(scores: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), Ruzzo and Tompa's linear scan; `scores` holds (position, score) of
    the tokens that score, and every position between costs `drift`."""
    # Each entry: cumulative sum before its start, after its end, start, end.
    stack: list[tuple[float, float, int, int]] = []
    total, last = 0.0, 0
    for at, s in scores:
        total += drift * (at - last)
        last = at + 1
        if s <= 0:
            total += s
            continue
        left, total = total, total + s
        begin = at
        while stack:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j -= 1
            if j < 0 or stack[j][1] >= total:
                break
            left, begin = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((left, total, begin, at + 1))
    return [(b, e, r - l) for l, r, b, e in stack]


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


class Scorer:
    def __init__(self, scores: dict[str, float], lam: float = 1.0, k: float = 1.0, curve: tuple[float, float] = (1.0, -3.0)) -> None:
        self.scores, self.lam, self.k, self.curve = scores, lam, k, curve
        self.seen: dict[str, float | None] = {}

    def token(self, word: str) -> float | None:
        """The score of the word itself, else of its longest beginning that scores, else None."""
        keys = [word + "$", *(word[:n] for n in STEMS if len(word) > n)]
        return next((self.scores[k] for k in keys if k in self.scores), None)

    def segments(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """All maximal segments (start, end in tokens, score) and the number of tokens."""
        words = tokens(text)
        if len(self.seen) > WORDS_KEPT:
            self.seen.clear()
        for w in set(words).difference(self.seen):
            self.seen[w] = self.token(w)
        hits = [(i, s) for i, s in enumerate(map(self.seen.get, words)) if s is not None]
        return maximal_segments(hits) if hits else [], len(words)

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Significant segments (start, end in tokens, evidence -ln E)."""
        found, n = self.segments(text)
        chance = math.log(self.k * max(n, 1))
        return [(b, e, x) for b, e, s in found if (x := self.lam * s - chance) > -math.log(E_VALUE)]

    def evidence(self, passages: list[tuple[int, int, float]]) -> float:
        """ln(1 + sum of 1/E) over the significant segments: 0 where there is none."""
        top = max((p[2] for p in passages), default=0.0)
        return top + math.log(math.exp(-top) + sum(math.exp(p[2] - top) for p in passages))

    def probability(self, evidence: float) -> float:
        x = self.curve[0] * evidence + self.curve[1]
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def solve_lambda(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(p * exp(lambda * s)) = 1, which exists if the mean is below zero and some score is above; else 1."""
    p = weights / weights.sum()
    if not len(scores) or (p * scores).sum() >= 0 or scores.max() <= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    value = lambda x: float((p * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    while value(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        lo, hi = (mid, hi) if value(mid := (lo + hi) / 2) < 0 else (lo, mid)
    return hi


def fit_k(tops: np.ndarray, sizes: np.ndarray, lam: float) -> float:
    """K by maximum likelihood from the best score (0: no segment) and the number of tokens of clean texts.

    A text's best score is below s with the probability exp(-K * n * exp(-lambda * s)), and there is none with exp(-K * n).
    """
    chance = float((sizes * np.exp(-lam * tops)).sum())
    return max(float((tops > 0).sum()), 1.0) / chance if chance > 0 else 1.0


def fit_logistic(x: np.ndarray, y: np.ndarray, weights: np.ndarray | float = 1.0) -> tuple[float, float]:
    """Slope and intercept of weighted rows by Newton's method with a small ridge; the slope is not negative."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = weights * p * (1 - p) + 1e-9
        g = np.array([(weights * (y - p) * x).sum() - 1e-2 * a, (weights * (y - p)).sum() - 1e-2 * b])
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
    return (max(a, 1e-3), b)


def training_rows(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, bound: int = TRAIN_DOCS) -> DataFrame:
    """(text, y) of at most `bound` labelled ids that are not held out, the first by a hash of the id; of rows that share an id the greatest text.

    The chosen ids number at most `bound`, so they may be broadcast: the documents are read once, and only the chosen are shuffled.
    """
    chosen = labels.where(F.col(label).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("_id", F.lit("sample")), "_id").limit(bound)
    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id").groupBy("_id", "y").agg(F.max("text").alias("text")).select("text", "y")


def token_list(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
    """Learn from the labelled rows that are not held out. Without any toxic or any clean row, every text scores the prior."""
    rows = training_rows(docs, labels, doc_id, text, label).persist()
    words = rows.select("y", F.explode(token_list("text")).alias("word")).groupBy("word").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")).persist()
    total = words.agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).first()
    pos, n = float(total["pos"] or 0), float(total["n"] or 0)
    scorer = Scorer({})
    if pos and n > pos:

        def telling(counts: DataFrame, least: float) -> DataFrame:
            """(token, odds) of the tokens with |z| of `least` or more."""
            prior = F.lit(PRIOR) * F.col("n") / n
            a, b = F.col("pos") + prior, F.col("n") - F.col("pos") + prior
            odds = F.log(a / (pos + PRIOR - a)) - F.log(b / (n - pos + PRIOR - b))
            return counts.select("token", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z")).where(F.abs("z") >= least)

        whole = telling(words.withColumnRenamed("word", "token"), LEAST_Z)
        # A beginning speaks for the words that have no score of their own.
        stems = F.array(*(F.when(F.length("word") > k, F.substring("word", 1, k)) for k in STEMS))
        rest = words.join(whole.select(F.col("token").alias("word")), "word", "left_anti")
        rest = rest.select(F.explode(F.array_compact(stems)).alias("token"), "pos", "n").groupBy("token").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
        # A share of the words of a bounded sample.
        model = whole.withColumn("token", F.concat("token", F.lit("$"))).collect() + telling(rest, LEAST_STEM_Z).collect()
        scorer = Scorer({r.token: max(-TOP, min(TOP, r.odds)) for r in model})
        shared = rows.sparkSession.sparkContext.broadcast(scorer)

        def clean_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[float, float] = {}
            for b in batches:
                for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    x = shared.value.token(w)
                    x = DRIFT if x is None else x
                    sums[x] = sums.get(x, 0.0) + c
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.float64()), pa.array(sums.values(), pa.float64())], names=["score", "n"])

        # One row for each score that the model has.
        seen = words.select("word", (F.col("n") - F.col("pos")).cast("double").alias("n")).where("n > 0").mapInArrow(clean_scores, "score double, n double")
        seen = sorted((r.score, r.n) for r in seen.groupBy("score").agg(F.sum("n").alias("n")).collect())
        scorer.lam = solve_lambda(*map(np.array, zip(*seen)))
        tops = with_evidence(rows.where("y = 0"), "text", scorer, top=True).select("top", "size").toPandas()  # TRAIN_DOCS rows at most
        scorer.k = fit_k(tops["top"].to_numpy(float), tops["size"].to_numpy(float), scorer.lam)
    seen = with_evidence(rows, "text", scorer).select("evidence", "y").toPandas()  # TRAIN_DOCS rows at most
    words.unpersist()
    rows.unpersist()
    if len(seen):
        y = seen["y"].to_numpy(float)
        # Both kinds weigh alike, so that 0.5 parts them however rare one is.
        weights = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) if 0 < y.mean() < 1 else 1.0
        scorer.curve = fit_logistic(seen["evidence"].to_numpy(float), y, weights)
    return scorer


def with_evidence(docs: DataFrame, text: str, scorer: Scorer, top: bool = False) -> DataFrame:
    """docs with `evidence`, `probability` and `n_passages` (significant segments) of their texts; with `top` instead `top`, the
    best segment's score (0 without one), and `size`, the number of tokens."""
    names = ("top", "size") if top else ("evidence", "probability", "n_passages")
    if taken := set(names).intersection(docs.columns):
        raise ValueError(f"docs has columns {taken}")
    kinds = (pa.float64(), pa.int64()) if top else (pa.float64(), pa.float64(), pa.int32())
    schema = docs.withColumns({n: F.lit(0).cast("double" if k == pa.float64() else "long" if k == pa.int64() else "int") for n, k in zip(names, kinds)}).schema
    at = docs.columns.index(text)
    # The words that a worker has looked up do not travel.
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(scorer.scores, scorer.lam, scorer.k, scorer.curve))

    def one(s: Scorer, t: str | None) -> tuple:
        if top:
            found, n = s.segments(t)
            return max((x for *_, x in found), default=0.0), n
        found = s.passages(t)
        x = s.evidence(found)
        return x, s.probability(x), len(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            more = list(zip(*(one(s, t) for t in b.column(at).to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, more, kinds)], names=schema.names)

    return docs.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row (doc_id, held_out, score, predicted, n_passages) for each input row.

    The score looks at the text alone. Null and empty texts have no evidence and get the curve's lowest score. Labels of
    held-out ids, null labels and labels without a document are not learned from; of several labels of an id the largest counts.
    """
    scorer = fit(docs, labels, doc_id, text, label)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return with_evidence(rows, "text", scorer).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("probability").alias("score"), (F.col("probability") >= 0.5).cast("int").alias("predicted"), "n_passages"
    )
