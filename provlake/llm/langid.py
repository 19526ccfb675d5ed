"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece, fitted by expectation
maximisation over all segmentations of its training words. A text's likelihood in a language is the product over its words
of the sum over all segmentations, by the forward algorithm. A word's likelihoods are remembered within a bound.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, held_out, unused

#: Training documents in all, about; EM rounds; words that a worker remembers; letters of a word that is scored in a batch
#: (longer ones one by one, with the same sum); words in such a batch; characters of texts whose words are looked up together.
TRAIN_DOCS, ROUNDS, WORDS_KEPT, BATCH_LETTERS, BATCH_WORDS, BLOCK_CHARS = 12_000, 2, 500_000, 256, 2048, 1 << 21
#: Pseudo-count of every piece, and probability of a character that no piece covers.
PSEUDO, UNKNOWN = 0.01, 1e-7
NONE = "und"
#: Text below this posterior is rejected by keep_known.
LEAST_SCORE = 0.5
_WORD = regex.compile(WORD)
MARK = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> dict[str, int]:
    """Numbers of the pieces that hold a letter and nothing but letters and the word mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [p for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and (p := sp.id_to_piece(i)).replace(MARK, "").isalpha() and p.rfind(MARK) <= 0]
    return {p: i for i, p in enumerate(dict.fromkeys(q for p in kept for q in (p.lower(),)))}


def same_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    """(length, places) of the words of each length, at most BATCH_WORDS at a time."""
    by_length = defaultdict(list)
    for n, w in enumerate(words):
        by_length[len(w)].append(n)
    for length, at in sorted(by_length.items()):
        for i in range(0, len(at), BATCH_WORDS):
            yield length, at[i : i + BATCH_WORDS]


class Model:
    """Piece probabilities: table[k, pieces[p]] is that of piece p in language k."""

    def __init__(self, langs: list[str], pieces: dict[str, int], table: np.ndarray, prior: np.ndarray) -> None:
        self.langs, self.prior, self.pieces = langs, prior, pieces
        # One row a piece, and a last one, that of number -1, for what is no piece.
        self.probs = np.concatenate((table.T, np.zeros((1, len(langs)))))
        self.single = np.concatenate((table.T, np.full((1, len(langs)), UNKNOWN)))  # of single characters
        with np.errstate(divide="ignore"):
            self.logs = np.log(self.probs)
        self.longest = max(map(len, pieces), default=1)
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, len(langs)))

    def edges(self, texts: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(begin, end, piece numbers) of every stretch, by end, over marked words of one length; -1 where it is no piece."""
        get, missing = self.pieces.get, len(self.pieces)
        for j in range(1, len(texts[0]) + 1):
            for i in range(max(0, j - self.longest), j):
                at = np.fromiter((get(t[i:j], missing) for t in texts), "i8", len(texts))
                if i == j - 1 or (at != missing).any():
                    yield i, j, at

    def edge_logs(self, i: int, j: int, at: np.ndarray, k: int) -> np.ndarray:
        """Log-probabilities of the edges in language k; a character that is no piece has UNKNOWN."""
        p = self.logs[at, k]
        return np.where(at == len(self.pieces), math.log(UNKNOWN), p) if j == i + 1 else p

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods of words, one row each with one value for each language: the forward algorithm, words of one length at once."""
        out = np.zeros((len(words), len(self.langs)))
        for n, at in same_length(words):
            texts = [MARK + words[x] for x in at]
            if n <= BATCH_LETTERS:
                out[at] = self.likelihoods(texts)
            else:
                for x, t in zip(at, texts):
                    out[x] = self.long_word(t)
        return out

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        """The forward algorithm over marked words of one length, with a scale taken out every 16 letters."""
        window, scale = {0: np.ones((len(texts), len(self.langs)))}, np.zeros((len(texts), len(self.langs)))
        for i, j, at in self.edges(texts):
            if j not in window:
                if j % 16 == 0:
                    window = {x: w for x, w in window.items() if x >= j - self.longest}
                    top = np.max(list(window.values()), axis=0)
                    window, scale = {x: w / top for x, w in window.items()}, scale + np.log(top)
                window[j] = np.zeros_like(scale)
            window[j] += window[i] * (self.probs if i < j - 1 else self.single)[at]
        return np.log(window[len(texts[0])]) + scale

    def long_word(self, text: str) -> np.ndarray:
        """The same for one marked word of any length, within a window of the longest piece."""
        get, unknown = self.pieces.get, np.full(len(self.langs), UNKNOWN)
        window, scale = [np.ones(len(self.langs))], np.zeros(len(self.langs))
        for j in range(1, len(text) + 1):
            total = np.zeros(len(self.langs))
            for back in range(1, len(window) + 1):
                x = get(text[j - back : j])
                if x is not None:
                    total = total + window[-back] * self.probs[x]
                elif back == 1:
                    total = total + window[-1] * unknown
            window = [*window, total][-self.longest :]
            if j % 16 == 0:
                top = np.max(window, axis=0)
                window, scale = [w / top for w in window], scale + np.log(top)
        return np.log(window[-1]) + scale

    def expected(self, words: list[str], weights: list[int], k: int) -> np.ndarray:
        """Expected piece counts in language k of words of any length, times their weights: forward and backward over all segmentations."""
        sums = np.zeros(len(self.pieces) + 1)
        for _, at in same_length(words):
            texts, weight = [MARK + words[x] for x in at], np.array([weights[x] for x in at], float)
            edges = list(self.edges(texts))
            alpha = [np.zeros(len(texts))] + [np.full(len(texts), -np.inf) for _ in texts[0]]
            beta = alpha[:0:-1] + alpha[:1]
            for i, j, x in edges:
                alpha[j] = np.logaddexp(alpha[j], alpha[i] + self.edge_logs(i, j, x, k))
            for i, j, x in reversed(edges):
                beta[i] = np.logaddexp(beta[i], beta[j] + self.edge_logs(i, j, x, k))
            for i, j, x in edges:
                share = np.exp(alpha[i] + self.edge_logs(i, j, x, k) + beta[j] - alpha[-1])
                np.add.at(sums, x, weight * share)
        return sums[:-1]  # the last are characters that are no piece

    def score_all(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """(language, posterior) of each text; (`und`, 0) where there is no letter. New words of a block of texts are scored together."""
        held, chars = [], 0
        for t in texts:
            held.append(_WORD.findall((t or "").lower()))
            chars += len(t or "")
            if chars >= BLOCK_CHARS:
                yield from self._scores(held)
                held, chars = [], 0
        yield from self._scores(held)

    def _scores(self, texts: list[list[str]]) -> Iterator[tuple[str, float]]:
        if len(self.index) > WORDS_KEPT:
            self.index.clear()
        new = list(set(chain.from_iterable(texts)).difference(self.index)) if self.langs else []
        if new:
            first = len(self.index)
            while first + len(new) > len(self.rows):
                self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
            self.rows[first : first + len(new)] = self.words(new)
            self.index.update(zip(new, range(first, first + len(new))))
        get = self.index.__getitem__
        for words in texts:
            if not words or not self.langs:
                yield NONE, 0.0
                continue
            logs = self.rows[list(map(get, words))].sum(0) + self.prior
            p = np.exp(logs - logs.max())
            k = int(p.argmax())
            yield self.langs[k], float(p[k] / p.sum())

    def score(self, text: str | None) -> tuple[str, float]:
        return next(self.score_all([text]))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None) -> Model:
    """Learn from about TRAIN_DOCS rows with a language that are not held out, an equal number of each language by a hash of the id.

    The word counts of the sample stay distributed; what comes to the driver is a table of pieces by languages, so `lang`
    must be a column of language names, not of free text. All words of the sample count, whatever their length.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    n = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    langs = list(n)
    pieces = vocabulary(path or default_path())
    if not langs:
        return Model([], pieces, np.zeros((0, len(pieces))), np.zeros(0))
    # A share of each language by a hash of the id, so that no row is sorted; about TRAIN_DOCS rows in all.
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, TRAIN_DOCS / len(langs) / v))) for k, v in n.items()))
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
    words = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).persist()
    prior = np.log(np.array([n[k] for k in langs], float) / sum(n.values()))
    # From equal probabilities of all pieces.
    model = Model(langs, pieces, np.full((len(langs), len(pieces)), 1 / len(pieces)), prior)
    names = list(pieces)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m, sums = shared.value, np.zeros((len(langs), len(names)))
            for b in batches:
                of, words_, counts = (b.column(i).to_pylist() for i in range(3))
                for k, name in enumerate(langs):
                    mine = [i for i, x in enumerate(of) if x == name]
                    if mine:
                        sums[k] += m.expected([words_[i] for i in mine], [counts[i] for i in mine], k)
            k, piece = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(sums[k, piece], pa.float64())], names=["k", "piece", "x"])

        # At most pieces x languages rows.
        sums = words.mapInArrow(expect, "k int, piece int, x double").groupBy("k", "piece").agg(F.sum("x").alias("x")).collect()
        table = np.full((len(langs), len(pieces)), PSEUDO)
        for r in sorted(sums, key=lambda r: (r.k, r.piece)):
            table[r.k, r.piece] += round(r.x, 6)
        model = Model(langs, pieces, table / table.sum(1, keepdims=True), prior)
    words.unpersist()
    return model


def with_language(docs: DataFrame, text: str, model: Model, lang_pred: str = "lang_pred", lang_score: str = "lang_score") -> DataFrame:
    """docs with two more columns: the predicted language and its posterior."""
    schema = docs.withColumns({lang_pred: F.lit(""), lang_score: F.lit(0.0)}).schema
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = list(m.score_all(b.column(at).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", path: str | None = None) -> DataFrame:
    """One row (doc_id, held_out, lang_pred, score) for each input row; the prediction looks at the text alone.

    Null texts and texts without a letter (of any script, as Unicode has it) are `und` with score 0, and so is all without a
    training row. Rows that share an id are predicted each; a null id is held out. An empty table gives an empty one.
    """
    model = fit(docs, doc_id, text, lang, path)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return with_language(rows, "text", model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the rows whose language is `und` (null texts and texts without a letter) or uncertain (posterior below LEAST_SCORE).

    Each row is judged by its own text: repeated rows stay or go together, whatever their ids. Columns and their order stay.
    """
    pred, score = unused(docs, "lang_pred", "lang_score")
    marked = with_language(docs, text, fit(docs, doc_id, text, lang), pred, score)
    return marked.where((F.col(pred) != NONE) & (F.col(score) >= LEAST_SCORE)).select(docs.columns)
