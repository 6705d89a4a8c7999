"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text is lower-cased, white space runs become one space and a space is put on
either side; its features are hashed character n-grams of ``ORDERS``, weighted by
their share of the text's n-grams times inverse document frequency.
The weights are learned by follow-the-regularised-leader (FTRL-Proximal) under
an elastic net: the L1 part keeps most of them at zero, the L2 part the rest small.
A temperature is then fitted on examples that the weights have not seen, so that
scores are probabilities.

Document frequencies come from all rows to learn from, counted in one pass: each task adds up its own and
emits a count a feature.  The regression is fitted in one task on an executor on at most
``MAX_ROWS`` rows, a documented bound: the languages take turns, each with the rows of smallest hash of
their id, so that rare ones are in it with all they have; every fifth of them is kept for the temperature.  Only the weights that are not zero
come to the driver and go out with the scoring function, which
reads every whole text in one pass without a shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0; of equally likely languages the first in code point order is
taken; a null id counts as held out; rows that repeat are learned from and predicted as often as they come; without rows to learn from all is
``und``; with one language all is that one, with score 1; texts of any length are read
whole, a piece at a time; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import materialise, scratch, table
from granary.llm.toxicity import code_points, held_out

ORDERS = (1, 2, 3, 4)
BITS = 16
MAX_ROWS = 6_000
MIN_DOCS = 2
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.1
#: What brings values to about 1, so that one set of penalties fits.
SCALE = 10.0
#: Code points looked at at a time.
PIECE = 1 << 19
#: A table of at most so many languages is broadcast.
MOST_LANGS = 10_000
UNKNOWN = "und"
_SPACE = re.compile(r"\s+")
_MULT, _BASE = np.uint32(0x9E3779B1), np.uint32(0x01000193)


def ngram_ids(text: str | None) -> Iterator[np.ndarray]:
    """The features at the places of a text; a long text comes in pieces, which overlap by the longest n-gram less one."""
    codes = code_points(f" {_SPACE.sub(' ', (text or '').lower()).strip()} ")
    over = max(ORDERS) - 1
    for start in range(0, len(codes), PIECE):
        piece = codes[start : start + PIECE + over]
        h, found = np.zeros(len(piece), np.uint32), []
        for k in range(1, min(len(piece), max(ORDERS)) + 1):
            h = h[: len(piece) - k + 1] * _BASE + (piece[k - 1 :] + np.uint32(1))
            if k in ORDERS:
                # what starts in the overlap belongs to the next piece
                found.append(((h[:PIECE] ^ np.uint32(k * 0x7F4A7C15 & 0xFFFFFFFF)) * _MULT) >> np.uint32(32 - BITS))
        yield np.concatenate(found)


def ngram_totals(text: str | None) -> np.ndarray:
    """How often each feature comes in a text."""
    pieces = [np.bincount(ids, minlength=1 << BITS) for ids in ngram_ids(text)]
    return pieces[0] if len(pieces) == 1 else sum(pieces)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and how often each comes."""
    total = ngram_totals(text)
    found = np.flatnonzero(total)
    return found, total[found]


class Weights:
    """TF-IDF of the kept features and their weights for each language."""

    def __init__(self, langs: list[str], features: np.ndarray, idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.features, self.idf = langs, features, idf
        self.weights, self.bias, self.temperature = weights, bias, temperature

    def logits(self, texts: list[str | None]) -> np.ndarray:
        """One row a text."""
        rows = self.weights * self.idf[:, None] * SCALE
        out = np.empty((len(texts), len(self.langs)))
        for i, text in enumerate(texts):
            total = ngram_totals(text)
            out[i] = self.bias + total[self.features] @ rows / max(1, total.sum())
        return out

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each text's language and its probability."""
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(texts)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def tfidf(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and their values: share of its n-grams times inverse document frequency, scaled to numbers of about 1."""
    feature, n = ngram_counts(text)
    return feature, n / max(1, n.sum()) * idf[feature] * SCALE


def _leader(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
    """The weights that follow from the summed gradients z and squared gradients n."""
    return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_features: int, n_langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after EPOCHS passes over rows of (feature, value)."""
    z, n = np.zeros((n_features, n_langs)), np.zeros((n_features, n_langs))
    zb, nb = np.zeros(n_langs), np.zeros(n_langs)
    target = np.eye(n_langs)
    for _ in range(EPOCHS):
        for (at, value), label in zip(rows, y):
            w, b = _leader(z[at], n[at], L1), _leader(zb, nb, 0.0)
            error = softmax(value @ w + b) - target[label]
            g = value[:, None] * error
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            zb += error - (np.sqrt(nb + error * error) - np.sqrt(nb)) / ALPHA * b
            nb += error * error
    return _leader(z, n, L1), _leader(zb, nb, 0.0)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by ternary search of a function with one valley.

    Targets are smoothed as if each language had been seen once more, so that rows without an error do not make it sure of everything.
    """
    if not len(y):
        return 1.0
    n, langs = logits.shape
    target = np.full((n, langs), 1 / (n + langs))
    target[np.arange(n), y] = (n + 1) / (n + langs)

    def loss(t: float) -> float:
        return -float(np.mean(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))))

    low, high = np.log(0.05), np.log(20.0)
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(examples: Iterator[tuple[str | None, str]], idf: np.ndarray, known: np.ndarray) -> Weights:
    """Fit on (text, language) pairs in their order; known: the features to use.  Of each text only its known features are kept."""
    slot = np.full(1 << BITS, -1, np.int32)
    slot[known] = np.arange(len(known))
    rows, said = [], []
    for text, lang in examples:
        feature, value = tfidf(text, idf)
        at = slot[feature]
        rows.append((at[at >= 0], value[at >= 0]))
        said.append(lang)
    langs = sorted(set(said))
    if len(langs) < 2:
        return Weights(langs, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(langs))), np.zeros(len(langs)), 1.0)
    y = np.searchsorted(np.array(langs), said)
    kept = np.arange(len(y)) % 5 == 4
    learn = np.flatnonzero(~kept)
    w, b = ftrl([rows[i] for i in learn], y[learn], len(known), len(langs))
    logits = np.array([rows[i][1] @ w[rows[i][0]] + b for i in np.flatnonzero(kept)])
    used = np.flatnonzero(np.abs(w).sum(axis=1) > 0)
    return Weights(langs, known[used], idf[known[used]], w[used], b, temperature(logits, y[kept]))


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """How many rows of texts (text) there are, and how many hold each feature; at most 2^BITS counts come to the driver."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, mark = np.zeros(1 << BITS, np.int64), 0, np.zeros(1 << BITS, np.uint8)
        for b in batches:
            for text in b.column(0):
                mark[:] = 0
                for ids in ngram_ids(text.as_py()):
                    mark[ids] = 1
                total += mark
                rows += 1
        hit = np.flatnonzero(total)
        # feature -1 counts the rows
        yield pa.RecordBatch.from_pydict({"feature": np.append(hit, -1), "n": np.append(total[hit], rows)})

    got = texts.mapInArrow(counted, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(1 << BITS, np.int64)
    hit = got["feature"].to_numpy() >= 0
    frequency[got["feature"].to_numpy()[hit]] = got["n"].to_numpy()[hit]
    return int(got["n"].to_numpy()[~hit].sum()), frequency


def train(rows: DataFrame, max_rows: int = MAX_ROWS) -> Weights:
    """Fit on rows (id, text, lang); all of them count for the document frequencies, max_rows of them for the regression."""
    rows = rows.where("text is not null and lang is not null")
    total, frequency = document_frequencies(rows.select("text"))
    known = np.flatnonzero(frequency >= MIN_DOCS)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    # the ids to learn from are chosen first, so that only their texts are joined; of each language a hash keeps some more than
    # max_rows, so that a language of a third of all rows is no large group in the ranking
    ids = rows.select(F.col("id").alias("x_id"), "lang", F.xxhash64(F.col("id").cast("string")).alias("h"))
    sizes = ids.groupBy(F.col("lang").alias("x_lang")).agg(F.count("*").alias("size"))
    keep = F.least(F.lit(1.0), F.lit(1.2 * max_rows + 100) / F.col("size")) * 2.0**32
    ids = ids.join(F.broadcast(sizes) if sizes.count() <= MOST_LANGS else sizes, F.col("lang") == F.col("x_lang")).where(F.pmod(F.col("h"), F.lit(1 << 32)) < keep)
    ids = ids.withColumn("turn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "x_id"))).where(F.col("turn") <= max_rows)
    ids = materialise(ids.orderBy("turn", "h", "x_id", "lang").limit(max_rows).select("x_id", "h").distinct(), "lang-train")
    # max_rows ids at most: a proven bound for the broadcast
    some = rows.join(F.broadcast(ids), F.col("id") == F.col("x_id")).orderBy("h", "x_id", "lang", "text").limit(max_rows).select("text", "lang")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = fit(((t.as_py(), y.as_py()) for b in batches for t, y in zip(b.column("text"), b.column("lang"))), idf, known)
        yield pa.RecordBatch.from_pydict({"langs": [m.langs], "features": [m.features.tolist()], "weights": [m.weights.ravel().tolist()], "bias": [m.bias.tolist()], "temperature": [m.temperature]})

    got = some.repartition(1).sortWithinPartitions(F.xxhash64("text")).mapInArrow(fitted, "langs array<string>, features array<bigint>, weights array<double>, bias array<double>, temperature double").collect()
    langs, features, weights, bias, t = got[0] if got else ([], [], [], [], 1.0)
    features = np.array(features, np.int64)
    return Weights(langs, features, idf[features], np.array(weights, float).reshape(len(features), len(langs)), np.array(bias, float), t)


def identify(docs: DataFrame, model: Weights, text_col: str = "text") -> DataFrame:
    """Appends lang_pred and score to docs, which has no columns of these names."""
    at = docs.columns.index(text_col)
    names = [*docs.columns, "lang_pred", "score"]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, p = model.predict(b.column(at).to_pylist()) if model.langs else (None, np.zeros(b.num_rows))
            langs = [model.langs[i] for i in best] if model.langs else [UNKNOWN] * b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(p, pa.float64())], names=names)

    found = docs.mapInArrow(named, docs.select("*").schema.add("lang_pred", "string").add("score", "double"))
    spoken = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return found.withColumn("lang_pred", F.when(spoken, F.col("lang_pred")).otherwise(UNKNOWN)).withColumn("score", F.when(spoken, F.col("score")).otherwise(0.0))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        model = train(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang"))
    got = identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
