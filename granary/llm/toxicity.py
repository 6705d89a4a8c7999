"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text is lower-cased, white space runs become one space and a space is put on
either side; its features are the hashed character n-grams of ``ORDERS`` that
occur in it anywhere, each counted once.  Training finds for every feature the
log ratio of its smoothed frequencies in toxic and other texts, keeps the
features that stand out, and fits a logistic regression on them with the
ratios as their values, so that rare chance features weigh little.

Training uses at most ``MAX_TOXIC`` + ``MAX_CLEAN`` labelled texts, those with
the smallest hash of their id: that bound is a parameter.  It runs in one task
on an executor; only the weights of the kept features (at most ``FEATURES``)
come to the driver and go out with the scoring function.  Every whole text is
then scored in one pass without a shuffle.

Defined results: a null text counts as empty; an empty text scores by the
intercept alone; labels that are null, or not 0 or 1, are ignored; a text with
several labels is toxic if any says so; without labels of both kinds the score
is the share of toxic labels (0 without any).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import free, materialise, scratch, table

ORDERS = (3, 4, 5, 6)
BITS = 20
FEATURES = 6_000
MAX_TOXIC, MAX_CLEAN = 3_000, 6_000
MIN_DOCS = 3
SMOOTH = 1.0
L2 = 0.05
STEPS = 150
_SPACE = re.compile(r"\s+")
_MULT = np.uint32(0x9E3779B1)
_BASE = np.uint32(0x01000193)


def normalise(text: str | None) -> str:
    return f" {_SPACE.sub(' ', (text or '').lower()).strip()} "


def ngram_ids(codes: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the feature of the n-gram that starts at each position."""
    if len(codes) < max(ORDERS):
        codes = np.concatenate([codes, np.full(max(ORDERS) - len(codes), 32, np.uint32)])
    n = len(codes)
    h = np.zeros(n, np.uint32)
    for k in range(1, max(ORDERS) + 1):
        h = h[: n - k + 1] * _BASE + (codes[k - 1 :] + np.uint32(1))
        if k in ORDERS:
            yield ((h ^ np.uint32(k * 0x7F4A7C15 & 0xFFFFFFFF)) * _MULT) >> np.uint32(32 - BITS)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def text_features(text: str | None) -> np.ndarray:
    return np.unique(np.concatenate(list(ngram_ids(code_points(normalise(text))))))


class Model:
    """Weights by feature: log-odds = intercept + the sum of weights of the features that occur."""

    def __init__(self, intercept: float, features: np.ndarray, weights: np.ndarray):
        self.intercept, self.features, self.weights = intercept, features, weights

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        slot = np.full(1 << BITS, -1, np.int32)
        slot[self.features] = np.arange(len(self.features))
        hit = slot >= 0
        out = np.full(len(texts), self.intercept)
        start = 0
        while start < len(texts):
            # about a million code points at a time
            stop, size, group = start, 0, []
            while stop < len(texts) and (not group or size < 1_000_000):
                group.append(normalise(texts[stop]))
                size += len(group[-1])
                stop += 1
            lengths = np.array([len(t) for t in group])
            ends = np.cumsum(lengths)
            codes = code_points("".join(group))
            pairs = []
            for k, ids in zip(ORDERS, ngram_ids(codes)):
                at = np.flatnonzero(hit[ids])
                doc = np.searchsorted(ends, at, side="right")
                inside = doc < len(group)
                at, doc = at[inside], doc[inside]
                inside = at + k <= ends[doc]
                pairs.append(doc[inside].astype(np.int64) * len(self.features) + slot[ids[at[inside]]])
            each = np.unique(np.concatenate(pairs)) if len(self.features) else np.zeros(0, np.int64)
            out[start:stop] += np.bincount(each // max(1, len(self.features)), self.weights[each % max(1, len(self.features))] if len(each) else None, minlength=len(group))
            start = stop
        return out


def fit(texts: Iterator[tuple[str | None, int]]) -> Model:
    """Fit on (text, label) pairs.  The texts are kept and read twice: their n-grams would take some ten times their room."""
    rows, labels = [], []
    counts = np.zeros((2, 1 << BITS), np.int32)
    for text, label in texts:
        counts[label, text_features(text)] += 1
        rows.append(text)
        labels.append(label)
    y = np.array(labels, float)
    n = np.array([len(y) - y.sum(), y.sum()])
    none = np.zeros(0, np.int64)
    if not n.all():
        share = y.mean() if len(y) else 0.0
        return Model(float(np.log((share + 1e-9) / (1 - share + 1e-9))), none, np.zeros(0))
    ratio = np.log((counts[1] + SMOOTH) / (n[1] + 2 * SMOOTH)) - np.log((counts[0] + SMOOTH) / (n[0] + 2 * SMOOTH))
    # how far the toxic count stands from what chance gives, in standard deviations
    total = counts.sum(0)
    expected = total * (n[1] / n.sum())
    spread = np.sqrt(np.maximum(expected * (n[0] / n.sum()), 1e-9))
    stands = np.where(total >= MIN_DOCS, np.abs(counts[1] - expected) / spread, 0)
    order = np.argsort(-stands, kind="stable")[:FEATURES]
    kept = np.sort(order[stands[order] > 2.5])
    if not len(kept):
        return Model(float(np.log(n[1] / n[0])), none, np.zeros(0))
    slot = np.full(1 << BITS, -1, np.int32)
    slot[kept] = np.arange(len(kept))
    cols, sizes = [], []
    for text in rows:
        s = slot[text_features(text)]
        s = s[s >= 0]
        cols.append(s)
        sizes.append(len(s))
    cols, sizes = np.concatenate(cols), np.array(sizes)
    row = np.repeat(np.arange(len(y)), sizes)
    r = ratio[kept]
    # a text holds many n-grams of one word: scale the ratios so that a typical text's squared length is 1
    r = r / np.sqrt(max(1.0, float(np.bincount(row, r[cols] ** 2, minlength=len(y)).mean())))
    x = r[cols]
    w, b = np.zeros(len(kept)), float(np.log(n[1] / n[0]))
    importance = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = b + np.bincount(row, x * w[cols], minlength=len(y))
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * importance
        g = np.bincount(cols, x * error[row], minlength=len(kept)) + L2 / len(y) * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.2 / (1 + step / 100)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-6)
    return Model(float(b), kept.astype(np.int64), w * r)


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Fit on a bounded sample of labelled rows, in one task on an executor."""
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("y"))
    some = rows.where("y = 1").orderBy("h").limit(max_toxic).unionByName(rows.where("y = 0").orderBy("h").limit(max_clean))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit((t.as_py(), y.as_py()) for b in batches for t, y in zip(b.column("text"), b.column("y")))
        yield pa.RecordBatch.from_pydict({"intercept": [model.intercept], "features": [model.features.tolist()], "weights": [model.weights.tolist()]})

    got = some.repartition(1).mapInArrow(fitted, "intercept double, features array<bigint>, weights array<double>").collect()
    return Model(got[0][0], np.array(got[0][1], np.int64), np.array(got[0][2], float)) if got else Model(-20.7, np.zeros(0, np.int64), np.zeros(0))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, name: str = "tox_score") -> DataFrame:
    """The columns keep of docs (all of them, if None) and, under the name given, which none of these may have, the score."""
    keep = docs.columns if keep is None else keep
    texts = docs.columns.index(text_col)
    kept = [docs.columns.index(c) for c in keep]
    if name in keep:
        raise ValueError(f"docs already has a column {name}")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = model.log_odds(b.column(texts).to_pylist())
            s = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), s], names=[*keep, name])

    return docs.mapInArrow(scored, docs.select(*keep).schema.add(name, "double"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled texts outside the held-out fold."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(marks.where(~held_out(F.col("doc_id"))), "doc_id")


def _sample(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    # the ids to learn from are chosen first, so that only their texts are joined
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    marks = marks.withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    some = marks.where("toxic = 1").orderBy("h").limit(MAX_TOXIC).unionByName(marks.where("toxic = 0").orderBy("h").limit(MAX_CLEAN))
    some = materialise(some.select("doc_id", "toxic"), "tox-train")
    # at most MAX_TOXIC + MAX_CLEAN ids: a proven bound for the broadcast
    return train(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with scratch(spark):
        model = _sample(spark, docs, sf_dir)
    got = score(docs, model, keep=["doc_id"])
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"))


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score under 0.5, with their own columns."""
    columns = docs.columns
    (name,) = free(docs, "tox_score")
    with scratch(spark):
        model = _sample(spark, docs, sf_dir)
    return score(docs, model, name=name).where(F.col(name) < 0.5).select(*columns)
