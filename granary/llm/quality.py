"""Quality by hierarchical empirical Bayes.

A document's own evidence is a logistic classifier over shape features of its whole
text (repetition, symbols, capitals, separators, lengths), fitted on at most
``FIT_ROWS`` labelled rows (smallest hash of their id; that bound is a parameter).

Documents of one site and of one path of a site are alike.  The classifier's
probabilities are summed by site and by (site, path), and each level's rate is
shrunk to the level above: path to site, site to the global rate.  The strength of each prior
is estimated from all documents by moments: the less sites (paths) differ beyond
chance, the more rows it takes to leave the prior, so that a sparse site stays
near it.  A document's posterior log-odds are its own plus the difference
between its path's and the global log-odds, both without its own share at every level,
so that in a site of its own it keeps what it says itself.

Only sums are grouped, with partial aggregation; rates join back to rows without texts.

The ``documents`` table has no addresses: op2 takes the source as the site and the
language as its path.

Defined results: null texts count as empty; null sites and paths are sites and
paths of their own; labels other than 0 and 1 are ignored, and of several for one
document the smallest counts; without labels of both kinds all probabilities are the share of
good labels (0.5 without any); an empty table gives no rows.  Rows that repeat an id are rated each by its
own text; texts of any length are read whole; rows of equal hash at the end of the sample go by their id, and of a labelled id that repeats any
one text is fitted on; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import materialise, scratch, table

FIT_ROWS = 4_000
L2 = 1e-3
KEEP = 0.5
FEATURES = 12


def features(text: str | None) -> list[float]:
    """What the shape of a text tells, as numbers of about unit size."""
    text = text or ""
    n = max(1, len(text))
    words = text.split()
    w = max(1, len(words))
    counts = Counter(words)
    letters = _letters(text)
    lines = text.split("\n")
    return [
        np.log1p(len(words)) / 5,
        len(counts) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w,
        max(counts.values(), default=0) / w,
        letters / n,
        text.count(" ") / n * 5,
        sum(map(str.isupper, words)) / w,
        (text.count("|") + text.count("#") + text.count("%") + text.count("$") + text.count("*") + text.count("&") + text.count("@")) / w,
        (text.count("!") + text.count("?")) / w,
        sum(map(len, words)) / w / 6,
        len(set(lines)) / len(lines),
        (text.count(",") + text.count(".")) / w * 5,
    ]


_alpha: list[np.ndarray] = []


def _letters(text: str) -> int:
    """How many characters are str.isalpha, by a table of all code points."""
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return int(np.count_nonzero(_alpha[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]))


class Model:
    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, intercept: float):
        self.mean, self.spread, self.weights, self.intercept = mean, spread, weights, intercept

    def probability(self, texts: list[str | None]) -> np.ndarray:
        x = (np.array([features(t) for t in texts]).reshape(-1, FEATURES) - self.mean) / self.spread
        z = np.hstack([x, x**2]) @ self.weights + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression on standardised features and their squares."""
    mean, spread = np.zeros(FEATURES), np.ones(FEATURES)
    share = float(y.mean()) if len(y) else 0.5
    flat = Model(mean, spread, np.zeros(2 * FEATURES), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    if not len(y) or not 0 < share < 1:
        return flat
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = (x - mean) / spread
    z = np.hstack([z, z**2])
    w, b = np.zeros(2 * FEATURES), flat.intercept
    # Newton steps with a ridge
    a = np.hstack([z, np.ones((len(z), 1))])
    ridge = np.diag([L2 * len(z)] * (2 * FEATURES) + [0.0])
    v = np.append(w, b)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -12, 12)))
        g = a.T @ (p - y) + ridge @ v
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + ridge
        step = np.linalg.solve(h, g)
        v = v - step
        if np.abs(step).max() < 1e-6:
            break
    return Model(mean, spread, v[:-1], float(v[-1]))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    half = lambda q: marks.where(F.col("quality") == q).orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(rows // 2)
    some = materialise(half(0).unionByName(half(1)), "quality-train")
    share = marks.agg(F.avg("quality")).first()[0]

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.list_(pa.float64())), "y": b.column(1).cast(pa.int32())})

    # at most FIT_ROWS ids, FEATURES numbers each
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).select("text", "quality").mapInArrow(described, "x array<double>, y int").collect()
    model = fit(np.array([r[0] for r in got]).reshape(-1, FEATURES), np.array([r[1] for r in got], float))
    if got and share and 0 < share < 1:
        sampled = float(np.mean([r[1] for r in got]))
        if 0 < sampled < 1:
            # the sample holds the two kinds evenly: back to their true odds
            model.intercept += float(np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)))
    return model


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _strength(parent: Column) -> Column:
    """Prior rows by moments over groups (n, s): rate variance beyond chance gives the beta prior's strength."""
    rate = F.col("s") / F.col("n")
    n, m = F.sum("n"), F.sum("s") / F.sum("n")
    spread = F.sum(F.col("n") * (rate - parent) ** 2)
    chance = (F.count("*") - 1) * m * (1 - m)
    variance = F.greatest(F.lit(1e-6), (spread - chance) / F.greatest(F.lit(1.0), n - F.sum(F.col("n") * F.col("n")) / n))
    return F.greatest(F.lit(1.0), F.least(F.lit(1e6), m * (1 - m) / variance - 1))


def posterior(evidence: DataFrame, keep: float = KEEP) -> DataFrame:
    """evidence: rows with site, path and p; adds site_rate, path_rate, quality and keep.

    Each row's rates are those of the other rows: its own share is taken out of its path, its site and the whole.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    paths = materialise(evidence.groupBy(F.col("site").alias("t_site"), F.col("path").alias("t_path")).agg(F.count("*").alias("n"), F.sum("p").alias("s")), "quality-paths")
    sites = materialise(paths.groupBy(F.col("t_site").alias("u_site")).agg(F.sum("n").alias("site_n"), F.sum("s").alias("site_s")), "quality-sites")
    # single rows
    rows, whole = sites.agg(F.sum("site_n"), F.sum("site_s")).first()
    rate = whole / rows if rows else 0.5
    k_site = sites.select(F.col("site_n").alias("n"), F.col("site_s").alias("s")).agg(_strength(F.lit(rate))).first()[0] or 1.0
    joined = materialise(paths.join(sites, same("t_site", "u_site")).drop("u_site"), "quality-rates")
    shrunk = (F.col("site_s") + F.lit(k_site) * F.lit(rate)) / (F.col("site_n") + F.lit(k_site))
    k_path = joined.agg(_strength(shrunk)).first()[0] or 1.0
    got = evidence.join(joined, same("site", "t_site") & same("path", "t_path"))
    own = F.col("p")
    base = (F.lit(whole) - own) / F.lit(rows - 1) if rows and rows > 1 else F.lit(0.5)
    got = got.withColumn("qb_base", base).withColumn("site_rate", (F.col("site_s") - own + F.lit(k_site) * F.col("qb_base")) / (F.col("site_n") - 1 + F.lit(k_site)))
    got = got.withColumn("path_rate", (F.col("s") - own + F.lit(k_path) * F.col("site_rate")) / (F.col("n") - 1 + F.lit(k_path)))
    got = got.withColumn("quality", 1 / (1 + F.exp(-(_logit(own) + _logit(F.col("path_rate")) - _logit(F.col("qb_base"))))))
    return got.withColumn("keep", F.col("quality") >= keep).drop("t_site", "t_path", "n", "s", "site_n", "site_s", "qb_base")


def rate_documents(docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id_col, site, path, p (its own evidence), site_rate, path_rate, quality and keep."""
    with scratch(docs.sparkSession):
        return _rated(docs, labels, site, path, id_col, text_col)


def _rated(docs: DataFrame, labels: DataFrame, site: str, path: str, id_col: str, text_col: str) -> DataFrame:
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels)
    rows = docs.select(F.col(id_col), F.col(site).cast("string").alias("site"), F.col(path).cast("string").alias("path"), F.col(text_col).alias("qb_text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = pa.array(model.probability(b.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), p], names=[id_col, "site", "path", "p"])

    schema = rows.select(id_col, "site", "path").schema.add("p", "double")
    return materialise(posterior(materialise(rows.mapInArrow(scored, schema), "quality-evidence")), "quality", keep=True)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
