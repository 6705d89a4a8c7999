"""Near-duplicates, repeated passages and quality on whole small tables, against plain versions of the same definitions."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
from granary.llm import neardup, passages, quality

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def shingles(text, short=False):
    words = WORD.findall((text or "").lower())
    if short and 0 < len(words) < 5:
        return [tuple(words)]
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def test_classes_are_the_components_of_weighted_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sets = {r["doc_id"]: Counter(shingles(r["text"], True)) for r in docs}
    df = Counter(s for c in sets.values() for s in c)
    weight = {s: math.log1p(1 / max(n / len(sets), neardup.RARE)) for s, n in df.items()}
    holders = defaultdict(list)
    for i, c in sets.items():
        for s in c:
            holders[s].append(i)
    pairs = {(min(a, b), max(a, b)) for h in holders.values() for a in h for b in h if a != b}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = 0
    for a, b in pairs:
        x, y = sets[a], sets[b]
        low = sum(min(n, y[s]) * weight[s] for s, n in x.items() if s in y)
        whole = sum(n * weight[s] for s, n in x.items()) + sum(n * weight[s] for s, n in y.items()) - low
        if low / whole >= neardup.THRESHOLD + 1e-6:
            near += 1
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = {r["doc_id"]: r["class_id"] for r in neardup.op10_neardup(spark, SF).collect()}
    assert near and got == {i: find(i) for i in sets}


def test_every_exact_repeat_is_covered(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    spans = defaultdict(list)
    for r in passages.op4_passages(spark, SF).collect():
        spans[r["doc_id"]].append((r["start"], r["stop"]))
    held, repeats, missed = {}, 0, 0
    for i, text in docs:
        s = shingles(text)
        for at in range(len(s) - passages.LENGTH + 1):
            run = hash(tuple(s[at : at + passages.LENGTH]))
            if held.setdefault(run, i) != i:
                repeats += 1
                missed += not any(a <= at and at + passages.LENGTH + 4 <= b for a, b in spans[i])
    assert repeats and not missed


def test_near_repeats_are_found(spark):
    """Passages of 80 words with one word changed, between texts of their own."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    rows, planted = [], []
    for k in range(40):
        part = [word() for _ in range(80)]
        other = list(part)
        other[40] = word()
        around = lambda p: " ".join([*(word() for _ in range(40)), *p, *(word() for _ in range(40))])
        rows += [(2 * k, around(part)), (2 * k + 1, around(other))]
        planted.append(2 * k + 1)
    got = defaultdict(int)
    for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        if r["first_doc_id"] == r["doc_id"] - 1:
            got[r["doc_id"]] = max(got[r["doc_id"]], min(r["stop"], 120) - max(r["start"], 40))
    assert sum(got[d] >= 70 for d in planted) >= 0.9 * len(planted)


def test_quality_on_rows_it_was_not_fitted_on(spark):
    """The document classifier, fitted on half of the labelled rows, marks the other half."""
    sf = "/root/testdata/sf0.01"
    marks = spark.read.parquet(f"{sf}/labels.parquet").where("quality in (0, 1)").groupBy("doc_id").agg({"quality": "min"}).withColumnRenamed("min(quality)", "q")
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").join(marks, "doc_id").select("doc_id", "text", "q").collect())
    x, y = np.array([quality.features(r["text"]) for r in rows]), np.array([r["q"] for r in rows], float)
    model = quality.fit(x[::2], y[::2])
    told = model.probability([r["text"] for r in rows[1::2]]) >= 0.5
    assert (told == (y[1::2] == 1)).mean() >= 0.95
