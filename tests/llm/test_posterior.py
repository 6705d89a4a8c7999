"""The posterior against plain Python, and documents of no id in the mix."""

import math
import random

import pytest
from pyspark.sql import functions as F

from granary.llm import mixing, quality

ROWS = "doc_id long, site string, path string, p double"


def strength(groups, parents):
    """Prior rows of groups (n, s) against their parents' rates, by moments."""
    n = sum(g[0] for g in groups)
    m = sum(g[1] for g in groups) / n
    spread = sum(g[0] * (g[1] / g[0] - q) ** 2 for g, q in zip(groups, parents))
    variance = max(1e-6, (spread - (len(groups) - 1) * m * (1 - m)) / max(1.0, n - sum(g[0] ** 2 for g in groups) / n))
    return max(1.0, min(1e6, m * (1 - m) / variance - 1))


def plain(rows):
    logit = lambda p: math.log(max(1e-6, min(1 - 1e-6, p)) / (1 - max(1e-6, min(1 - 1e-6, p))))
    paths, sites = {}, {}
    for _, s, t, p in rows:
        for d, k in ((paths, (s, t)), (sites, s)):
            n, total = d.get(k, (0, 0.0))
            d[k] = n + 1, total + p
    whole = sum(r[3] for r in rows)
    rate = whole / len(rows)
    k_site = strength(list(sites.values()), [rate] * len(sites))
    above = {s: (x + k_site * rate) / (n + k_site) for s, (n, x) in sites.items()}
    k_path = strength(list(paths.values()), [above[s] for s, _ in paths])
    out = {}
    for i, s, t, p in rows:
        # all but the row itself
        base = (whole - p) / (len(rows) - 1) if len(rows) > 1 else 0.5
        site = (sites[s][1] - p + k_site * base) / (sites[s][0] - 1 + k_site)
        path = (paths[s, t][1] - p + k_path * site) / (paths[s, t][0] - 1 + k_path)
        out[i] = site, path, 1 / (1 + math.exp(-(logit(p) + logit(path) - logit(base))))
    return out


def test_posterior_is_that_of_plain_python(spark):
    rng = random.Random(3)
    bias = {s: rng.random() for s in ("a", "b", "c", "d", None)}
    rows = []
    for i in range(400):
        s = rng.choice(list(bias))
        rows.append((i, s, rng.choice(["x", "y", None]), min(1.0, max(0.0, rng.gauss(bias[s], 0.2)))))
    rows += [(400, "alone", "x", 0.99), (401, "pair", "x", 0.0), (402, "pair", "y", 1.0)]
    want = plain(rows)
    got = {r["doc_id"]: (r["site_rate"], r["path_rate"], r["quality"]) for r in quality.posterior(spark.createDataFrame(rows, ROWS)).collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_a_site_of_one_row_gets_no_evidence_twice(spark):
    rows = [(i, "big", "x", 0.5) for i in range(50)] + [(50, "alone", "x", 0.9)]
    got = {r["doc_id"]: r for r in quality.posterior(spark.createDataFrame(rows, ROWS)).collect()}
    assert got[50]["site_rate"] == pytest.approx(0.5) and got[50]["quality"] == pytest.approx(0.9)
    one = quality.posterior(spark.createDataFrame(rows[-1:], ROWS)).first()
    assert one["quality"] == pytest.approx(0.9) and quality.posterior(spark.createDataFrame([], ROWS)).count() == 0


def test_rows_of_no_id_and_of_one_id_have_keys_of_their_own(spark):
    rows = [(None, f"text number {i}", "hot") for i in range(3000)] + [(7, f"other text {i}", "hot") for i in range(3000)] + [(None, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keyed = docs.select(mixing._key(F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))), F.lit(0.5), "s").alias("k"))
    assert keyed.distinct().count() == 6001
    got = mixing.mix(docs).collect()
    taken = sum(r["taken"] for r in got if r["source"] == "hot")
    assert len(got) == 6003 and abs(taken - next(r["target"] for r in got if r["source"] == "hot")) < 1
    # of equal quality, with and without an id are drawn alike
    share = [sum(r["taken"] > r["epochs"] * r["size"] for r in got if r["source"] == "hot" and (r["doc_id"] is None) == none) for none in (True, False)]
    assert abs(share[0] - share[1]) < 250
