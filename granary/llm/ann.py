"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

Index.  The tree is fitted on a bounded sample (``FIT_ROWS`` vectors, those of
smallest hash) in one task; its leaves number about four times the square root of the
rows, ``MAX_LEAVES`` at most (the sample has some vectors for each).  Every row is then assigned to a leaf by
descending the tree.  Largest inner products become smallest distances by one
more component, sqrt(M^2 - |x|^2) with M the largest norm (0 for queries).

Search.  For each query a priority queue holds the branches of the tree by the
distance of their centres; branches are opened nearest first, which gives the order
in which the query would visit the leaves.  How many visits are made is
calibrated: ``CALIBRATION`` vectors are searched by brute force against all
rows, in blocks, and visits are widened until the mean recall of ``k``
neighbours reaches ``RECALL``.  All leaves, if need be: vectors without any clusters, as random ones in many dimensions,
have their neighbours in many leaves whatever the index.

A leaf can hold a third of all rows (copies of one vector), so leaves are cut
into blocks of about ``BLOCK`` rows by a hash of the id; a leaf that more than ``QUERIES`` queries visit is dealt out once
for each so many.  A task holds one block at a time and streams the queries that visit its leaf past it; what it keeps
is each query's best k so far, sent on when they get many.

Scores are inner products in double precision of the original vectors,
computed for the final candidates component by component, so that equal
vectors tie exactly; ties go to the smaller id.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part; neither do those whose length is not the commonest
one (the larger of equally common ones); null ids take no part; rows that
repeat an id are candidates of their own, and of a repeated query id the
smallest vector asks; no rows give no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import materialise, scratch, table

K = 20
EVERY = 20
FIT_ROWS = 50_000
MAX_LEAVES = 16_384
BRANCHES = 16
CALIBRATION = 200
RECALL = 0.92
BLOCK = 4096
QUERIES = 65_536
#: Candidates that a task keeps before it sends them on.
HELD = 2_000_000


class Tree:
    """Nodes in arrays: centres of the children of each node, and for each child a node (>= 0) or a leaf (-1 - leaf)."""

    def __init__(self, centres: list[np.ndarray], children: list[list[int]], leaves: int):
        self.centres, self.children, self.leaves = centres, children, leaves

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            near = _nearest(x[rows], self.centres[node])
            for c, child in enumerate(self.children[node]):
                mine = rows[near == c]
                if len(mine):
                    if child < 0:
                        out[mine] = -1 - child
                    else:
                        todo.append((child, mine))
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """The first leaves that a best-bin-first search from q visits."""
        if not self.centres:
            return [0]
        found, queue = [], [(0.0, 0, 0)]
        tick = 0
        while queue and len(found) < most:
            _, _, node = heapq.heappop(queue)
            while True:
                if node < 0:
                    found.append(-1 - node)
                    break
                d = ((self.centres[node] - q) ** 2).sum(1)
                order = np.argsort(d, kind="stable")
                for c in order[1:]:
                    tick += 1
                    heapq.heappush(queue, (float(d[c]), tick, self.children[node][c]))
                node = self.children[node][order[0]]
        return found


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(1) - 2 * (x @ centres.T), axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(8):
        near = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def fit_tree(x: np.ndarray, leaves: int, seed: int = 7) -> Tree:
    rng = np.random.default_rng(seed)
    centres, children, count = [], [], 0
    share = max(1, len(x) / max(1, leaves))

    def grow(rows: np.ndarray) -> int:
        nonlocal count
        k = int(min(BRANCHES, np.ceil(len(rows) / share), len(rows)))
        if k >= 2:
            c = _kmeans(x[rows], k, rng)
            near = _nearest(x[rows], c)
            used = [i for i in range(k) if (near == i).any()]
            if len(used) >= 2:
                node = len(centres)
                centres.append(c[used])
                children.append([])
                children[node] = [grow(rows[near == i]) for i in used]
                return node
        count += 1
        return -count

    root = grow(np.arange(len(x)))
    return Tree(centres, children, count) if root >= 0 else Tree([], [], 1)


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """av_id and av_vec (array<double>) of the vectors that take part."""
    bad = F.exists("av_vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    got = rows.select(F.col(id_col).cast("long").alias("av_id"), F.col(vec_col).cast("array<double>").alias("av_vec")).where(F.col("av_id").isNotNull() & F.col("av_vec").isNotNull())
    got = got.where(~bad & F.exists("av_vec", lambda v: v != 0))
    common = got.groupBy(F.size("av_vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return got.where(F.size("av_vec") == (common[0] if common else 0))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _top(queries: np.ndarray, qids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, own: bool = False) -> pd.DataFrame:
    """For each query its k best rows of this block; own: a query's own id counts too."""
    out = []
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    for lo in range(0, len(qids), 256):
        q, qid = queries[lo : lo + 256], qids[lo : lo + 256]
        rough = q @ vectors.T
        if not own:
            rough[qid[:, None] == ids[None, :]] = -np.inf
        keep = min(k, len(ids))
        level = np.partition(rough, len(ids) - keep, axis=1)[:, len(ids) - keep]
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(level), level, 0)))
        row, col = np.nonzero((rough >= (level - slack)[:, None]) & np.isfinite(rough))
        exact = (q[row] * vectors[col]).sum(1) if len(row) < 1_000_000 else np.concatenate([(q[row[i : i + 65536]] * vectors[col[i : i + 65536]]).sum(1) for i in range(0, len(row), 65536)])
        by = np.lexsort((col, -exact, row))
        row, col, exact = row[by], col[by], exact[by]
        first = np.searchsorted(row, np.arange(len(qid)))
        best = np.arange(len(row)) - first[row] < k
        out.append(pd.DataFrame({"query_id": qid[row[best]], "vec_id": ids[col[best]], "score": exact[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})


PAIRS = "query_id long, vec_id long, score double"


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query; partial lists first, so that no task sees more than k rows of a block."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _kept(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The k best of each query."""
    all_ = pd.concat(found)
    q, v, score = (all_[c].to_numpy() for c in ("query_id", "vec_id", "score"))
    by = np.lexsort((v, -score, q))
    q = q[by]
    first = np.searchsorted(q, q)
    by = by[np.arange(len(q)) - first < k]
    return all_.iloc[by]


def _streamed(k: int):
    """From rows (leaf, block, part, asks, id, vec), sorted: the best k of each query among the blocks of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, found, rows = None, [], [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy() for i in range(3)], 1)
            asks, own = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy()
            x = b.column(5).flatten().to_numpy().reshape(b.num_rows, -1)
            edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]]))
            for lo, hi in zip(edges[:-1], edges[1:]):
                if key is None or (keys[lo] != key).any():
                    key, ids, vectors = keys[lo], [], []
                cut = lo + int(np.searchsorted(asks[lo:hi], True))
                if cut > lo:
                    ids.append(own[lo:cut])
                    vectors.append(x[lo:cut])
                if cut < hi and ids:
                    ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    found.append(_top(x[cut:hi], own[cut:hi], vectors[0], ids[0], k))
                    rows += len(found[-1])
                if rows > HELD:
                    found = [_kept(found, k)]
                    rows = len(found[0])
                    if rows > HELD / 2:
                        yield pa.RecordBatch.from_pandas(found[0], preserve_index=False)
                        found, rows = [], 0
        if found:
            yield pa.RecordBatch.from_pandas(_kept(found, k), preserve_index=False)

    return run


def search(rows: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of each row whose id is divisible by every."""
    with scratch(rows.sparkSession):
        return materialise(_search(rows, k, every, id_col, vec_col, recall), "ann-nearest", keep=True)


def _search(rows: DataFrame, k: int, every: int, id_col: str, vec_col: str, recall: float) -> DataFrame:
    spark = rows.sparkSession
    vectors = materialise(usable(rows, id_col, vec_col), "ann-vectors")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = F.aggregate("av_vec", F.lit(0.0), lambda a, v: a + v * v)
    stats = vectors.agg(F.count("*"), F.max(norm), F.max(F.size("av_vec"))).first()
    count, longest, dims = stats[0], stats[1], stats[2]
    if not count:
        return empty
    leaves = int(min(MAX_LEAVES, max(1, 4 * count**0.5)))

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.sqrt(np.maximum(longest - (x**2).sum(1), 0))[:, None]])

    # one vector that a third of all rows repeat is one row of the sample
    sample = vectors.groupBy("av_vec").agg(F.min("av_id").alias("av_id")).orderBy(F.xxhash64("av_id"), "av_id").limit(FIT_ROWS)

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = [_stack(f["av_vec"]) for f in frames if len(f)]
        tree = fit_tree(lifted(np.concatenate(x)), leaves)
        yield pd.DataFrame({"centres": [c.ravel().tolist() for c in tree.centres], "children": tree.children, "leaves": [tree.leaves] * len(tree.centres)})

    nodes = sample.repartition(1).mapInPandas(fitted, "centres array<double>, children array<int>, leaves int").collect()
    tree = Tree([np.array(n[0]).reshape(len(n[1]), dims + 1) for n in nodes], [list(n[1]) for n in nodes], nodes[0][2] if nodes else 1)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(leaf=tree.assign(lifted(_stack(f["av_vec"]))))

    index = materialise(vectors.mapInPandas(placed, "av_id long, av_vec array<double>, leaf int"), "ann-index")
    # one row for each of at most MAX_LEAVES leaves
    sizes = materialise(index.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")), "ann-leaves")
    hashed = "cast(pmod(xxhash64(av_id), blocks) as int) as block"

    visits = _calibrate(index, tree, k, recall, lifted)

    def visiting(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = _stack(f["q_vec"])
                q = np.hstack([x, np.zeros((len(x), 1))])
                lists = [tree.visits(v, visits) for v in q]
                n = [len(v) for v in lists]
                yield pd.DataFrame({"q_id": np.repeat(f["q_id"].to_numpy(), n), "q_vec": f["q_vec"].repeat(n), "leaf": np.concatenate(lists).astype(np.int32)})

    queries = vectors.where(F.col("av_id") % every == 0).groupBy(F.col("av_id").alias("q_id")).agg(F.min("av_vec").alias("q_vec"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = materialise(queries.repartition(tasks, "q_id").mapInPandas(visiting, "q_id long, q_vec array<double>, leaf int"), "ann-visits")
    # one row for each leaf again: its blocks, and how often it is dealt out for its queries
    parts = asked.groupBy(F.col("leaf").alias("p_leaf")).agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("parts"))
    spread = materialise(sizes.join(parts, F.col("leaf") == F.col("p_leaf")).drop("p_leaf"), "ann-spread")
    left = index.join(F.broadcast(spread), "leaf").selectExpr("leaf", hashed, "explode(sequence(0, parts - 1)) as part", "false as asks", "av_id as id", "av_vec as vec")
    right = asked.join(F.broadcast(spread), "leaf").selectExpr("leaf", "explode(sequence(0, blocks - 1)) as block", "cast(pmod(xxhash64(q_id), parts) as int) as part", "true as asks", "q_id as id", "q_vec as vec")
    met = left.unionByName(right).repartition("leaf", "block", "part").sortWithinPartitions("leaf", "block", "part", "asks", "id")
    return _best(met.mapInArrow(_streamed(k), PAIRS), k).select("query_id", "rank", "vec_id", "score")


def _calibrate(index: DataFrame, tree: Tree, k: int, recall: float, lifted) -> int:
    """How many leaves a search visits for a mean recall of at least ``recall``, by brute force for a few vectors."""
    probes = index.orderBy(F.xxhash64(F.col("av_id"), F.lit(1)), "av_id").limit(CALIBRATION).select("av_id", "av_vec").collect()
    ids, vecs = np.array([p[0] for p in probes]), np.array([p[1] for p in probes])

    def brute(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                leaf = dict(zip(f["av_id"], f["leaf"]))
                top = _top(vecs, ids, _stack(f["av_vec"]), f["av_id"].to_numpy(), k)
                yield top.assign(leaf=top["vec_id"].map(leaf).astype("int32"))

    best = _best(index.mapInPandas(brute, f"{PAIRS}, leaf int"), k).select("query_id", "leaf").collect()
    order = {}
    for i, v in zip(ids, vecs):
        order[i] = {leaf: n for n, leaf in enumerate(tree.visits(np.append(v, 0.0), tree.leaves))}
    ranks = np.array([order[q][leaf] for q, leaf in best])
    visits = 1
    while visits < tree.leaves and len(ranks) and (ranks < visits).mean() < recall:
        visits = max(visits + 1, int(visits * 1.15))
    return min(visits, tree.leaves)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
