"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Weights.  A text is the weighted set of its five-word shingles: the number of
times a shingle occurs times ln(1 + 1/share), share being the part of all documents that
hold it.  A count-min sketch of fixed size over all documents names the shingles whose share may reach ``RARE``; their
document frequencies are then counted exactly, over all documents too.  There are at most (distinct shingles of a mean document) / ``RARE`` of them.
Shares under ``RARE`` count as ``RARE``: telling them apart would take the frequency of every shingle to every document
that holds it, several times the input in shuffles.

Signatures.  Each of ``BANDS * ROWS`` samples draws, for a shingle, r and c from
Gamma(2, 1) and b from U(0, 1), quantises t = floor(ln w / r + b), and picks the
shingle of smallest ln a = ln c - r (t - b) - r; two texts pick the same
(shingle, t) with a probability equal to their weighted Jaccard similarity.
The draws come from tables of ``2 ** TABLE_BITS`` entries that a hash of the shingle, another one for each sample, indexes;
for the commonest weight the tables hold t and ln a ready.  Everything
runs in one pass, many texts at a time.

Candidates.  Equal weighted sets are one node from then on.  Samples are banded
(``BANDS`` keys of ``ROWS`` samples: a pair at 0.8 shares one with 0.9996).
In a bucket all members' sketches (one byte a sample) are compared; pairs whose
estimate is under ``LEAST`` (5 standard deviations under 0.8, 3 in 10 million) are left.  No
bucket emits all its pairs: first those of a maximum spanning forest by
estimate are verified and joined to components; then, in each bucket whose members still
lie in different components, every pair between two of them is verified inside the
task, which emits only links that join two.  What is not compared
lies inside one class already, so that no link between classes is lost.  A
bucket of over ``BLOCK`` members is compared as pairs of blocks, in as many tasks.

Verification.  The shingles of the texts in question are taken from their whole texts again,
and the exact weighted Jaccard similarity must reach ``THRESHOLD``.

Defined results: texts without words, and null ids, are in no class with others
(class_id is their own id); texts of one to four words have one shingle, of all their
words; rows that repeat an id are one document, which any of its texts
links; class_id is the smallest id of the class; texts of any length are read whole; an empty table gives no
rows; other columns, whatever their names, are kept by keep_one and not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import bucketed, free, materialise, scratch, table
from granary.llm.components import components
from granary.llm.shingling import groups, mix64, shingle_hashes, word_hashes

THRESHOLD = 0.8
BANDS, ROWS = 20, 5
SAMPLES = BANDS * ROWS
LEAST = 0.6
RARE = 0.002
DEPTH, WIDTH_BITS = 2, 20
WIDTH = 1 << WIDTH_BITS
BLOCK = 2048
#: Buckets of up to so many members have all pairs compared at once.
SMALL = 4
TABLE_BITS = 13


def _distinct(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles, sorted, and how often each occurs."""
    for lo, hi in groups(texts):
        words, bounds = word_hashes(texts[lo:hi])
        h, at = shingle_hashes(words, bounds, short=True)
        for i in range(hi - lo):
            mine = np.sort(h[at[i] : at[i + 1]])
            first = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
            yield mine[first], np.diff(np.concatenate([first, [len(mine)]]))


def _cells(h: np.ndarray) -> list[np.ndarray]:
    return [((h * np.uint64(m)) >> np.uint64(64 - WIDTH_BITS)).astype(np.int64) for m in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class Frequencies:
    """The document frequencies of the shingles whose share is at least RARE."""

    def __init__(self, documents: int, shingles: np.ndarray, counts: np.ndarray):
        self.usual = float(np.log(np.log1p(1 / RARE)))
        share = counts / max(1, documents)
        often = share > RARE
        order = np.argsort(shingles[often], kind="stable")
        self.shingles = shingles[often][order]
        self.logs = np.log(np.log1p(1 / share[often][order]))
        # most shingles are told to be rare by one look-up
        self.marked = np.zeros(1 << 16, bool)
        self.marked[(self.shingles >> np.uint64(48)).astype(np.int64)] = True

    def log_idf(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.usual)
        some = np.flatnonzero(self.marked[(h >> np.uint64(48)).astype(np.int64)])
        if len(some):
            at = np.searchsorted(self.shingles, h[some])
            at[at == len(self.shingles)] = 0
            same = self.shingles[at] == h[some]
            out[some[same]] = self.logs[at[same]]
        return out


def _distinct_shingles(texts: list[str | None], lo: int, hi: int) -> np.ndarray:
    """The distinct shingles of each of the texts lo..hi, one after the other."""
    words, bounds = word_hashes(texts[lo:hi])
    h, at = shingle_hashes(words, bounds, short=True)
    parts = []
    for i in range(hi - lo):
        mine = np.sort(h[at[i] : at[i + 1]])
        parts.append(mine[np.concatenate([[True], mine[1:] != mine[:-1]])] if len(mine) else mine)
    return np.concatenate(parts)


def _sketched(docs: DataFrame) -> tuple[int, np.ndarray]:
    """The number of documents and a count-min sketch of their shingles: each task sends one sketch, pieces of it are added up."""
    pieces = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((DEPTH, WIDTH), np.int32), 0
        for b in batches:
            for lo, hi in groups(texts := b.column(0).to_pylist()):
                for d, cells in enumerate(_cells(_distinct_shingles(texts, lo, hi))):
                    np.add.at(counts[d], cells, 1)
                n += hi - lo
        if n:
            parts = [zlib.compress(p.astype(np.int64).tobytes(), 1) for p in np.split(counts.ravel(), pieces)]
            yield pa.RecordBatch.from_pydict({"piece": pa.array(range(pieces), pa.int32()), "n": pa.array([n] * pieces, pa.int64()), "counts": pa.array(parts, pa.binary())})

    schema = "piece int, n long, counts binary"

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, list] = {}
        for f in frames:
            for p, m, c in zip(f["piece"], f["n"], f["counts"]):
                was = totals.setdefault(int(p), [0, 0])
                was[0], was[1] = was[0] + np.frombuffer(zlib.decompress(c), np.int64), was[1] + m
        if totals:
            yield pd.DataFrame([{"piece": p, "n": n, "counts": zlib.compress(np.asarray(t).tobytes(), 1)} for p, (t, n) in totals.items()])

    # DEPTH * WIDTH numbers, whatever the input
    rows = sorted(docs.mapInArrow(count, schema).repartition(pieces, "piece").mapInPandas(added, schema).collect())
    if not rows:
        return 0, np.zeros((DEPTH, WIDTH), np.int64)
    return rows[0][1], np.concatenate([np.frombuffer(zlib.decompress(r[2]), np.int64) for r in rows]).reshape(DEPTH, WIDTH)


def frequencies(docs: DataFrame, text_col: str = "text") -> Frequencies:
    """Document frequencies over all documents: a sketch first, then exact counts of what it says may be frequent."""
    docs = docs.select(text_col)
    n, sketch = _sketched(docs)
    maybe = sketch > RARE * n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for lo, hi in groups(texts := b.column(0).to_pylist()):
                h = _distinct_shingles(texts, lo, hi)
                first, second = _cells(h)
                found.append(h[maybe[0][first] & maybe[1][second]])
            if found and sum(map(len, found)):
                h, k = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k)], names=["h", "k"])

    rows = docs.mapInArrow(count, "h long, k long").groupBy("h").agg(F.sum("k").alias("k")).where(F.col("k") > RARE * n).collect() if n else []
    return Frequencies(n, np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.float64))


class Sampler:
    """Draws and ready samples in tables, made anew in each Python worker."""

    def __init__(self, usual: float):
        rng = np.random.default_rng(20_11)
        n = 1 << TABLE_BITS
        self.r = [rng.gamma(2.0, 1.0, n).astype(np.float32) for _ in range(SAMPLES)]
        self.c = [np.log(rng.gamma(2.0, 1.0, n)).astype(np.float32) for _ in range(SAMPLES)]
        self.b = [rng.random(n, np.float32) for _ in range(SAMPLES)]
        self.mult = [np.uint64(int(x) | 1) for x in rng.integers(1 << 62, 1 << 63, SAMPLES)]
        self.usual = usual
        self.ready = [self._packed(usual, self.r[k], self.c[k], self.b[k]) for k in range(SAMPLES)]

    @staticmethod
    def _packed(log_w, r, c, b) -> np.ndarray:
        t = np.floor(log_w / r + b)
        log_a = (c - r * (t - b) - r).astype(np.float32)
        bits = log_a.view(np.uint32)
        ordered = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
        mark = (mix64(t.astype(np.int64).astype(np.uint64) + np.uint64(77)) >> np.uint64(32)).astype(np.uint64)
        return (ordered << np.uint64(32)) | mark

    def signatures(self, h: np.ndarray, starts: np.ndarray, log_w: np.ndarray) -> np.ndarray:
        """The sampled (shingle, t) of each text as 32 bits: an array (texts, SAMPLES)."""
        low = h & np.uint64(0xFFFFFFFF)
        other = np.flatnonzero(log_w != self.usual)
        out = np.empty((len(starts), SAMPLES), np.uint32)
        shift = np.uint64(64 - TABLE_BITS)
        for k in range(SAMPLES):
            at = ((h * self.mult[k]) >> shift).astype(np.int32)
            key = self.ready[k][at]
            if len(other):
                o = at[other]
                key[other] = self._packed(log_w[other], self.r[k][o], self.c[k][o], self.b[k][o])
            key ^= low
            out[:, k] = (np.minimum.reduceat(key, starts) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return out


_samplers: dict[float, Sampler] = {}
SIGNED = "id long, key binary, bands array<long>, sketch binary"


def _sign(freq: Frequencies):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if freq.usual not in _samplers:
            _samplers[freq.usual] = Sampler(freq.usual)
        sampler = _samplers[freq.usual]
        multipliers = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in groups(texts):
                rows, sets, weights = [], [], []
                for i, (h, tf) in enumerate(_distinct(texts[lo:hi]), lo):
                    if ids[i] is not None and len(h):
                        rows.append(ids[i])
                        sets.append(h)
                        weights.append(tf)
                if not rows:
                    continue
                sizes = np.array([len(s) for s in sets])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                h, tf = np.concatenate(sets), np.concatenate(weights)
                log_w = freq.log_idf(h)
                many = tf > 1
                log_w[many] += np.log(tf[many])
                sig = sampler.signatures(h, starts, log_w)
                k1 = np.add.reduceat(mix64(h + tf.astype(np.uint64)), starts)
                k2 = np.add.reduceat(mix64((h ^ np.uint64(0x5851F42D4C957F2D)) * (tf.astype(np.uint64) + np.uint64(3))), starts)
                keys = np.stack([k1, k2], 1)
                banded = np.zeros((len(rows), BANDS), np.uint64)
                for j in range(ROWS):
                    banded = mix64(banded + sig[:, j::ROWS].astype(np.uint64) * multipliers[j])
                banded = mix64(banded + np.arange(1, BANDS + 1, dtype=np.uint64))
                sketch = (sig & np.uint32(0xFF)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows, pa.int64()),
                        pa.array([k.tobytes() for k in keys], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (len(rows) + 1) * BANDS, BANDS), pa.int32()), pa.array(banded.view(np.int64).ravel())),
                        pa.array([s.tobytes() for s in sketch], pa.binary()),
                    ],
                    names=["id", "key", "bands", "sketch"],
                )

    return sign


def _weighted_sets(freq: Frequencies):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi in groups(texts):
                hs, ws = [], []
                for h, tf in _distinct(texts[lo:hi]):
                    hs.append(h.tobytes())
                    ws.append((np.exp(freq.log_idf(h)) * tf).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi], pa.int64()), pa.array(hs, pa.binary()), pa.array(ws, pa.binary())], names=["id", "hs", "ws"])

    return sets


def weighted_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Of two weighted sets, given by sorted hashes and their weights."""
    at = np.searchsorted(h2, h1)
    at[at == len(h2)] = 0
    same = h2[at] == h1 if len(h2) else np.zeros(len(h1), bool)
    low = np.minimum(w1[same], w2[at[same]]).sum(dtype=np.float64)
    total = w1.sum(dtype=np.float64) + w2.sum(dtype=np.float64) - low
    return float(low / total) if total > 0 else 0.0


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(6)]
        a, c, j = [], [], []
        for x, y, h1, w1, h2, w2 in zip(*cols):
            s = weighted_jaccard(np.frombuffer(h1, np.uint64), np.frombuffer(w1, np.float32), np.frombuffer(h2, np.uint64), np.frombuffer(w2, np.float32))
            a.append(x)
            c.append(y)
            j.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(j, pa.float64())], names=["a", "b", "similarity"])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """The columns after the first ``keys`` ones, of each run of rows with equal keys."""
    last, held = None, None
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for row in zip(*columns):
            if row[:keys] != last:
                if held and len(held) > 1:
                    yield list(zip(*held))
                last, held = row[:keys], []
            held.append(row[keys:])
    if held and len(held) > 1:
        yield list(zip(*held))


def _near(sketch: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different components whose sketches agree often enough, and in how many samples."""
    left, right, score = [], [], []
    for lo in range(0, len(sketch), 64):
        s = (sketch[lo : lo + 64, None, :] == sketch[None, :, :]).sum(2, dtype=np.int16)
        i, j = np.nonzero((s >= LEAST * SAMPLES) & (comp[lo : lo + 64, None] != comp[None, :]))
        up = i + lo < j
        left.append(i[up] + lo)
        right.append(j[up])
        score.append(s[i[up], j[up]])
    return np.concatenate(left), np.concatenate(right), np.concatenate(score)


class _Union:
    def __init__(self, labels: np.ndarray):
        self.at = {x: x for x in labels.tolist()}

    def root(self, x: int) -> int:
        while self.at[x] != x:
            self.at[x] = self.at[self.at[x]]
            x = self.at[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.at[max(x, y)] = min(x, y)
        return x != y


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (bucket, x, y, id, comp, sketch): pairs to verify, a maximum spanning forest of each bucket (all pairs of small ones)."""
    for ids, comp, sketch in _runs(batches, 3):
        ids = np.array(ids, np.int64)
        left, right, score = _near(np.frombuffer(b"".join(sketch), np.uint8).reshape(len(ids), SAMPLES), np.array(comp, np.int64))
        union, out = _Union(ids), []
        for e in np.argsort(-score, kind="stable"):
            x, y = int(ids[left[e]]), int(ids[right[e]])
            if x != y and (len(ids) <= SMALL or union.join(x, y)):
                out.append((min(x, y), max(x, y)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])


def _rest(threshold: float):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (bucket, x, y, id, comp, sketch, hs, ws): links between the components that share a bucket, verified on the spot."""
        for ids, comp, sketch, hs, ws in _runs(batches, 3):
            comp = np.array(comp, np.int64)
            left, right, score = _near(np.frombuffer(b"".join(sketch), np.uint8).reshape(len(ids), SAMPLES), comp)
            sets = [(np.frombuffer(h, np.uint64), np.frombuffer(w, np.float32)) for h, w in zip(hs, ws)]
            total = np.array([w.sum(dtype=np.float64) for _, w in sets])
            union, out = _Union(comp), []
            for e in np.argsort(-score, kind="stable"):
                i, j = left[e], right[e]
                x, y = int(comp[i]), int(comp[j])
                if union.root(x) == union.root(y) or min(total[i], total[j]) < threshold * max(total[i], total[j]):
                    continue
                if weighted_jaccard(*sets[i], *sets[j]) >= threshold:
                    union.join(x, y)
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])

    return links


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id_col and class_id, one row for each row of docs."""
    with scratch(docs.sparkSession):
        found = materialise(_classes(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), threshold), "near-classes", keep=True)
    got = docs.select(F.col(id_col).alias("nd_id")).join(found.withColumnRenamed("id", "nd_key"), F.col("nd_id").cast("long") == F.col("nd_key"), "left")
    return got.select(F.col("nd_id").alias(id_col), F.coalesce("class_id", F.col("nd_id").cast("long")).alias("class_id"))


def _classes(rows: DataFrame, threshold: float) -> DataFrame:
    """id and class_id, one row for each id of rows (id, text) that has words."""
    freq = frequencies(rows)
    signed = materialise(rows.mapInArrow(_sign(freq), SIGNED), "near-signatures")
    texts = signed.groupBy("key").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands"), F.min_by("sketch", "id").alias("sketch"))
    texts = materialise(texts, "near-texts")

    keyed = texts.select("rep", F.explode("bands").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = keyed.join(sizes, "bucket")
    members = materialise(members.withColumn("blocks", F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")).drop("members"), "near-members")
    asked = members.select("rep").distinct()
    sketches = materialise(texts.select("rep", "key", "sketch").join(asked, "rep", "left_semi"), "near-sketches")

    # the weighted sets of the texts that share a bucket with another, bucketed by id: pairs come to them
    wanted = rows.join(sketches.select(F.col("rep").alias("id")).distinct().hint("merge"), "id", "left_semi")
    wanted = wanted.withColumn("hash", F.xxhash64("text")).dropDuplicates(["id", "hash"]).select("id", "text")
    sets = bucketed(wanted.mapInArrow(_weighted_sets(freq), "id long, hs binary, ws binary"), "near-sets", "id")

    def buckets(rows: DataFrame, columns: list[str]) -> DataFrame:
        """rows of members, sorted by bucket; a large bucket becomes its pairs of blocks."""
        placed = rows.withColumn("mine", F.expr("cast(pmod(xxhash64(rep), blocks) as int)")).withColumn("other", F.expr("explode(sequence(0, blocks - 1))"))
        placed = placed.select("bucket", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), *columns)
        return placed.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y", "rep")

    held = members.join(sketches.drop("key"), "rep").withColumn("comp", F.col("rep"))
    pairs = materialise(buckets(held, ["rep", "comp", "sketch"]).mapInArrow(_forest, "a long, b long").distinct(), "near-pairs")
    left = sets.select(F.col("id").alias("a"), F.col("hs").alias("h1"), F.col("ws").alias("w1"))
    right = sets.select(F.col("id").alias("b"), F.col("hs").alias("h2"), F.col("ws").alias("w2"))
    checked = pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "h1", "w1", "h2", "w2").mapInArrow(_verify, "a long, b long, similarity double")
    links = materialise(checked.where(F.col("similarity") >= threshold).select("a", "b"), "near-links")
    comp = components(links)

    # buckets whose members still lie in different components
    held = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    mixed = held.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
    held = held.join(mixed, "bucket", "left_semi").join(sketches.drop("key"), "rep").hint("merge").join(sets.withColumnRenamed("id", "rep"), "rep")
    more = materialise(buckets(held, ["rep", "comp", "sketch", "hs", "ws"]).mapInArrow(_rest(threshold), "a long, b long").distinct(), "near-links")
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    found = signed.select("id", "key").join(texts.select("key", "rep"), "key").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    # a repeated id may stand in several texts: its smallest class holds for all
    return found.groupBy("id").agg(F.min(F.coalesce("comp", "rep")).alias("class_id"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each class; rows are told apart by id and text, and of exact repeats of both one stays.

    Rows without an id have none to be ordered by: of each class one of them stays besides the one of smallest id.
    """
    key = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text")
    rows = docs.select(key.alias("id"), F.col("doc_id").cast("long").alias("nd_doc"), "text")
    with scratch(spark):
        found = _classes(rows.select("id", "text"), THRESHOLD)
        who = rows.select("id", "nd_doc").groupBy("id").agg(F.first("nd_doc").alias("nd_doc"), F.count("*").alias("nd_n"))
        placed = materialise(who.join(found, "id", "left").withColumn("class_id", F.coalesce("class_id", "id")), "near-rows")
        first = placed.groupBy("class_id", F.col("nd_doc").isNull().alias("nameless")).agg(F.min_by("id", F.struct("nd_doc", "id")).alias("id")).select("id")
        gone = materialise(placed.join(first, "id", "left_anti").select(F.col("id").alias("x_id")), "near-gone", keep=True)
        twice = materialise(placed.join(first, "id", "left_semi").where("nd_n > 1").select(F.col("id").alias("x_id")), "near-repeated", keep=True)
    own, other = free(docs, "nd_key", "nd_other")
    gone, twice = gone.select(F.col("x_id").alias(other)), twice.select(F.col("x_id").alias(other))
    kept = docs.withColumn(own, key).join(gone, F.col(own) == F.col(other), "left_anti")
    if twice.isEmpty():
        return kept.drop(own)
    again = F.col(own) == F.col(other)
    return kept.join(twice, again, "left_anti").unionByName(kept.join(twice, again, "left_semi").dropDuplicates([own])).drop(own)
