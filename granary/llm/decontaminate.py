"""Benchmark decontamination: size-partitioned MinHash containment search.

Texts become lower-case words (runs of letters and digits), words become
64-bit hashes and each five words in a row a shingle; an item of one to four words is one shingle
of all its words, which documents are searched for at that length.  A test item leaks into
a document if the document holds at least ``THRESHOLD`` of the item's distinct
shingles.

Search.  Items are partitioned by their number of shingles.  An item with n
shingles that is contained to the threshold misses at most m = n - ceil(0.8 n)
of them, so that any m + 1 of its shingles include one that the document
holds; the m + 1 with the smallest hashes, a bottom-k MinHash sketch whose k
follows the size partition, find it for certain.  Size partitions are put together to passes of at
most about ``PROBES`` sketch hashes, a larger partition is dealt over several passes by hash; each pass reads the
documents once and keeps, inside the array of a document's shingles, those that are in its literal set, so that
only hits leave the scan.  However long a document, it is probed shingle by shingle.

Verification.  Only the documents with a probe that hits are read again, and
the distinct shared shingles of each candidate pair are counted.  The items' shingles are written before, so that
their size is known: up to ``BROADCAST_ROWS`` of them are broadcast, beyond that nothing here asks for it.
No task gathers a document's or an item's matches: counts are partial sums.

Defined results: null texts and texts without words count as empty and leak nothing; repeated items report the same
documents; rows that repeat a document id are documents of their own, told
apart by their text; null ids are kept as ids; an empty table on either side gives no rows; other columns, whatever their
names, are not read.  A very long text is one array in its task, nothing of it is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import materialise, scratch, table

WORDS = 5
THRESHOLD = 0.8
#: The largest table of shingles that is broadcast: some 40 bytes a row, under 20 MB.
BROADCAST_ROWS = 400_000
#: Sketch hashes that one pass over the documents looks for, a few MB of literals.
PROBES = 50_000


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""), lambda w: F.xxhash64(w))


def _roll(hashed: Column, words: int) -> Column:
    """The hashes of all runs of so many words, in order, repeats included; of fewer words none."""
    runs = F.transform(hashed, lambda h, i: F.xxhash64(h, *[F.get(hashed, i + k) for k in range(1, words)]))
    return F.slice(runs, F.lit(1), F.greatest(F.size(hashed) - F.lit(words - 1), F.lit(0)))


def shingles(text: Column, words: int = WORDS) -> Column:
    return _bound(word_hashes(text), lambda hashed: _roll(hashed, words))


def one_of(values: list[int]) -> Callable[[Column], Column]:
    return lambda shingle: shingle.isin(values)


def _all_shingles(text: Column, lengths: list[int], keep: Callable[[Column], Column] | None = None) -> Column:
    """The shingles of each of these lengths that keep accepts, in one array."""

    def of(hashed: Column) -> Column:
        found = [_roll(hashed, k) for k in lengths]
        return F.concat(*[F.filter(f, keep) for f in found] if keep else found)

    return _bound(word_hashes(text), of)


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """dc_item, dc_words (a shingle's length), dc_shingle, dc_n (the item's number of shingles), dc_rank (from 1, by hash), dc_probe."""
    hashed = items.select(F.col(id_col).alias("dc_item"), word_hashes(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    own = reduce(lambda found, k: F.when(F.size("w") == k, _roll(F.col("w"), k)).otherwise(found), range(1, WORDS), _roll(F.col("w"), WORDS))
    each = hashed.select("dc_item", F.least(F.size("w"), F.lit(WORDS)).alias("dc_words"), F.array_sort(F.array_distinct(own)).alias("s"))
    each = each.select("dc_item", "dc_words", F.size("s").alias("dc_n"), F.posexplode("s").alias("dc_rank", "dc_shingle"))
    # rounded before ceil: 0.8 * 5 must stay 4
    probes = F.col("dc_n") - F.ceil(F.round(F.col("dc_n") * F.lit(threshold), 9)) + 1
    return each.withColumn("dc_probe", F.col("dc_rank") < probes).dropDuplicates(["dc_item", "dc_n", "dc_rank", "dc_shingle"])


def _passes(probes: DataFrame) -> list[Column]:
    """Conditions on probes (dc_n, dc_shingle) that part them into passes of about PROBES hashes, size partition by size partition.

    A size partition holds the items whose number of shingles has the same binary length: there are at most 32 of them.
    """
    part = F.length(F.bin("dc_n"))
    sizes = sorted((r[0], r[1]) for r in probes.groupBy(part.alias("part")).count().collect())
    found, held, total = [], [], 0
    for p, n in sizes:
        if held and total + n > PROBES:
            found.append(part.isin(held))
            held, total = [], 0
        if n > PROBES:
            ways = -(-n // PROBES)
            found += [(part == p) & (F.pmod(F.col("dc_shingle"), F.lit(ways)) == i) for i in range(ways)]
        else:
            held.append(p)
            total += n
    return [*found, part.isin(held)] if held else found


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document and item that it contains: id_col, item_col, shared, item_shingles, containment."""
    with scratch(docs.sparkSession):
        found = _leaks(docs, items, id_col, text_col, threshold, item_col)
        found = found.groupBy(F.col("dc_doc").alias(id_col), F.col("dc_item").alias(item_col)).agg(F.max("shared").alias("shared"), F.max("dc_n").alias("item_shingles"), F.max("containment").alias("containment"))
        return materialise(found, "leaks", keep=True)


def _leaks(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, threshold: float, item_col: str = "item_id") -> DataFrame:
    """dc_doc, dc_hash (of the text), dc_item, shared, dc_n, containment: one row for each id, text and item."""
    wanted = materialise(item_shingles(items, item_col, "text", threshold), "leak-items")
    small = wanted.count() <= BROADCAST_ROWS
    hint = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    lengths = sorted(r[0] for r in wanted.select("dc_words").distinct().collect()) or [WORDS]
    texts = docs.select(F.col(id_col).alias("dc_doc"), F.col(text_col).alias("dc_text")).withColumn("dc_hash", F.xxhash64("dc_text"))

    probes = materialise(wanted.where("dc_probe").select("dc_n", "dc_shingle").distinct(), "leak-probes")
    hits = None
    for chosen in _passes(probes):
        values = [r[0] for r in probes.where(chosen).select("dc_shingle").distinct().collect()]
        found = texts.select("dc_doc", "dc_hash", F.explode(F.array_distinct(_all_shingles(F.col("dc_text"), lengths, one_of(values)))).alias("dc_shingle"))
        found = materialise(found, "leak-hits")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = texts.select("dc_doc", "dc_hash", F.lit(0).cast("long").alias("dc_shingle")).where("false")

    # candidate pairs, then the documents that have any
    pairs = hits.join(hint(wanted.where("dc_probe").select("dc_shingle", "dc_item", "dc_n")), "dc_shingle").select("dc_doc", "dc_hash", "dc_item", "dc_n").distinct()
    who = materialise(hits.select(F.col("dc_doc").alias("c_doc"), F.col("dc_hash").alias("c_hash")).distinct(), "leak-documents")
    again = texts.join(who, F.col("dc_doc").eqNullSafe(F.col("c_doc")) & (F.col("dc_hash") == F.col("c_hash")), "left_semi")
    again = again.dropDuplicates(["dc_doc", "dc_hash"]).select("dc_doc", "dc_hash", F.explode(F.array_distinct(_all_shingles(F.col("dc_text"), lengths))).alias("dc_shingle"))
    shared = again.join(hint(wanted.select("dc_shingle", "dc_item")), "dc_shingle").groupBy("dc_doc", "dc_hash", "dc_item").agg(F.count("*").alias("shared"))
    renamed = pairs.select(F.col("dc_doc").alias("p_doc"), F.col("dc_hash").alias("p_hash"), F.col("dc_item").alias("p_item"), "dc_n")
    same = F.col("dc_doc").eqNullSafe(F.col("p_doc")) & (F.col("dc_hash") == F.col("p_hash")) & F.col("dc_item").eqNullSafe(F.col("p_item"))
    checked = shared.join(renamed, same).withColumn("containment", F.col("shared") / F.col("dc_n"))
    return checked.where(F.col("shared") >= F.ceil(F.round(F.col("dc_n") * F.lit(threshold), 9))).select("dc_doc", "dc_hash", "dc_item", "shared", "dc_n", "containment")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def filter_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose own text contains no benchmark item; rows that share an id, or have none, are decided one by one."""
    with scratch(spark):
        found = _leaks(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", THRESHOLD).select(F.col("dc_doc").alias("x_doc"), F.col("dc_hash").alias("x_hash")).distinct()
        found = materialise(found, "leaking", keep=True)
    # xxhash64 of a null text is the seed, never null
    return docs.join(found, docs["doc_id"].eqNullSafe(found["x_doc"]) & (F.xxhash64(docs["text"]) == found["x_hash"]), "left_anti")


ORACLE = r"""
with t as (
  select 'd' as kind, doc_id as id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w, text from documents
  union all select 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> ''), text from benchmark),
s as (
  select kind, id, text, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) as s
  from t, (values (1), (2), (3), (4), (5)) as v(k)
  where len(w) >= k and (kind = 'i' and k = least(len(w), 5) or kind = 'd' and k in (select least(len(w), 5) from t where kind = 'i'))),
i as (select distinct id as item_id, k, s from s where kind = 'i'),
n as (select item_id, count(*) as item_shingles from i group by item_id),
m as (select d.id as doc_id, d.text, i.item_id, count(distinct i.s) as shared from s d join i on d.s = i.s and d.k = i.k where d.kind = 'd' group by all)
select doc_id, item_id, max(shared)::bigint as shared, max(item_shingles)::int as item_shingles, max(shared::double / item_shingles) as containment
from m join n using (item_id) where shared >= ceil(round(item_shingles * 0.8, 9)) group by doc_id, item_id
"""
