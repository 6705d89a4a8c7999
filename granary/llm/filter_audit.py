"""Filter interaction audit: what each of five filters removes, in every order of applying them.

Filters A to D look at one text (words, repeated words, capitals, symbols).  E
fails a document whose text some document of smaller id has as well.  Those are found by
partition refinement: documents are split by length in code points, then by the hash of
one block of text after another, and whatever stands alone in its class leaves.
The full texts of what survives are then compared, and all but the smallest id of
each text are marked.

How it runs: one pass over the texts leaves a narrow row a document: filters A to D as a
mask, length, block hashes.  Refinement works on those; blocks end at eight times the end of the one before, so
that texts of any length take few rounds.  Classes are counted with partial aggregation, and
rows leave by a join on class *and* id, so that a large group of copies is no
key of a join.  The comparison reads the texts again, passes those of survivors
on and groups them by class and text, where copies collapse before the shuffle.  Where a
class holds different texts (a collision of 64-bit hashes), its rows are told apart by
their texts.  From the masks on all is counts: rows of one id, part and mask are
added up before labels are joined, 32 masks a part come out at most, and the 120 orders
are spread over those.

Defined results: a null text is empty; a null source counts as the empty string; a null id is smaller than none and has none
smaller, so that it never fails E; rows that repeat both id and text do not fail E by each other; an id with several labels is
good or toxic if any says so; labels of unknown ids count nothing; texts of any length are read whole; an empty
table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import materialise, scratch, table

FILTERS = "ABCDE"
WORD_GAP = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 50, 65, 5
#: Code points of the first block; each block ends at eight times the end of the one before.
BLOCK, GROWTH = 64, 8


def word_filters(text: Column) -> Column:
    """Bits 1, 2, 4, 8 where the text fails A, B, C, D."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words = F.split(trimmed, WORD_GAP)
    n = F.when(trimmed == "", 0).otherwise(F.size(words))
    distinct = F.when(trimmed == "", 0).otherwise(F.size(F.array_distinct(words)))
    capitals, points = F.regexp_count(text, F.lit("[A-Z]")).cast("long"), F.char_length(text).cast("long")
    fails = (n < MIN_WORDS, distinct.cast("long") * 100 < n.cast("long") * MIN_DISTINCT, capitals * 100 > points * MAX_CAPITALS, text.rlike(r"[#$%&*|]"))
    mask = F.lit(0)
    for i, failed in enumerate(fails):
        mask = mask + failed.cast("int") * (1 << i)
    return mask


def block_hashes(text: Column, bits: int = 64) -> Column:
    """The hash of each block of a text; bits below 64 make collisions, for tests."""
    # block 1 ends at 64, block k at 64 * 8^(k-1); one block too many hashes nothing
    blocks = F.ceil(F.log(F.char_length(text) / F.lit(float(BLOCK))) / F.log(F.lit(float(GROWTH))) + 1e-9) + 1

    def hashed(k: Column) -> Column:
        end = (F.pow(F.lit(float(GROWTH)), k - 1) * BLOCK).cast("int")
        start = F.when(k == 1, 0).otherwise((F.pow(F.lit(float(GROWTH)), k - 2) * BLOCK).cast("int"))
        return F.shiftrightunsigned(F.xxhash64(F.substring(text, start + 1, end - start)), 64 - bits)

    return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), blocks.cast("int"))), hashed)


def _of(cls: str = "cls", doc: str = "id") -> Column:
    """Rows of one class and id; ids may be null."""
    return (F.col(cls) == F.col("x_cls")) & F.col(doc).eqNullSafe(F.col("x_id"))


def survivors(profile: DataFrame) -> DataFrame:
    """The distinct (cls, id) of profile (id, n, hashes, rows) that refinement leaves in classes of more than one row."""
    left, k = profile.select("id", "n", "hashes", "rows"), 0
    while True:
        classed = left.withColumn("cls", F.xxhash64("n", F.slice("hashes", 1, k)) if k else F.xxhash64("n"))
        alone = classed.groupBy("cls").agg(F.sum("rows").alias("rows"), F.min("id").alias("x_id")).where("rows = 1").select(F.col("cls").alias("x_cls"), "x_id")
        left = materialise(classed.join(alone, _of(), "left_anti").drop("cls"), f"audit-round-{k}")
        deepest = left.agg(F.max(F.size("hashes"))).first()[0]
        if deepest is None or k >= deepest:
            return left.select(F.xxhash64("n", "hashes").alias("cls"), "id").distinct()
        k += 1


def masks(docs: DataFrame, bits: int = 64) -> DataFrame:
    """How many rows of docs (id, part, text) there are of each id, part and mask; bit 16 of a mask is filter E.  bits: as in block_hashes."""
    read = docs.select("id", "part", "text", word_filters(F.col("text")).alias("mask"), F.char_length("text").alias("n"), block_hashes(F.col("text"), bits).alias("hashes"))
    profile = materialise(read.groupBy("id", "part", "mask", "n", "hashes").agg(F.count("*").alias("rows")), "audit-profile")
    left = materialise(survivors(profile), "audit-survivors")
    texts = docs.select("id", "text", F.xxhash64(F.char_length("text"), block_hashes(F.col("text"), bits)).alias("cls"))
    # survivors grow with the input: one way at every size
    whole = texts.join(left.select(F.col("cls").alias("x_cls"), F.col("id").alias("x_id")).hint("merge"), _of(), "left_semi")
    found = materialise(whole.groupBy("cls", "text").agg(F.min("id").alias("least")), "audit-texts")
    variants = materialise(found.groupBy("cls").agg(F.count("*").alias("variants"), F.min("least").alias("least")), "audit-classes")
    # whoever is not the first of its class fails E; such a row is known by class and id
    first = variants.where("variants = 1").select(F.col("cls").alias("x_cls"), F.col("least").alias("x_id"))
    fails = left.where("id is not null").join(first, _of(), "left_anti").select(F.col("cls").alias("x_cls"), F.col("id").alias("x_id"))
    rows = profile.withColumn("cls", F.xxhash64("n", "hashes"))
    mixed = variants.where("variants > 1").select("cls")
    collided = not mixed.isEmpty()
    if collided:
        rows = rows.join(mixed, "cls", "left_anti")
    marked = rows.join(fails, _of(), "left").select("id", "part", (F.col("mask") + F.when(F.col("x_cls").isNotNull(), 16).otherwise(0)).alias("mask"), "rows")
    if collided:
        # different texts in one class: its rows go by their texts
        apart = read.withColumn("cls", F.xxhash64("n", "hashes")).join(mixed, "cls", "left_semi").groupBy("id", "part", "mask", "cls", "text").agg(F.count("*").alias("rows"))
        head = found.select(F.col("cls").alias("x_cls"), F.col("text").alias("x_text"), F.col("least").alias("x_id"))
        apart = apart.join(head, _of() & (F.col("text") == F.col("x_text")), "left")
        fails = F.col("id").isNotNull() & F.col("x_cls").isNull()
        marked = marked.unionByName(apart.select("id", "part", (F.col("mask") + F.when(fails, 16).otherwise(0)).alias("mask"), "rows"))
    return marked.groupBy("id", "part", "mask").agg(F.sum("rows").alias("rows"))


def orders() -> Column:
    """All orders of the filters as (filter_order, step, bit, before): the filter's own bit and those of the ones before it."""
    found = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            found.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    return F.from_json(F.lit(json.dumps(found)), "array<struct<filter_order: string, step: int, bit: int, before: int>>")


def audit(marked: DataFrame, labels: DataFrame) -> DataFrame:
    """The report of masks (id, part, mask, rows) and labels (doc_id, quality, toxic)."""
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    total = lambda of: F.coalesce(F.sum(F.when(F.coalesce(of, F.lit(False)), F.col("rows"))), F.lit(0)).cast("long")
    counted = marked.join(said, "id", "left").groupBy("part", "mask").agg(F.sum("rows").alias("n"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic"))
    # 32 masks at most
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    each = parts.select("part", "masks", F.inline(orders()))
    own, earlier = (lambda m: m["mask"].bitwiseAND(F.col("bit")) > 0), (lambda m: m["mask"].bitwiseAND(F.col("before")) > 0)
    add = lambda where, value: F.aggregate(F.filter("masks", where), F.lit(0).cast("long"), lambda s, m: s + value(m))
    n = lambda m: m["n"]
    return each.select(
        "part", "filter_order", "step",
        add(lambda m: ~own(m) & ~earlier(m), n).alias("kept"),
        add(lambda m: own(m) & ~earlier(m), n).alias("removed"),
        add(lambda m: own(m) & earlier(m), n).alias("redundant"),
        add(lambda m: m["mask"] == F.col("bit"), n).alias("unique_fails"),
        add(lambda m: own(m) & ~earlier(m), lambda m: m["good"]).alias("good_lost"),
        add(lambda m: own(m) & ~earlier(m), lambda m: m["toxic"]).alias("toxic_lost"),
        # of the 120 orders each filter that a document fails comes first among them in an equal share
        add(own, lambda m: m["n"] * (F.lit(120) / F.bit_count(m["mask"])).cast("long")).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = F.lit("")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("source", blank).alias("part"), F.coalesce("text", blank).alias("text"))
    with scratch(spark):
        got = materialise(audit(masks(docs), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")), "op12", keep=1)
    return got


ORACLE = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as least from d),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by 1),
m as (select part, l.good, l.toxic, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text),
  regexp_matches(text, '[#$%&*|]'), coalesce(least < w.doc_id, false)] as fails from w left join l using (doc_id)),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
perms as (select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, step::int as step, ascii(filter_order[step]) - 64 as own, list_transform(string_split(filter_order[:step - 1], ''), lambda x: ascii(x) - 64) as earlier from perms, range(1, 6) r(step)),
counted as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by all),
each as (select s.*, c.*, c.fails[s.own] as now, len(list_filter(s.earlier, lambda i: c.fails[i])) > 0 as gone, len(list_filter(c.fails, lambda f: f)) as many from counted c, steps s),
report as (select part, filter_order, step, own, coalesce(sum(n) filter (not now and not gone), 0)::bigint as kept, coalesce(sum(n) filter (now and not gone), 0)::bigint as removed, coalesce(sum(n) filter (now and gone), 0)::bigint as redundant,
  coalesce(sum(n) filter (now and many = 1), 0)::bigint as unique_fails, coalesce(sum(good) filter (now and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (now and not gone), 0)::bigint as toxic_lost from each group by all)
select * exclude (own), sum(removed) over (partition by part, own)::bigint as shapley from report
"""
