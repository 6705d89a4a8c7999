"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Each document gets the exponential key -ln(u) / quality, where u is a hash of
its id and its text, so that rows without an id, or of one id, spread over the buckets all the same: taking documents in the order of their keys draws them without
replacement with chances in proportion to their quality.  Within a source the
documents are sorted by key and their sizes prefix-summed; whole epochs of a
source come first, and the prefix that fits what is left of its token budget
is taken once more.

A source may hold a third of all rows, so no window spans a source: keys are
cut into buckets of about ``BUCKET_ROWS`` rows, bucket sums are
prefix-summed for each source, and the documents only inside their bucket.
Buckets have equal shares of the source's own distribution of keys, which is the mean of 1 - exp(-quality * key) over its
documents' qualities (in at most ``CLASSES`` classes), so that they are alike whatever the qualities.
The windows over one source's buckets and over the sources see one row for
some 2,000 documents and one for each source.

Defined results: a null text has size 0; a null source is a source of its own
and the last in order; a null id hashes as ``null``, beside its text; rows that repeat both id and text tie, lie in one bucket and are
drawn one after the other; a quality that is null or not positive counts as
``DEFAULT_QUALITY``; an empty table gives no rows.  A budget ends inside a document
where needed: of that one only the first words are taken the last time; long texts are counted whole; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import materialise, scratch, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
BUCKET_ROWS = 2048
DEFAULT_QUALITY = 0.5
#: Qualities are told apart for the buckets by quarters of a power of two, from 2^-8 to 2^8.
CLASSES = 65
#: Sampling weights of documents labelled good and bad; those without a label get DEFAULT_QUALITY.
GOOD, BAD = 1.0, 0.25


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(doc_id: Column, text_hash: Column, quality: Column, seed: str) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), text_hash)), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(2.0**52)) / quality


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """One row for each source of sizes (mx_source, mx_size): its size, rows and target.

    The targets share ``share`` times all sizes by weight; a target stops at
    ``cap`` times its source's size and the excess is shared again by weight.
    The level at which that ends is found by prefix sums in the order in
    which sources reach their caps.
    """
    per = sizes.groupBy("mx_source").agg(F.sum("mx_size").alias("source_size"), F.count("*").alias("mx_rows"))
    order = Window.orderBy(F.col("mx_source").asc_nulls_last())
    picks = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("mx_w", F.element_at(picks, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    whole = Window.partitionBy()
    per = per.withColumn("mx_cap", F.col("source_size") * F.lit(float(cap))).withColumn("mx_ratio", F.col("mx_cap") / F.col("mx_w"))
    fill = Window.orderBy("mx_ratio", F.col("mx_source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(whole) * F.lit(float(share))
    per = per.withColumn("mx_level", (total - F.coalesce(F.sum("mx_cap").over(before), F.lit(0.0))) / F.sum("mx_w").over(after))
    # levels only rise while sources are capped: the first that its source does not reach is the final one
    per = per.withColumn("mx_final", F.min(F.when(F.col("mx_level") <= F.col("mx_ratio"), F.struct("mx_ratio", "mx_level"))).over(whole)["mx_level"])
    target = F.when(F.col("mx_final").isNull(), F.col("mx_cap")).otherwise(F.least(F.col("mx_cap"), F.col("mx_final") * F.col("mx_w")))
    return per.select("mx_source", "source_size", "mx_rows", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    quality: DataFrame | None = None,
    weights=WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    seed: str = SEED,
    size: Column | None = None,
) -> DataFrame:
    """How many words the mix takes of each document.

    quality: rows (id_col, quality), one for each id at most.  Returns id_col, source_col, size,
    source_size, target, epochs (whole passes over the source) and taken.
    """
    with scratch(docs.sparkSession):
        return materialise(_mix(docs, id_col, text_col, source_col, quality, weights, share, cap, seed, size), "mix", keep=True)


def _mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, quality: DataFrame | None, weights, share: float, cap: float, seed: str, size: Column | None) -> DataFrame:
    sized = docs.select(F.col(id_col).alias("mx_id"), F.col(source_col).cast("string").alias("mx_source"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("mx_text"), (word_count(F.col(text_col)) if size is None else size).alias("mx_size"))
    sized = materialise(sized, "mix-sizes")
    targets = materialise(source_targets(sized, weights, share, cap), "mix-sources")
    if quality is None:
        drawn = sized.withColumn("mx_q", F.lit(DEFAULT_QUALITY))
    else:
        q = quality.select(F.col(id_col).alias("mx_id"), F.col("quality").cast("double").alias("mx_q"))
        drawn = sized.join(q, "mx_id", "left").withColumn("mx_q", F.when(F.col("mx_q") > 0, F.col("mx_q")).otherwise(F.lit(DEFAULT_QUALITY)))
    same = F.col("mx_source").eqNullSafe(F.col("t_source"))
    drawn = drawn.withColumn("mx_key", _key(F.col("mx_id"), F.col("mx_text"), F.col("mx_q"), seed)).drop("mx_text")
    top = (CLASSES - 1) // 8
    drawn = drawn.withColumn("mx_class", F.pow(F.lit(2.0), F.least(F.lit(float(top)), F.greatest(F.lit(float(-top)), F.round(F.log2("mx_q") * 4) / 4))))
    drawn = materialise(drawn, "mix-keys")
    classes = drawn.groupBy("mx_source", "mx_class").agg(F.count("*").alias("n"))
    classes = classes.groupBy(F.col("mx_source").alias("c_source")).agg(F.sort_array(F.collect_list(F.struct("mx_class", "n"))).alias("mx_classes"))
    targets = targets.join(classes, F.col("mx_source").eqNullSafe(F.col("c_source"))).withColumnRenamed("mx_source", "t_source").drop("c_source")
    drawn = drawn.join(targets, same).drop("t_source")
    buckets = F.ceil(F.col("mx_rows") / F.lit(BUCKET_ROWS))
    below = F.aggregate("mx_classes", F.lit(0.0), lambda sum, c: sum + c["n"] * (1.0 - F.exp(-F.col("mx_key") * c["mx_class"])))
    drawn = drawn.withColumn("mx_bucket", F.least(buckets - 1, F.floor(below / F.col("mx_rows") * buckets))).drop("mx_classes")

    sums = drawn.groupBy("mx_source", "mx_bucket").agg(F.sum("mx_size").alias("mx_sum"))
    over = Window.partitionBy("mx_source").orderBy("mx_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("mx_source").alias("s_source"), F.col("mx_bucket").alias("s_bucket"), F.coalesce(F.sum("mx_sum").over(over), F.lit(0)).alias("mx_offset"))
    placed = drawn.join(sums, F.col("mx_source").eqNullSafe(F.col("s_source")) & (F.col("mx_bucket") == F.col("s_bucket")))
    inside = Window.partitionBy("mx_source", "mx_bucket").orderBy("mx_key", "mx_id", "mx_size").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("mx_offset") + F.sum("mx_size").over(inside) - F.col("mx_size")

    epochs = F.coalesce(F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))), F.lit(0))
    rest = F.floor(F.col("target") - F.col("mx_epochs") * F.col("source_size"))
    last = F.greatest(F.lit(0), F.least(F.col("mx_size"), F.col("mx_rest") - F.col("mx_before")))
    return (
        placed.withColumn("mx_before", before)
        .withColumn("mx_epochs", epochs)
        .withColumn("mx_rest", rest)
        .select(
            F.col("mx_id").alias(id_col),
            F.col("mx_source").alias(source_col),
            F.col("mx_size").alias("size"),
            "source_size",
            "target",
            F.col("mx_epochs").alias("epochs"),
            (F.col("mx_epochs") * F.col("mx_size") + last).cast("long").alias("taken"),
        )
    )


def label_quality(labels: DataFrame) -> DataFrame:
    """Sampling weights from labels (doc_id, quality); a document with several labels gets their mean."""
    score = F.avg(F.when(F.col("quality") == 1, F.lit(GOOD)).when(F.col("quality") == 0, F.lit(BAD)))
    return labels.groupBy("doc_id").agg(score.alias("quality")).where("quality is not null and doc_id is not null")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs, quality=label_quality(table(spark, sf_dir, "labels"))).drop("source", "epochs")


ORACLE = r"""
with sized as (
  select doc_id, source, md5(coalesce(text, '')) as hash, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end::bigint as size from documents),
q as (select doc_id, avg(case quality when 1 then 1.0::double when 0 then 0.25::double end) as qw from labels where doc_id is not null group by doc_id),
per as (select source, sum(size)::bigint as source_size, count(*) as n from sized group by source),
w as (select *, case ((row_number() over (order by source asc nulls last)) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w from per),
r as (select *, source_size * 2.0::double as cap, source_size * 2.0::double / w as ratio, sum(source_size) over () * 1.5::double as total from w),
l as (select *, (total - coalesce(sum(cap) over (order by ratio, source asc nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
        / sum(w) over (order by ratio, source asc nulls last rows between current row and unbounded following) as level from r),
f as (select *, (select level from l where level <= ratio order by ratio, level limit 1) as final from l),
t as (select source, source_size, case when final is null then cap else least(cap, final * w) end as target from f),
k as (
  select s.doc_id, s.source, s.size, t.source_size, t.target,
    -ln((('0x' || substr(md5('mix-1:' || coalesce(s.doc_id::varchar, 'null') || ':' || s.hash), 1, 13))::bigint::double + 0.5::double) / 4503599627370496.0::double)
      / (case when q.qw > 0 then q.qw else 0.5::double end) as k
  from sized s join t on s.source is not distinct from t.source left join q on s.doc_id = q.doc_id),
p as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as e,
    sum(size) over (partition by source order by k, doc_id, size rows between unbounded preceding and current row) - size as before from k)
select doc_id, size, source_size, target,
  (e * size + greatest(0, least(size, floor(target - e * source_size) - before)))::bigint as taken
from p
"""
