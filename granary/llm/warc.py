"""WARC archives: writing them, and reading them back by boundary-chain verification.

Writing.  Each page becomes a record; of pages with equal payloads of at least
``MIN_REVISIT`` bytes the one with the smallest id is a response and the others
are revisits of it, without a block.  Only ids and digests are grouped and
joined.  Spark's text writer makes the files: a record is one value and the
CR LF CR LF that ends it is the line separator.

Reading.  Spark's text reader cuts the files, in splits, at each place where the
magic of a record stands, also where it stands inside a payload.  Each piece
is a candidate record; its header says where its successor has to start.
The pieces' lengths, prefix-summed in file order, give every candidate's
offset.  Candidates that follow each other directly and that nothing else points
into are contracted to runs, and pointer jumping over the runs, from the
start of each file, finds those that can be reached: after k rounds each
pointer spans 2^k runs, so that the rounds grow with the logarithm of the
number of runs.  A candidate that no chain from the start reaches is payload.
Payloads that hold a magic are put together again from their pieces, the
files concerned being read once more; all others are whole in their piece.

A file's candidates are sorted in one task, without their payloads; archive
files are bounded by whoever writes them (customarily 1 GB).

Defined results: a null html is an empty payload; a null url writes no target
URI; control characters and spaces in a URL are percent-encoded; a null page id reads
back as null; rows that repeat the smallest page id of equal payloads are all
responses; an empty table gives no records; a file that does not start with
a record has none, and a chain that breaks off ends with its last whole record.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import drop_path, materialise, scratch, shared_path, table

MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
MIN_REVISIT = 100
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
_ID = "urn:x-page:"


def _clean(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A"), r"[\x00-\x20\x7F]", "%20")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One column, record: each page's record without the break that ends it."""
    page = pages.select(F.col(id_col).cast("string").alias("wr_id"), F.col(id_col).alias("wr_key"), F.col(url_col).alias("wr_url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("wr_payload"))
    page = page.withColumn("wr_bytes", F.octet_length("wr_payload").cast("long")).withColumn("wr_digest", F.sha2("wr_payload", 256))
    digests = materialise(page.select("wr_key", "wr_digest", "wr_bytes").where(F.col("wr_bytes") >= MIN_REVISIT), "warc-digests")
    # ids of equal payloads: the smallest and the largest tell whether there is a revisit
    first = digests.groupBy("wr_digest").agg(F.min("wr_key").alias("wr_first"), F.max("wr_key").alias("wr_last"), F.count("*").alias("n"), F.count("wr_key").alias("known"))
    first = first.where("n > 1 and (wr_first < wr_last or (known > 0 and known < n))").select("wr_digest", "wr_first")
    refers = digests.join(first, "wr_digest").where(~F.col("wr_key").eqNullSafe(F.col("wr_first"))).select(F.col("wr_key").alias("r_key"), F.col("wr_digest").alias("r_digest"), "wr_first").distinct()
    refers = materialise(refers, "warc-revisits")
    page = page.join(refers, F.col("wr_key").eqNullSafe(F.col("r_key")) & (F.col("wr_digest") == F.col("r_digest")), "left")
    revisit = F.col("wr_first").isNotNull()
    head = F.concat(F.lit(_HTTP), F.col("wr_bytes").cast("string"), F.lit(BREAK))
    block = F.when(revisit, F.lit("")).otherwise(F.concat(head, F.col("wr_payload").cast("string")))
    length = F.when(revisit, F.lit(0)).otherwise(F.octet_length(head) + F.col("wr_bytes"))
    uri = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("wr_url")), F.lit("\r\n")), F.lit(""))
    lines = [
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"\r\nWARC-Record-ID: <{_ID}"), F.coalesce(F.col("wr_id"), F.lit("null")), F.lit(">\r\n"), uri,
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha256:"), F.col("wr_digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <{_ID}"), F.col("wr_first").cast("string"), F.lit(">\r\nX-Payload-Length: "), F.col("wr_bytes").cast("string"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(BREAK), block,
    ]
    return page.select(F.concat(*lines).alias("record"))


def write_warc(pages: DataFrame, path: str, **columns: str) -> None:
    records(pages, **columns).write.option("lineSep", BREAK).text(path)


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?i)(?:^|\n){name}: *([^\r\n]*)", 1)
    return F.when(found != "", found)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value"),
        F.octet_length("value").cast("long").alias("bytes"),
    )


def _offsets(pieces: DataFrame) -> DataFrame:
    """offset: where the magic before each piece starts; -1 for what stands before the first magic."""
    order = Window.partitionBy("file").orderBy("block", "seq")
    return pieces.withColumn("offset", F.sum(F.col("bytes") + len(MAGIC)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes") - 2 * len(MAGIC)).withColumn(
        "offset", F.when(F.row_number().over(order) == 1, F.lit(-1)).otherwise(F.col("offset"))
    )


def _body(value: Column) -> dict[str, Column]:
    """What a record's own bytes, after its magic, say."""
    head = F.substring_index(value, BREAK, 1)
    head_bytes = F.octet_length(head) + len(BREAK)
    return {"head": head, "head_bytes": head_bytes.cast("long"), "length": _field(head, "Content-Length").try_cast("bigint")}


def _payload(value: Column, head_bytes: Column, length: Column) -> Column:
    block = F.substring(value.cast("binary"), (head_bytes + 1).cast("int"), length.cast("int"))
    http = F.octet_length(F.substring_index(block.cast("string"), BREAK, 1)) + len(BREAK)
    return F.substring(block, (http + 1).cast("int"), F.greatest(length - http, F.lit(0)).cast("int"))


def _described(df: DataFrame) -> DataFrame:
    """Adds what is known from value, head_bytes and length: one row of the result."""
    head = F.col("head")
    page = F.regexp_extract(head, rf"(?i)WARC-Record-ID: *<{_ID}(-?\d+)>", 1).try_cast("bigint")
    refers = F.regexp_extract(head, rf"(?i)WARC-Refers-To: *<{_ID}(-?\d+)>", 1).try_cast("bigint")
    kind = _field(head, "WARC-Type")
    payload = _payload(F.col("value"), F.col("head_bytes"), F.col("length"))
    stated = F.regexp_replace(_field(head, "WARC-Payload-Digest"), "(?i)^sha256:", "")
    return df.withColumns({
        "page_id": page,
        "url": _field(head, "WARC-Target-URI"),
        "record_type": kind,
        "refers_to": refers,
        "payload": payload,
        "payload_bytes": F.when(kind == "revisit", _field(head, "X-Payload-Length").try_cast("bigint")).otherwise(F.octet_length(payload).cast("long")),
        "payload_digest": F.when(kind == "revisit", stated).otherwise(F.sha2(payload, 256)),
    })


RESULT = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]


def reachable(spark: SparkSession, candidates: DataFrame) -> DataFrame:
    """The (file, offset) of the candidates (file, offset, next_offset: of the piece after it, succ) that a chain from offset 0 reaches."""
    jumped = candidates.where("succ is not null and not succ <=> next_offset").select("file", F.col("succ").alias("offset")).distinct().withColumn("landing", F.lit(True))
    order = Window.partitionBy("file").orderBy("offset")
    marked = candidates.join(jumped, ["file", "offset"], "left")
    chained = F.coalesce(F.lag("succ").over(order) == F.col("offset"), F.lit(False)) & F.col("landing").isNull()
    runs = marked.withColumn("run", F.sum(F.when(chained, 0).otherwise(1)).over(order))
    runs = materialise(runs.select("file", "run", "offset", "succ"), "warc-runs")
    nodes = runs.groupBy("file", "run").agg(F.min("offset").alias("head"), F.max(F.struct("offset", "succ"))["succ"].alias("to"))
    nodes = materialise(nodes.select("file", F.col("head").alias("at"), "to"), "warc-nodes")
    most = nodes.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    reach, jump = nodes.where("at = 0").select("file", "at"), nodes
    for _ in range(math.ceil(math.log2(most)) if most > 1 else 0):
        forward = jump.select("file", "at", "to")
        more = reach.join(forward, ["file", "at"]).select("file", F.col("to").alias("at")).join(nodes.select("file", "at"), ["file", "at"], "left_semi")
        reach = materialise(reach.unionByName(more).distinct(), "warc-reach")
        hop = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = materialise(jump.join(hop, ["file", "to"]).select("file", "at", F.col("far").alias("to")), "warc-jump")
    heads = runs.groupBy("file", "run").agg(F.min("offset").alias("at")).join(reach, ["file", "at"], "left_semi")
    return runs.join(heads.select("file", "run"), ["file", "run"], "left_semi").select("file", "offset")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Columns RESULT, and payload (binary) if wanted, one row for each true record."""
    pieces = _pieces(spark, path)
    body = _body(F.col("value"))
    seen = _described(pieces.withColumns(body))
    keep = [*RESULT, "payload"] if payloads else RESULT
    # payloads stay out of the index: it is sorted file by file
    index = seen.select("file", "block", "seq", "bytes", "head_bytes", "length", *RESULT)
    index = _offsets(materialise(index, "warc-index"))
    order = Window.partitionBy("file").orderBy("offset")
    end = len(MAGIC) + F.col("head_bytes") + F.col("length") + len(BREAK)
    cand = index.withColumn("next_offset", F.lead("offset").over(order)).where("offset >= 0")
    cand = cand.withColumn("succ", F.col("offset") + end).withColumn("whole", len(MAGIC) + F.col("bytes") >= end)
    cand = materialise(cand, "warc-candidates")
    # the first magic has to stand at the file's start
    true = reachable(spark, cand.select("file", "offset", "next_offset", "succ"))
    found = materialise(cand.join(true, ["file", "offset"], "left_semi"), "warc-records").where("length is not null")

    torn = found.where("not whole")
    again_files = materialise(torn.select("file").distinct(), "warc-torn")
    whole = found.where("whole")
    if payloads:
        # the same files in the same splits: seq may differ, offsets do not
        valued = _offsets(_described(pieces.withColumns(body)).select("file", "block", "seq", "bytes", "payload"))
        whole = whole.drop("payload").join(valued.select("file", "offset", "payload"), ["file", "offset"])
    if not again_files.take(1):
        return whole.select(*keep)
    parts = _offsets(pieces.join(again_files, "file", "left_semi")).where("offset >= 0").select("file", "offset", "value")
    starts = found.select("file", "offset", F.lit(True).alias("start"), F.col("whole").alias("rec_whole"), "succ")
    upto = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.join(starts, ["file", "offset"], "left")
    parts = parts.withColumn("rec", F.last(F.when(F.col("start"), F.struct("offset", "succ", "rec_whole")), ignorenulls=True).over(upto))
    parts = parts.where("rec is not null and not rec.rec_whole and offset < rec.succ")
    joined = parts.groupBy("file", F.col("rec.offset").alias("at")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC).alias("value"))
    joined = joined.withColumns(_body(F.col("value")))
    joined = joined.where(F.octet_length("value") >= F.col("head_bytes") + F.col("length"))
    return whole.select(*keep).unionByName(_described(joined).select(*keep))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    with scratch(spark):
        write_warc(table(spark, sf_dir, "pages"), path)
        got = read_warc(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        got = materialise(got, "warc-result", keep=True)
    drop_path(spark, path)
    return got


ORACLE = r"""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h))::bigint as payload_bytes, sha256(h) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d group by payload_digest)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from d join f using (payload_digest)
"""
