"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.shipping import ship

_facts: dict[tuple[str, str], DataFrame] = {}

#: While a table is written: HotSpot never compiles a method of over 8,000 bytes, so that Spark generates small ones for such a stage.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where none is set, a temporary folder if all runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^,\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='granary-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder.

    Enriched columns are long CASE ladders: a filter on one would be pushed below the projections that make it, with
    every ladder substituted into the next.  Written once, filters and column pruning reach a scan instead.
    """
    spark = df.sparkSession
    ship(spark)
    path = shared_path(spark, name)
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, by: str, name: str) -> DataFrame:
    """df, written, with the rank of each row (from 0) in the order of by, whose values differ: a sorted, range-partitioned pass."""
    held = written(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("rank_id", F.monotonically_increasing_id()), "ranked")
    # the id is a partition's number and a number within it: what earlier partitions hold is added instead, one row for each partition
    part = F.shiftright("rank_id", 33)
    before = Window.orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy(part.alias("rank_part")).count().select("rank_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("rank_before"))
    placed = held.join(F.broadcast(sizes), part == F.col("rank_part"))
    return placed.withColumn(name, F.col("rank_before") + F.col("rank_id").bitwiseAND((1 << 33) - 1)).drop("rank_id", "rank_part", "rank_before")


def once(spark: SparkSession, key: str, build) -> DataFrame:
    """The table that build() makes, written once for an application."""
    at = (spark.sparkContext.applicationId, key)
    if at not in _facts:
        _facts[at] = written(build(), "facts")
    return _facts[at]
