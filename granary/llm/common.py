"""What the corpus operators share: reading tables, and tables written to the shared folder."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from granary.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where none is set, a temporary one if all runs in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^,\]]*)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='granary-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/granary/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


def materialise(df: DataFrame, name: str, keep: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back.

    It cuts the lineage: a lost executor costs only a re-read.  The table's
    size is known to the planner from then on, so that later joins broadcast
    it only under spark.sql.autoBroadcastJoinThreshold.  Within scratch() the table goes with
    that block, or with the one so many blocks around it as keep says.
    """
    ship(df.sparkSession)
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if len(_scopes) > keep:
        _scopes[-1 - keep].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, keep: int = 0) -> DataFrame:
    """As materialise, as a table bucketed by key: joins on it deal out only the other side."""
    spark = df.sparkSession
    ship(spark)
    path, held = shared_path(spark, name), f"granary_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(held)
    if len(_scopes) > keep:
        _scopes[-1 - keep] += [path, held]
    return spark.table(held)


#: While an operator runs: rows of whole texts or shingles go to Python in small batches.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256"}


#: HotSpot never compiles a method of over 8,000 bytes: Spark generates small ones for such a stage.
SMALL_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


@contextmanager
def scratch(spark: SparkSession, more: dict[str, str] | None = None) -> Iterator[None]:
    """Tables written inside, with SETTINGS and these more, are deleted at the end; shuffles that nothing refers to any more may go with them."""
    ship(spark)
    _scopes.append([])
    settings = SETTINGS | (more or {})
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        for made in _scopes.pop():
            if "/" in made:
                drop_path(spark, made)
            else:
                spark.sql(f"drop table if exists {made}")
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, longer where df has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate files that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
