"""An extension: statements that land in a folder are parsed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import url_decode
from granary.sources.statements import parse_statements


def parsed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of parsed rows; statements stay whole, one file is one row until it is parsed."""
    files = spark.readStream.option("pathGlobFilter", "*.{txt,md}").text(folder, wholetext=True)
    return parse_statements(files.select(url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)).alias("name"), F.col("value").alias("text")))
