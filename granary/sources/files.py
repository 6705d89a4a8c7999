"""Statement files in folders: listed without their contents, chosen by their names, and only the chosen ones read.

Roots come in order of preference; one that does not exist has no files.  Files lie directly in a root, those in
subfolders are left out, and names that start with a dot or an underscore are hidden, as in every Spark source.  A file that cannot be opened or is
no UTF-8 gives a row with ``error`` and an empty text, and the rest goes on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import url_decode
from granary.operators.coverage import expectations
from granary.shipping import ship
from granary.sources.settings import _at
from granary.sources.statements import parse_statements, statement_meta, unique_statements

SUFFIXES = ("pdf", "md", "txt")
LISTED = "path string, length long, root int"
#: Texts of so many files are held at once.
FILES_A_FRAME = 32


def named(path: Column) -> dict[str, Column]:
    """file, stem and ext of a path."""
    file = F.regexp_extract(path, r"([^/]+)$", 1)
    return {"file": file, "stem": F.regexp_replace(file, r"(?<=.)\.[^.]*$", ""), "ext": F.lower(F.regexp_extract(file, r"(?<=.)\.([^.]*)$", 1))}


def list_statements(spark: SparkSession, *roots: str) -> DataFrame:
    """path, length, root (its number), file, stem, ext and drop (whether in the first root) of the files in roots."""
    found = []
    for number, root in enumerate(roots):
        fs, at = _at(spark, root)
        if fs.exists(at):
            folder = fs.makeQualified(at).toString()
            # without the column content no file is opened; a recursive listing takes no subfolder k=v for a partition
            got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.lit(number).alias("root"))
            found.append(got.where(F.regexp_replace("path", r"/[^/]*$", "") == folder))
    listed = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], LISTED)
    return listed.withColumns(named(F.col("path"))).withColumn("drop", F.col("root") == 0).where(F.col("ext").isin(*SUFFIXES))


def _pdf_text(body: bytes) -> str:
    """The text layers of a PDF, pages joined by newlines, where a reader is installed."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError:
        raise ValueError("no reader of PDF files is installed; give its text layer as .txt") from None
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(body)).pages)


def _body(path: str) -> bytes:
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        where, name = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        host, _, name = rest.lstrip("/").partition("/")
        where, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
        name = f"{base.rstrip('/')}/{name}"
    with where.open_input_stream(name) as stream:
        return stream.read()


def read_statements(chosen: DataFrame) -> DataFrame:
    """name, text and error of the files of a listing: each is opened by the task that has its row, one at a time."""
    ship(chosen.sparkSession)
    spread = chosen.select("path", url_decode(F.col("file")).alias("name")).repartition("path")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), FILES_A_FRAME):
                rows = []
                for path, name in frame.iloc[lo : lo + FILES_A_FRAME][["path", "name"]].itertuples(index=False):
                    try:
                        body = _body(path)
                        rows.append((name, _pdf_text(body) if body.startswith(b"%PDF") else body.decode("utf-8"), None))
                    except Exception as error:  # one bad file is a row of its own, not the job's end
                        rows.append((name, "", f"{type(error).__name__}: {error}"))
                yield pd.DataFrame(rows, columns=["name", "text", "error"])

    return spread.mapInPandas(read, "name string, text string, error string")


def statements_in(spark: SparkSession, *roots: str, folders: bool = True) -> DataFrame:
    """Parsed rows of the one file that counts for each statement; folders: whether the first root goes before the others."""
    return parse_statements(read_statements(unique_statements(list_statements(spark, *roots), folders=folders)))


def statement_coverage(listed: DataFrame, counts: dict[str, int] | None = None, exact: dict[str, list[str]] | None = None) -> DataFrame:
    """Each month's statements of a listing, one file for each, held against the accounts that are expected; names that are no statement's are left out."""
    chosen = unique_statements(listed)
    meta = statement_meta(F.col("stem"))
    rows = chosen.select("stem", meta["statement_month"].alias("month"), meta["account_kind"].alias("kind"), meta["account_last4"].alias("last4"))
    return expectations(rows.where("kind <> 'unknown' and month is not null"), counts, exact)
