"""Sends this package to the executors, for sessions whose workers do not have it on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: a zip of the package's modules goes out with addPyFile."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="granary-")) / "granary.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(home.rglob("*.py")):
            out.write(path, str(path.relative_to(home.parent)))
    context.addPyFile(str(target))
    _sent.add(context.applicationId)
