"""Settings as files in any store that Spark reaches: category rules and aliases as JSON, overrides as tables; missing or broken ones give the defaults.

A save makes a new version, which appears whole by a rename; the newest is read, the older ones stay.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from granary.functions import fixed
from granary.operators.coverage import KINDS
from granary.operators.overrides import valid_rules
from granary.sources.schemas import CATEGORY_RULE, OVERRIDE


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, length and time of each file of a folder: changes whenever one is written."""
    fs, p = _at(spark, path)
    files, found = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, by Spark's own reader."""
    rows = spark.read.text(path, wholetext=True).collect()
    return rows[0][0] if rows else ""


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and renames it: readers see the old or the new one."""
    fs, p = _at(spark, path)
    _, draft = _at(spark, f"{path}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if fs.exists(p):
        fs.delete(p, False)
    if not fs.rename(draft, p):
        raise OSError(f"cannot write {path}")


class Settings:
    """Versioned settings in a folder: rules-000001.json, overrides-000001 and so on."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self, name: str) -> list[int]:
        fs, p = _at(self.spark, self.folder)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(rf"{name}-(\d+)(?:\.json)?", n)))

    def _newest(self, name: str, end: str = "") -> str | None:
        found = self._versions(name)
        return f"{self.folder}/{name}-{found[-1]:06d}{end}" if found else None

    def _next(self, name: str, end: str = "") -> str:
        return f"{self.folder}/{name}-{max(self._versions(name), default=0) + 1:06d}{end}"

    def _load(self, name: str, default):
        path = self._newest(name, ".json")
        if path is None:
            return default
        try:
            return json.loads(read_text(self.spark, path))
        except ValueError:
            return default

    def rules(self) -> DataFrame:
        """The newest rules as saved, pos their order."""
        rules = [(i, *[r[n] for n in CATEGORY_RULE.fieldNames()]) for i, r in enumerate(self.load_rules())]
        return self.spark.createDataFrame(rules, "pos long, keyword string, category string, necessity string, beneficiary string")

    def load_rules(self) -> list[dict[str, str]]:
        """Valid rules in the file's order; the defaults if there are none.  A settings list, some hundred rows."""
        return self._valid(self._load("rules", []))

    def save_rules(self, rules: list[dict[str, str]]) -> list[dict[str, str]]:
        """Saves valid rules, the defaults if there are none, and gives what was saved."""
        saved = self._valid(rules)
        write_text(self.spark, self._next("rules", ".json"), json.dumps(saved, indent=2))
        return saved

    def _valid(self, rules) -> list[dict[str, str]]:
        rows = [(i, *[str(r.get(n) or d) for n, d in (("keyword", ""), ("category", "Other"), ("necessity", fixed.AUTO), ("beneficiary", fixed.AUTO))]) for i, r in enumerate(rules if isinstance(rules, list) else []) if isinstance(r, dict)]
        df = self.spark.createDataFrame(rows, "pos long, keyword string, category string, necessity string, beneficiary string")
        got = sorted(valid_rules(df, "pos").collect(), key=lambda r: r["pos"])
        return [{n: r[n] for n in CATEGORY_RULE.fieldNames()} for r in got] or fixed.category_rules()

    def load_aliases(self) -> list[tuple[str, str]]:
        return valid_aliases(self._load("aliases", []))

    def save_aliases(self, aliases: list[tuple[str, str]]) -> list[tuple[str, str]]:
        saved = valid_aliases([{"contains": a, "label": b} for a, b in aliases])
        write_text(self.spark, self._next("aliases", ".json"), json.dumps([{"contains": a, "label": b} for a, b in saved], indent=2))
        return saved

    def load_expectations(self) -> tuple[dict[str, int], dict[str, list[str]]]:
        """Expected numbers of accounts, and exact lists of last digits, by kind; what the file does not name is as by default."""
        return valid_expectations(self._load("expectations", {}))

    def save_expectations(self, counts: dict[str, int | None], exact: dict[str, list[str] | None]) -> tuple[dict[str, int], dict[str, list[str]]]:
        raw = {f"expected_{k}_count": n for k, n in counts.items()} | {f"{k}_last4_exact": v for k, v in exact.items()}
        write_text(self.spark, self._next("expectations", ".json"), json.dumps(raw, indent=2))
        return valid_expectations(raw)

    def overrides_path(self) -> str | None:
        """Where the newest overrides lie."""
        return self._newest("overrides")

    def load_overrides(self) -> DataFrame:
        """tx_key and targets, a table: there may be many."""
        path = self.overrides_path()
        return self.spark.read.schema(OVERRIDE).parquet(path) if path else self.spark.createDataFrame([], OVERRIDE)

    def save_overrides(self, overrides: DataFrame) -> None:
        path = self._next("overrides")
        draft = f"{self.folder}/draft-overrides"
        overrides.select(*OVERRIDE.fieldNames()).write.mode("overwrite").parquet(draft)
        fs, p = _at(self.spark, path)
        if not fs.rename(_at(self.spark, draft)[1], p):
            raise OSError(f"cannot write {path}")

    def import_overrides(self, path: str) -> None:
        """Saves overrides of a JSON file {tx_key: {category, necessity, beneficiary}}; entries of other forms are left out."""
        try:
            raw = json.loads(read_text(self.spark, path))
        except ValueError:
            raw = {}
        rows = [(" ".join(k.split()), v.get("category"), v.get("necessity") or fixed.AUTO, v.get("beneficiary") or fixed.AUTO) for k, v in (raw.items() if isinstance(raw, dict) else []) if isinstance(v, dict)]
        self.save_overrides(self.spark.createDataFrame(rows, OVERRIDE))


def valid_aliases(raw) -> list[tuple[str, str]]:
    """(contains, label) of a list of such objects; those without either are left out."""
    clean = lambda v: " ".join(str(v or "").split())
    return [(clean(r.get("contains")).lower(), clean(r.get("label"))) for r in (raw if isinstance(raw, list) else []) if isinstance(r, dict) and clean(r.get("contains")) and clean(r.get("label"))]


def valid_expectations(raw) -> tuple[dict[str, int], dict[str, list[str]]]:
    """(counts, exact) by kind of an object with expected_<kind>_count and <kind>_last4_exact; null says that nothing is expected, other values count as absent."""
    raw = raw if isinstance(raw, dict) else {}
    counts, exact = dict(fixed.EXPECTED_ACCOUNTS), {}
    for kind in KINDS:
        n, digits = raw.get(f"expected_{kind}_count", ""), raw.get(f"{kind}_last4_exact")
        if n is None or isinstance(n, int) and not isinstance(n, bool):
            counts[kind] = n
        if isinstance(digits, list):
            exact[kind] = [str(d) for d in digits]
    return {k: n for k, n in counts.items() if n is not None}, exact


def write_csv(df: DataFrame, path: str) -> None:
    """Every value quoted, quotes doubled."""
    df.write.mode("overwrite").option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)
