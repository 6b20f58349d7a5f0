"""Readers: files, vendor lists, rule policies, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import strip

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"

# The default policy of the rules.
DEFAULT_POLICY: dict[str, dict] = {
    "mandatory_fields": {"params": {"required": ["invoice_number", "invoice_date", "vendor_name", "total"]}},
    "invoice_number_format": {"params": {"min_length": 3, "max_length": 40}},
    "currency_valid": {"params": {"allowed": ["USD", "EUR", "GBP", "INR", "AUD", "CAD", "SGD", "JPY"]}},
    "invoice_total_arithmetic": {"params": {"tolerance": 0.01}},
    "subtotal_matches_line_items": {"params": {"tolerance": 0.01}},
    "line_item_amount_consistency": {"params": {"tolerance": 0.01}},
    "tax_percentage_plausible": {"params": {"max_percent": 30.0, "known_rates": [0, 5, 8, 12, 18, 20, 28], "rate_tolerance": 0.6}},
    "negative_quantity": {"params": {"allow_zero": False}},
    "future_date": {"params": {"grace_days": 1}},
    "stale_date": {"params": {"max_age_days": 365}},
    "vendor_known": {"severity": "warning"},
}


def files(spark: SparkSession, path: str) -> DataFrame:
    """All files below a folder: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def sized_files(spark: SparkSession, path: str, max_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Files of at most ``max_bytes`` with their content, and the others without it.

    The length is a filter of the scan: content of a larger file is never read, so one that no
    row could hold is told by its size as well.
    """
    found = files(spark, path)
    return found.where(F.col("length") <= max_bytes), found.where(F.col("length") > max_bytes).select("path", "modificationTime", "length")


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as files arrive."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema(BINARY_FILE).load(path)


def vendors(spark: SparkSession, path: str) -> DataFrame:
    """One vendor a line, trimmed; empty lines are left out. Column ``vendor_name``."""
    name = strip(F.col("value"))
    return spark.read.text(path).select(name.alias("vendor_name")).where("vendor_name <> ''")


def policy(spark: SparkSession, path: str) -> dict[str, dict]:
    """The rules' settings from a JSON or YAML file with a key ``rules``; a missing file is an error."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith(".json"):
        import json

        return json.loads(text)["rules"]
    import yaml

    return yaml.safe_load(text)["rules"]


def policy_table(spark: SparkSession, settings: dict[str, dict]) -> DataFrame:
    """``rule_id, enabled, severity``: what of the policy applies to finished results."""
    rows = [(k, v.get("enabled", True), v.get("severity")) for k, v in sorted(settings.items())]
    return spark.createDataFrame(rows, "rule_id string, enabled boolean, severity string")


def table(spark: SparkSession, path: str, key: str | None = None, value=None) -> DataFrame:
    """A stored table, or its rows with a key (pushed down to the files)."""
    df = spark.read.parquet(path)
    return df if key is None else df.where(F.col(key) == value)
