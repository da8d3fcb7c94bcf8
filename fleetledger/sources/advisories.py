"""Vulnerability data as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetledger.functions.versions import parsed, version_key

SCHEMA = "advisory_id string, ecosystem string, name string, introduced string, fixed string, severity string"


def advisories_read(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Advisories with keys of their bounds. A null fixed means that there is no fix."""
    return keyed(spark.read.schema(SCHEMA).format(form).load(path))


def keyed(rows: DataFrame) -> DataFrame:
    """Advisories whose bounds can be ordered; the others are in unparsed()."""
    ok = parsed(F.col("ikey")) & (F.col("fkey").isNull() | parsed(F.col("fkey")))
    return rows.withColumns({"ikey": version_key(F.col("introduced")), "fkey": version_key(F.col("fixed"))}).where(ok)


def unparsed(rows: DataFrame) -> DataFrame:
    bad = lambda c: c.isNotNull() & ~parsed(version_key(c))
    return rows.where(F.col("introduced").isNull() | bad(F.col("introduced")) | bad(F.col("fixed")))
