"""Counts over the fleet and over time."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, GroupedData, Window
from pyspark.sql import functions as F


def prevalence(installed: DataFrame) -> DataFrame:
    return installed.groupBy("ecosystem", "name").agg(F.count_distinct("asset_id").alias("n_assets"), F.count_distinct("version").alias("n_versions"))


def _per_asset(findings: DataFrame, *also: str) -> DataFrame:
    """(asset_id, also, n_findings), of findings with a row for each advisory or of counted ones (inventory.count_vulnerabilities)."""
    n = F.sum("n_advisories") if "n_advisories" in findings.columns else F.count(F.lit(1))
    return findings.groupBy("asset_id", *also).agg(n.alias("n_findings"))


def _counts(findings: DataFrame, assets: DataFrame, grouped: Callable[[DataFrame], GroupedData]) -> DataFrame:
    """What is grouped, or cubed, is a row for each asset and severity, not for each finding."""
    return grouped(_per_asset(findings, "severity").join(assets, "asset_id")).agg(F.sum("n_findings").alias("n_findings"), F.count_distinct("asset_id").alias("n_assets"))


def severity_rollup(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """By site and severity, with subtotals (nulls)."""
    return _counts(findings, assets, lambda rows: rows.rollup("site_id", "severity"))


def severity_cube(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """By kind of asset and severity, with all subtotals (nulls)."""
    return _counts(findings, assets, lambda rows: rows.cube("asset_kind", "severity"))


def top_exposed(findings: DataFrame, n: int) -> DataFrame:
    return _per_asset(findings).orderBy(F.desc("n_findings"), "asset_id").limit(n)


def top_per_site(findings: DataFrame, assets: DataFrame, k: int) -> DataFrame:
    """The k assets with most findings of each site; ties stay."""
    n = _per_asset(findings).join(assets.select("asset_id", "site_id"), "asset_id")
    w = Window.partitionBy("site_id").orderBy(F.desc("n_findings"))
    return n.withColumn("place", F.rank().over(w)).where(F.col("place") <= k)


def scan_gap(scans: DataFrame) -> DataFrame:
    """Every scan with the asset's scan before it."""
    w = Window.partitionBy("asset_id").orderBy("scanned_at", "scan_id")
    return scans.withColumns({"previous_scan": F.lag("scan_id").over(w), "days": F.date_diff("scanned_at", F.lag("scanned_at").over(w))})


def rolling_scan_count(scans: DataFrame) -> DataFrame:
    """Scans among each scan and the two before it."""
    w = Window.partitionBy("asset_id").orderBy("scanned_at", "scan_id").rowsBetween(-2, 0)
    return scans.withColumn("n_recent", F.count("scan_id").over(w))


def weekly_coverage(scans: DataFrame) -> DataFrame:
    return scans.groupBy(F.date_trunc("week", "scanned_at").alias("week")).agg(F.count(F.lit(1)).alias("n_scans"), F.count_distinct("asset_id").alias("n_assets"))


def approx_versions(installed: DataFrame, error: float = 0.05) -> DataFrame:
    """About how many versions each asset has; error: the relative standard deviation that the sketch allows.

    Of very many assets some lie several deviations off, so the sketch is four times as fine as error asks: three times
    error are then twelve deviations. Few versions (up to about a tenth of the registers) are kept as they are.
    """
    log_k = min(21, max(4, math.ceil(2 * math.log2(4 * 1.04 / error))))
    n = F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg("version", F.lit(log_k))), F.lit(0).cast("long"))
    return installed.groupBy("asset_id").agg(n.alias("n_versions"))


def version_sketches(installed: DataFrame, *keys: str, log_k: int = 12) -> DataFrame:
    """(keys, sketch): the distinct versions of each group as a HyperLogLog sketch, to be stored; later days add rows, none is counted anew.

    log_k: a sketch has at most 2^log_k registers, and its relative standard deviation is about 1.04 / sqrt(2^log_k).
    """
    return installed.groupBy(*keys).agg(F.hll_sketch_agg("version", F.lit(log_k)).alias("sketch"))


def merged_versions(sketches: DataFrame, *keys: str) -> DataFrame:
    """About how many versions each group of keys has over all its stored sketches. A version of several days counts once."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_versions"))


def version_sets(installed: DataFrame, *keys: str) -> DataFrame:
    """(keys, version): the distinct versions of each group, to be stored where an estimate is not enough."""
    return installed.select(*keys, "version").distinct()


def merged_sets(sets: DataFrame, *keys: str) -> DataFrame:
    """Exactly how many versions each group of keys has over all its stored sets. A version of several days counts once."""
    return sets.groupBy(*keys).agg(F.count_distinct("version").alias("n_versions"))


def daily_uploads(events: DataFrame) -> DataFrame:
    """Tumbling days of ts (a timestamp) and event_type; batch or stream."""
    return events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def sliding_uploads(events: DataFrame) -> DataFrame:
    """Windows of two days that start every day."""
    return events.groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def upload_sessions(events: DataFrame, *also: str) -> DataFrame:
    """A user's events with gaps under six hours; also: further columns that keep sessions apart."""
    s = events.groupBy("user_id", *also, F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", *also, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
