"""Differences between scans and feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_asset(marked: DataFrame, contents: DataFrame, catalog: DataFrame, key: str, marks: list[str]) -> DataFrame:
    """For each asset and value of key, which marks its scans (asset_id, scan_id, marks) with that value have: contents are read once."""
    any_of = [F.max(m).alias(m) for m in marks]
    of_packages = marked.join(contents.select("scan_id", "pkg_id"), "scan_id").groupBy("asset_id", "pkg_id").agg(*any_of)
    return of_packages.join(catalog.select("pkg_id", key), "pkg_id").groupBy("asset_id", key).agg(*any_of)


def scan_diff(scans: DataFrame, contents: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """added, removed and kept values of key between the last two scans of every asset that has two."""
    w = Window.partitionBy("asset_id").orderBy(F.desc("scanned_at"), F.desc("scan_id"))
    placed = scans.select("asset_id", "scan_id", F.row_number().over(w).alias("place"), F.lead("scan_id").over(w).isNotNull().alias("has_older"))
    both = placed.where("place = 1 AND has_older OR place = 2").select("asset_id", "scan_id", (F.col("place") == 1).alias("now"), (F.col("place") == 2).alias("then"))
    change = F.when(~F.col("then"), "added").when(~F.col("now"), "removed").otherwise("kept")
    return _by_asset(both, contents, catalog, key, ["now", "then"]).select("asset_id", key, change.alias("change"))


def first_seen(scans: DataFrame, contents: DataFrame, catalog: DataFrame, cutoff: str, key: str) -> DataFrame:
    """What an asset's last scan has and none of its scans before the cut-off."""
    w = Window.partitionBy("asset_id").orderBy(F.desc("scanned_at"), F.desc("scan_id"))
    marked = scans.select("asset_id", "scan_id", (F.row_number().over(w) == 1).alias("now"), (F.col("scanned_at") < F.to_timestamp_ntz(F.lit(cutoff))).alias("before"))
    return _by_asset(marked.where("now OR before"), contents, catalog, key, ["now", "before"]).where("now AND NOT before").select("asset_id", key)


def common_host_image(installed: DataFrame, assets: DataFrame) -> DataFrame:
    """Packages that hosts and images both have."""
    of = lambda kind: installed.join(assets.where(F.col("asset_kind") == kind), "asset_id").select("ecosystem", "name")
    return of("host").intersect(of("image"))


def merge_feeds(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()
