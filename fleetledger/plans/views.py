"""The logical tables of a fleet, from the tables at hand: customers stand for assets, orders for scans, parts for packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetledger.functions.versions import version_key
from fleetledger.operators import inventory as inv
from fleetledger.sources.advisories import keyed


class Fleet:
    """Lazy views over the Parquet tables in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def assets(self) -> DataFrame:
        return self.table("customer").selectExpr("c_custkey AS asset_id", "c_name AS hostname", "c_nationkey AS site_id", "CASE WHEN c_custkey % 3 = 0 THEN 'image' ELSE 'host' END AS asset_kind")

    @property
    def scans(self) -> DataFrame:
        return self.table("orders").selectExpr("o_orderkey AS scan_id", "o_custkey AS asset_id", "o_orderdate AS scanned_at")

    @property
    def contents(self) -> DataFrame:
        """What each scan holds, by number."""
        version = "concat(l_linenumber, '.', cast(l_quantity AS int), '.', cast(round(l_discount * 100) AS int)) AS version"
        return self.table("lineitem").selectExpr("l_orderkey AS scan_id", "l_partkey AS pkg_id", version)

    @property
    def catalog(self) -> DataFrame:
        """What the numbers stand for."""
        return self.table("part").selectExpr("p_partkey AS pkg_id", "p_type AS ecosystem", "concat(p_name, '/', p_brand) AS name")

    @property
    def packages(self) -> DataFrame:
        rows = self.contents.join(self.catalog, "pkg_id").select("scan_id", "pkg_id", "ecosystem", "name", "version")
        return rows.withColumn("vkey", version_key(F.col("version")))

    @property
    def raw_advisories(self) -> DataFrame:
        return self.table("part").where("p_partkey % 5 = 0").selectExpr(
            "concat('ADV-', p_partkey) AS advisory_id", "p_type AS ecosystem", "concat(p_name, '/', p_brand) AS name", "concat(p_size % 3 + 1, '.0.0') AS introduced",
            "CASE WHEN p_size % 7 = 0 THEN NULL ELSE concat(p_size % 3 + 2 + p_size % 2, '.', p_size % 20, '.0') END AS fixed",
            "CASE WHEN p_size < 5 THEN 'CRITICAL' WHEN p_size < 15 THEN 'HIGH' WHEN p_size < 35 THEN 'MEDIUM' ELSE 'LOW' END AS severity",
        )

    @property
    def advisories(self) -> DataFrame:
        return keyed(self.raw_advisories)

    @property
    def inventory(self) -> DataFrame:
        return inv.inventory(self.scans, self.contents, self.catalog)

    @property
    def findings(self) -> DataFrame:
        return inv.match_vulnerabilities(self.inventory, self.advisories)

    @property
    def counted_findings(self) -> DataFrame:
        """findings without their ids: a row for each range, with the number of its advisories."""
        return inv.count_vulnerabilities(self.inventory, self.advisories)

    @property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def enrolments(self) -> DataFrame:
        return self.events.where("event_type = 'signup'")

    def register(self) -> None:
        """Temporary views for queries in SQL."""
        for name in ("assets", "scans", "packages", "advisories", "inventory", "findings"):
            getattr(self, name).createOrReplaceTempView(name)


#: The same views for DuckDB.
SQL = """
WITH assets AS (SELECT c_custkey AS asset_id, c_name AS hostname, c_nationkey AS site_id, CASE WHEN c_custkey % 3 = 0 THEN 'image' ELSE 'host' END AS asset_kind FROM customer),
scans AS (SELECT o_orderkey AS scan_id, o_custkey AS asset_id, o_orderdate AS scanned_at FROM orders),
packages0 AS (SELECT l_orderkey AS scan_id, l_partkey AS pkg_id, p_type AS ecosystem, concat(p_name, '/', p_brand) AS name,
  concat(l_linenumber, '.', cast(l_quantity AS int), '.', cast(round(l_discount * 100) AS int)) AS version FROM lineitem JOIN part ON l_partkey = p_partkey),
packages AS (SELECT *, list_transform(string_split(version, '.'), lambda x: cast(x AS int)) AS vkey FROM packages0),
advisories0 AS (SELECT concat('ADV-', p_partkey) AS advisory_id, p_type AS ecosystem, concat(p_name, '/', p_brand) AS name, concat(p_size % 3 + 1, '.0.0') AS introduced,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE concat(p_size % 3 + 2 + p_size % 2, '.', p_size % 20, '.0') END AS fixed,
  CASE WHEN p_size < 5 THEN 'CRITICAL' WHEN p_size < 15 THEN 'HIGH' WHEN p_size < 35 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM part WHERE p_partkey % 5 = 0),
advisories AS (SELECT *, list_transform(string_split(introduced, '.'), lambda x: cast(x AS int)) AS ikey, list_transform(string_split(fixed, '.'), lambda x: cast(x AS int)) AS fkey FROM advisories0),
latest AS (SELECT scan_id, asset_id, scanned_at FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY scanned_at DESC, scan_id DESC) AS rn FROM scans) WHERE rn = 1),
inventory AS (SELECT DISTINCT asset_id, scan_id, ecosystem, name, version, vkey FROM latest JOIN packages USING (scan_id)),
findings AS (SELECT i.*, advisory_id, introduced, fixed, fkey, severity FROM inventory i JOIN advisories a ON i.ecosystem = a.ecosystem AND i.name = a.name AND vkey >= ikey AND (fkey IS NULL OR vkey < fkey)),
enrolments AS (SELECT * FROM events WHERE event_type = 'signup')
"""
