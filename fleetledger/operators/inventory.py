"""What is installed where, and what is known against it."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetledger.functions.versions import parsed, version_key


def latest_scan(scans: DataFrame) -> DataFrame:
    """The last scan of each asset; of those at one time the one with the largest scan_id."""
    w = Window.partitionBy("asset_id").orderBy(F.desc("scanned_at"), F.desc("scan_id"))
    return scans.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def inventory(scans: DataFrame, contents: DataFrame, catalog: DataFrame) -> DataFrame:
    """Distinct packages of each asset's last scan, from contents (scan_id, pkg_id, version) and catalog (pkg_id, ecosystem, name).

    Contents meet the last scans first, so only theirs go on to the catalog. Keys are made after the distinct: arrays
    are neither shuffled nor compared.
    """
    # last scans are one row an asset: hashed, so a task neither sorts nor holds its share of all contents
    last = contents.join(latest_scan(scans).select("scan_id", "asset_id").hint("shuffle_hash"), "scan_id")
    found = last.join(catalog, "pkg_id").select("asset_id", "scan_id", "ecosystem", "name", "version").distinct()
    return found.withColumn("vkey", version_key(F.col("version")))


def advisory_ranges(advisories: DataFrame, *also: str, ids: bool = True) -> DataFrame:
    """Advisories that differ in nothing but their id as one row with n_advisories, and with their ids unless ids is false.

    Many advisories name one package with one range; so installed packages meet each range once, whatever their number.
    """
    same = ["ecosystem", "name", *also, "introduced", "fixed", "ikey", "fkey", "severity"]
    # in structs, as collect_list leaves nulls out; as plain strings the ids are cheaper to explode
    listed = [F.transform(F.collect_list(F.struct("advisory_id")), lambda x: x["advisory_id"]).alias("advisory_ids")] if ids else []
    return advisories.groupBy(*same).agg(F.count(F.lit(1)).alias("n_advisories"), *listed)


def match_ranges(installed: DataFrame, ranges: DataFrame, *also: str, key: str | None = None) -> DataFrame:
    """Pairs of equal ecosystem and name with the version in [introduced, fixed); no fix: no upper end. ranges: see advisory_ranges.

    An equi-join with a range on the keys. Spark broadcasts the ranges if they measure small, else both sides are
    shuffled by (ecosystem, name) and adaptive execution splits packages that very many assets have. Versions that can't
    be ordered match nothing and are in unparsed(); this is asked of candidates only, as a filter it would be pushed to every row scanned.
    also: further columns that must be equal. key: a column of both sides that is equal wherever these columns are; then
    rows meet by it alone, and the columns are compared where they meet.
    """
    i, a = installed.alias("i"), ranges.alias("a")
    inside = (F.col("i.vkey") >= F.col("a.ikey")) & (F.col("a.fkey").isNull() | (F.col("i.vkey") < F.col("a.fkey")))
    equal = lambda *columns: reduce(and_, [F.col(f"i.{c}") == F.col(f"a.{c}") for c in columns])
    same, ok = equal("ecosystem", "name", *also), parsed(F.col("i.vkey"))
    within = equal(key) & F.when(same & ok, inside).otherwise(False) if key else same & F.when(ok, inside).otherwise(False)
    rest = [F.col(f"a.{c}") for c in ranges.columns if c not in ("ecosystem", "name", "ikey", key, *also)]
    return i.join(a, within).select("i.*", *rest)


def match_vulnerabilities(installed: DataFrame, advisories: DataFrame, *also: str, key: str | None = None) -> DataFrame:
    """match_ranges with a row for each advisory. Where only their number counts, count_vulnerabilities has fewer rows."""
    ranges = advisory_ranges(advisories, *also, *([key] if key else []))
    found = match_ranges(installed, ranges, *also, key=key)
    return found.select(*installed.columns, F.explode("advisory_ids").alias("advisory_id"), "introduced", "fixed", "fkey", "severity")


def count_vulnerabilities(installed: DataFrame, advisories: DataFrame) -> DataFrame:
    """Each installed package with every range that it is in, and the number n_advisories of the advisories with this range and severity."""
    return match_ranges(installed, advisory_ranges(advisories, ids=False))


def store_bucketed(packages: DataFrame, advisories: DataFrame, name: str, path: str, buckets: int = 64, spread: int = 4) -> tuple[str, str]:
    """Store packages and advisories as tables in buckets of (ecosystem, name, part); their two names, for match_bucketed.

    part deals the rows of one package to spread buckets, by all their columns, so a package that very many scans hold is
    no one task's. Each advisory is stored spread times. Buckets go by cell, a number made of the three columns: dealing,
    sorting and meeting compare one number instead of texts. Keys of versions are made after the shuffle. path: a folder
    that all executors share.
    """
    spark = packages.sparkSession
    rest = [c for c in packages.columns if c not in ("ecosystem", "name", "vkey")]
    have = packages.drop("vkey").withColumn("part", F.pmod(F.xxhash64(*rest), F.lit(spread)).cast("int"))
    known = advisories.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    dealt = lambda rows: rows.withColumn("cell", F.xxhash64("ecosystem", "name", "part")).repartition(buckets, "cell").sortWithinPartitions("cell")
    for side, rows in {"packages": dealt(have).withColumn("vkey", version_key(F.col("version"))), "advisories": dealt(known)}.items():
        # sorted by now, not by sortBy, whose sort makes a row's bucket anew at each comparison; readers sort what is in order, at little cost
        rows.write.bucketBy(buckets, "cell").option("path", f"{path}/{side}").saveAsTable(f"{name}_{side}")
    return f"{name}_packages", f"{name}_advisories"


def match_bucketed(packages: str, advisories: str, where: str = "true") -> DataFrame:
    """match_vulnerabilities of two stored tables; where: a condition on the advisories. Buckets meet where they lie: nothing is shuffled."""
    spark = SparkSession.getActiveSession()
    return match_vulnerabilities(spark.table(packages), spark.table(advisories).where(where), "part", key="cell").drop("part", "cell")


def unparsed(installed: DataFrame, advisories: DataFrame) -> DataFrame:
    """Installed packages that an advisory names but whose versions can't be ordered: neither affected nor unaffected."""
    named = installed.join(advisories.select("ecosystem", "name").distinct(), ["ecosystem", "name"], "left_semi")
    return named.where(F.col("vkey").isNull() | ~parsed(F.col("vkey")))


def asset_kinds(hosts: DataFrame, images: DataFrame) -> DataFrame:
    """Hosts and container images in one relation."""
    return hosts.withColumn("asset_kind", F.lit("host")).unionByName(images.withColumn("asset_kind", F.lit("image")))


def critical_assets(assets: DataFrame, findings: DataFrame) -> DataFrame:
    return assets.join(findings.where("severity = 'CRITICAL'"), "asset_id", "left_semi")


def unaffected_assets(assets: DataFrame, findings: DataFrame) -> DataFrame:
    return assets.join(findings, "asset_id", "left_anti")


def undecided_assets(assets: DataFrame, findings: DataFrame, undecided: DataFrame) -> DataFrame:
    """Assets without a finding of which nothing can be said: an advisory names a package of theirs, whose version is in unparsed()."""
    return unaffected_assets(assets, findings).join(undecided, "asset_id", "left_semi")


def unknown_packages(installed: DataFrame, advisories: DataFrame) -> DataFrame:
    """Packages that no advisory names."""
    return installed.select("ecosystem", "name").distinct().join(advisories, ["ecosystem", "name"], "left_anti")


def stale_assets(assets: DataFrame, scans: DataFrame, cutoff: str) -> DataFrame:
    """Assets whose last scan is missing or before the cut-off."""
    last = scans.groupBy("asset_id").agg(F.max("scanned_at").alias("last_seen"))
    return assets.join(last, "asset_id", "left").where(F.col("last_seen").isNull() | (F.col("last_seen") < F.to_timestamp_ntz(F.lit(cutoff))))


def not_scanned_since(assets: DataFrame, scans: DataFrame, cutoff: str) -> DataFrame:
    return assets.join(scans.where(F.col("scanned_at") >= F.to_timestamp_ntz(F.lit(cutoff))), "asset_id", "left_anti")


def upgrade_plan(installed: DataFrame, advisories: DataFrame) -> DataFrame:
    """For each asset's package the highest fixed version among what matches now, and how many have no fix."""
    f = count_vulnerabilities(installed, advisories)
    unfixed = F.sum(F.when(F.col("fkey").isNull(), F.col("n_advisories")).otherwise(0))
    return f.groupBy("asset_id", "ecosystem", "name", "version").agg(F.max_by(F.when(F.col("fkey").isNotNull(), F.col("fixed")), "fkey").alias("upgrade_to"), unfixed.alias("n_unfixed"))
