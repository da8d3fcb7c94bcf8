"""SPDX JSON documents: reading, writing, and one row per package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Field names of SPDX 2.x JSON, in this one place.
PACKAGE = T.StructType([T.StructField("name", T.StringType()), T.StructField("versionInfo", T.StringType()), T.StructField("SPDXID", T.StringType()), T.StructField("primaryPackagePurpose", T.StringType())])
DOCUMENT = T.StructType([
    T.StructField("spdxVersion", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("creationInfo", T.StructType([T.StructField("created", T.StringType())])),
    T.StructField("packages", T.ArrayType(PACKAGE)),
])
CORRUPT = "_corrupt_record"
READ_SCHEMA = T.StructType([*DOCUMENT.fields, T.StructField(CORRUPT, T.StringType())])


def sbom_read(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """One row per document with its file; a broken document has its text in _corrupt_record and nulls elsewhere.

    multi_line: a file is one document. Otherwise every line is one, and large files are split among tasks.
    """
    return spark.read.schema(READ_SCHEMA).option("multiLine", multi_line).option("columnNameOfCorruptRecord", CORRUPT).json(path).withColumn("file", F.col("_metadata.file_path"))


def packages(docs: DataFrame, keep: tuple[str, ...] = (), empty: bool = False) -> DataFrame:
    """A row per package: name of the document, name and version of the package. empty: keep documents without one."""
    one = (F.explode_outer if empty else F.explode)("packages").alias("p")
    docs = docs.where(F.col(CORRUPT).isNull()) if CORRUPT in docs.columns else docs
    return docs.select(*keep, F.col("name").alias("document"), one).select(*keep, "document", F.col("p.name").alias("name"), F.col("p.versionInfo").alias("version"), F.col("p.SPDXID").alias("spdx_id"), F.col("p.primaryPackagePurpose").alias("purpose"))


def document(name: Column, created: Column, listed: Column, pretty: bool = False) -> Column:
    return F.to_json(F.struct(F.lit("SPDX-2.3").alias("spdxVersion"), name.alias("name"), F.struct(created.alias("created")).alias("creationInfo"), listed.alias("packages")), {"pretty": str(pretty).lower()})


def sbom_write(found: DataFrame, created: str | None = None, pretty: bool = False) -> DataFrame:
    """(scan_id, doc): one document per scan of packages (scan_id, pkg_id, ecosystem, name, version), packages in a fixed order.

    created: the column with the time of the scan (a timestamp in UTC); pretty: over many lines, as a file of its own has it.
    """
    listed = F.sort_array(F.collect_list(F.struct(F.col("name").alias("name"), F.col("version").alias("versionInfo"), F.concat(F.lit("SPDXRef-"), F.col("pkg_id")).alias("SPDXID"), F.col("ecosystem").alias("primaryPackagePurpose"))))
    time = F.date_format(F.max(created), "yyyy-MM-dd'T'HH:mm:ss'Z'") if created else F.lit("1970-01-01T00:00:00Z")
    rows = found.groupBy("scan_id").agg(listed.alias("listed"), time.alias("created"))
    return rows.select("scan_id", document(F.concat(F.lit("scan-"), F.col("scan_id")), F.col("created"), F.col("listed"), pretty).alias("doc"))


#: A line of a spool: the name of a file as it was sent, and its text as it came, whole or not.
SPOOL = "file string, body string"


def write_spool(sent: DataFrame, path: str) -> None:
    """(file, body) as packed lines, many documents to a file: a fleet's files are too many to be made, listed and opened one by one."""
    sent.select("file", "body").write.option("compression", "gzip").json(path)


def from_spool(lines: DataFrame) -> DataFrame:
    """Lines of a spool (file, body, and _corrupt_record for a line that is none) as sbom_read has documents: one row for each, file being the name sent."""
    d, at = F.col("_d"), F.coalesce("file", F.col("_metadata.file_path"))
    broken = F.coalesce(F.col(CORRUPT), F.col(f"_d.{CORRUPT}"), F.when(d.isNull(), F.coalesce("body", F.lit(""))))
    read = lines.select(at.alias("file"), "body", CORRUPT, F.from_json("body", READ_SCHEMA, {"columnNameOfCorruptRecord": CORRUPT}).alias("_d"))
    return read.select(*[F.col(f"_d.{f.name}").alias(f.name) for f in DOCUMENT.fields], broken.alias(CORRUPT), "file")


def write_files(docs: DataFrame, path: str) -> None:
    """(scan_id, doc) as one file per document, in a folder of its scan.

    Making so many files takes the time, so all cores share it, and tasks put their files in place themselves. A job that
    fails leaves those of its ended tasks; written again, they are the same.
    """
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    docs.select("scan_id", F.col("doc").alias("value")).repartition(tasks, "scan_id").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("overwrite").partitionBy("scan_id").text(path)
