"""Digests, enrolment and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetledger.functions.scalars import sha256
from fleetledger.session import scratch


def digest_check(content: DataFrame, manifest: DataFrame) -> DataFrame:
    """(id, status) for content (id, body) against manifest (id, digest): ok, mismatch or missing."""
    c = content.select("id", sha256(F.col("body")).alias("own"))
    status = F.when(F.col("digest").isNull(), "missing").when(F.col("digest") == F.col("own"), "ok").otherwise("mismatch")
    return c.join(manifest, "id", "left").select("id", status.alias("status"))


def admitted_uploads(events: DataFrame, enrolments: DataFrame) -> DataFrame:
    """Uploads at or after their user's first enrolment."""
    joined = enrolments.groupBy("user_id").agg(F.min("ts").alias("joined_at"))
    return events.join(joined, "user_id").where(F.col("ts") >= F.col("joined_at"))


def code_reuse_audit(enrolments: DataFrame, limit: int) -> DataFrame:
    return enrolments.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)


def asof_enrolment(events: DataFrame, enrolments: DataFrame) -> DataFrame:
    """Every event with its user's last enrolment at or before it; both have (event_id, user_id, ts). See asof_marked."""
    kind = lambda df, enrols: df.select("event_id", "user_id", "ts", F.lit(enrols).alias("enrols"), F.lit(not enrols).alias("asks"))
    return asof_marked(kind(events, False).unionByName(kind(enrolments, True)))


def asof_marked(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """(event_id, user_id, ts, enrolled_at) of the rows that ask: their user's last row that enrols, at or before them.

    rows (event_id, user_id, ts, enrols, asks) are read once and dealt out in ranges of (user, ts), which is the only
    shuffle of all of them by more than the user: a user, or a user's day, with very many events lies in many ranges.
    Within a range and user it is a running maximum. Only the first user of a range can have an earlier part, so what is
    carried into a range is one value, found from one row for each range. A null user has no enrolment. parts: how many
    ranges; if not given, as many as the session has shuffle partitions, or fewer for little data.
    """
    enrolled = F.when(F.col("enrols") & F.col("user_id").isNotNull(), F.col("ts")).alias("enrolled")
    path = scratch(rows.sparkSession, "asof-ranges")
    dealt = rows.select("event_id", "user_id", "ts", "asks", enrolled).repartitionByRange(*([parts] if parts else []), "user_id", "ts").withColumn("part", F.spark_partition_id())
    dealt.write.parquet(path)  # which range a row is in may not change between the two uses
    ranges = rows.sparkSession.read.schema(dealt.schema).parquet(path)
    ends = ranges.groupBy("part").agg(F.min("user_id").alias("first"), F.max(F.struct("user_id", "enrolled")).alias("last"))
    a, b = ends.alias("a"), ends.alias("b")
    before = (F.col("b.last.user_id") == F.col("a.first")) & (F.col("b.part") < F.col("a.part"))
    carried = a.join(b, before).groupBy(F.col("a.part").alias("into"), F.col("a.first").alias("of")).agg(F.max("b.last.enrolled").alias("carried"))
    w = Window.partitionBy("part", "user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    within = ranges.withColumn("own", F.max("enrolled").over(w)).where("asks")
    # one row for each range at most: its size does not depend on the events
    out = within.join(F.broadcast(carried), (F.col("part") == F.col("into")) & (F.col("user_id") == F.col("of")), "left")
    return out.select("event_id", "user_id", "ts", F.coalesce("own", "carried").alias("enrolled_at"))


def content_duplicates(docs: DataFrame) -> DataFrame:
    """Digests that several rows of (id, body) share."""
    return docs.groupBy(sha256(F.col("body")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")
