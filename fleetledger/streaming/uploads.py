"""Uploads as streams. Sources and sinks are files in shared folders; every query can stop and start again."""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from fleetledger.functions.versions import version_key
from fleetledger.session import discard, scratch
from fleetledger.sources.spdx import CORRUPT, READ_SCHEMA, SPOOL, from_spool, packages

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events, with ts as a timestamp, which watermarks need."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    pattern = f"{path[:-1]}[{path[-1]}]"  # the same place as a pattern: without one, a stream's path can't be a single file
    return reader.parquet(pattern).withColumn("ts", F.col("ts").cast("timestamp"))


#: Package rows as collected, and documents that could not be read. period (the first day of the scan's day, month or year) and batch are folders.
COLLECTED = "document string, name string, version string, spdx_id string, purpose string, created timestamp, file string, vkey array<bigint>, period date, batch long"
REJECTED = "file string, text string, reason string, batch long"


def collected(spark: SparkSession, out: str, since: str | None = None, period: str = "day") -> DataFrame:
    """The packages that collect_results has written; since: only those of scans at that time or later, and only their folders are read."""
    rows = spark.read.schema(COLLECTED).parquet(f"{out}/packages")
    if since is None:
        return rows
    at = F.lit(since).cast("timestamp")
    return rows.where((F.col("period") >= F.to_date(F.date_trunc(period, at))) & (F.col("created") >= at))


def rejected(spark: SparkSession, out: str) -> DataFrame:
    """The documents that collect_results could not read, with their file and text."""
    return spark.read.schema(REJECTED).parquet(f"{out}/rejects")


def documents(spark: SparkSession, out: str) -> DataFrame:
    """(document, created, file, n_packages, batch): the documents that collect_results has read, those without packages too."""
    return spark.read.schema("document string, created timestamp, file string, n_packages long, batch long").parquet(f"{out}/documents")


def write_collected(docs: DataFrame, n: int, out: str, period: str = "day") -> None:
    """A batch of documents (as sbom_read has them) into the tables under out, in place of what a batch of that number wrote before.

    A document is read if its JSON is whole and it has a name and a list of packages, and rejected otherwise: each one
    that arrives is in one of the two tables. Documents are dealt to their folders, those of a large one to several tasks;
    packages have their version key stored, so no query has to make it again. period: day, month or year, as the fleet is large.
    """
    reason = F.when(F.col(CORRUPT).isNotNull(), "no JSON").when(F.col("name").isNull(), "no name").when(F.col("packages").isNull(), "no packages")
    docs = docs.withColumns({"reason": reason, "created": F.try_to_timestamp(F.col("creationInfo.created"))})
    # documents are dealt, not their packages: what is shuffled has each name, file and time once
    dealt = docs.where("reason IS NULL").drop(CORRUPT).withColumn("period", F.to_date(F.date_trunc(period, "created"))).hint("rebalance", F.col("period"))
    rows = packages(dealt, ("created", "file", "period")).withColumns({"vkey": version_key(F.col("version")), "batch": F.lit(n).cast("long")})
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "batch").parquet(f"{out}/packages")
    # The files are read once more for what is known of each document. A batch is not persisted: executors would hold it with all its packages.
    text = F.when(F.col("reason").isNotNull(), F.coalesce(CORRUPT, F.to_json(F.struct("spdxVersion", "name", "creationInfo", "packages"))))
    known = f"{out}/_known/batch={n}"  # readers of the tables pass over it
    heads = docs.select(F.col("name").alias("document"), "created", "file", F.size("packages").cast("long").alias("n_packages"), text.alias("text"), "reason")
    heads.write.mode("overwrite").parquet(known)
    heads = docs.sparkSession.read.schema(heads.schema).parquet(known)
    heads.where("reason IS NULL").drop("text", "reason").write.mode("overwrite").parquet(f"{out}/documents/batch={n}")
    heads.where("reason IS NOT NULL").select("file", "text", "reason").write.mode("overwrite").parquet(f"{out}/rejects/batch={n}")
    discard(heads)


def collect_results(spark: SparkSession, in_dir: str, out: str, checkpoint: str, multi_line: bool = True, period: str = "day") -> StreamingQuery:
    """SPDX documents that arrive in in_dir into tables under out: see collected(), documents() and rejected().

    Every batch writes under its own number, so one that runs again after a failure replaces its rows.
    """
    docs = spark.readStream.schema(READ_SCHEMA).option("multiLine", multi_line).option("columnNameOfCorruptRecord", CORRUPT).json(in_dir).withColumn("file", F.col("_metadata.file_path"))
    return _into_tables(docs, out, checkpoint, period)


def collect_spool(spark: SparkSession, in_dir: str, out: str, checkpoint: str, period: str = "day") -> StreamingQuery:
    """collect_results for documents of many lines that arrive in spools (spdx.write_spool), each under the name of the file that was sent."""
    lines = spark.readStream.schema(f"{SPOOL}, {CORRUPT} string").option("columnNameOfCorruptRecord", CORRUPT).json(in_dir)
    return _into_tables(from_spool(lines), out, checkpoint, period)


def _into_tables(docs: DataFrame, out: str, checkpoint: str, period: str) -> StreamingQuery:
    return docs.writeStream.foreachBatch(lambda batch, n: write_collected(batch, n, out, period)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedup(events: DataFrame, delay: str = "40 days") -> DataFrame:
    """Events without those sent again within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def stream_enrich(events: DataFrame, assets: DataFrame) -> DataFrame:
    """Every event with its asset, from a static table."""
    return events.join(assets, events.user_id == assets.asset_id, "left")


def stream_enrolment_join(clicks: DataFrame, enrolments: DataFrame, delay: str = "40 days") -> DataFrame:
    """Clicks within a day after an enrolment of the same user; both sides are streams."""
    c = clicks.withWatermark("ts", delay).select(F.col("event_id").alias("click_id"), F.col("user_id").alias("u"), F.col("ts").alias("clicked"))
    e = enrolments.withWatermark("ts", delay).select(F.col("event_id").alias("enrolment_id"), "user_id", F.col("ts").alias("enrolled"))
    return c.join(e, F.expr("u = user_id AND clicked >= enrolled AND clicked <= enrolled + INTERVAL 1 DAY")).select("user_id", "click_id", "enrolment_id")


def stream_latest(events: DataFrame, keep: str = "30 days", delay: str = "1 day") -> DataFrame:
    """The last event of each user in each window of the length keep: (user_id, since, event_id, ts), for update mode.

    A user's state lives until the watermark has passed their window, so users who stay away leave the state and it
    is as large as those of the last windows, not as all users there ever were. latest_of() has the last event of all.
    """
    in_window = events.withWatermark("ts", delay).groupBy("user_id", F.window("ts", keep).alias("w"))
    return in_window.agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts")).select("user_id", F.col("w.start").alias("since"), "event_id", "ts")


def latest_of(rows: DataFrame) -> DataFrame:
    """Each user's last event among the rows of stream_latest."""
    return rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


PROGRESS = "query string, run string, at string, batch long, operator string, place int, n_dropped long, n_state long, n_removed long"


class ProgressTable(StreamingQueryListener):
    """Appends what every batch of every query says of its stateful operators to a table.

    A query itself remembers its last batches only. One row per batch and operator, which its place
    tells from others of its name: rows dropped as late, rows in the state, rows removed from it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._end(event.runId)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        rows = [(str(p.id), str(p.runId), p.timestamp, p.batchId, s.operatorName, k, s.numRowsDroppedByWatermark, s.numRowsTotal, s.numRowsRemoved) for k, s in enumerate(p.stateOperators)]
        if rows:
            self.spark.createDataFrame(rows, PROGRESS).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._end(event.runId).set()

    def _end(self, run) -> threading.Event:
        return self.ended.setdefault(str(run), threading.Event())

    def rows(self, *queries: StreamingQuery, timeout: float = 60) -> DataFrame:
        """The table, once all that these ended queries had to say is in it."""
        for q in queries:
            if not self._end(q.runId).wait(timeout):
                raise TimeoutError(f"the end of run {q.runId} was not reported")
        return self.spark.read.schema(PROGRESS).parquet(self.path)


def late_data_report(progress: DataFrame) -> DataFrame:
    """(batch, operator, n_dropped): rows dropped as late, of the rows of a ProgressTable. A batch that ran twice counts as it ran last."""
    last = progress.groupBy("query", "batch", "operator", "place").agg(F.max_by("n_dropped", "at").alias("n_dropped"))
    return last.groupBy("batch", "operator").agg(F.sum("n_dropped").alias("n_dropped"))


#: A closing marker: the source of markers is a folder of such rows.
MARKER = "ts timestamp_ntz"


def closable(events: DataFrame, markers: DataFrame, delay: str) -> DataFrame:
    """events and markers as one stream with one watermark; a column closing tells the markers, which are else null."""
    return events.withColumn("closing", F.lit(False)).unionByName(markers.select(F.col("ts").cast("timestamp").alias("ts"), F.lit(True).alias("closing")), allowMissingColumns=True).withWatermark("ts", delay)


def run_and_close(spark: SparkSession, query: Callable[[DataFrame], DataFrame], ahead: timedelta) -> DataFrame:
    """Run an appending stream over all there is now, then close what is open in its state; the sink read back.

    query makes the stream from the stream of markers (closable() takes both). Such a stream writes windows and sessions
    once they are closed, and the last ones wait for a later event. When no event is to come, a marker goes through the
    same query: later than the watermark by ahead, which must exceed twice the delay and the longest open time. The
    watermark then passes all that is open; the marker's own group stays in the state and does not come out. query keeps
    the column closing, by which the sink is read: a filter in the stream would move below the watermark.
    """
    marks, out, state = (scratch(spark, f"stream-{k}") for k in ("marks", "out", "state"))
    spark.createDataFrame([], MARKER).write.parquet(marks)
    df = query(spark.readStream.schema(MARKER).parquet(marks))

    def go() -> StreamingQuery:
        q = df.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out)
        q.awaitTermination()
        return q

    seen = (go().lastProgress or {}).get("eventTime", {}).get("watermark", "1970")
    if not seen.startswith("1970"):  # else no event has come, and nothing is open
        at = datetime.fromisoformat(seen.replace("Z", "+00:00")).replace(tzinfo=None) + ahead
        spark.createDataFrame([(at,)], MARKER).write.mode("append").parquet(marks)
        go()
    return spark.read.schema(df.schema).parquet(out).where("NOT closing").drop("closing")


def run(df: DataFrame, mode: str = "append", keys: tuple[str, ...] = ()) -> tuple[DataFrame, StreamingQuery]:
    """Run a stream over all there is now; the sink read back, and the ended query.

    append goes to a file sink. update adds the rows that a batch has changed to a table, with the batch's number; read
    back, the last row of each of keys counts. A batch that runs again writes over its own rows.
    """
    spark = df.sparkSession
    out, state = scratch(spark, "stream-out"), scratch(spark, "stream-state")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").start(out)
        query.awaitTermination()
        return spark.read.schema(df.schema).parquet(out), query
    query = writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")).start()
    query.awaitTermination()
    rest = [c for c in df.columns if c not in keys]
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, batch long").parquet(out)
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*keys, "last.*")
    return last.select(*df.columns), query
