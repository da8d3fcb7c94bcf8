import json
import os
import random
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetledger.functions.versions import parsed, version_key
from fleetledger.operators import inventory as inv
from fleetledger.operators import integrity, rollups
from fleetledger.plans import catalog
from fleetledger.plans.views import Fleet
from fleetledger.sources import advisories, spdx
from fleetledger.streaming import uploads


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(same, name):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_asof_spans_days(spark):
    """The last enrolment may be days before; equal times count; a user without one has none."""
    rows = spark.sql("SELECT * FROM VALUES (1, 7, TIMESTAMP_NTZ '2024-01-01 10:00:00'), (2, 7, TIMESTAMP_NTZ '2024-01-04 09:00:00'), (3, 7, TIMESTAMP_NTZ '2024-01-04 11:00:00'), (4, 8, TIMESTAMP_NTZ '2024-01-04 11:00:00') AS t(event_id, user_id, ts)")
    enrolled = spark.sql("SELECT * FROM VALUES (10, 7, TIMESTAMP_NTZ '2024-01-01 10:00:00'), (11, 7, TIMESTAMP_NTZ '2024-01-04 11:00:00'), (12, 8, TIMESTAMP_NTZ '2024-01-04 11:00:01') AS t(event_id, user_id, ts)")
    got = {r.event_id: str(r.enrolled_at) for r in integrity.asof_enrolment(rows, enrolled).collect()}
    assert got == {1: "2024-01-01 10:00:00", 2: "2024-01-01 10:00:00", 3: "2024-01-04 11:00:00", 4: "None"}


def test_entry_points(spark):
    assert entry.entry(spark).count() == 35
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_version_keys(spark):
    rows = spark.createDataFrame([("1.2",), ("1.2.0",), ("1.10",), ("1.2-rc1",), ("",), (None,)], "v string").select("v", version_key(F.col("v")).alias("k"), parsed(version_key(F.col("v"))).alias("ok"))
    got = {r.v: (r.k, r.ok) for r in rows.collect()}
    assert got["1.10"] == ([1, 10], True) and got["1.2"][0] < got["1.2.0"][0] < got["1.10"][0]
    assert got["1.2-rc1"] == ([1, None], False) and got[""] == ([None], False) and got[None] == (None, None)


def test_version_keys_of_odd_texts(spark):
    """F3 of round 4: keys made in compiled code are those made part by part."""
    odd = [".", "1.", "..1", "1..2", " 1 . 2", "+5.-3", "1e3", "9223372036854775808.9223372036854775807", "2:1.0-1ubuntu3", "1.0f", "01.2\n", "1.5d", None]
    rows = spark.createDataFrame([(v,) for v in odd], "v string").repartition(1)
    by_part = F.transform(F.split("v", "[.]"), lambda x: x.try_cast("bigint"))
    assert rows.where(~by_part.eqNullSafe(version_key(F.col("v")))).count() == 0
    assert "transform" not in str(version_key(F.col("v")))


def test_matching_bounds_and_broken_versions(spark):
    have = spark.createDataFrame([(1, "e", "n", v) for v in ("1.0", "1.9", "1.10", "2.0", "x", None)], "asset_id int, ecosystem string, name string, version string").withColumn("vkey", version_key(F.col("version")))
    known = spark.createDataFrame([("a", "e", "n", "1.9", "2.0", "LOW"), ("b", "e", "n", "1.10", None, "HIGH"), ("c", "e", "n", "1.0-x", None, "LOW")], advisories.SCHEMA)
    got = {(r.version, r.advisory_id) for r in inv.match_vulnerabilities(have, advisories.keyed(known)).collect()}
    assert got == {("1.9", "a"), ("1.10", "a"), ("1.10", "b"), ("2.0", "b")}
    assert [r.advisory_id for r in advisories.unparsed(known).collect()] == ["c"]


def test_installed_versions_without_order_are_kept_apart(spark):
    rows = [(1, "e", "n", v) for v in ("1.0", "1.2-rc1", "2:1.0-1ubuntu3", "1.0.20240101120000", None)] + [(1, "e", "other", "x")]
    have = spark.createDataFrame(rows, "asset_id int, ecosystem string, name string, version string").withColumn("vkey", version_key(F.col("version")))
    known = advisories.keyed(spark.createDataFrame([("a", "e", "n", "1.0.1", None, "LOW"), ("b", "e", "n", "9", None, "LOW")], advisories.SCHEMA))
    assert {r.version for r in inv.unparsed(have, known).collect()} == {"1.2-rc1", "2:1.0-1ubuntu3", None} and inv.unparsed(have, known).count() == 3
    assert {r.version for r in inv.match_vulnerabilities(have, known).collect()} == {"1.0.20240101120000"}


def test_assets_without_scans_are_stale(spark):
    assets = spark.createDataFrame([(1,), (2,)], "asset_id int")
    scans = spark.sql("SELECT 10 AS scan_id, 1 AS asset_id, TIMESTAMP_NTZ '2024-01-01' AS scanned_at")
    assert [r.asset_id for r in inv.stale_assets(assets, scans, "2001-01-01").collect()] == [2]
    assert [r.asset_id for r in inv.not_scanned_since(assets, scans, "2001-01-01").collect()] == [2]


def _documents(folder):
    docs = {"a": [{"name": "x", "versionInfo": "1"}, {"name": "y", "versionInfo": "2"}], "b": [{"name": "x", "versionInfo": "3"}, {"name": "z", "versionInfo": "4"}], "c": []}
    for k, p in docs.items():
        (folder / f"{k}.json").write_text(json.dumps({"spdxVersion": "SPDX-2.3", "name": k, "creationInfo": {"created": "t"}, "packages": p}, indent=1))
    (folder / "d.json").write_text('{"name": "x", "packages": [')


def test_spdx_files(spark, tmp_path):
    _documents(tmp_path)
    docs = spdx.sbom_read(spark, str(tmp_path)).cache()
    assert docs.count() == 4 and docs.where("_corrupt_record is not null").count() == 1
    assert spdx.packages(docs).count() == 4 and spdx.packages(docs, empty=True).count() == 5


def test_collecting_a_stream_of_files(spark, tmp_path):
    """Two documents with packages, one without, one broken, one that is no document: each is found again, broken ones with their text."""
    (tmp_path / "in").mkdir()
    _documents(tmp_path / "in")
    (tmp_path / "in" / "e.json").write_text('{"some": "other"}')
    out = str(tmp_path / "out")
    uploads.collect_results(spark, str(tmp_path / "in"), out, str(tmp_path / "state")).awaitTermination()
    assert {(r.document, r.name, tuple(r.vkey)) for r in uploads.collected(spark, out).collect()} == {("a", "x", (1,)), ("a", "y", (2,)), ("b", "x", (3,)), ("b", "z", (4,))}
    assert {r.document: r.n_packages for r in uploads.documents(spark, out).collect()} == {"a": 2, "b": 2, "c": 0}
    bad = {r.file[-6:]: (r.reason, r.text) for r in uploads.rejected(spark, out).collect()}
    assert bad["d.json"] == ("no JSON", '{"name": "x", "packages": [') and bad["e.json"][0] == "no name" and len(bad) == 2


def test_collecting_a_spool(spark, tmp_path):
    """many files of many lines arrive in few; each is found under the name it was sent, whatever it holds, and a broken line too."""
    good = json.dumps({"spdxVersion": "SPDX-2.3", "name": "a", "creationInfo": {"created": "2024-01-05T00:00:00Z"}, "packages": [{"name": "x", "versionInfo": "1"}, {"name": "y", "versionInfo": "2"}]}, indent=1)
    sent = [("good", good), ("half", good[: len(good) // 2]), ("other", '{"some": 1}'), ("bare", "[1"), ("empty", ""), ("none", None)] + [(f"g{k}", good.replace('"a"', f'"a{k}"')) for k in range(50)]
    spdx.write_spool(spark.createDataFrame(sent, spdx.SPOOL).coalesce(2), str(tmp_path / "in"))
    (tmp_path / "in" / "z.json").write_text('{"file": "cut')
    assert len(list((tmp_path / "in").glob("[!._]*.json*"))) == 3
    uploads.collect_spool(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "month").awaitTermination()
    assert {r.file: r.n_packages for r in uploads.documents(spark, str(tmp_path / "out")).collect()} == {"good": 2} | {f"g{k}": 2 for k in range(50)}
    bad = {r.file.split("/")[-1]: (r.reason, r.text) for r in uploads.rejected(spark, str(tmp_path / "out")).collect()}
    assert bad["half"] == ("no JSON", good[: len(good) // 2]) and bad["bare"] == ("no JSON", "[1") and bad["other"][0] == "no name"
    assert set(bad) == {"half", "other", "bare", "empty", "none", "z.json"} and bad["z.json"] == ("no JSON", '{"file": "cut')
    assert uploads.collected(spark, str(tmp_path / "out")).count() == 102


def _batch(spark, names):
    rows = [("SPDX-2.3", n, (f"2024-0{k % 3 + 1}-05T00:00:00Z",), [(f"p{n}", "1.2", "s", "e")], None, f"{n}.json") for k, n in enumerate(names)]
    schema = spdx.READ_SCHEMA.add("file", "string") if "file" not in spdx.READ_SCHEMA.names else spdx.READ_SCHEMA
    return spark.createDataFrame(rows, schema)


def test_a_batch_that_runs_again_replaces_its_rows(spark, tmp_path):
    out, first = str(tmp_path), ["a", "b", "c", "d"]
    uploads.write_collected(_batch(spark, first), 0, out)
    uploads.write_collected(_batch(spark, ["e"]), 1, out)
    uploads.write_collected(_batch(spark, first), 0, out)
    assert sorted(r.name for r in uploads.collected(spark, out).collect()) == ["pa", "pb", "pc", "pd", "pe"]
    assert uploads.documents(spark, out).count() == 5 and uploads.rejected(spark, out).count() == 0


def test_a_batch_is_held_by_no_executor(spark, tmp_path, monkeypatch):
    """F1, F2 of round 4: persisted batches with all their packages took the executors' memory. What is read twice is small, and goes."""
    docs = spark.createDataFrame([("SPDX-2.3", "a", ("2024-01-05T00:00:00Z",), [("p", "1.2", "s", "e")] * 3, None, "a.json"), (None, None, None, None, "{", "b.json")], spdx.READ_SCHEMA.add("file", "string") if "file" not in spdx.READ_SCHEMA.names else spdx.READ_SCHEMA)
    held = []
    for f in ("persist", "cache"):
        monkeypatch.setattr(type(docs), f, lambda self, *a, _f=getattr(type(docs), f): held.append(_f) or _f(self, *a))
    for _ in range(2):
        uploads.write_collected(docs, 0, str(tmp_path), "month")
    assert not held and not list(tmp_path.glob("_known/*/*"))
    assert [tuple(r)[::3] for r in uploads.documents(spark, str(tmp_path)).collect()] == [("a", 3)] and uploads.collected(spark, str(tmp_path)).count() == 3
    assert [(r.file, r.text, r.reason) for r in uploads.rejected(spark, str(tmp_path)).collect()] == [("b.json", "{", "no JSON")]


def test_collected_findings_persist_nothing(spark, data, monkeypatch):
    """F2 of round 4: the whole fleet's documents were persisted on the way to the findings of a few months."""
    held, kind = [], type(spark.range(1))
    monkeypatch.setattr(kind, "persist", lambda self, *a, _f=kind.persist: held.append(self) or _f(self, *a))
    assert catalog.QUERIES["findings_collected"](spark, data).count() >= 0 and not held


def test_collected_reads_only_what_is_asked_for(spark, tmp_path):
    for period in ("day", "month"):
        out = str(tmp_path / period)
        uploads.write_collected(_batch(spark, ["a", "b", "c"]), 0, out, period)
        since = uploads.collected(spark, out, "2024-02-03 12:00:00", period)
        assert sorted(r.name for r in since.collect()) == ["pb", "pc"]
        plan = since._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(period" in plan and "period#" in plan.split("PartitionFilters")[1].split("]")[0]
        assert len(since.inputFiles()) == 3 and since.select("file").distinct().count() == 2


def test_late_rows_are_reported(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").write.parquet(str(tmp_path / "in"))
    for k, f in enumerate(sorted((tmp_path / "in").glob("part*"), reverse=True)):
        os.utime(f, (1e9 + 100 * k, 1e9 + 100 * k))
    listener = uploads.ProgressTable(spark, str(tmp_path / "progress"))
    spark.streams.addListener(listener)
    stream = uploads.events_stream(spark, str(tmp_path / "in"), 1).withWatermark("ts", "1 hour")
    _, ended = uploads.run(rollups.daily_uploads(stream))
    report = uploads.late_data_report(listener.rows(ended)).collect()
    spark.streams.removeListener(listener)
    assert sum(r.n_dropped for r in report) > 0


def test_late_rows_of_over_a_hundred_batches(spark, tmp_path):
    """A query keeps its last 100 batches only; the late rows here are in the first ten of 106."""
    s = spark.newSession()
    s.conf.set("spark.sql.shuffle.partitions", "1")
    (tmp_path / "in").mkdir()
    for k in range(106):
        day = datetime(2024, 3, 1) if k < 2 else datetime(2024, 1, 1) if k < 10 else datetime(2024, 3, 1) + timedelta(hours=k)
        rows = [(1000 * k + n, day, n, "click", 1.0, "{}") for n in range(k % 3 + 1)]
        s.createDataFrame(rows, uploads.EVENTS).coalesce(1).write.parquet(str(tmp_path / "one" / str(k)))
        (f,) = (tmp_path / "one" / str(k)).glob("part*")
        f.rename(tmp_path / "in" / f"{k:03d}.parquet")
        os.utime(tmp_path / "in" / f"{k:03d}.parquet", (1e9 + 100 * k, 1e9 + 100 * k))
    listener = uploads.ProgressTable(s, str(tmp_path / "progress"))
    s.streams.addListener(listener)
    stream = uploads.events_stream(s, str(tmp_path / "in"), 1)
    _, ended = uploads.run(uploads.stream_dedup(stream, "1 hour"))
    report = {r.batch: r.n_dropped for r in uploads.late_data_report(listener.rows(ended)).collect()}
    s.streams.removeListener(listener)
    remembered = sum(s["numRowsDroppedByWatermark"] for p in ended.recentProgress for s in p["stateOperators"])
    assert len(report) > 104 and remembered < sum(report.values())
    assert sum(report.values()) == sum(k % 3 + 1 for k in range(2, 10)) == sum(n for b, n in report.items() if b < 10)


def test_open_sessions_are_closed_once(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1), 7, "c", 0.0, ""), (2, datetime(2024, 1, 1, 5), 7, "c", 0.0, ""), (3, datetime(2024, 1, 1, 12), 7, "c", 0.0, ""), (4, datetime(2024, 1, 1, 1), None, "c", 0.0, "")]
    spark.createDataFrame(rows, uploads.EVENTS).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([], uploads.EVENTS).write.parquet(str(tmp_path / "none"))

    def closed(path):
        sessions = lambda m: rollups.upload_sessions(uploads.closable(uploads.events_stream(spark, path), m, "1 hour"), "closing")
        return uploads.run_and_close(spark, sessions, timedelta(days=1)).collect()

    assert sorted((r.user_id or 0, r.n) for r in closed(str(tmp_path / "in"))) == [(0, 1), (7, 1), (7, 2)]
    assert closed(str(tmp_path / "none")) == []


def test_users_who_stay_away_leave_the_state(spark, tmp_path):
    """1,000 users once, then ten users for some weeks: the state ends with those of the last windows; the last event of all is still known."""
    listener, out, state = uploads.ProgressTable(spark, str(tmp_path / "progress")), [], str(tmp_path / "state")
    spark.streams.addListener(listener)
    ended = []
    for k in range(5):
        users = 1000 if k == 0 else 10
        rows = spark.range(users).selectExpr(f"id + {k} * 10000 AS event_id", f"TIMESTAMP_NTZ '2024-01-01' + make_interval(0, 0, {k}, 0, 1) AS ts", "id AS user_id", "'c' AS event_type", "1D AS value", "'' AS props")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        latest = uploads.stream_latest(uploads.events_stream(spark, str(tmp_path / "in")), "7 days")
        q = latest.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(lambda b, n: out.extend(b.collect())).start()
        q.awaitTermination()
        ended.append(q)
    progress = listener.rows(*ended).orderBy("batch").collect()
    spark.streams.removeListener(listener)
    assert progress[0].n_state == 1000 and progress[-1].n_state <= 20 and sum(r.n_removed for r in progress) >= 1000
    got = {r.user_id: r.event_id for r in uploads.latest_of(spark.createDataFrame(out)).collect()}
    assert got == {u: (u + 40000 if u < 10 else u) for u in range(1000)}


def test_asof_with_a_hot_day(spark):
    """One user's single day is over half of all rows and lies in several ranges; against brute force, with ties and nulls."""
    rng = random.Random(2)
    rows = []
    for k in range(6000):
        hot = rng.random() < 0.6
        ts = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(86_400)) if hot else datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(50_000))
        rows.append((k, 5 if hot else rng.choice([None, *range(12)]), ts, rng.random() < 0.02))
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, enrols boolean").repartition(7)
    asof = integrity.asof_marked(df.withColumn("asks", ~F.col("enrols")), 12)
    want = {e: max((t for _, v, t, n in rows if n and v == u and u is not None and t <= ts), default=None) for e, u, ts, enrols in rows if not enrols}
    assert {r.event_id: r.enrolled_at for r in asof.collect()} == want
    dealt = df.repartitionByRange(12, "user_id", "ts").where("user_id = 5").select(F.spark_partition_id()).distinct().count()
    assert dealt > 5
    assert integrity.asof_marked(df.limit(0).withColumn("asks", F.lit(True))).count() == 0


def test_stored_buckets_are_matched_without_a_shuffle(spark, data, tmp_path):
    """Broadcasts off: no exchange stands below the join, at the second matching either; a hot package lies in several buckets."""
    x = Fleet(spark, data)
    hot = spark.range(400).selectExpr("id AS scan_id", "'e' AS ecosystem", "'hot' AS name", "'1.5' AS version").withColumn("vkey", version_key(F.col("version")))
    rows = x.packages.select(*hot.columns).union(hot)
    known = x.advisories.unionByName(advisories.keyed(spark.createDataFrame([("H", "e", "hot", "1", None, "CRITICAL")], advisories.SCHEMA)))
    want = sorted((r.scan_id, r.name, r.version, r.advisory_id) for r in inv.match_vulnerabilities(rows, known).collect())
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        have, adv = inv.store_bucketed(rows, known, f"t{uuid.uuid4().hex}", str(tmp_path), buckets=8)
        critical = {a.advisory_id for a in known.where("severity = 'CRITICAL'").collect()}
        for where in ("true", "severity = 'CRITICAL'"):
            got = inv.match_bucketed(have, adv, where)
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
            found = sorted((r.scan_id, r.name, r.version, r.advisory_id) for r in got.collect())
            assert found == [r for r in want if where == "true" or r[3] in critical]
        parts = spark.table(have).where("name = 'hot'").groupBy("part").count().collect()
        assert len(parts) == 4 and max(r["count"] for r in parts) < 200
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_buckets_meet_by_one_number(spark, tmp_path):
    """F3 of round 4: texts were sorted and compared. Rows now meet by a number, and where two names share it, they are told apart."""
    rows = [(k, e, n, v) for k, (e, n, v) in enumerate([("e", "n", "1.5"), ("e", "m", "1.5"), ("f", "n", "1.5"), (None, "n", "1.5"), ("e", None, "1.5"), ("e", "n", "x"), ("e", "n", None), ("e", "n", "9")])]
    have = spark.createDataFrame(rows, "scan_id int, ecosystem string, name string, version string").withColumn("vkey", version_key(F.col("version")))
    known = advisories.keyed(spark.createDataFrame([("a", "e", "n", "1", "2", "LOW"), ("b", "e", "n", "1", "2", "LOW"), (None, "e", "m", "1", None, "LOW"), ("d", "f", "n", "1.6", None, "LOW")], advisories.SCHEMA))
    want = sorted((r.scan_id, str(r.advisory_id)) for r in inv.match_vulnerabilities(have, known).collect())
    assert want == [(0, "a"), (0, "b"), (1, "None")]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = inv.match_bucketed(*inv.store_bucketed(have, known, f"t{uuid.uuid4().hex}", str(tmp_path), buckets=2))
        (join,) = [x for x in stored._jdf.queryExecution().executedPlan().toString().splitlines() if "SortMergeJoin" in x]
        assert "SortMergeJoin [cell#" in join and "Join [ecosystem" not in join
        one = [x.withColumn("cell", F.lit(1)) for x in (have, known)]
        for got in (stored, inv.match_vulnerabilities(*one, key="cell")):
            assert sorted((r.scan_id, str(r.advisory_id)) for r in got.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_merged_sketches_equal_one_sketch(spark):
    rows = spark.range(300_000).selectExpr("id % 3 AS asset_id", "id % 30 AS day", "cast(id % 120000 AS string) AS version")
    merged = {r.asset_id: r.n_versions for r in rollups.merged_versions(rollups.version_sketches(rows, "asset_id", "day"), "asset_id").collect()}
    once = {r.asset_id: r.n_versions for r in rollups.merged_versions(rollups.version_sketches(rows, "asset_id"), "asset_id").collect()}
    for asset, n in merged.items():
        assert abs(n - once[asset]) <= 0.01 * n and abs(n - 40_000) <= 3 * 1.04 / 64 * 40_000


def test_operators_of_one_name_are_told_apart(spark):
    """Two of a name in one batch count each; a batch that ran twice counts as it ran last."""
    row = lambda run, at, place, n: ("q", run, at, 0, "stateStoreSave", place, n, 1, 0)
    rows = [row("a", "2024-01-01T00:00:00Z", 0, 9), row("a", "2024-01-01T00:00:00Z", 1, 9), row("b", "2024-01-01T00:01:00Z", 0, 3), row("b", "2024-01-01T00:01:00Z", 1, 4)]
    report = uploads.late_data_report(spark.createDataFrame(rows, uploads.PROGRESS)).collect()
    assert [tuple(r) for r in report] == [(0, "stateStoreSave", 7)]


def test_approximate_numbers_of_very_many_assets_are_close(spark):
    """of 40,000 assets each is within three of the standard deviations asked for, or one version; few and many versions."""
    for assets, each in ((40_000, 7), (3_000, 100)):
        rows = spark.range(assets * each).selectExpr(f"id % {assets} AS asset_id", "cast(id AS string) AS version")
        got = rollups.approx_versions(rows).where(F.abs(F.col("n_versions") - each) > max(1.0, 0.15 * each))
        assert got.count() == 0
    assert [tuple(r) for r in rollups.approx_versions(spark.sql("SELECT 1 AS asset_id, cast(null AS string) AS version")).collect()] == [(1, 0)]


def test_stored_sets_give_the_exact_number(spark, tmp_path):
    """the two assets at sf0.1 for which the merged sketches' estimate was one off."""
    ids = [2574, 5113]
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet").where(F.col("o_custkey").isin(ids))
    lines = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    x = Fleet(spark, str(tmp_path))
    want = {r.asset_id: r.n for r in x.scans.join(x.contents, "scan_id").groupBy("asset_id").agg(F.count_distinct("version").alias("n")).collect()}
    assert {r.asset_id: r.n_versions for r in catalog.QUERIES["sketched_versions"](spark, str(tmp_path)).collect()} == want and set(want) == set(ids)


def test_counts_are_not_made_from_single_findings(spark):
    """F4, F5, F9-F11: packages meet each range once; 50 advisories of one range, two of another, one without an id."""
    have = spark.createDataFrame([(a, "e", "n", "1.5") for a in range(20)] + [(99, "e", "n", "3.0")], "asset_id int, ecosystem string, name string, version string").withColumn("vkey", version_key(F.col("version")))
    rows = [(f"A{k}", "e", "n", "1.0", "2.0", "LOW") for k in range(50)] + [("B", "e", "n", "1.0", None, "HIGH"), ("C", "e", "n", "1.0", None, "HIGH"), (None, "e", "n", "2.5", None, "HIGH")]
    known = advisories.keyed(spark.createDataFrame(rows, advisories.SCHEMA))
    each, counted = inv.match_vulnerabilities(have, known), inv.count_vulnerabilities(have, known)
    assert each.count() == 20 * 52 + 3 and counted.count() == 20 * 2 + 2
    assert sorted(str(r.advisory_id) for r in each.where("asset_id = 99").collect()) == ["B", "C", "None"]
    kinds = spark.range(100).selectExpr("cast(id AS int) AS asset_id", "cast(id % 2 AS int) AS site_id", "CASE WHEN id % 3 = 0 THEN 'image' ELSE 'host' END AS asset_kind")
    for f in (lambda x: rollups.severity_cube(x, kinds), lambda x: rollups.severity_rollup(x, kinds), lambda x: rollups.top_exposed(x, 5), lambda x: rollups.top_per_site(x, kinds, 2)):
        assert sorted(map(str, f(each).collect())) == sorted(map(str, f(counted).collect()))
    assert {(r.asset_id, r.upgrade_to, r.n_unfixed) for r in inv.upgrade_plan(have, known).collect()} == {(a, "2.0", 2) for a in range(20)} | {(99, None, 3)}
