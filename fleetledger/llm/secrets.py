"""Secret scans with a ledger of blobs: every content is scanned once for each version of the rules, wherever it occurs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetledger.session import scratch

from .common import cut, spans_of, table, unused


@dataclass(frozen=True)
class Rule:
    """pattern: Java's; holds: what a match must fulfil besides (its group, that group's least length); hint: a string every match holds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    hint: str = ""


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kinds in the order in which spans at one place are listed. For hex and access the shortest good match is part of the
#: pattern: such runs are matched whole or not at all.
BASE = (Rule("assign", _ASSIGN, 2, 6), Rule("access", "AKIA[A-Z0-9]{16,}", hint="AKIA"), Rule("hex", "[0-9a-f]{24,}"))
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("google", "AIza[A-Za-z0-9_-]{35,}", hint="AIza"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
)
RULES = BASE + MORE
RULES_VERSION = "2026-11"
_SPAN = "array<struct<s:int,k:int,e:int>>"
#: Columns of a stored ledger: what was scanned by which rules, and what was found.
LEDGER = f"blob_id string, spans {_SPAN}, rules_version string"


def rule_spans(text: Column, rule: Rule, k: int) -> Column:
    found = spans_of(text, rule.pattern)
    if rule.least:
        found = F.filter(found, lambda x: F.length(F.regexp_extract(x["m"], rule.pattern, rule.group)) >= rule.least)
    spans = F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))).cast(_SPAN)
    there = text.rlike(rule.pattern)
    return F.when(text.contains(rule.hint) & there if rule.hint else there, spans).otherwise(F.array().cast(_SPAN))


def all_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.sort_array(F.concat(*[rule_spans(text, r, k) for k, r in enumerate(rules)]))


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def blobs(versions: DataFrame, path: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return versions.select(F.col(path).alias("path"), body.alias("text"), F.sha2(body.cast("binary"), 256).alias("blob_id"))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, rules_version: str = RULES_VERSION) -> DataFrame:
    """(blob_id, rules_version, spans): one row for every content that the ledger does not have for these rules.

    The ledger has the columns blob_id and rules_version; after the rows returned here are stored, append theirs to it.
    Contents are counted by digest before any text moves, and of each content the row with the smallest path is
    scanned, so texts are dealt out by their own paths and a content with very many copies is no hot key.
    """
    v = blobs(versions, path, text)
    todo = v.groupBy("blob_id").agg(F.min("path").alias("carrier"))
    if ledger is not None:
        todo = todo.join(ledger.where(F.col("rules_version") == rules_version).select("blob_id"), "blob_id", "left_anti")
    todo = todo.withColumnRenamed("blob_id", "todo_id")
    texts = v.join(todo, F.col("path").eqNullSafe(F.col("carrier")) & (F.col("blob_id") == F.col("todo_id")))
    found = texts.select("blob_id", F.lit(rules_version).alias("rules_version"), all_spans(F.col("text"), rules).alias("spans"))
    return found.dropDuplicates(["blob_id"])  # repeated rows of the smallest path


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The stored findings in a folder; none if there is no such folder yet."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def record(versions: DataFrame, folder: str, path: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, rules_version: str = RULES_VERSION) -> DataFrame:
    """Scan what the ledger in a folder lacks, append it there, and return the whole ledger, for at_paths and redact.

    A run that is cut off before its files are committed leaves the ledger as it was; the next one scans the same again.
    """
    spark = versions.sparkSession
    new = scan_unseen(versions, read_ledger(spark, folder), path, text, rules, rules_version)
    new.select("blob_id", "spans", "rules_version").write.mode("append").partitionBy("rules_version").parquet(folder)
    return read_ledger(spark, folder)


def at_paths(versions: DataFrame, findings: DataFrame, path: str = "doc_id", text: str = "text", rules_version: str = RULES_VERSION) -> DataFrame:
    """(path, blob_id, spans): one row for every row of versions, with what the rules of rules_version found in its content.

    findings: rows (blob_id, rules_version, spans), new and stored ones; those of other rules don't count, and a content
    that was recorded twice (two runs at one time may do that) counts once.
    """
    v = blobs(versions, path, text).select("path", "blob_id")
    # a table, so that the join has a shuffle of its own, which Spark can split where many paths share a content
    known = findings.where((F.col("rules_version") == rules_version) & (F.size("spans") > 0)).dropDuplicates(["blob_id"])
    own = cut(known, "secret-findings").select(F.col("blob_id").alias("found_id"), "spans")
    return v.join(own, F.col("blob_id") == F.col("found_id"), "left").select("path", "blob_id", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))


def redacted(text: Column, spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """text with every span, or what overlapping spans cover together, replaced by [SECRET:kind] of the first."""
    names, kind = F.array(*[F.lit(r.kind) for r in rules]), "struct<at:int,out:array<string>>"

    def step(a: Column, x: Column) -> Column:
        new = F.concat(a["out"], F.array(text.substr(a["at"] + 1, x["s"] - a["at"]), F.concat(F.lit("[SECRET:"), F.get(names, x["k"]), F.lit("]"))))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], new).otherwise(a["out"]).alias("out")).cast(kind)

    end = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind), step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(end["out"], ""), text.substr(end["at"] + 1, F.length(text))))


def redact(docs: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The rows of docs, with all their columns; secrets in text are replaced, n_chars (if there) follows.

    stored: all rows (blob_id, rules_version, spans) of earlier scans; their contents are redacted without a new scan.
    """
    findings = scan_unseen(docs, stored)
    if stored is not None:
        findings = findings.unionByName(stored.where(F.col("rules_version") == RULES_VERSION).select(*findings.columns).dropDuplicates(["blob_id"]))
    # a table, as in at_paths: a content that very many rows share can then be split over tasks
    own_id, blob, spans = unused(docs, "own_id", "blob", "spans")
    found = cut(findings.where(F.size("spans") > 0), "secret-findings").select(F.col("blob_id").alias(blob), F.col("spans").alias(spans))
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.withColumn(own_id, F.sha2(body.cast("binary"), 256)).join(found, F.col(own_id) == F.col(blob), "left")
    out = own.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col(spans))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def count_kind(k: int) -> Column:
    return F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first scan of documents, recorded in a new ledger and read from it; paths are doc_ids.

    A null text is empty. Repeated rows come back each; rows with a null doc_id too. No finding: zeros and empty spans.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = at_paths(docs, record(docs, scratch(spark, "secret-ledger")))
    base = F.filter("spans", lambda x: x["k"] < len(BASE))
    n = {f"n_{r.kind}": count_kind(k) for k, r in enumerate(BASE)}
    return out.select(F.col("path").alias("doc_id"), *[c.alias(name) for name, c in n.items()], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _duck(rule: Rule, k: int) -> str:
    """Spans of one rule: the lengths of the texts before each match, and of the matches, summed."""
    p = rule.pattern.replace("'", "''")
    keep = f"WHERE length(regexp_extract(m, '{p}', {rule.group})) >= {rule.least}" if rule.least else ""
    return f"""
  SELECT r, {k} AS k, '{rule.kind}' AS kind, e - length(m) AS s, e FROM (
    SELECT r, m, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
      SELECT r, unnest(range(1, len(m) + 1)) AS i, unnest(m) AS m, unnest(g[1:len(m)]) AS g
      FROM (SELECT r, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g FROM d WHERE regexp_matches(t, '{p}')))) {keep}"""


OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_duck(r, k) for k, r in enumerate(RULES))}),
w AS (
  SELECT r, {", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))},
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k, e) FILTER (k < {len(BASE)}) AS base,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k, e) AS spans
  FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN w USING (r)"""
