"""From raw documents to packed sequences: classify, deduplicate, decontaminate, redact, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetledger.llm import decontaminate, packing, quality_classifier, secrets, simhash
from fleetledger.llm.common import cut, table
from fleetledger.session import discard

#: The classifier is trained here and bins are planned: SQL can't express the whole run.
ORACLE_SQL = None


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts get the labels' mean; without labels all stay."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_classifier.keep_quality(docs, quality_classifier.fit(docs, labels))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Texts without a word form one group. Rows that share doc_id and text are one; a row without doc_id goes if any other
    row of its group has one.
    """
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; without items all documents stay."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced and n_chars follows. Null texts stay null."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the packed sequences. A null text is packed as an empty one; repeated rows are packed each."""
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("quality classifier", classify),
    ("simhash near-dedup", deduplicate),
    ("benchmark decontamination", decontaminated),
    ("secret scans", redact),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read back.

    A stage's input is deleted when its own rows are written, so one copy of the corpus lies there at a time; the last
    stage's input stays, as the result is computed from it.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"pipeline-{k}")
            if k:
                discard(before)
    return docs
