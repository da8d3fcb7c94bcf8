"""Ties, blocks of a benchmark, words of short texts, and tables that a pipeline has done with."""

import subprocess
import sys

import numpy as np

import corpus_pipeline
from fleetledger.llm import decontaminate, quality_classifier, simhash


def test_keep_one_among_ties_does_not_depend_on_the_order(spark):
    """Rows with one doc_id and text that differ elsewhere: the same one stays however they are dealt out."""
    rows = [(1, "the same words in every row", f"src{k}") for k in range(6)]
    kept = {tuple(simhash.keep_one(spark.createDataFrame(r, "doc_id long, text string, source string").repartition(n)).collect()) for r, n in ((rows, 1), (rows[::-1], 1), (rows, 3))}
    assert len(kept) == 1 and len(next(iter(kept))) == 1


def test_one_block_of_items_is_held_at_a_time(spark, monkeypatch):
    """With several blocks each one's broadcast is destroyed before the next is made."""
    docs = spark.createDataFrame([(k, f"start {k} one two three four five six {k}", "x") for k in range(40)] + [(99, None, "x")], "doc_id long, text string, source string")
    items = spark.createDataFrame([(k, f"start {k} one two three four") for k in range(0, 40, 2)], "item_id long, text string")
    held, most = set(), [0]
    make = type(spark.sparkContext).broadcast

    def broadcast(self, value):
        b = make(self, value)
        if isinstance(value, decontaminate.ItemIndex):
            held.add(id(b))
            most[0] = max(most[0], len(held))
            destroy = b.destroy
            b.destroy = lambda *a: (held.discard(id(b)), destroy(*a))
        return b

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    hits = decontaminate.find_leaks(docs, items, block_chars=60).collect()
    assert sorted((r.doc_id, r.item_id) for r in hits) == [(k, k) for k in range(0, 40, 2)]
    rest = decontaminate.without_leaks(docs, items, block_chars=60)
    assert sorted(r.doc_id for r in rest.collect()) == [*range(1, 40, 2), 99]
    assert most[0] == 1


def test_words_of_short_texts_count():
    a, b = (set(quality_classifier.terms(t)[0].tolist()) for t in ("hi", "no"))
    assert a and b and not a & b
    assert len(quality_classifier.terms("")[0]) == len(quality_classifier.terms(None)[0]) == 0


def test_cross_validation_scores_every_document_by_the_others():
    """Labels that words tell have no error; labels that nothing tells are guessed."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["good", "fine", "best"] if k % 2 else ["evil", "vile", "baad"], 30)) for k in range(120)]
    labels = np.array([k % 2 for k in range(120)], float)
    terms = [quality_classifier.terms(t) for t in texts]
    assert quality_classifier.cross_validate(terms, labels, (0.5,))[0.5] == (0.0, 1.0)
    assert quality_classifier.cross_validate(terms, rng.permutation(labels), (0.5,))[0.5][0] > 0.1


def test_the_pipeline_keeps_one_copy_of_the_corpus(spark, data, tmp_path, monkeypatch):
    folder = tmp_path / "shared"
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda s, d, f: d) for n, _ in corpus_pipeline.STAGES])
    old = spark.conf.get("spark.checkpoint.dir")
    monkeypatch.setattr("fleetledger.session.scratch", lambda s, name: f"{folder}/{name}")
    monkeypatch.setattr("fleetledger.llm.common.scratch", lambda s, name: f"{folder}/{name}")
    n = corpus_pipeline.run(spark, data).count()
    assert n == spark.read.parquet(f"{data}/documents.parquet").count() and old
    assert [p.name for p in folder.iterdir()] == ["pipeline-3"]


def test_a_missing_part_is_an_error():
    """Only an installation without the whole package leaves the queries out."""
    code = "import sys; sys.modules['fleetledger.llm.secrets'] = None\nimport __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])
    assert done.returncode and "ModuleNotFoundError" in done.stderr
