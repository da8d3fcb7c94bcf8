"""Quality by nearest-neighbour voting: labelled latent-semantic vectors are broadcast, every document meets all of them."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, slices, table

#: Labelled documents of either class that the model may hold: this bounds what is collected and broadcast.
PER_CLASS = 1000
DIMENSIONS, NEIGHBOURS, SHARPNESS, BLOCK = 24, 15, 8, 4096
THRESHOLD = 0.3
_CLASSES = 16
_OF_BYTE = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\v\f", b".", b",;:", b"!", b"?", b"*#$%&", b"|<>", b"'\"`", b"()[]{}", b"@+=/\\_-^~")):
    _OF_BYTE[list(_chars)] = _k + 1
_OF_BYTE[128:] = 15
#: Terms: hashed words of the whole text; further ones: triples of character classes, the share of words equal to the one
#: before, and how many words are new. Relative frequencies of words and of triples are
#: multiplied by these weights; the words' was chosen by cross_validate() within the rows that may be learnt from.
WORD_TERMS, SHAPES = 1 << 16, _CLASSES**3
TERMS = WORD_TERMS + SHAPES + 2
WORD_WEIGHT, SHAPE_WEIGHT = 0.125, 1.0
#: Words are runs without spaces and punctuation; from Thai on, scripts that put no spaces between words give pairs of characters.
_WORD = re.compile("[^\\s!-/:-@\\[-`{-\xbf\u060c\u061b\u061f\u06d4\u0964\u0965\u2000-\u206f\u3000-\u303f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")
_UNSPACED = "\u0e00"
#: Columns of the term matrix that the driver holds as numbers at one time.
COLUMNS = 1024


def words_of(text: str) -> Counter:
    """How often each word occurs, in lower case."""
    found = Counter(_WORD.findall(text.lower()))
    if not text.isascii():
        for w in [w for w in found if len(w) > 2 and max(w) >= _UNSPACED]:
            n = found.pop(w)
            for pair in map("".join, zip(w, w[1:])):
                found[pair] += n
    return found


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and their weights (roots of relative frequencies) in the whole text. A text without any byte has none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return np.empty(0, np.int64), np.empty(0)
    c = _OF_BYTE[np.frombuffer(raw, np.uint8)]
    counts = words_of(text)
    hashed = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in counts), np.int64, len(counts)) % WORD_TERMS
    words, which = np.unique(hashed, return_inverse=True)
    weights = np.bincount(which, np.fromiter(counts.values(), np.float64, len(counts)), len(words)) * (WORD_WEIGHT / max(1, counts.total()))
    n = np.bincount(c[:-2] * 256 + c[1:-1] * 16 + c[2:], minlength=SHAPES + 2).astype(np.float64)
    n[0] = 0
    n *= SHAPE_WEIGHT / max(1.0, n.sum())
    tokens = raw.split()
    if tokens:
        n[-2] = sum(map(bytes.__eq__, tokens[1:], tokens)) / len(tokens)
        n[-1] = (1 - len(set(tokens)) / len(tokens)) ** 2
    at = np.flatnonzero(n)
    return np.concatenate([words, at + WORD_TERMS]), np.sqrt(np.concatenate([weights, n[at]]))


@dataclass
class Model:
    """Projection of weighted terms, words among them (inverse document frequency times right singular vectors), labelled unit vectors, their labels."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        v = np.array([w @ self.projection[at] for at, w in texts]).reshape(len(texts), -1)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def score(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Share of label 1 among the nearest neighbours' votes, weighted by a power of the cosine; no vote: the labels' mean."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        v, best, votes = self.embed(texts), np.empty((len(texts), 0)), np.empty((len(texts), 0))
        for at in range(0, len(self.labels), BLOCK):
            cosines = np.concatenate([best, v @ self.vectors[at : at + BLOCK].T], axis=1)
            labels = np.concatenate([votes, np.broadcast_to(self.labels[at : at + BLOCK], (len(texts), len(self.labels[at : at + BLOCK])))], axis=1)
            k = min(NEIGHBOURS, cosines.shape[1])
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            best, votes = np.take_along_axis(cosines, near, axis=1), np.take_along_axis(labels, near, axis=1)
        w = np.maximum(best, 0) ** SHARPNESS
        total = w.sum(axis=1)
        return np.where(total > 1e-12, (w * votes).sum(axis=1) / np.maximum(total, 1e-12), self.labels.mean())


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        got = [terms(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0].astype("<i4").tobytes() for g in got], pa.binary()), pa.array([g[1].astype("<f8").tobytes() for g in got], pa.binary())], ["doc_id", "at", "w"])


def largest(gram: np.ndarray, k: int, tolerance: float = 1e-12, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix without negative ones, and their vectors as columns.

    By iterating a subspace, until they fit the matrix to the tolerance: a whole decomposition takes five times the matrix
    in memory, which is the driver's. It is made only if the matrix is small or the steps don't get there.
    """
    n, width = len(gram), 2 * k + 8
    if n > 4 * width:
        v = np.random.default_rng(0).standard_normal((n, width))
        for _ in range(steps):
            v = np.linalg.qr(gram @ v)[0]
            image = gram @ v
            values, turn = np.linalg.eigh(v.T @ image)
            turn, values = turn[:, : -k - 1 : -1], values[: -k - 1 : -1]
            if np.abs(image @ turn - v @ turn * values).max() <= tolerance * max(values[0], 1e-12):
                return values, v @ turn
    return np.linalg.eigh(gram)


def project(found: list[tuple[np.ndarray, np.ndarray]], dimensions: int) -> np.ndarray:
    """Inverse document frequency times the first right singular vectors of the term matrix, made COLUMNS columns at a time."""
    doc = np.repeat(np.arange(len(found), dtype=np.int32), [len(at) for at, _ in found])
    term, w = np.concatenate([at for at, _ in found]), np.concatenate([w for _, w in found])
    idf = np.log((1 + len(found)) / (1 + np.bincount(term, minlength=TERMS)))
    order = np.argsort(term, kind="stable")
    doc, term, w = doc[order], term[order], (w * idf[term])[order]

    def blocks() -> Iterator[tuple[int, np.ndarray]]:
        for first in range(0, TERMS, COLUMNS):
            a, b = np.searchsorted(term, [first, first + COLUMNS])
            if a < b:
                m = np.zeros((len(found), min(COLUMNS, TERMS - first)))
                m[doc[a:b], term[a:b] - first] = w[a:b]
                yield first, m

    gram = np.zeros((len(found), len(found)))
    for _, m in blocks():
        gram += m @ m.T
    values, left = largest(gram, dimensions)
    keep = [i for i in np.argsort(-values)[:dimensions] if values[i] > 1e-9 * max(values.max(), 1e-12)]
    right = np.zeros((TERMS, len(keep)))
    for first, m in blocks():
        right[first : first + m.shape[1]] = m.T @ left[:, keep] / np.sqrt(values[keep])
    return idf[:, None] * right


def cross_validate(found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, word_weights: tuple[float, ...], folds: int = 5, dimensions: int = DIMENSIONS) -> dict[float, tuple[float, float]]:
    """(mean squared error of the scores, accuracy) for each weight of words, every document scored by a model of the other folds.

    found: terms() of labelled documents that may be learnt from (weighted by WORD_WEIGHT), so held-out rows have no say.
    """
    out = {}
    for weight in word_weights:
        scaled = [(at, np.where(at < WORD_TERMS, w * np.sqrt(weight / WORD_WEIGHT), w)) for at, w in found]
        score = np.zeros(len(found))
        for k in range(folds):
            learn = [i for i in range(len(found)) if i % folds != k]
            model = Model(project([scaled[i] for i in learn], dimensions), np.zeros((0, 1)), np.zeros(0))
            model = Model(model.projection, model.embed([scaled[i] for i in learn]), labels[learn])
            score[k::folds] = model.score(scaled[k::folds])
        out[weight] = (float(np.mean((score - labels) ** 2)), float(np.mean((score >= THRESHOLD) == (labels == 1))))
    return out


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, dimensions: int = DIMENSIONS) -> Model:
    """Learn from at most per_class labelled, not held out documents of either class, chosen by a hash of doc_id.

    Only their ids (bounded) are broadcast to find their texts, and only their term weights come to the driver. Where
    rows repeat a doc_id, the smallest text stands for it, so a repeated row brings nothing more to the driver.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).distinct()
    order = lambda q: known.where(F.col("quality") == q).orderBy(F.xxhash64("id"), "id").limit(per_class)
    quality = {}
    for r in order(0).union(order(1)).collect():
        quality.setdefault(r.id, []).append(r.quality)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isin(list(quality))).groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = sorted(texts.mapInArrow(_featurize, "doc_id long, at binary, w binary").collect(), key=lambda r: r.doc_id) if quality else []
    if not rows:
        return Model(np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0))
    found = [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["w"], "<f8")) for r in rows]
    model = Model(project(found, dimensions), np.zeros((0, 1)), np.zeros(0))
    v = model.embed(found)
    ones = [q for r in rows for q in quality[r.doc_id]]
    return Model(model.projection, np.repeat(v, [len(quality[r.doc_id]) for r in rows], axis=0), np.array(ones, np.float64))


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, over its whole text.

    An empty text or a null has no terms and gets the labels' mean (0.5 with no labels). Rows
    are scored alone: repeated rows come back each, a null doc_id counts as not held out, extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            score = shared.value.score([terms(t.as_py()) for t in b.column(2)]) if b.num_rows else np.empty(0)
            score = np.clip(score, 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_quality of documents, fitted to the labels; edge cases as there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))


def keep_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose text the classifier accepts. Rows are not moved."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if b.num_rows:
                yield b.filter(pa.array(shared.value.score([terms(t.as_py()) for t in b.column(at)]) >= threshold))

    return docs.mapInArrow(work, docs.schema)
