"""Language identification by a bidirectional gated recurrent network over bytes, trained here by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held_out, slices, table

#: Documents per language that the network may learn from, characters of each, and most languages: these bound what is collected.
PER_LANGUAGE, SAMPLE_CHARS, LANGUAGES = 150, 384, 200
#: STEPS: bytes of a window. A text is read in windows, each from a fresh state, and all its positions are pooled.
STEPS, HIDDEN, EPOCHS, BATCH, RATE = 48, 8, 12, 128, 0.02
_PAD = 256
_F = np.float32


def _softsign(x: np.ndarray) -> np.ndarray:
    bound = np.abs(x)
    bound += _F(1)
    return np.divide(x, bound, out=x)


@dataclass
class Network:
    """Per direction d: t (3h, 257) is what a byte adds to update, reset and candidate; u (2h, h) and c (h, h) take the state.

    out (L, 2h) and bias (L, 1) make a distribution over the languages at every position. The batch is the last axis of
    every array. The column of t for padding holds the update gate at 1, so a padded position keeps the state. Gates and
    candidates use x / (1 + |x|), whose slope follows from its value, in place of the slower hyperbolic tangent.
    """

    languages: list[str]
    p: dict[str, np.ndarray]

    @staticmethod
    def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = 8) -> Network:
        r, p = np.random.default_rng(seed), {}
        for d in "fb":
            p |= {f"t{d}": r.normal(0, 0.3, (3 * hidden, 257)), f"u{d}": r.normal(0, 0.3, (2 * hidden, hidden)), f"c{d}": r.normal(0, 0.3, (hidden, hidden))}
            p[f"t{d}"][:hidden, _PAD] = 1e9
        p |= {"out": r.normal(0, 0.3, (len(languages), 2 * hidden)), "bias": np.zeros((len(languages), 1))}
        return Network(languages, {k: v.astype(_F) for k, v in p.items()})

    def _states(self, x: np.ndarray, d: str, keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Position and state (h, batch) in the order in which direction d reads x (steps, batch)."""
        t, u, c = self.p[f"t{d}"], self.p[f"u{d}"], self.p[f"c{d}"]
        n, half, one = u.shape[1], _F(0.5), _F(1)
        h = np.zeros((n, x.shape[1]), _F)
        for s in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            e = np.take(t, x[s], axis=1, mode="clip")
            g = u @ h
            g += e[: 2 * n]
            g = _softsign(g)
            g += one
            g *= half
            z, r = g[:n], g[n:]
            k = c @ (r * h)
            k += e[2 * n :]
            k = _softsign(k)
            new = h - k
            new *= z
            new += k
            if keep is not None:
                keep.append((s, h, z, r, k))
            h = new
            yield s, h

    def positions(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Position and the distributions (L, batch) there, from the last position to the first."""
        n = self.p["cf"].shape[0]
        forward = [h for _, h in self._states(x, "f")]
        ahead, behind = self.p["out"][:, :n], self.p["out"][:, n:]
        for s, h in self._states(x, "b"):
            e = ahead @ forward[s]
            e += behind @ h
            e += self.p["bias"]
            e -= e.max(axis=0)
            np.exp(e, out=e)
            e /= e.sum(axis=0)
            yield s, e

    def labels(self, text: str) -> list[str]:
        """The likeliest language at every byte of a text."""
        x = windows(text.encode("utf-8", "surrogatepass"))
        best = np.empty(x.shape, np.int64)
        for s, p in self.positions(x.T):
            best[:, s] = p.argmax(axis=0)
        return [self.languages[k] for k in best[x != _PAD].tolist()]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions that aren't padding."""
        kept: dict[str, list] = {"f": [], "b": []}
        n, g, states = self.p["cf"].shape[0], {}, np.empty((len(x), 2 * self.p["cf"].shape[0], x.shape[1]), _F)
        for d, rows in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            for s, h in self._states(x, d, kept[d]):
                states[s, rows] = h
        e = self.p["out"] @ states + self.p["bias"]
        e = np.exp(e - e.max(axis=1, keepdims=True))
        delta = e / e.sum(axis=1, keepdims=True)
        delta[:, y, np.arange(len(y))] -= 1
        real = (x != _PAD)[:, None, :]
        delta = delta * real / _F(max(1, real.sum()))
        g["out"] = np.einsum("slb,shb->lh", delta, states)
        g["bias"] = delta.sum(axis=(0, 2))[:, None]
        back = self.p["out"].T @ delta
        for d, rows in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            u, c = self.p[f"u{d}"], self.p[f"c{d}"]
            gt, gu, gc, dh = np.zeros((257, 3 * n), _F), np.zeros_like(u), np.zeros_like(c), np.zeros((n, x.shape[1]), _F)
            for s, h, z, r, k in reversed(kept[d]):
                dh = dh + back[s, rows]
                dk = dh * (1 - z) * (1 - np.abs(k)) ** 2
                drh = c.T @ dk
                dg = np.concatenate([dh * (h - k) * (1 - np.abs(2 * z - 1)) ** 2, drh * h * (1 - np.abs(2 * r - 1)) ** 2]) * _F(0.5)
                gc += dk @ (r * h).T
                gu += dg @ h.T
                np.add.at(gt, x[s], np.concatenate([dg, dk]).T)
                dh = dh * z + drh * r + u.T @ dg
            g |= {f"t{d}": gt.T, f"u{d}": gu, f"c{d}": gc}
        return g


def windows(raw: bytes, steps: int = STEPS) -> np.ndarray:
    """(n, steps): the whole text in windows, the last one padded."""
    b = np.frombuffer(raw, np.uint8)
    out = np.full((-(-len(b) // steps), steps), _PAD, np.int16)
    out.reshape(-1)[: len(b)] = b
    return out


def train(texts: list[tuple[str, str]], epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE) -> Network:
    """Adam over windows of (text, language); every position of a window learns its document's language."""
    languages = sorted({lang for _, lang in texts})
    net = Network.fresh(languages)
    parts = [(w, languages.index(lang)) for t, lang in texts for w in [windows(t.encode("utf-8", "surrogatepass"))] if len(w)]
    if not parts or len(languages) < 2:
        return net
    x, y = np.concatenate([w for w, _ in parts]), np.concatenate([np.full(len(w), k) for w, k in parts])
    r, step = np.random.default_rng(8), 0
    m, v = {k: np.zeros_like(p) for k, p in net.p.items()}, {k: np.zeros_like(p) for k, p in net.p.items()}
    for _ in range(epochs):
        order = r.permutation(len(x))
        for at in range(0, len(x), batch):
            step += 1
            take = order[at : at + batch]
            for k, g in net.gradients(x[take].T, y[take]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.p[k] = (net.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(_F)
    return net


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, chars: int = SAMPLE_CHARS, languages: int = LANGUAGES) -> Network:
    """Learn from per_language documents of each language that aren't held out, and a stretch of chars characters of each.

    Documents are chosen, and stretches placed, by a hash of doc_id. Rows without a doc_id, a text or
    a language teach nothing. languages bounds what is collected: where there are more, it is a ValueError, so none is left out unseen.
    """
    d = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    stretch = d.select("doc_id", "lang", F.col("text").substr(start, F.lit(chars)).alias("t"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "t"))
    chosen = stretch.withColumn("rank", rank).where(F.col("rank") <= per_language).orderBy("lang", "rank").limit((languages + 1) * per_language)
    texts = [(r.t, r.lang) for r in chosen.collect()]
    if len({lang for _, lang in texts}) > languages:
        raise ValueError(f"there are over {languages} languages; give a larger bound, or map rare ones to one of their own")
    return train(texts)


def identify(net: Network, texts: list[str], windows_at_once: int = 4096) -> list[tuple[str | None, float]]:
    """Language and probability of each text: the mean of the distributions at all its positions."""
    sums = np.zeros((len(texts), len(net.languages)))
    parts = [windows(t.encode("utf-8", "surrogatepass")) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    if not net.languages:
        return [(None, 0.0)] * len(texts)
    x = np.concatenate(parts) if parts else np.empty((0, STEPS), np.int16)
    for at in range(0, len(x), windows_at_once):
        part = np.ascontiguousarray(x[at : at + windows_at_once].T)
        real, pooled = (part != _PAD).astype(_F), np.zeros((len(net.languages), part.shape[1]), _F)
        for step, p in net.positions(part):
            p *= real[step]
            pooled += p
        np.add.at(sums, owner[at : at + windows_at_once], pooled.T)
    total = np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)
    best = sums.argmax(axis=1)
    return [(net.languages[k], float(min(1.0, s))) for k, s in zip(best.tolist(), (sums / total)[np.arange(len(texts)), best], strict=True)]


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs, over its whole text.

    A null text, one without a letter, and every text if nothing could be learnt, is 'und' with score 0. Rows stand
    alone; a null doc_id counts as not held out; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ask = [i for i, a in enumerate(b.column(2).to_pylist()) if a]
            out = [("und", 0.0)] * b.num_rows
            size, group = 0, []
            for i in [*ask, None]:
                if i is not None:
                    group.append((i, t := b.column(3)[i].as_py()))
                    size += len(t)
                if group and (i is None or size > 1_000_000):
                    for (j, _), (lang, score) in zip(group, identify(shared.value, [t for _, t in group]), strict=True):
                        out[j] = (lang, score) if lang is not None else ("und", 0.0)
                    size, group = 0, []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"), text.alias("text"))
    return d.mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predict of documents, by a network fitted to those that are not held out; edge cases as there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs.select("doc_id", "text"), fit(docs))
