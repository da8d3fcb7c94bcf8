"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table

SHINGLE = 5
CONTAINMENT = 0.8
#: Characters of benchmark text that one pass over the documents may carry to the executors.
BLOCK_CHARS = 16_000_000
#: A word: letters and digits after lower-casing; every character beyond ASCII counts as a letter.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
_M, _Q = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


class _Powers:
    """Powers of _M and of its inverse, as many as the longest text so far has bytes."""

    def __init__(self) -> None:
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        with np.errstate(over="ignore"):
            self.up, self.down = _powers(_M, n), _powers(np.uint64(pow(int(_M), -1, 1 << 64)), n)


def word_hashes(text: str, powers: _Powers) -> np.ndarray:
    """A hash of each word, from running sums over the whole text's bytes."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = _IN_WORD[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    if len(b) > len(powers.up):
        powers.grow(2 * len(b))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers.up[: len(b)], dtype=np.uint64)))
        return _mix((sums[ends] - sums[starts]) * powers.down[starts])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[:n].copy()
        for k in range(1, size):
            out = out * _Q + words[k : k + n]
        return _mix(out)


def sketch_size(n: int, containment: float) -> int:
    """MinHash values to keep for an item of n shingles, by the upper end of its size partition (powers of two).

    At containment c at most u - ceil(c * u) shingles of u are missing, so one value more always meets a document.
    """
    u = 1 << (n - 1).bit_length()
    return min(n, u - int(np.ceil(containment * u - 1e-9)) + 1)


class ItemIndex:
    """Sketches of some items: the k smallest shingle hashes of each, k by its size partition."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, containment: float) -> None:
        self.items, self.containment = [], containment
        sketches: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        powers = _Powers()
        for item_id, text in items:
            if not (w := words_of(text)):
                continue
            size = min(shingle, len(w))
            hashes = np.unique(shingle_hashes(word_hashes(text, powers), size))
            self.items.append((item_id, size, frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))))
            for h in hashes[: sketch_size(len(hashes), containment)].tolist():
                sketches[size][h].append(len(self.items) - 1)
        self.sketches = {s: (np.array(sorted(d), np.uint64), dict(d)) for s, d in sketches.items()}

    def search(self, text: str, powers: _Powers) -> list[tuple[int, int, int]]:
        """(item_id, its shingles, those that text has) for every item contained enough."""
        w = word_hashes(text, powers)
        found: set[int] = set()
        for size, (keys, owners) in self.sketches.items():
            if len(h := shingle_hashes(w, size)):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                for key in np.unique(h[keys[at] == h]).tolist():
                    found.update(owners[key])
        if not found:
            return []
        words, out, own = words_of(text), [], {}
        for i in sorted(found):
            item_id, size, shingles = self.items[i]
            if size not in own:
                own[size] = {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}
            if (n := len(shingles & own[size])) >= self.containment * len(shingles) - 1e-9:
                out.append((item_id, len(shingles), n))
        return out


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str, shingle: int, containment: float, block_chars: int) -> Iterator[tuple[Broadcast, bool]]:
    """Indexes of the benchmark's items in blocks of about block_chars characters, and whether it is the last. A block is made when it is asked for."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").distinct()
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = 1 if chars <= block_chars else -(-2 * chars // block_chars)
    if n > 1:
        items = cut(items, "benchmark-items")  # read once for each block, made once
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        yield spark.sparkContext.broadcast(ItemIndex([(r.i, r.t) for r in rows], shingle, containment)), k == n - 1


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, containment: float = CONTAINMENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): items of which a document holds enough distinct word shingles.

    MinHash for sets of very different sizes: only the small side, the item, is sketched; a document is a candidate if
    any value of the sketch is among its shingles' hashes, which no item contained enough can miss; candidates are
    verified with the shingles themselves. An item of fewer than five words is one shingle of all its words.

    The benchmark is a query set: it goes to the executors in blocks of at most block_chars characters (and one item
    more), one at a time: the hits of a pass over the documents are written, then its block is destroyed and the next
    one made. Documents stay where they are: nothing is shuffled.
    Null and empty texts, and items without words, never match. A repeated document row is reported again; an item
    with the same id and text counts once. Extra columns are ignored; empty tables give no rows.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
    out = None
    for index, _ in item_blocks(benchmark, item_id, item_text, shingle, containment, block_chars):

        def work(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            powers = _Powers()
            for b in slices(batches):
                hits = [(d, i, m, k, k / m) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) if (body := t.as_py()) for i, m, k in index.value.search(body, powers)]
                yield pa.RecordBatch.from_arrays([pa.array([h[c] for h in hits], pa.float64() if c == 4 else pa.int64()) for c in range(5)], ["doc_id", "item_id", "n_shingles", "n_shared", "containment"])

        found = cut(d.mapInArrow(work, schema), "benchmark-hits")
        index.destroy()
        out = found if out is None else out.union(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, containment: float = CONTAINMENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no benchmark item (as find_leaks has it). Rows are not moved.

    Of a benchmark of several blocks, each but the last costs a table of the rows that are left, so that one block at a
    time is held.
    """
    for index, last in item_blocks(benchmark, item_id, item_text, shingle, containment, block_chars):

        def work(batches: Iterator[pa.RecordBatch], index=index, at=docs.columns.index(text)) -> Iterator[pa.RecordBatch]:
            powers = _Powers()
            for b in slices(batches):
                if b.num_rows:
                    yield b.filter(pa.array([not ((body := t.as_py()) and index.value.search(body, powers)) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
        if not last:
            docs = cut(docs, "benchmark-rest")
            index.destroy()
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_leaks of documents and benchmark; edge cases as there."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = rf"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
its AS (SELECT DISTINCT item_id, least({SHINGLE}, len(w)) AS size, array_to_string(w[i:i + least({SHINGLE}, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least({SHINGLE}, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM its),
ds AS (SELECT DISTINCT doc_id, size, array_to_string(w[i:i + size - 1], ' ') AS s
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes)),
n AS (SELECT item_id, count(*) AS n_shingles FROM its GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS n_shared FROM ds JOIN its USING (size, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared::DOUBLE / n_shingles AS containment
FROM m JOIN n USING (item_id) WHERE n_shared >= {CONTAINMENT} * n_shingles - 1e-9"""
