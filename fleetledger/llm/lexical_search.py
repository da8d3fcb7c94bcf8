"""Ranked lexical search: integer BM25 scores; documents are grouped by the mask of an item's terms that they hold."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, slices, table

TOP = 10
#: Characters of items (and one item more) that one pass over the documents carries to the executors.
BLOCK_CHARS = 1_000_000
#: Documents whose bitmaps are made at one time.
ROWS = 4096
#: What a term is made of, and the bytes that a text becomes: A-Z in lower case, a space for all that is in no term.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Block:
    """Some items as numbers: every term's place, and for each item its distinct terms and how often it has them."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.places: dict[bytes, int] = {}
        self.items: list[tuple[int | None, np.ndarray, np.ndarray]] = []
        for item_id, text in items:
            counts = Counter(terms_of(text.encode("utf-8", "surrogatepass")))
            own = np.fromiter((self.places.setdefault(t, len(self.places)) for t in counts), np.int64, len(counts))
            self.items.append((item_id, own, np.fromiter(counts.values(), np.int64, len(counts))))


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str, block_chars: int) -> Iterator[Block]:
    """The distinct items in blocks of about block_chars characters, one at a time."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").distinct()
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = 1 if chars <= block_chars else -(-2 * chars // block_chars)
    if n > 1:
        items = cut(items, "search-items")  # read once for each block, made once
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        yield Block(sorted(((r.i, r.t) for r in rows), key=lambda x: (x[0] is None, x)))


def postings(docs: DataFrame, places: Broadcast, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row of docs with a term: n terms in all, and which of the block's it has how often."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = places.value.get
        for b in slices(batches):
            rows, sizes, ns, terms, tfs = [], [0], [], [], []
            for k, t in enumerate(b.column(1)):
                if (body := t.as_py()) and (words := terms_of(body)):
                    own, tf = np.unique(np.array([p for w in words if (p := get(w)) is not None], np.int32), return_counts=True)
                    rows.append(k)
                    ns.append(len(words))
                    terms.append(own)
                    tfs.append(tf)
                    sizes.append(sizes[-1] + len(own))
            at = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.empty(0, x), *parts]).astype(x))) for parts, x in ((terms, np.int32), (tfs, np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(ns, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n long, terms array<int>, tfs array<long>")


class Best:
    """The best rows of one item so far, by score, then by id (none last)."""

    def __init__(self, top: int) -> None:
        self.top, self.score, self.none, self.doc = top, np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """A score under this can't come in any more; one equal to it can, by its id."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, none: np.ndarray, doc: np.ndarray) -> None:
        s, n, d = np.concatenate([self.score, score]), np.concatenate([self.none, none]), np.concatenate([self.doc, doc])
        keep = np.lexsort((d, n, -s))[: self.top]
        keep = keep[s[keep] > 0]
        self.score, self.none, self.doc = s[keep], n[keep], d[keep]


class Rows:
    """The postings of some documents: bitmaps by term, what each posting is worth, and each term's highest worth."""

    def __init__(self, doc: np.ndarray, none: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, w: np.ndarray) -> None:
        self.doc, self.none, self.sizes, self.terms, self.n = doc, none, sizes, terms, len(doc)
        self.starts = np.cumsum(sizes) - sizes
        row = np.repeat(np.arange(self.n), sizes)
        self.worth = w[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[row]))
        self.most = np.zeros(len(w), np.int64)
        np.maximum.at(self.most, terms, self.worth)
        wide = -(-self.n // 8)
        bits = np.zeros(len(w) * wide, np.uint8)
        np.bitwise_or.at(bits, terms.astype(np.int64) * wide + (row >> 3), (128 >> (row & 7)).astype(np.uint8))
        self.bits = bits.reshape(len(w), wide)

    def masks(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows with any of own terms; the distinct masks of own terms that they hold, as bits; which mask each has."""
        bitmaps = self.bits[own]
        rows = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bitmaps, axis=0), count=self.n))
        packed = np.packbits(np.unpackbits(bitmaps, axis=1, count=self.n)[:, rows], axis=0)
        keys = np.zeros((len(rows), -(-len(packed) // 8) * 8), np.uint8)
        keys[:, : len(packed)] = packed.T
        keys = keys.view(np.uint64)
        first, which = np.unique(keys[:, 0] if keys.shape[1] == 1 else keys.view(f"V{8 * keys.shape[1]}")[:, 0], return_index=True, return_inverse=True)[1:]
        return rows, np.unpackbits(packed[:, first].T, axis=1, count=len(own)), which.reshape(-1)

    def search(self, own: np.ndarray, times: np.ndarray, best: Best, worths: np.ndarray) -> int:
        """Bring the item's best up to date; how many rows were scored. worths: zeros by term, and zeros again after it.

        The masks are taken by descending highest score (every term of the mask at its highest worth here), until the
        next one's is under the score of the last of the best: no row from there on can come in.
        """
        if not len(own) or int(times @ self.most[own]) < best.least:
            return 0
        rows, bits, which = self.masks(own)
        highest = bits.astype(np.int64) @ (times * self.most[own])
        order = np.lexsort((which, -highest[which]))  # rows of one mask stand together
        rows, limit, at, step = rows[order], highest[which[order]], 0, 4 * best.top
        worths[own] = times
        while at < len(rows) and limit[at] >= best.least:
            end = at + int(np.searchsorted(-limit[at : at + step], -best.least, "right"))
            some, at, step = rows[at:end], end, 4 * step
            sizes = self.sizes[some]
            flat = np.repeat(self.starts[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            best.add(np.add.reduceat(self.worth[flat] * worths[self.terms[flat]], np.cumsum(sizes) - sizes), self.none[some], self.doc[some])
        worths[own] = 0
        return at


def best_of_tasks(index: DataFrame, query: Broadcast, top: int) -> DataFrame:
    """(item: its place in the block, doc_id, score): each task's best rows of each item. A task keeps top rows an item, however many it reads."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w, total, length = query.value
        bests, worths = [Best(top) for _ in items], np.zeros(len(w), np.int64)
        for b in slices(batches, ROWS):
            if not b.num_rows:
                continue
            doc, n = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            lists = b.column(2)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            terms, tfs = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
            rows = Rows(doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False), 25 + 75 * n * total // length, sizes, terms, tfs, w)
            for (_, own, times), best in zip(items, bests, strict=True):
                rows.search(own, times, best, worths)
        out = [(k, None if none else int(d), int(s)) for k, best in enumerate(bests) for s, none, d in zip(best.score, best.none, best.doc, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], ["item", "doc_id", "score"])

    return index.mapInArrow(work, "item long, doc_id long, score long")


def search(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): the top documents of every item with a score above 0, equal scores by ascending doc_id.

    Terms are the maximal matches of TERM, A-Z in lower case. Each text is read once for a block of items (BLOCK_CHARS),
    into a table of postings of the block's terms; documents are counted over all of it. Then each task groups its
    documents by the mask of an item's terms that they hold (bitmaps by term) and scores masks by descending highest
    score, until none that is left can come in. Tasks pass on top rows an item. Nothing but those is shuffled.

    Null and empty texts and texts without a term are no documents; an item without a term has no rows. A row without
    doc_id is ranked, after equal scores that have one. Repeated rows are documents of their own. An item with the same
    id and text counts once; equal ids with other texts are items of their own. Extra columns are ignored; empty tables
    give no rows. All numbers are 64-bit integers, but the logarithm.
    """
    spark, out = docs.sparkSession, None
    for block in item_blocks(benchmark, item_id, item_text, block_chars):
        places = spark.sparkContext.broadcast(block.places)
        index = cut(postings(docs, places, doc_id, text), "search-postings")
        total, length = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        w = np.zeros(len(block.places), np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():  # at most the block's terms
            w[r.t] = math.floor(1000 * math.log((2 * total + 2) / (2 * r.df + 1)))
        query = spark.sparkContext.broadcast((block.items, w, total, length))
        found, order = best_of_tasks(index, query, top), [F.desc("score"), F.asc_nulls_last("doc_id")]
        for keys in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(64))], ["item"]):  # first within parts of an item, so that no task gets all of its rows
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
        ids = spark.createDataFrame([(k, i) for k, (i, _, _) in enumerate(block.items)], "item long, item_id long")
        found = cut(found.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"), "search-ranked")
        places.destroy()
        query.destroy()
        out = found if out is None else out.union(found)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search over documents for the items of benchmark; edge cases as there."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS w FROM documents WHERE text IS NOT NULL),
q AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
qt AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS t FROM q) GROUP BY ALL),
stats AS (SELECT count(*)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, stats),
p AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll))) AS worth FROM tf JOIN w USING (t), stats),
s AS (SELECT item_id, doc_id, sum(times * worth)::BIGINT AS score FROM qt JOIN p USING (t) GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}"""
