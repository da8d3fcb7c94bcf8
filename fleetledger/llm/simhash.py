"""SimHash near-duplicates: pivot distance tables discard pairs of fingerprints, survivors are verified and linked.

The pivots are placed so that their distances spell out segments of the fingerprint: what is joined on are coordinates of
the pivot table, but they hold the same as the fingerprint's bits in those cells, so the search by keys is a search by
segments. With scattered pivots distances of unrelated fingerprints all lie near 32, and ranges of them share nearly all
pairs; that can't be run at scale. The difference of distances discards what the keys let through, which is little.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, slices, table, unused

MAX_BITS = 2
SEED = 42
#: The reference fingerprints: a base, and references that differ from it in two neighbouring bits of one cell. A cell
#: has as many references as bits; cells (first bit, bits) make up five blocks.
BASE = 0x9E3779B97F4A7C15
BLOCKS = tuple(((at, 5 if at < 52 else 4), (at + (5 if at < 52 else 4), 4), (at + (9 if at < 52 else 8), 4)) for at in (0, 13, 26, 39, 52))
CELLS = tuple(c for block in BLOCKS for c in block)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64 bits: one is set if over half of the shingles' XXH64 have it. 0 if text has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < shingle:
        spans = [(0, len(line))]
    else:
        spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, th: XXH64 of the text as a signed long, a null text counting as empty; fp as signed long) for every row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "th", "fp"])

    body = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(body).alias("th"), body.alias("text"))
    return rows.mapInArrow(work, "doc_id long, th long, fp long")


def text_hash(body: Column) -> Column:
    return F.xxhash64(F.coalesce(body, F.lit("")))


def references() -> np.ndarray:
    """The base, then the references of each cell in order."""
    pairs = [(1 << at + k) | (1 << at + (k + 1) % n) for at, n in CELLS for k in range(n)]
    return np.array([BASE, *[BASE ^ p for p in pairs]], np.uint64)


def distances(fps: np.ndarray) -> np.ndarray:
    """A row of the pivot table for each fingerprint: its Hamming distances to all references."""
    return np.bitwise_count(fps.view(np.uint64)[:, None] ^ references()).astype(np.int8)


def coordinates(fps: np.ndarray) -> np.ndarray:
    """(n, cells): what the distances to a cell's references say beyond the distance to the base (-2, 0 or 2 each), as one number.

    A changed bit changes the coordinates of its own cell only.
    """
    d = distances(fps)
    digits = (d[:, 1:] - d[:, :1]) // 2 + 1
    out, at = np.empty((len(fps), len(CELLS)), np.int64), 0
    for c, (_, n) in enumerate(CELLS):
        out[:, c] = digits[:, at : at + n] @ 3 ** np.arange(n)
        at += n
    return out


#: Every choice of blocks that agree (level 1), and of cells of the blocks left out that agree besides (level 2).
AGREE = [[3 * b + k for b in blocks for k in range(3)] for blocks in combinations(range(5), 5 - MAX_BITS)]
BESIDES = [list(c) for cells in AGREE for c in combinations([x for x in range(15) if x not in cells], 6 - MAX_BITS)]


def first_keys(fps: DataFrame) -> DataFrame:
    """(fp, t, key): for every fingerprint and choice of blocks, a hash of the coordinates there."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            c = coordinates(fp)
            keys = [pa.array(np.column_stack([_hash(c[:, cells], t) for t, cells in enumerate(AGREE)]).reshape(-1))]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, len(AGREE))), pa.array(np.tile(np.arange(len(AGREE), dtype=np.int8), len(fp))), *keys], ["fp", "t", "key"])

    return fps.select("fp").mapInArrow(work, "fp long, t tinyint, key long")


def second_keys(first: DataFrame) -> DataFrame:
    """(fp, key): for every row of first keys and choice of cells besides, a hash of the first key and the coordinates there."""
    n = len(BESIDES) // len(AGREE)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, t, key = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            c, out = coordinates(fp), np.empty((len(fp), n), np.int64)
            for k in range(len(AGREE)):
                own = np.flatnonzero(t == k)
                for s in range(n):
                    out[own, s] = _hash(np.column_stack([key[own], c[own][:, BESIDES[k * n + s]]]), s)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(fp, n)), pa.array(out.reshape(-1))], ["fp", "key"])

    return first.select("fp", "t", "key").mapInArrow(work, "fp long, key long")


def _hash(columns: np.ndarray, seed: int) -> np.ndarray:
    """One number for each row. Rows that collide are candidates without need, which the distances discard."""
    h = np.full(len(columns), seed + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(columns.shape[1]):
            h = (h ^ columns[:, k].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(29)
    return h.view(np.int64)


def shared_keys(keyed: DataFrame, name: str) -> DataFrame:
    """The rows of keyed whose key is on two rows or more.

    Keys are counted with partial sums and kept as a table: the join has shuffles of its own, which Spark can split.
    """
    keyed = cut(keyed, f"{name}-all")
    counts = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("of")), f"{name}-counts")
    return cut(keyed.join(counts, F.col("key") == F.col("of"), "left_semi"), name)


def candidates(fps: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v, of distinct fingerprints (fp) that agree in the coordinates of 13 of the 15 cells.

    At most MAX_BITS cells hold the bits in which a pair in reach differs, so such a pair agrees in all others and in at
    least three of the five blocks. The index has two levels of keys: the coordinates of three blocks, then, of
    fingerprints that share such a key, those of four of the other two blocks' six cells. The two cells left out have at
    most ten bits, which bounds what shares a key by about 2^10 fingerprints however many there are.
    """
    both = shared_keys(second_keys(shared_keys(first_keys(fps), "simhash-blocks")), "simhash-cells")
    a, b = both.alias("a"), both.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") > F.col("b.fp"))).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def links(fps: DataFrame) -> DataFrame:
    """Edges (u, v), u > v: all pairs of distinct fingerprints (fp) at most MAX_BITS apart, once each.

    Two fingerprints k bits apart have distances to any reference that differ by at most k. Pairs are found by their
    coordinates, discarded if the largest difference of their distances exceeds MAX_BITS, and survivors are verified.
    A fingerprint has no more than 2,080 others in reach, so edges grow with the fingerprints.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = (b.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            left = np.flatnonzero(np.abs(distances(u) - distances(v)).max(axis=1, initial=0) <= MAX_BITS)
            left = left[np.bitwise_count((u[left] ^ v[left]).view(np.uint64)) <= MAX_BITS]
            yield pa.RecordBatch.from_arrays([pa.array(u[left]), pa.array(v[left])], ["u", "v"])

    return candidates(fps).mapInArrow(near, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node of edges but each component's smallest, with that smallest one. Alternating large and small stars.

    Each round cuts its lineage with a table in the shared folder; rounds grow with the logarithm of the nodes.
    """
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = cut(edges, "simhash-edges")
    now = state(edges)
    while now[0]:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        edges, was = cut(small, "simhash-edges"), now
        now = state(edges)
        if now == was:
            break
    return edges


def grouped(fp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the rows of fingerprints: (node, component_id) for each fingerprint, and (none, id, th) of each component's first row.

    The first row has the smallest doc_id (rows without one come last) and of those the smallest th. Rows with equal
    fingerprints are one node, whose number is the fingerprint, so thousands of exact copies cost one row in the search.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "th")
    nodes = cut(fp.groupBy("fp").agg(F.min(order).alias("least")), "simhash-nodes")
    comp = components(links(nodes))
    # tables, so that later joins have shuffles of their own, which Spark can split where many rows share a key
    roots = cut(nodes.join(comp, F.col("fp") == F.col("u"), "left").select(F.col("fp").alias("node"), F.coalesce("v", "fp").alias("root"), "least"), "simhash-roots")
    firsts = cut(roots.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("first")), "simhash-firsts")
    component = F.when(~F.col("first.none"), F.col("first.id")).alias("component_id")
    return cut(roots.join(firsts, F.col("root") == F.col("of")).select("node", component), "simhash-components"), firsts.select("first.*")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """A row per row of docs: doc_id, fp (long), component_id (smallest doc_id reachable over links of at most 2 bits).

    Null and empty texts and texts without words have fingerprint 0 and are linked like any other. Rows with a null
    doc_id are kept and get a component like others; where no row of a component has an id, it is null. Repeated rows
    each come back. Extra columns are ignored. An empty table gives an empty result.
    """
    fp = cut(fingerprints(docs, doc_id, text, shingle), "simhash-fps")
    return fp.join(grouped(fp)[0], F.col("fp") == F.col("node"), "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each component: that of the smallest doc_id, of those the smallest XXH64 of the text.

    Rows without a doc_id come last: one of them stays only where no other row is in reach. A null text counts as empty.
    Rows that share doc_id and text are one row here: the one with the smallest hash of its other columns. Rows that share a doc_id but not the text are judged by their own
    fingerprints, so no text goes unless a near copy of it, or one linked to it by others, stays.
    """
    none, own_id, own_hash, row, n, i, h = unused(docs, "none", "own_id", "own_hash", "row", "n", "i", "h")
    firsts = grouped(cut(fingerprints(docs), "simhash-fps"))[1].toDF(n, i, h)
    keys = {none: F.col("doc_id").isNull(), own_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), own_hash: text_hash(F.col("text").cast("string"))}
    others = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])))
    # before the join, so that each task passes on one of its equal rows at most; the join uses the same partitioning
    once = docs.withColumns(keys).withColumn(row, F.row_number().over(Window.partitionBy(*keys).orderBy(others))).where(F.col(row) == 1)
    kept = once.join(firsts, (F.col(none) == F.col(n)) & (F.col(own_id) == F.col(i)) & (F.col(own_hash) == F.col(h)), "left_semi")
    return kept.select(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of documents; edge cases as there. The fingerprint is written as 16 lower-case hex digits."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
