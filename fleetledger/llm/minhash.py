"""MinHash near-duplicates by min-max hashing: both ends of every permutation are banded, candidates confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, cut, slices, table
from .simhash import components, text_hash

SHINGLE = 5
#: Documents are linked at this many per cent of Jaccard similarity or more.
PERCENT = 85
#: Values in a band; permutations. Each permutation gives two values, its minimum and its maximum, so there are twice
#: as many bands as permutations fill. Two sets at 0.85 share no band with a probability of (1 - 0.85^6)^40 = 6e-9.
BAND, PERMUTATIONS = 6, 120
SEED = 42
#: Words of 64 bits in a set's parities.
PARITY = 8


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles as sorted XXH64 values. Of fewer words, the whole sequence is one shingle; no word: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = [(0, len(line))] if len(words) < shingle else zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in spans], np.uint64))


class MinMax:
    """Permutations x -> a * x + b of the 64-bit numbers; the bands of a set's minima and maxima."""

    def __init__(self, permutations: int = PERMUTATIONS, band: int = BAND) -> None:
        rng = np.random.default_rng(SEED)
        self.a = rng.integers(0, 1 << 63, (permutations, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, (permutations, 1), dtype=np.uint64)
        self.band = band

    def ends(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The minimum and the maximum of the set under every permutation: each element is hashed once for both."""
        low, high = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(self.a), np.uint64)
        for at in range(0, len(h), 1024):
            x = self.a * h[None, at : at + 1024] + self.b
            low, high = np.minimum(low, x.min(axis=1)), np.maximum(high, x.max(axis=1))
        return low, high

    def bands(self, h: np.ndarray) -> np.ndarray:
        """A number for each band. All values of a band are of different permutations, and all minima or all maxima."""
        values = np.concatenate(self.ends(h)).reshape(-1, self.band)
        key = np.arange(1, len(values) + 1, dtype=np.uint64)
        for c in range(self.band):
            key = (key ^ values[:, c]) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(29)
        return key.view(np.int64)


def least_banded(percent: int) -> int:
    """Sets smaller than this are linked to equal ones only: one element more or less is below the threshold."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def signatures(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int, minmax: MinMax) -> DataFrame:
    """(doc_id, th: XXH64 of the text, digest of the set (none of an empty one), n: its size, bands) for every row of docs."""
    few = least_banded(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            digests, sizes, bands = [], [], []
            for t in b.column(2):
                h = shingle_set(t.as_py(), shingle)
                sizes.append(len(h))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                bands.append(minmax.bands(h) if len(h) >= few else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "th", "digest", "n", "bands"])

    body = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_hash(body).alias("th"), body.alias("text"))
    return rows.mapInArrow(work, "doc_id long, th long, digest binary, n long, bands array<long>")


def distinct_sets(sigs: DataFrame) -> DataFrame:
    """(node: any number, digest, n, bands, none, id, th): one row for all documents with the same set, with its first one's id and text hash."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "th")
    nodes = sigs.where("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min(order).alias("f"))
    return cut(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "n", "bands", "f.*"), "minhash-nodes")


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, node): for every band that two nodes or more have in common, its nodes. Keys are counted with partial sums."""
    keyed = nodes.select(F.explode("bands").alias("key"), "node")
    shared = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("key").alias("of")), "minhash-keys")
    return cut(keyed.join(shared, F.col("key") == F.col("of"), "left_semi"), "minhash-buckets")


def stars(members: DataFrame) -> DataFrame:
    """(key, u, v): every bucket's first node with each of the others."""
    first = cut(members.groupBy(F.col("key").alias("of")).agg(F.min("node").alias("u")), "minhash-firsts")
    return members.join(first, F.col("key") == F.col("of")).where("u <> node").select("key", "u", F.col("node").alias("v"))


def sets_of(docs: DataFrame, nodes: DataFrame, members: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(node, items: the sorted shingles, 8 bytes each) of the nodes in any bucket, from their first documents' whole texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t.as_py(), shingle).tobytes() for t in b.column(1)], pa.binary())], ["node", "items"])

    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("none").alias("n"), F.col("id").alias("i"), F.col("th").alias("h"))
    body = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).isNull().alias("none"), F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("id"), text_hash(body).alias("th"), body.alias("text"))
    once = rows.withColumn("row", F.row_number().over(Window.partitionBy("none", "id", "th").orderBy(F.lit(0)))).where("row = 1")
    found = once.join(wanted, (F.col("none") == F.col("n")) & (F.col("id") == F.col("i")) & (F.col("th") == F.col("h")))
    return cut(found.select("node", "text").mapInArrow(work, "node long, items binary"), "minhash-sets")


def prefix(p: np.ndarray, x: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Of x, in the order: what p lacks first, then by number: the elements of which one is shared with any linked set that
    is not larger (all that come back), or not smaller (the first so many)."""
    known = np.isin(x, p, assume_unique=True)
    order, n = np.concatenate([x[~known], x[known]]), len(x)
    least = -(-percent * n // 100)  # shared with a linked set that is not larger
    equal = -(-2 * percent * n // (100 + percent))  # with one that is not smaller
    return order[: n - least + 1], n - equal + 1


def parity(x: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY bits, whether x has an odd number of elements there.

    Two sets' bits differ where their symmetric difference has an odd number of elements, so at no more places than that
    has elements.
    """
    bits = np.bincount((x % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def compare(pairs: DataFrame, sets: DataFrame, percent: int, with_prefix: bool, name: str) -> DataFrame:
    """(u, v, n: size of v's set, linked, tokens, n_index, parity) for pairs (u, v), on full sets; tokens: the prefix of v as seen from u."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            sizes, linked, tokens, n_index, bits = [], [], [], [], []
            for left, right in zip(b.column(2), b.column(3), strict=True):
                p, x = (np.frombuffer(s.as_py(), np.uint64) for s in (left, right))
                both = len(np.intersect1d(p, x, assume_unique=True))
                some, k = prefix(p, x, percent) if with_prefix else (np.empty(0, np.uint64), 0)
                sizes.append(len(x))
                linked.append(100 * both >= percent * (len(p) + len(x) - both))
                tokens.append(some.view(np.int64))
                n_index.append(k)
                bits.append(parity(x) if with_prefix else [])
            columns = [b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(linked, pa.bool_()), pa.array(tokens, pa.list_(pa.int64())), pa.array(n_index, pa.int32()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["u", "v", "n", "linked", "tokens", "n_index", "parity"])

    one = cut(pairs.join(sets, F.col("v") == F.col("node")).select("u", "v", F.col("items").alias("right")), f"{name}-right")
    two = one.join(sets, F.col("u") == F.col("node")).select("u", "v", F.col("items").alias("left"), "right")
    return cut(two.mapInArrow(work, "u long, v long, n long, linked boolean, tokens array<long>, n_index int, parity array<long>"), name)


def placed(rows: DataFrame, comp: DataFrame, node: str, name: str) -> DataFrame:
    """rows with the component of their node, as a column of the given name."""
    c = comp.toDF("__u", "__v")
    return rows.join(c, F.col(node) == F.col("__u"), "left").withColumn(name, F.coalesce("__v", node)).drop("__u", "__v")


def cross_pairs(compared: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) still to be compared: in a bucket together, in different components, with a prefix token in common and near by their parities.

    compared has every bucket's first node u with all others. Seen from u, all its bucket's sets are in one order: what u
    lacks comes first. Two linked sets share one of the first tokens (the prefix filter), and the places where their
    parities differ are no more than the elements that a linked pair may have apart. Neither loses a link. So a large
    group of copies that are edited too much to be linked has hardly a pair here: the join drops them by its condition.
    Tokens of one component only go before the join; of its two sides one holds only nodes outside u's component.
    """
    state = placed(placed(compared, comp, "u", "cu"), comp, "v", "cv")
    tokens = cut(state.select("u", "v", "n", "cu", "cv", "n_index", F.posexplode("tokens").alias("at", "token")).select("u", "v", "n", "cu", "cv", "token", (F.col("at") < F.col("n_index")).alias("index")), "minhash-tokens")
    mixed = tokens.groupBy(F.col("u").alias("mu"), F.col("token").alias("mt")).agg(F.min("cv").alias("low"), F.max("cv").alias("high")).where("low < high")
    bits = compared.select(F.col("v").alias("of"), "parity").dropDuplicates(["of"])
    left = tokens.join(mixed, (F.col("u") == F.col("mu")) & (F.col("token") == F.col("mt")), "left_semi").join(bits, F.col("v") == F.col("of"))
    left = cut(left.select("u", "v", "n", "cu", "cv", "token", "index", *[F.get("parity", F.lit(k)).alias(f"p{k}") for k in range(PARITY)]), "minhash-mixed")
    a, b = left.where("cu <> cv").alias("a"), left.alias("b")
    larger = (F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.v") > F.col("b.v")))
    apart = sum((F.bit_count(F.col(f"a.p{k}").bitwiseXOR(F.col(f"b.p{k}"))) for k in range(PARITY)), F.lit(0))
    near = apart * (100 + percent) <= (F.col("a.n") + F.col("b.n")) * (100 - percent)
    met = a.join(b, (F.col("a.u") == F.col("b.u")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.cv") != F.col("b.cv")) & F.when(larger, F.col("b.index")).otherwise(F.col("a.index")) & near)
    return met.select(F.least("a.v", "b.v").alias("u"), F.greatest("a.v", "b.v").alias("v")).distinct()


def links(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """(u, v): for every node but its component's smallest, that smallest one. Components are those of all links within buckets.

    Three steps, so that few sets meet: every node with the first node of one of its buckets; then, in buckets that are
    not yet of one component, all nodes with the bucket's first; then the pairs that cross_pairs leaves.
    """
    members = buckets(nodes)
    sets = sets_of(docs, nodes, members, doc_id, text, shingle)
    once = compare(stars(members).groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), sets, percent, False, "minhash-first")
    linked = once.where("linked").select("u", "v")
    inside = placed(members, components(linked), "node", "c")
    mixed = cut(inside.groupBy(F.col("key").alias("of")).agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("of"), "minhash-unresolved")
    second = compare(stars(members.join(mixed, F.col("key") == F.col("of"), "left_semi")).select("u", "v").distinct(), sets, percent, True, "minhash-second")
    linked = linked.union(second.where("linked").select("u", "v"))
    comp = components(linked)
    third = compare(cross_pairs(second, comp, percent), sets, percent, False, "minhash-third").where("linked").select("u", "v")
    return components(comp.union(third)) if third.take(1) else comp


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, permutations: int = PERMUTATIONS, band: int = BAND) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (is it that one?).

    Documents with equal sets are one node, so copies cost one row in the search. A null or empty text, or one without a
    word, has no shingle and is linked with nothing. Rows with a null doc_id are kept in the result and link others; a
    component without any id has a null component_id, and kept is true there. Repeated rows each come back. Extra
    columns are ignored. An empty table gives an empty result.
    """
    sigs = cut(signatures(docs, doc_id, text, shingle, percent, MinMax(permutations, band)), "minhash-signatures")
    nodes = distinct_sets(sigs)
    comp = cut(placed(nodes, links(docs, nodes, doc_id, text, shingle, percent), "node", "c").select("digest", "none", "id", "c"), "minhash-components")
    # tables, so that later joins have shuffles of their own, which Spark can split where many rows share a key
    firsts = cut(comp.groupBy(F.col("c").alias("of")).agg(F.min(F.when(~F.col("none"), F.col("id"))).alias("first")), "minhash-roots")
    member = cut(comp.join(firsts, F.col("c") == F.col("of")).select(F.col("digest").alias("d"), "first"), "minhash-members")
    out = sigs.select("doc_id", "digest", "n").join(member, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of documents; edge cases as there."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{SPACES}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE} - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE} + 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM m JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id) AS component_id, w.doc_id = coalesce(c, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id"""
