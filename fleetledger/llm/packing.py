"""Best-fit packing by minimum bin slack: a bitset subset-sum finds the fullest bin, which is taken as often as it can be.

The plan needs only how many pieces there are of each length (at most `capacity` numbers, whatever the input), so one
combination stands for all the sequences that repeat it. Pieces get their place from their rank within their length.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, slices, table

CAPACITY = 2048
#: Encoded words that a worker keeps are up to twice CACHE; longer ones than LONG characters are not kept.
CACHE, LONG = 400_000, 32
#: A space where a text can be cut: neither neighbour is white space of any kind.
_CUT = re.compile(r"(?<=\S) (?=\S)")


class WordTokenizer:
    """Ids as little-endian 32-bit bytes. Words are encoded once and kept.

    The tokenizer never joins a piece across a space whose neighbours both are no white space, so a text is the
    concatenation of what stands between such spaces, each part with the space before it. Only parts that neither
    begin nor end with white space are kept, so a text with other spaces is not mistaken for a row of kept words.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.older, self.quick = Tokenizer.from_file(path), {}, {}, None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own, special_tokens={}).encode_ordinary

    def _encode(self, texts: list[str]) -> list[bytes]:
        """With ranks, texts without special tokens are encoded with them: the same ids, in a sixth of the time."""
        if not self.quick:
            return self._whole(texts)
        if any(x in t for x in self.special for t in texts):
            return [self._whole([t])[0] if any(x in t for x in self.special) else array("I", self.quick(t)).tobytes() for t in texts]
        return [array("I", ids).tobytes() for ids in map(self.quick, texts)]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        first, *words = text.split(" ")
        got = list(map(self.kept.get, words))
        new = {w for w, ids in zip(words, got, strict=True) if ids is None}
        if words and (not first or first[-1].isspace()) or not all(map(_plain, new)):  # some space has white space beside it
            first, *words = _CUT.split(text)
            got = list(map(self.kept.get, words))
            new = {w for w, ids in zip(words, got, strict=True) if ids is None}
        if new:
            coded = self._look_up(new)
            got = [coded[w] if ids is None else ids for w, ids in zip(words, got, strict=True)]
        return self._encode([first])[0] + b"".join(got)

    def _look_up(self, new: set[str]) -> dict[str, bytes]:
        """The ids of these words, each with the space before it; kept for later, under the word without that space."""
        if len(self.kept) > CACHE:  # words not met again since the last time are dropped
            self.kept, self.older = {}, self.kept
        coded = {w: self.older[w] for w in new if w in self.older}
        rare = [w for w in new if w not in coded]
        coded.update(zip(rare, self._encode([" " + w for w in rare]), strict=True))
        self.kept.update((w, ids) for w, ids in coded.items() if len(w) < LONG and _plain(w))
        return coded


def _plain(word: str) -> bool:
    """Neither empty nor with white space at either end."""
    return word != "" and not word[0].isspace() and not word[-1].isspace()


@lru_cache(maxsize=1)
def worker_tokenizer(path: str, ranks: str | None, pattern: str | None) -> WordTokenizer:
    """One for each Python worker, whose tasks share its words."""
    return WordTokenizer(path, ranks, pattern)


def pieces(docs: DataFrame, tokenizer: tuple[str, str | None, str | None], doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and a closing 0, cut only if longer than capacity.

    tokenizer: the tokenizer's file; the same vocabulary as ranks, and its pattern, or None and None.

    All pieces but the first of a cut document are full, so what is left over is one piece a document.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_tokenizer(*tokenizer)
        for b in slices(batches):
            out: list[list[int]] = [[], [], [], [], []]
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = coder.ids(t.as_py() or "") + b"\0\0\0\0"
                n, start, end, k = len(ids) // 4, 0, (len(ids) // 4 - 1) % capacity + 1, 0
                while start < n:
                    for col, v in zip(out, (d, k, start, end - start, zlib.crc32(ids[4 * start : 4 * end])), strict=True):
                        col.append(v)
                    start, end, k = end, end + capacity, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(out)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], first: int, capacity: int) -> dict[int, int]:
    """The fullest combination that holds one piece of length first and others of what counts has."""
    room, bits, used, before = capacity - first, 1, [], []
    limit = (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length] - (length == first), room // length), 1
        while left > 0:
            n = min(k, left)
            before.append(bits)
            used.append((length, n))
            bits |= (bits << (length * n)) & limit
            left, k = left - n, 2 * k
        if bits >> room & 1:
            break
    at, out = bits.bit_length() - 1, {first: 1}
    for (length, n), was in zip(reversed(used), reversed(before), strict=True):
        if not was >> at & 1:
            at -= length * n
            out[length] = out.get(length, 0) + n
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, sequences, offset), sorted: pieces of a length, by rank, go round the sequences."""
    left, used, out, sequence = dict(counts), dict.fromkeys(counts, 0), [], 0
    while left:
        combination = fullest(left, max(left), capacity)
        times, offset = min(left[x] // n for x, n in combination.items()), 0
        for length, n in sorted(combination.items(), reverse=True):
            out.append((length, used[length], sequence, times, offset))
            used[length] += n * times
            offset += n * length
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """found (with a column length of 1 to capacity) plus sequence_id and offset: every sequence gapless from 0.

    Lengths are counted over all rows; only the counts, at most capacity numbers, reach the driver. Equal lengths are
    ranked by a range sort over length and the other columns, so a length that many rows share is spread over tasks.
    Repeated rows are packed each. An empty table gives an empty result.
    """
    spark, names = found.sparkSession, found.columns
    order = ["length", *[c for c in names if c != "length"]]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(range(at, at + b.num_rows), pa.int64())], [*b.schema.names, "__part", "__at"])
            at += b.num_rows

    schema = ", ".join(f"`{c}` {t}" for c, t in found.dtypes)
    ranked = cut(found.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{schema}, __part int, __at long"), "packing-ranked")
    counts = {r[0]: r[1] for r in ranked.groupBy("length").count().collect()}
    sizes = {r[0]: r[1] for r in ranked.groupBy("__part").count().collect()}  # a number for each task of the sort
    parts, lengths = np.array(sorted(sizes), np.int64), np.array(sorted(counts), np.int64)
    before = lambda keys, n: np.concatenate(([0], np.cumsum([n[k] for k in keys.tolist()], dtype=np.int64)))
    shared = spark.sparkContext.broadcast((parts, before(parts, sizes), lengths, before(lengths, counts), plan(counts, capacity)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, part_at, lengths, length_at, slots = shared.value
        for b in slices(batches):
            length, part, at = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "__part", "__at"))
            rank = part_at[np.searchsorted(parts, part)] + at - length_at[np.searchsorted(lengths, length)]
            key = np.int64(1) << np.int64(48)
            slot = slots[np.searchsorted(slots[:, 0] * key + slots[:, 1], length * key + rank, side="right") - 1]
            k = rank - slot[:, 1]
            sequence, offset = slot[:, 2] + k % slot[:, 3], slot[:, 4] + k // slot[:, 3] * length
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(names))], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: tuple[str, str | None, str | None], doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, packed. A null text is empty: one piece, the closing 0. A null doc_id is kept."""
    return pack(cut(pieces(docs, tokenizer, doc_id, text, capacity), "packing-pieces"), capacity)


def default_tokenizer() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_documents of documents; edge cases as there."""
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
