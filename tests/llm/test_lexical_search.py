"""Ranked lexical search against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fleetledger.llm import lexical_search

TERMS = re.compile(lexical_search.TERM)


def terms(text):
    return TERMS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    bags = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    total, length = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in {(i, t) for i, t in items if t is not None}:
        scored = []
        for doc, bag, n in bags:
            m = 100 - 75 + 75 * n * total // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t])
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def ranked(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["É", "straße", "ÉT", "K9"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for i in range(300)]
    docs += [(i, docs[i][1]) for i in range(20)] + [(400 + i, docs[5][1].upper()) for i in range(15)]  # repeated rows, ties
    docs += [(900, None), (901, ""), (902, " .,- "), (903, "w1 " * 30_000), (None, docs[5][1]), (None, "w1 w2")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 90)))) for i in range(25)]
    items += [items[0], (1, "w3 w3 w4"), (None, "w5-W6"), (70, None), (71, ""), (72, "nowhere"), (73, docs[5][1])]
    wide = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], "doc_id long, text string, n int, score int, item long").repartition(5)
    return docs, items, wide, spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, rank int")


def test_equals_brute_force(tables):
    docs, items, d, q = tables
    assert ranked(lexical_search.search(d, q)) == brute(docs, items)


def test_blocks_and_small_bitmaps_change_nothing(tables, monkeypatch):
    docs, items, d, q = tables
    monkeypatch.setattr(lexical_search, "ROWS", 7)
    assert ranked(lexical_search.search(d, q, block_chars=2500, top=3)) == brute(docs, items, 3)


def test_empty_tables(tables):
    _, _, d, q = tables
    assert lexical_search.search(d.limit(0), q).count() == 0
    assert lexical_search.search(d, q.limit(0)).count() == 0


def test_masks_group_rows_and_stop_early():
    """Masks of over 64 terms; of 3,000 rows only those are scored whose masks can still come in."""
    rng = np.random.default_rng(1)
    held = [np.sort(rng.choice(200, 20, replace=False)) for _ in range(2990)] + [np.arange(100)] * 10
    sizes = np.array([len(h) for h in held])
    terms_, tfs = np.concatenate(held), np.ones(int(sizes.sum()), np.int64)
    w = np.full(200, 1000, np.int64)
    rows = lexical_search.Rows(np.arange(3000), np.zeros(3000, bool), np.full(3000, 100), sizes, terms_, tfs, w)
    own = np.arange(100)
    at, bits, which = rows.masks(own)
    for r, k in list(zip(at, which, strict=True))[::100]:
        assert set(own[bits[k] == 1]) == set(held[r]) & set(own)
    best, zeros = lexical_search.Best(10), np.zeros(200, np.int64)
    scored = rows.search(own, np.ones(100, np.int64), best, zeros)
    assert scored < 300 and sorted(best.doc) == list(range(2990, 3000)) and not zeros.any()
