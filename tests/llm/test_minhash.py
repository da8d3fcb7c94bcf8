"""Min-max hashing near-duplicates against brute force, and on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from fleetledger.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(len(w) - k, 0) + 1)) if w else frozenset()


def brute(docs, percent=85):
    """(doc_id, size, smallest id reachable, kept) of each row; rows with equal sets are one node."""
    sets = {s for _, t in docs if (s := shingles(t))}
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for a, b in combinations(sets, 2):
        if min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)) and len(a & b) * 100 >= percent * len(a | b):
            root[find(a)] = find(b)
    least = {}
    for i, t in docs:
        if (s := shingles(t)) and i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    out = []
    for i, t in docs:
        s = shingles(t)
        c = least.get(find(s)) if s else i
        out.append((i, len(s), c, c is None if i is None else i == c))
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"x{rng.randrange(10**9)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    """Copies edited a little and too much, truncated copies, chains, a passage that many texts share, and edge rows."""
    rng = random.Random(11)
    vocabulary = [f"v{k}" for k in range(4000)]
    docs = []
    for n_words, copies, most in ((200, 150, 6), (60, 40, 3), (400, 40, 16)):
        base = rng.choices(vocabulary, k=n_words)
        docs += [edited(rng, base, rng.randrange(most + 1)) for _ in range(copies)]
        docs += [" ".join(base[: rng.randrange(n_words * 3 // 4, n_words)]) for _ in range(30)]
    chain = rng.choices(vocabulary, k=300)
    docs += [" ".join(chain[at : at + 150]) for at in range(0, 150, 5)]
    passage = rng.choices(vocabulary, k=150)
    for _ in range(60):
        tail = rng.choices(vocabulary, k=40)
        docs += [" ".join(passage + tail)] + [" ".join(passage + tail + ["end"])] * rng.randrange(2)
    docs += [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 80))) for _ in range(100)]
    docs += ["A b  c\td e f", "a B c D e f", "a b c d e f g", "one two", "ONE\nTWO", "one two three", "É", "é", docs[3], docs[3].upper()]
    rng.shuffle(docs)
    return list(enumerate(docs)) + [(5000, None), (5001, ""), (5002, " \n\t "), (5003, "word number one. " * 8000), (5003, "word number one. " * 8000), (None, "null id of its own here"), (None, docs[7]), (None, None)]


@pytest.mark.parametrize("percent", [85, 60])
def test_equals_brute_force(spark, corpus, percent):
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in corpus], "doc_id long, text string, n int, node int, digest int").repartition(6)
    got = rows(minhash.near_duplicates(df, percent=percent, band=6 if percent == 85 else 3))
    assert got == brute(corpus, percent)
    assert len({c for _, _, c, _ in got}) < len(corpus) - 100


def test_empty_table(spark, corpus):
    assert minhash.near_duplicates(spark.createDataFrame(corpus[:1], "doc_id long, text string").limit(0)).count() == 0


def test_both_ends_estimate_similarity_with_less_variance():
    """Minima and maxima together estimate without bias, with about half the squared error of the minima alone."""
    rng, both, low = np.random.default_rng(2), [], []
    minmax = minhash.MinMax()
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 115, dtype=np.uint64)
        a, b = (minmax.ends(h) for h in (x[:100], x[15:]))
        same = [(p == q).mean() for p, q in zip(a, b, strict=True)]
        both.append(np.mean(same))
        low.append(same[0])
    true = 85 / 115
    assert abs(np.mean(both) - true) < 0.01
    assert np.var(both) < 0.75 * np.var(low)


def test_prefixes_of_linked_sets_meet():
    rng = random.Random(4)
    for _ in range(400):
        p = frozenset(rng.sample(range(300), rng.randrange(20, 150)))
        x = frozenset(rng.sample(sorted(p), len(p) * 3 // 4)) | frozenset(rng.sample(range(1000), rng.randrange(0, 30)))
        y = frozenset(rng.sample(sorted(x), len(x) - rng.randrange(0, len(x) // 6))) | frozenset(rng.sample(range(1000), rng.randrange(0, 5)))
        x, y = sorted((x, y), key=len, reverse=True)
        if len(x & y) * 100 >= 85 * len(x | y):
            arrays = [np.array(sorted(s), np.uint64) for s in (p, x, y)]
            (probe, _), (index, k) = minhash.prefix(arrays[0], arrays[1], 85), minhash.prefix(arrays[0], arrays[2], 85)
            assert set(probe) & set(index[:k])
            if len(x) == len(y):
                assert set(minhash.prefix(arrays[0], arrays[2], 85)[0]) & set(probe[: minhash.prefix(arrays[0], arrays[1], 85)[1]])


def test_parities_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(9)
    for n in (0, 1, 3, 40, 700):
        x, y = (rng.integers(0, 2000, n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        x, y = np.unique(x), np.unique(y)
        apart = int(np.bitwise_count((minhash.parity(x) ^ minhash.parity(y)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(x, y)) and (n < 40 or apart > 10)


def test_small_sets():
    assert minhash.least_banded(85) == 6 and minhash.least_banded(50) == 1
