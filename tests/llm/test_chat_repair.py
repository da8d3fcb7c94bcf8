"""Conversation repair against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from fleetledger.llm import chat_repair
from fleetledger.llm.chat_repair import Prefixes, Repair

WORD = r"[^\x20\x09-\x0D]"


def cheapest(rows):
    """(cost, audit, repaired) of all edits, searched from the back: rows are (role, text, gone, short)."""

    @cache
    def after(i, state, inserted):
        """state: what was said last, '' at first; inserted: how many empty rows were put in here."""
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        follows = {"": "u", "s": "u", "a": "u", "u": "a"}[state]
        name = {"u": "user", "a": "assistant"}[follows]

        def add(cost, edit, line, rest):
            if rest:
                found.append((rest[0] + cost, edit + rest[1], ((line,) if line else ()) + rest[2]))

        if inserted < 2:
            add(2, "I", f"{name}:", after(i, follows, inserted + 1))
        if i < len(rows):
            role, text, gone, short = rows[i]
            add(3, "D", None, after(i + 1, state, 0))
            if not gone:
                if role[:1] == follows or (role[:1] == "s" and state == ""):
                    add(short, "K", f"{role}:{text}", after(i + 1, role[:1], 0))
                add(2 + short, "R", f"{name}:{text}", after(i + 1, follows, 0))
        return min(found, default=None)

    return after(0, "", 0)


def brute(conversations):
    out = []
    for conv in {c for c, *_ in conversations}:
        rows = []
        for c, turn, role, text in conversations:
            role, text = (" " if x is None else x for x in (role, text))
            if c == conv:
                fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
                text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
                rows += [(turn is not None, turn or 0, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
        rows.sort()
        n, seen, faulty = [0, 0, 0, 0], set(), []
        for k, (_, _, role, text) in enumerate(rows):
            last = re.findall(WORD, text)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last[0] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            faulty.append((role, text, fault in (0, 1), int(fault == 2)))
            n[3] += k > 0 and rows[k - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        turns = [t for there, t, _, _ in rows if there]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = cheapest(tuple(faulty))
        out.append((conv, gaps, *n, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(6)
    texts = ["Yes.", "No!", "and then", "", " \n", "Why? ", "ok", None, "É。", "a.b", "…"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"]
    out = []
    for conv in [*range(250), None]:
        turn = 0
        for _ in range(rng.randrange(1, 9)):
            turn += rng.choice([0, 1, 1, 1, 1, 3])
            row = (conv, None if rng.random() < 0.05 else turn, rng.choice(roles), rng.choice(texts))
            out += [row] * (1 + (rng.random() < 0.1))
    return out + [(900, next(t for t in range(1000) if zlib.crc32(f"900:{t}".encode()) % 20 == 0), "user", "Gone.")]


def test_equals_brute_force(spark, conversations):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in conversations], "conv_id long, turn long, role string, text string, kind int, sig int, edit string").repartition(5)
    got = chat_repair.reports(chat_repair.repair(chat_repair.damage(df), df)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(conversations)
    assert [(r.audit, r.cost) for r in got if r.conv_id == 900] == [("", 0)]  # nothing is left of it


def test_a_long_conversation_streams(spark, monkeypatch):
    """Rows leave in parts and nodes are freed; the result is that of the search from the back."""
    rng = random.Random(8)
    rows = [(rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Yes.", "so", "Well, no!"]) + str(k), rng.random() < 0.1, rng.random() < 0.2) for k in range(230)]
    want = cheapest(tuple(rows))
    monkeypatch.setattr(chat_repair, "COMMIT", 16)
    r, lines, waited, nodes = Repair(), [], 0, 0
    for row in rows:
        lines += r.row(*row)
        waited, nodes = max(waited, len(r.waiting)), max(nodes, len(r.prefixes.parent))
    lines += r.end()
    assert (r.cost, "".join(r.audit), tuple(f"{a}:{b}" for a, b, _ in lines)) == want
    assert waited < 100 and nodes < 600


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 2, "assistant", "Hi."), (1, 3, "user", "Tell me."), (2, 0, "user", "Bye.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_repair.repair(df).where("position is not null").orderBy("conv_id", "position").collect()
    assert [(r.conv_id, r.role, r.text, r.edit) for r in got] == [(1, "system", "Be kind.", "K"), (1, "user", "", "I"), (1, "assistant", "Hi.", "K"), (1, "user", "Tell me.", "K"), (1, "assistant", "", "I"), (2, "user", "Bye.", "K"), (2, "assistant", "", "I")]
    assert chat_repair.repair(df.limit(0)).count() == 0
    only = chat_repair.reports(chat_repair.repair(df.limit(0), df.select("conv_id"))).orderBy("conv_id").collect()
    assert [(r.conv_id, r.cost, r.audit, r.repaired_sha256) for r in only] == [(k, 0, "", hashlib.sha256(b"").hexdigest()) for k in (1, 2)]


def test_long_texts_and_a_large_conversation(spark):
    n = 3000
    df = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.repeat(F.lit("long text "), 500), F.col("id").cast("string"), F.lit(".")).alias("text"))
    (r,) = chat_repair.reports(chat_repair.repair(df)).collect()
    assert (r.cost, r.audit) == (0, "K" * n)


@pytest.mark.parametrize("prime", [(1 << 61) - 1, 3])
def test_order_of_prefixes(monkeypatch, prime):
    """Strings compare as Python's do, also where most hashes collide."""
    monkeypatch.setattr(chat_repair, "_PRIME", prime)
    rng, p = random.Random(5), Prefixes()
    nodes = [0]
    for _ in range(1500):
        nodes.append(p.add(rng.choice(nodes[-30:] if rng.random() < 0.9 else nodes), rng.choice("DDDDIK")))
    for _ in range(3000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert p.less(a, b) == (p.text(a) < p.text(b))
        d = rng.randrange(p.depth[a] + 1)
        assert p.text(p.lift(a, d)) == p.text(a)[:d]
