"""Conversation structure repair: cheapest edits of turns to a valid order of roles, by a dynamic program over persistent edit prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, table

#: The states of an order (s?(ua)+)?: nothing yet, after s, after u, after a. START and A are complete.
START, S, U, A = range(4)
DELETE, RENAME, INSERT, CUT_SHORT = 3, 2, 2, 1
BLANKS = " \t\n\x0b\x0c\r"
#: Rows after which the edits that all states agree on are passed on and their nodes freed.
COMMIT = 512
#: What being in one state costs at most beside another, whatever follows: dearer ones are in no cheapest repair.
BRIDGE = {START: ((S, 4), (U, 5), (A, 3)), S: ((START, 0), (U, 2), (A, 0)), U: ((START, 2), (S, 2), (A, 2)), A: ((START, 0), (S, 4), (U, 2))}
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


class Prefixes:
    """Strings of edits as nodes that share their beginnings. Node 0 is the empty string."""

    def __init__(self) -> None:
        self.parent, self.letter, self.depth, self.hash, self.up = [0], [""], [0], [0], [[0]]
        self.verified: set[tuple[int, int]] = set()

    def add(self, node: int, letter: str) -> int:
        """The string of node with one letter more."""
        up, k = [node], 0
        while k < len(self.up[up[k]]) and up[k]:
            up.append(self.up[up[k]][k])  # 2^(k+1) above is 2^k above what is 2^k above
            k += 1
        self.parent.append(node)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % _PRIME)
        self.up.append(up)
        return len(self.parent) - 1

    def lift(self, node: int, depth: int) -> int:
        """The beginning of node's string of the given length."""
        k = (self.depth[node] - depth).bit_length()
        for k in range(k - 1, -1, -1):
            if self.depth[node] - depth >= 1 << k:
                node = self.up[node][k]
        return node

    def same(self, a: int, b: int) -> bool:
        """Are two strings of one length with one hash the same? Letters are compared back to a node that both share, once."""
        back: list[tuple[int, int]] = []
        while a != b and (a, b) not in self.verified:
            if self.letter[a] != self.letter[b]:
                return False
            back.append((a, b))
            a, b = self.parent[a], self.parent[b]
        self.verified.update(back)
        return True

    def less(self, a: int, b: int) -> bool:
        """Is a's string before b's? Their longest common beginning is searched by hashes of beginnings, 2^k letters at a time."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, depth), self.lift(b, depth)
        if x == y or (self.hash[x] == self.hash[y] and self.same(x, y)):
            return self.depth[a] < self.depth[b]
        top_x, top_y = x, y
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and k < len(self.up[y]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if not self.same(self.parent[x], self.parent[y]) or self.letter[x] == self.letter[y]:  # hashes collided
            return self.text(top_x) < self.text(top_y)
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(out))


class Repair:
    """One conversation's repair: rows go in one at a time, (role, text, edit) of the repaired rows come out once all states agree on them."""

    def __init__(self) -> None:
        self.prefixes, self.best = Prefixes(), {START: (0, 0)}
        self.waiting: list[tuple[str, str]] = []
        self.audit: list[str] = []
        self.state, self.cost = START, 0

    def _offer(self, best: dict, state: int, cost: int, node: int, letter: str) -> None:
        """The string of node and letter is one for state, if it is cheaper than what is there, or as cheap and before it."""
        if state not in best or cost < best[state][0]:
            best[state] = (cost, self.prefixes.add(node, letter))
        elif cost == best[state][0]:
            new = self.prefixes.add(node, letter)
            if self.prefixes.less(new, best[state][1]):
                best[state] = (cost, new)

    def _inserts(self) -> None:
        best = self.best
        for state in (START, S, A):
            if state in best:
                self._offer(best, U, best[state][0] + INSERT, best[state][1], "I")
        if U in best:
            self._offer(best, A, best[U][0] + INSERT, best[U][1], "I")
        self._drop()

    def _drop(self) -> None:
        best = self.best
        for state in [x for x in best if any(y in best and best[x][0] > best[y][0] + more for y, more in BRIDGE[x])]:
            del best[state]

    def row(self, role: str, text: str, delete: bool, short: bool) -> Iterator[tuple[str, str, str]]:
        """The next row. delete: it may not stay; short: it costs one more if it stays."""
        self.waiting.append((role, text))
        self._inserts()
        out: dict[int, tuple[int, int]] = {}
        more = CUT_SHORT if short else 0
        for state, (cost, node) in self.best.items():
            self._offer(out, state, cost + DELETE, node, "D")
            if delete:
                continue
            to = A if state == U else U
            if role[:1] == ("a" if state == U else "u"):
                self._offer(out, to, cost + more, node, "K")
            elif role[:1] == "s" and state == START:
                self._offer(out, S, cost + more, node, "K")
            self._offer(out, to, cost + RENAME + more, node, "R")
        self.best = out
        self._drop()
        if len(self.waiting) >= COMMIT and len(self.prefixes.parent) > 8 * COMMIT:
            yield from self._commit()

    def _commit(self) -> Iterator[tuple[str, str, str]]:
        strings = {state: self.prefixes.text(node) for state, (_, node) in self.best.items()}
        agreed = commonprefix(list(strings.values()))
        yield from self._apply(agreed)
        self.prefixes = Prefixes()
        for state, (cost, _) in self.best.items():
            node = 0
            for letter in strings[state][len(agreed) :]:
                node = self.prefixes.add(node, letter)
            self.best[state] = (cost, node)

    def _apply(self, edits: str) -> Iterator[tuple[str, str, str]]:
        at = 0
        for e in edits:
            role, text = ("", "") if e == "I" else self.waiting[at]
            at += e != "I"
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if self.state == U else "user"
            self.state = S if e == "K" and role[:1] == "s" else A if self.state == U else U
            yield role, text, e
        del self.waiting[:at]
        self.audit.append(edits)

    def end(self) -> Iterator[tuple[str, str, str]]:
        """No row comes any more. Afterwards cost and audit are those of the whole conversation."""
        self._inserts()
        last = [self.best[x] for x in (START, A) if x in self.best]
        if len(last) == 2 and (last[1][0] < last[0][0] or (last[1][0] == last[0][0] and self.prefixes.less(last[1][1], last[0][1]))):
            last.reverse()
        self.cost = last[0][0]
        yield from self._apply(self.prefixes.text(last[0][1]))


def damage(rows: DataFrame) -> DataFrame:
    """Rows of conversations (nulls in them: one space) as a faulty export would have them.

    By crc32 of conv_id:turn, modulo 20: 0 is dropped, 1 loses its text, 2 its sentence ends, 3 comes twice, 4 is said by the user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(fault == 4, "user").otherwise(blank("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


#: A repaired row has a position; the conversation's report comes after its rows and has none.
OUT = "conv_id long, position long, role string, text string, edit string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Report:
    """What is known of a conversation so far."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.repair, self.position = conv_id, Repair(), 0
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None
        self.expected: set[bytes] = set()
        self.seen: set[bytes] = set()

    def row(self, turn: int | None, role: str, text: str, sig: bytes) -> Iterator[tuple]:
        if turn is not None:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + (turn != self.last)
            self.last = turn
        kept = text.strip(BLANKS)
        blank, again, short = not kept, sig in self.seen, bool(kept) and kept[-1] not in ".!?"
        if sig in self.expected:
            self.expected.remove(sig)
            self.seen.add(sig)
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += short and not again
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        yield from self._rows(self.repair.row(role, text, blank or again, short and not again))

    def _rows(self, rows: Iterator[tuple[str, str, str]]) -> Iterator[tuple]:
        for role, text, edit in rows:
            yield (self.conv_id, self.position, role, text, edit, *[None] * 7)
            self.position += 1

    def end(self) -> Iterator[tuple]:
        yield from self._rows(self.repair.end())
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        yield (self.conv_id, None, None, None, None, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.repair.cost, "".join(self.repair.audit))


def repair(rows: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """The repaired rows of every conversation (conv_id, position, role, text, edit), each followed by its report (no position).

    rows (conv_id, turn, role, text) are taken by turn (nulls first; rows of one turn by role and text). A row's first
    fault counts: blank, duplicate (role and text seen earlier) or truncated (it does not end a sentence). Edits: K keeps
    a row, R gives it the role user or assistant for 2, D deletes it for 3 (blank and duplicate rows must go), I inserts
    an empty row of user or assistant for 2; a truncated row that stays costs 1. The cheapest edits after which the
    roles' first letters are (s?(ua)+)? win, of equally cheap ones the string that is first in ASCII.

    Texts are shuffled once, by conversation, and stream through the task in order: they are not gathered, and edits that
    no later row can change leave the memory at once. A conversation stays in one task, however long, as its repair
    depends on all earlier rows; what is kept of it are its audit (a letter an edit) and hashes of rows that come again.
    Null role or text: one space. A null conv_id is a conversation of its own. also (conv_id): conversations that get a
    report even if they have no rows. Extra columns are ignored; an empty table gives no rows.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    known = rows.select(F.lit(2).alias("kind"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    said = known.withColumn("sig", F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))))
    # where something is said for the first time that is said again: counted with partial sums, so texts need no second shuffle
    again = said.groupBy("conv_id", "sig").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("f")).where("n > 1")
    marks = again.select(F.lit(1).alias("kind"), "conv_id", F.col("f.turn").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "sig")
    if also is not None:
        marks = marks.unionByName(also.select(F.lit(0).alias("kind"), F.col("conv_id").cast("long").alias("conv_id")).distinct(), allowMissingColumns=True)
    ordered = said.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "kind", "role", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in OUT.split(", ")]
        kinds = [pa.string() if f.endswith("string") else pa.int64() for f in OUT.split(", ")]
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        now, out = None, []
        for b in batches:
            kind, conv, turn, role, text, sig = b.columns
            for k in range(b.num_rows):
                conv_id, what = conv[k].as_py(), kind[k].as_py()
                if now is None or now.conv_id != conv_id:
                    if now:
                        out += now.end()
                    now = _Report(conv_id)
                if what == 1:
                    now.expected.add(sig[k].as_py())
                elif what == 2:
                    out += now.row(turn[k].as_py(), role[k].as_py(), text[k].as_py(), sig[k].as_py())
                if len(out) >= 1024:
                    yield pack(out)
                    out = []
        if now:
            out += now.end()
        if out:
            yield pack(out)

    return ordered.mapInArrow(work, OUT)


def reports(repaired: DataFrame) -> DataFrame:
    """One row per conversation of what repair() returns: its report and the SHA-256 of its repaired rows, role:text joined by line feeds.

    The rows stream by in order, as repair() has them: repaired must not have been shuffled since.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = hashlib.sha256()
        for b in batches:
            ends, digests = [], []
            for k, (at, role, text) in enumerate(zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True)):
                if at is None:
                    ends.append(k)
                    digests.append(digest.hexdigest())
                    digest = hashlib.sha256()
                else:
                    digest.update(f"{chr(10) if at else ''}{role.as_py()}:{text.as_py()}".encode("utf-8", "surrogatepass"))
            rows = b.take(pa.array(ends, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in (0, 5, 6, 7, 8, 9, 10, 11)] + [pa.array(digests, pa.string())], [f.split()[0] for f in REPORT.split(", ")])

    return repaired.mapInArrow(work, REPORT)


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of conversations, damaged by damage(); a conversation that lost all rows has zeros. Edge cases as in repair()."""
    rows = table(spark, sf_dir, "conversations")
    return reports(repair(damage(rows), rows))


def _sql() -> str:
    """The same by rows from the last to the first: for each state the cheapest repair of what follows, as {cost, audit, repaired rows}."""
    to = {START: U, S: U, U: A, A: U}
    none = "{'c': 1000000000, 'a': '', 'b': CAST([] AS VARCHAR[])}"
    add = lambda f, c, a, line: f"{{'c': {f}.c + {c}, 'a': '{a}' || {f}.a, 'b': {f'list_prepend({line}, {f}.b)' if line else f'{f}.b'}}}"
    least = lambda *some: f"list_sort([{', '.join(some)}])[1]"
    role = {s: "assistant" if t == A else "user" for s, t in to.items()}

    def without_insert(s: int) -> str:
        keep = f"CASE WHEN NOT gone AND left(role, 1) = '{role[s][0]}' THEN {add(f'f{to[s]}', 'short', 'K', 'line')} "
        keep += f"WHEN NOT gone AND left(role, 1) = 's' THEN {add(f'f{S}', 'short', 'K', 'line')} ELSE {none} END" if s == START else f"ELSE {none} END"
        rename = f"CASE WHEN gone THEN {none} ELSE {add(f'f{to[s]}', f'{RENAME} + short', 'R', f"'{role[s]}:' || text")} END"
        return least(add(f"f{s}", str(DELETE), "D", ""), keep, rename)

    def inserted(h: str, g: str, s: int) -> str:
        line = f"'{role[s]}:'"
        return least(f"{h}{s}", add(f"{g}{to[s]}", INSERT, "I", line))

    states = (START, S, U, A)
    each = lambda f, name: ", ".join(f"{f(s)} AS {name}{s}" for s in states)
    end = {START: "{'c': 0, 'a': '', 'b': CAST([] AS VARCHAR[])}", A: "{'c': 0, 'a': '', 'b': CAST([] AS VARCHAR[])}"}
    start = f"SELECT conv_id, n + 1 AS i, {each(lambda s: end.get(s, none), 'h')} FROM convs"
    finish = lambda rows: f"SELECT conv_id, i, {each(lambda s: inserted('h', 'g', s), 'f')} FROM (SELECT *, {each(lambda s: inserted('h', 'h', s), 'g')} FROM ({rows}))"
    step = f"SELECT r.conv_id, r.i - 1 AS i, {each(without_insert, 'h')} FROM r JOIN marked m ON m.conv_id IS NOT DISTINCT FROM r.conv_id AND m.rn = r.i - 1"
    return rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
k AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) % 20 AS fault FROM k, t),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE fault <> 0),
o AS (SELECT *, role || ':' || text AS line, row_number() OVER w AS rn, lag(left(role, 1)) OVER w || left(role, 1) AS pair, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  NOT regexp_matches(text, '[^{SPACES}]') AS blank, regexp_matches(text, '[^.!?{SPACES}][{SPACES}]*$') AS open FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
marked AS (SELECT *, blank OR again AS gone, CASE WHEN open AND NOT again THEN {CUT_SHORT} ELSE 0 END AS short FROM o),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
  sum(short)::BIGINT AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM marked GROUP BY conv_id),
convs AS (SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts x ON x.conv_id IS NOT DISTINCT FROM i.conv_id),
r AS ({finish(start)} UNION ALL {finish(step)})
SELECT x.conv_id, gaps, blank, duplicate, truncated, illegal, f0.c::BIGINT AS cost, f0.a AS audit, sha256(array_to_string(f0.b, chr(10))) AS repaired_sha256
FROM convs x JOIN r ON r.conv_id IS NOT DISTINCT FROM x.conv_id AND i = 1"""


OP12_SQL = _sql()
