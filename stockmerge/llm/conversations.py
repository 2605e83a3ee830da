"""Cheapest repair of damaged conversations, by Four-Russians block tables.

A row is one of nine symbols: its role (system, user, assistant, other) by whether it is truncated, or a row that has to go.  The
repaired roles are read by an automaton of four states (nothing yet, after s, after u, after a), so at any place the cheapest way
to the end is a vector of four costs.  Less its minimum it is one of a few vectors.  Tables hold, for every such vector and every
block of up to BLOCK symbols, the vector before the block and what was taken off; a conversation is read from its end, a lookup for
each block.  A block is then expanded: the vectors inside it are found backward from the vector behind it, and the
least edit that lies on a cheapest way is taken forward.  Those expansions are kept, as there are finitely many.

Rows are sorted by conversation and turn over ranges, so one conversation may lie in many tasks.  For the first and the last
conversation of each task a summary (for every vector behind it: the vector before it and the states it ends in) goes to the driver, two
for each task; there they are put together, and each task learns the vector behind its part and the state before it.
"""

from __future__ import annotations

import hashlib
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut

BLOCK = 4
DELETED = 8  # the symbol of a row that has to go; the others are 2 * role + truncated
SYMBOLS = 9
ROLES = {"s": 0, "u": 1, "a": 2}
BLANK = " \t\n\x0b\x0c\r"
NEXT = (2, 2, 3, 2)  # from nothing, s, u, a: the state after an inserted or rerouted row
KEEP = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))  # state, role: the state after
END = (0, 4, 2, 0)  # the cheapest way from each state behind the last row
PIECE = 1 << 20

FIELDS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after damage; a dropped row stays with 0 copies, so that its conversation is known."""
    long = lambda c: F.col(c).cast("long").alias(c)
    rows = conversations.select(long("conv_id"), long("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("hit", F.crc32(name.cast("binary")) % 20)
    hit = F.col("hit")
    return rows.select(
        "conv_id",
        "turn",
        F.when(hit == 0, "").when(hit == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(hit.isin(0, 1), "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"),
    )


def in_order(rows: DataFrame) -> DataFrame:
    """The rows by conv_id and turn (nulls first; then by role and the text's MD5) over ranges of tasks, with ``again``: null if no other row of
    the conversation has this role and text, else whether one has it in an earlier turn."""
    rows = rows.withColumn("digest", F.unhex(F.md5("text")))
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    same = rows.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(at).alias("first"), F.sum("copies").alias("n")).where("n > 1")
    same = same.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first")
    met = rows.join(same, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    met = met.select("conv_id", "turn", "role", "digest", "text", "copies", (F.col("first") < at).alias("again"))
    order = ("conv_id", "turn", "role", "digest")
    return met.repartitionByRange(*order).sortWithinPartitions(*order)


@cache
def vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Every normalised cost vector that occurs; then, by vector and symbol, the vector before it and what was taken off; and by
    (vector, state, symbol) the edits taken and the state after."""

    def before(v, x):
        role, cut_off = divmod(x, 2) if x != DELETED else (None, 0)
        base = [3 + v[s] for s in range(4)]
        if role is not None:
            for s in range(4):
                base[s] = min(base[s], 2 + cut_off + v[NEXT[s]])
                if KEEP[s][role] is not None:
                    base[s] = min(base[s], cut_off + v[KEEP[s][role]])
        for _ in range(3):  # insertions lead on without reading a row
            base = [min(base[s], 2 + base[NEXT[s]]) for s in range(4)]
        return base

    def edits(v, s, x):
        now, out = before(v, x), ""
        role, cut_off = divmod(x, 2) if x != DELETED else (None, 0)
        while True:
            if now[s] == 3 + v[s]:
                return out + "D", s
            if now[s] == 2 + now[NEXT[s]]:
                out, s = out + "I", NEXT[s]
                continue
            if role is not None and KEEP[s][role] is not None and now[s] == cut_off + v[KEEP[s][role]]:
                return out + "K", KEEP[s][role]
            return out + "R", NEXT[s]

    ids, todo, steps = {END: 0}, [END], []
    for v in todo:
        row = []
        for x in range(SYMBOLS):
            new = before(v, x)
            low = min(new)
            key = tuple(c - low for c in new)
            if key not in ids:
                ids[key] = len(ids)
                todo.append(key)
            row.append((ids[key], low))
        steps.append(row)
    steps = np.array(steps)
    taken = {(i, s, x): edits(v, s, x) for v, i in ids.items() for s in range(4) for x in range(SYMBOLS)}
    return np.array(todo), steps[:, :, 0], steps[:, :, 1], taken


@cache
def tables() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of 1 to BLOCK symbols (at its length less 1): by vector behind and block, the vector before and what was taken
    off; by vector behind, state before and block, the state behind."""
    _, step, off, taken = vectors()
    n = len(step)
    leads = np.array([[[taken[v, s, x][1] for x in range(SYMBOLS)] for s in range(4)] for v in range(n)])
    out = [(step, off, leads)]
    for _ in range(BLOCK - 1):
        last, cost, state = out[-1]
        first = step[last]  # vector, rest of the block, symbol before it
        costs = cost[:, :, None] + off[last]
        after = leads[last].transpose(0, 2, 1, 3)  # vector, state, rest, symbol
        states = state[np.arange(n)[:, None, None, None], after, np.arange(last.shape[1])[None, None, :, None]]
        out.append((first.transpose(0, 2, 1).reshape(n, -1), costs.transpose(0, 2, 1).reshape(n, -1), states.transpose(0, 1, 3, 2).reshape(n, 4, -1)))
    return out


def in_blocks(symbols: bytearray) -> list[tuple[int, int]]:
    """(length, code) of the blocks of a row of symbols; the last may be shorter."""
    out = []
    for i in range(0, len(symbols), BLOCK):
        code = 0
        for x in symbols[i : i + BLOCK]:
            code = code * SYMBOLS + x
        out.append((min(BLOCK, len(symbols) - i), code))
    return out


@lru_cache(1 << 17)
def expanded(vector: int, state: int, length: int, code: int) -> tuple[str, int]:
    """The least of the cheapest edits of a block, and the state behind it."""
    _, step, _, taken = vectors()
    symbols, behind = [], [vector]
    for _ in range(length):  # from the block's end
        code, x = divmod(code, SYMBOLS)
        symbols.append(x)
        behind.append(int(step[behind[-1], x]))
    out = ""
    for x, v in zip(reversed(symbols), reversed(behind[:-1]), strict=True):
        found, state = taken[v, state, x]
        out += found
    return out, state


def repair(symbols: bytearray, vector: int = 0, state: int = 0, last: bool = True) -> tuple[int, str]:
    """(what was taken off on the way, edits) of rows before the cost vector ``vector``, from ``state``; ``last``: with what has to
    be inserted behind them."""
    of, blocks, behind, cost = tables(), in_blocks(symbols), [], 0
    for length, code in reversed(blocks):
        behind.append(vector)
        step, off, _ = of[length - 1]
        cost += int(off[vector, code])
        vector = int(step[vector, code])
    out = []
    for (length, code), v in zip(blocks, reversed(behind), strict=True):
        found, state = expanded(v, state, length, code)
        out.append(found)
    if last:
        out.append("I" * (END[state] // 2))
    return cost + int(vectors()[0][vector][0]), "".join(out)


def summary(symbols: bytearray) -> tuple[list[int], list[int], list[int]]:
    """For every vector behind the rows: the vector before them, what was taken off, and for each state before the one behind."""
    of, n = tables(), len(vectors()[0])
    vector, cost, behind, blocks = np.arange(n), np.zeros(n, np.int64), [], in_blocks(symbols)
    for length, code in reversed(blocks):
        behind.append(vector)
        step, off, _ = of[length - 1]
        cost = cost + off[vector, code]
        vector = step[vector, code]
    state = np.tile(np.arange(4), (n, 1))
    for (length, code), v in zip(blocks, reversed(behind), strict=True):
        state = of[length - 1][2][v[:, None], state, code]
    return vector.tolist(), cost.tolist(), state.ravel().tolist()


class Part:
    """The rows of one conversation in one task, in order."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.symbols = conv_id, [], bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.turn = None  # least, greatest and last turn
        self.first = self.last = None  # initials of the roles
        self.before = None  # the last row's turn, role and text

    def add(self, turn, role, text, copies, again, keep):
        for _ in range(copies):
            here = (turn, role, text)
            core = text.rstrip(BLANK)
            symbol = 2 * ROLES.get(role[:1], 3)
            if not core:
                self.blank += 1
                symbol = DELETED
            elif again or again is not None and self.before == here:
                self.duplicate += 1
                symbol = DELETED
            elif core[-1] not in ".!?":
                self.truncated += 1
                symbol += 1
            if self.last is not None:
                self.illegal += self.last + role[:1] not in ("su", "ua", "au")
            self.first = role[:1] if self.first is None else self.first
            self.last, self.before = role[:1], here
            if turn is not None:
                self.turns += turn != self.turn
                self.low = turn if self.low is None else self.low
                self.turn = self.high = turn
            self.symbols.append(symbol)
            if keep:
                self.rows.append((role, text))

    def lines(self, audit: str, state: int):
        """role:text of the repaired rows, from ``state``."""
        rows = iter(self.rows)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(rows)
            if edit == "D":
                continue
            to = KEEP[state][ROLES.get(role[:1], 3)] if edit == "K" else NEXT[state]
            yield f"{role if edit == 'K' else 'user' if to == 2 else 'assistant'}:{text}"
            state = to


def parts(batches, keep=lambda first: True):
    """The Parts of one task, in order; ``keep`` tells from whether it is the task's first one if its texts are held."""
    part, first = None, True
    for batch in batches:
        for conv_id, *row in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "again")), strict=True):
            if part is None or part.conv_id != conv_id:
                if part is not None:
                    yield part
                    first = False
                part = Part(conv_id)
                held = keep(first)
            part.add(*row, held)
    if part is not None:
        yield part


def summaries(rows: DataFrame) -> dict[tuple[int, bool], tuple[int, int, int, bool]]:
    """For the parts of conversations that lie in several tasks, by (task, whether it is the task's first): the vector behind, the state
    before, the whole conversation's cost, whether the part is the last."""

    def run(batches):
        task, last, first = TaskContext.get().partitionId(), None, True
        out = []
        for part in parts(batches, lambda first: False):
            if first:
                out.append((task, True, part.conv_id, *summary(part.symbols)))
            first, last = False, part if not first else None
        if last is not None:
            out.append((task, False, last.conv_id, *summary(last.symbols)))
        types = (pa.int32(), pa.bool_(), pa.int64(), *[pa.list_(pa.int64())] * 3)
        names = ["task", "first", "conv_id", "vectors", "costs", "states"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    found = rows.mapInArrow(run, "task int, first boolean, conv_id long, vectors array<long>, costs array<long>, states array<long>").collect()  # two rows a task
    found.sort(key=lambda r: (r["task"], not r["first"]))
    out, i = {}, 0
    while i < len(found):
        j = i + 1
        while j < len(found) and found[j]["conv_id"] == found[i]["conv_id"]:
            j += 1
        run_, behind, vector, cost = found[i:j], [], 0, 0
        for r in reversed(run_):
            behind.append(vector)
            cost += r["costs"][vector]
            vector = r["vectors"][vector]
        cost, state = cost + int(vectors()[0][vector][0]), 0
        for r, v in zip(run_, reversed(behind), strict=True):
            if len(run_) > 1:
                out[r["task"], r["first"]] = (v, state, cost, r is run_[-1])
            state = r["states"][4 * v + state]
        i = j
    return out


def _found(rows, types, names):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


_TYPES = (*[pa.int64()] * 7, pa.string(), pa.string())
_NAMES = [f.split(" ")[0] for f in FIELDS.split(", ")]


def _gaps(low, high, turns) -> int:
    return 0 if low is None else min(high - low + 1 - turns, (1 << 63) - 1)


def _last_of(it):
    """(whether it is the last, item)"""
    before = None
    for x in it:
        if before is not None:
            yield False, before
        before = x
    if before is not None:
        yield True, before


def repaired(conversations: DataFrame) -> DataFrame:
    """For every conv_id what damage did and how it is repaired most cheaply: gaps, blank, duplicate, truncated, illegal, cost, audit (the
    edits' initials; of equally cheap ones the least string) and repaired_sha256 (``role:text`` of the repaired rows).

    A null role or text is one space, and so is a null id or turn in the name that decides the damage; null ids are one
    conversation.  Null turns come first.  Rows of one turn are ordered by role and then by the text's MD5, and rows equal in all
    follow each other.  A conversation whose rows are all dropped has zeros, an empty audit and the hash of the empty string.
    Gaps beyond a long are the greatest long.  An empty table gives an empty result.  Equal texts are found by role and MD5.
    Only conv_id, turn, role and text are read.

    A task holds the rows of one conversation that lie in its range.  A conversation that spans tasks is put together from their
    pieces in order, in one task that holds one piece and the audit, since SHA-256 cannot be split.
    """
    rows = cut(in_order(damaged(conversations)))
    spread = rows.sparkSession.sparkContext.broadcast(summaries(rows))

    def whole(batches):
        task, first, out = TaskContext.get().partitionId(), True, []
        inside = lambda first: not (first and (task, True) in spread.value)
        for last, part in _last_of(parts(batches, inside)):
            if not (first and (task, True) in spread.value or not first and last and (task, False) in spread.value):
                cost, audit = repair(part.symbols)
                text = "\n".join(part.lines(audit, 0)).encode("utf-8", "surrogatepass")
                counts = (_gaps(part.low, part.high, part.turns), part.blank, part.duplicate, part.truncated, part.illegal)
                out.append((part.conv_id, *counts, cost, audit, hashlib.sha256(text).hexdigest()))
                if len(out) >= 1000:
                    yield _found(out, _TYPES, _NAMES)
                    out = []
            first = False
        yield _found(out, _TYPES, _NAMES)

    names = "conv_id task seq low high low_turn turns blank duplicate truncated illegal first last cost audit lines text".split()
    types = (pa.int64(), pa.int64(), pa.int64(), *[pa.int64()] * 8, pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())

    def pieces(batches):
        task, first = TaskContext.get().partitionId(), True
        for last, part in _last_of(parts(batches)):
            known = spread.value.get((task, first)) if first or last else None
            first = False
            if known is None:
                continue
            vector, state, cost, ends = known
            _, audit = repair(part.symbols, vector, state, ends)
            counts = (part.low, part.high, part.turn, part.turns, part.blank, part.duplicate, part.truncated, part.illegal)
            held, size, seq = [], 0, 0
            head = (part.conv_id, 2 * task + (1 if not first and last else 0))
            for line in part.lines(audit, state):
                held.append(line)
                size += len(line)
                if size >= PIECE:
                    yield _found([(*head, seq + 1, *[None] * 10, None, None, len(held), "\n".join(held).encode("utf-8", "surrogatepass"))], types, names)
                    held, size, seq = [], 0, seq + 1
            yield _found([(*head, seq + 1, *[None] * 10, None, None, len(held), "\n".join(held).encode("utf-8", "surrogatepass"))], types, names)
            yield _found([(*head, 0, *counts, part.first, part.last, cost, audit, 0, b"")], types, names)

    def joined(batches):
        now, out = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now.conv_id != r["conv_id"]:
                    if now is not None:
                        out.append(now.row())
                    now = _Whole(r["conv_id"])
                now.add(r)
            yield _found(out, _TYPES, _NAMES)
            out = []
        yield _found([now.row()] if now is not None else [], _TYPES, _NAMES)

    kinds = {**dict.fromkeys(names, "long"), "first": "string", "last": "string", "audit": "string", "text": "binary"}
    found = rows.mapInArrow(pieces, ", ".join(f"{n} {kinds[n]}" for n in names))
    found = found.repartition("conv_id").sortWithinPartitions("conv_id", "task", "seq").mapInArrow(joined, FIELDS)
    return rows.mapInArrow(whole, FIELDS).union(found)


class _Whole:
    """A conversation from the pieces of several tasks."""

    def __init__(self, conv_id):
        self.conv_id, self.counts, self.audit, self.hash, self.lines = conv_id, [0, 0, 0, 0], [], hashlib.sha256(), 0
        self.low = self.high = self.turn = self.last = None
        self.turns = self.cost = 0

    def add(self, r):
        if r["seq"] == 0:
            self.cost = r["cost"]
            self.audit.append(r["audit"])
            self.counts = [a + r[c] for a, c in zip(self.counts, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
            if r["first"] is not None:
                if self.last is not None:
                    self.counts[3] += self.last + r["first"] not in ("su", "ua", "au")
                self.last = r["last"]
            if r["low"] is not None:
                self.turns += r["turns"] - (r["low"] == self.turn)
                self.low = r["low"] if self.low is None else self.low
                self.high, self.turn = r["high"], r["low_turn"]
        elif r["lines"]:
            self.hash.update((b"\n" if self.lines else b"") + r["text"])
            self.lines += r["lines"]

    def row(self):
        return (self.conv_id, _gaps(self.low, self.high, self.turns), *self.counts, self.cost, "".join(self.audit), self.hash.hexdigest())


def _with(cost: str, edit: str, way: str) -> str:
    """A way is nine digits of cost and then its edits, so that the least string is the cheapest way and of those the least."""
    return f"lpad((substr({way}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{edit}' || substr({way}, 10)"


def _row(state: int) -> str:
    """The best way from a state that begins with the next row."""
    to = NEXT[state]
    keep = " ".join(f"WHEN keeps AND initial = '{r}' THEN {_with('cut_off', 'K', f'v{KEEP[state][i]}')}" for r, i in ROLES.items() if KEEP[state][i] is not None)
    return f"least({_with('3', 'D', f'v{state}')}, CASE WHEN keeps THEN {_with('2 + cut_off', 'R', f'v{to}')} END, CASE {keep} END)"


_SPACE = " || ".join(f"chr({ord(c)})" for c in BLANK)
#: DuckDB SQL for ``repaired``: CRC-32 bit by bit, then one step of a recursion for each row from the last.
SQL = f"""
WITH RECURSIVE convs AS (
  SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM conversations)
), named AS (
  SELECT cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
  FROM conversations c JOIN convs ON convs.conv_id IS NOT DISTINCT FROM c.conv_id
), crcs AS (
  SELECT name, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(name) + 1), lambda i: ascii(substr(name, i::INT, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 20 AS hit FROM (SELECT DISTINCT name FROM named)
), hits AS (
  SELECT cid, turn, role, text, hit FROM named JOIN crcs USING (name) WHERE hit <> 0
), damaged AS (
  SELECT cid, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM hits, (VALUES (1), (2)) copies(copy) WHERE copy = 1 OR hit = 3
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM damaged
), seen AS (
  SELECT *, substr(role, 1, 1) AS initial, rtrim(text, {_SPACE}) AS core, row_number() OVER (PARTITION BY cid, role, text ORDER BY pos) > 1 AS again FROM placed
), ordered AS MATERIALIZED (
  SELECT *, core = '' AS is_blank, core <> '' AND again AS is_again, core <> '' AND NOT again AND right(core, 1) NOT IN ('.', '!', '?') AS is_cut,
    core <> '' AND NOT again AS keeps, (core <> '' AND NOT again AND right(core, 1) NOT IN ('.', '!', '?'))::INT AS cut_off,
    lag(initial) OVER (PARTITION BY cid ORDER BY pos) || initial NOT IN ('su', 'ua', 'au') AS is_odd
  FROM seen
), sums AS (
  SELECT cid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE is_blank) AS blank, count(*) FILTER (WHERE is_again) AS duplicate,
    count(*) FILTER (WHERE is_cut) AS truncated, count(*) FILTER (WHERE is_odd) AS illegal FROM ordered GROUP BY 1
), ways AS (
  SELECT cid, n + 1 AS pos, {", ".join(f"'{c:09d}{'I' * (c // 2)}' AS v{s}" for s, c in enumerate(END))} FROM sums
  UNION ALL
  SELECT cid, pos, least(b0, {_with("2", "I", "a2")}), least(b1, {_with("2", "I", "a2")}), a2, least(b3, {_with("2", "I", "b2")})
  FROM (SELECT *, least(b2, {_with("2", "I", "b3")}) AS a2 FROM (SELECT w.cid, r.pos, {", ".join(f"{_row(s)} AS b{s}" for s in range(4))} FROM ways w JOIN ordered r ON r.cid = w.cid AND r.pos = w.pos - 1))
), best AS (
  SELECT cid, substr(v0, 1, 9)::BIGINT AS cost, substr(v0, 10) AS audit FROM ways WHERE pos = 1
), edits AS (
  SELECT cid, i, substr(audit, i::INT, 1) AS edit, length(replace(substr(audit, 1, i::INT), 'I', '')) AS pos, length(replace(substr(audit, 1, i::INT), 'D', '')) AS place FROM (SELECT cid, audit, unnest(range(1, length(audit) + 1)) AS i FROM best)
), kept AS (
  SELECT e.cid, place, edit, r.role, CASE edit WHEN 'I' THEN '' ELSE r.text END AS text,
    max((place = 1 AND edit = 'K' AND r.initial = 's')::INT) OVER (PARTITION BY e.cid) AS system
  FROM edits e LEFT JOIN ordered r ON r.cid = e.cid AND r.pos = e.pos WHERE edit <> 'D'
), texts AS (
  SELECT cid, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY place) AS repaired FROM kept GROUP BY 1
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM convs LEFT JOIN sums USING (cid) LEFT JOIN best USING (cid) LEFT JOIN texts USING (cid)
"""
