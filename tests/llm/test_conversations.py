"""Conversation repair against plain dynamic programming over strings and against enumerated edits."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

SCHEMA = "conv_id long, turn long, role string, text string, hit string, copies string, digest string, first string, again string, _conv string, task string"
BLANK = " \t\n\x0b\x0c\r"


def plain_rows(rows):
    """conv_id -> rows after damage."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(name.encode()) % 20
        own = out.setdefault(conv, [])
        if hit:
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            own += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    return out


def faults(own):
    seen, out = set(), []
    for _, role, text in own:
        core = text.strip(BLANK)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(own):
    """Cheapest edits by (cost, edits, repaired rows) over all ways, from the last row backward; states are the roles so far: '', 's', 'u', 'a'."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ()), "a": (0, "", ())}

    def with_inserts(best):
        for _ in range(4):
            for s, to in follow.items():
                if to in best:
                    cost, edits, kept = best[to]
                    new = (2 + cost, "I" + edits, ((name[to], ""), *kept))
                    best[s] = min(best.get(s, new), new, key=lambda b: b[:2])
        return best

    best = with_inserts(best)
    for (_, role, text), fault in reversed(list(zip(own, faults(own), strict=True))):
        new = {}
        for s, to in follow.items():
            ways = [(3 + best[s][0], "D" + best[s][1], best[s][2])]
            if fault not in ("blank", "duplicate"):
                more = 1 if fault else 0
                ways.append((2 + more + best[to][0], "R" + best[to][1], ((name[to], text), *best[to][2])))
                if role[:1] == to or s == "" and role[:1] == "s":
                    ways.append((more + best[role[:1]][0], "K" + best[role[:1]][1], ((role, text), *best[role[:1]][2])))
            new[s] = min(ways, key=lambda w: w[:2])
        best = with_inserts(new)
    return best[""]


def plain(rows):
    out = set()
    for conv, own in plain_rows(rows).items():
        found, turns = faults(own), [t for t, _, _ in own if t is not None]
        cost, edits, kept = plain_repair(own)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), 2**63 - 1) if turns else 0
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out.add((conv, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest()))
    return out


def talk(seed):
    rng = random.Random(seed)
    says = ["Yes.", "No!", "Why?", "well", "", " \t", "It is so. ", "and then", "ÄÖ 日本", None, "Fine. ok" * 50]
    rows = []
    for conv in range(80):
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "User"]) if turn else rng.choice(["system", "user", "assistant"])
            rows.append((conv, turn * rng.choice([1, 1, 3]), role, rng.choice(says) if rng.random() < 0.4 else f"Answer {rng.randrange(99)}."))
    rows += [(500, t, "user" if t % 2 else "assistant", f"Line {t % 300}." if t % 3 else f"Line {t}") for t in range(3000)]  # one conversation has most rows
    rows += [(501, None, "user", "a."), (501, None, "assistant", "b."), (None, 3, "user", "c."), (None, None, None, None), (502, 5, "user", "same."), (502, 5, "user", "same."), (502, 5, "assistant", "other.")]
    dropped = next(i for i in range(600, 9000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (dropped, 0, "user", "gone."), (7, -(2**62), "user", "Long ago."), (7, 2**62 + 5, "user", "Far ahead.")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefg") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("spread", [False, True])
def test_repair_against_plain(spark, spread):
    from stockmerge.llm.conversations import repaired

    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        if spread:
            spark.conf.set("spark.sql.shuffle.partitions", "13")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = talk(3)
        got = repaired(frame(spark, rows)).collect()
        assert len(got) == len({r[0] for r in rows})
        assert {tuple(r) for r in got} == plain(rows)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_repair_of_an_empty_table(spark):
    from stockmerge.llm.conversations import repaired

    assert repaired(frame(spark, [])).collect() == []


def test_all_dropped_is_all_zero(spark):
    from stockmerge.llm.conversations import repaired

    dropped = next(i for i in range(9000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert [tuple(r) for r in repaired(frame(spark, [(dropped, 0, "user", "gone.")])).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def roles_after(symbols, edits):
    """What edits make of the roles, and their cost; None if they cannot be made."""
    out, cost, i = "", 0, 0
    for e in edits:
        if e == "I":
            out, cost = out + ("a" if out[-1:] == "u" else "u"), cost + 2
            continue
        if i == len(symbols):
            return None
        role, cut_off = divmod(symbols[i], 2) if symbols[i] != 8 else (None, 0)
        i += 1
        if e == "D":
            cost += 3
        elif role is None:
            return None
        else:
            out, cost = out + ("suao"[role] if e == "K" else "a" if out[-1:] == "u" else "u"), cost + cut_off + 2 * (e == "R")
    return (cost, edits) if i == len(symbols) and re.fullmatch("(s?(ua)+)?", out) else None


def test_tables_against_enumerated_edits():
    from stockmerge.llm.conversations import repair

    rng = random.Random(4)
    for _ in range(25):
        symbols = bytearray(rng.randrange(9) for _ in range(rng.randrange(4)))
        ways = (roles_after(symbols, "".join(e)) for n in range(8) for e in product("DIKR", repeat=n) if sum(x != "I" for x in e) == len(symbols))
        assert repair(symbols) == min(w for w in ways if w)


def test_summaries_continue_over_parts():
    from stockmerge.llm.conversations import repair, summary, vectors

    rng = random.Random(5)
    for _ in range(200):
        symbols = bytearray(rng.randrange(9) for _ in range(rng.randrange(1, 30)))
        k = rng.randrange(len(symbols))
        head, tail = symbols[:k], symbols[k:]
        behind = summary(tail)
        cost = behind[1][0] + summary(head)[1][behind[0][0]] + int(vectors()[0][summary(head)[0][behind[0][0]]][0])
        _, first = repair(head, behind[0][0], 0, False)
        state = summary(head)[2][4 * behind[0][0]]
        assert (cost, first + repair(tail, 0, state)[1]) == repair(symbols)
