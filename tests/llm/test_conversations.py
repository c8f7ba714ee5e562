"""Repairs of conversations against plain versions: every edit sequence, a walk from turn to turn, and the registered SQL."""

import hashlib
import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.llm import conversations as c

TURNS = "conv_id long, turn long, role string, text string"
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"


def legal(roles):
    roles = roles[1:] if roles[:1] == "s" else roles
    return roles == "ua" * (len(roles) // 2)


def every_audit(codes, most):
    """Cost and least audit among all edit sequences with up to ``most`` insertions."""
    best = None
    for letters in itertools.product("DKR", repeat=len(codes)):
        if any(x != "D" and k >> 2 in (1, 2) for x, k in zip(letters, codes)):
            continue
        if any(x == "K" and k & 3 == 3 for x, k in zip(letters, codes)):
            continue
        for counts in itertools.product(range(most + 1), repeat=len(codes) + 1):
            slots, audit, cost = [], "", 0
            for n, x, k in itertools.zip_longest(counts, letters, codes):
                slots += ["ua"] * n
                audit += "I" * n
                cost += 2 * n
                if x:
                    audit += x
                    cost += {"D": 3, "K": 0, "R": 2}[x] + (k >> 2 == 3 and x != "D")
                    slots += {"D": [], "K": ["sua"[k & 3] if k & 3 < 3 else "x"], "R": ["ua"]}[x]
            if best and (cost, audit) >= best:
                continue
            if any(s != "s" and legal(s) for s in map("".join, itertools.product(*slots))):
                best = cost, audit
    return best


def walked(rows):
    """(cost, audit, lines) by a walk from turn to turn; ``rows`` hold role, text and fault."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user:", "a": "assistant:"}
    at = {"": (0, "", [])}
    for role, text, fault in rows:
        new = {}
        for p, (cost, audit, lines) in at.items():
            q, made = p, []
            for inserted in range(3):
                if inserted:
                    q = step[q]
                    made = [*made, names[q]]
                options = [(q, 3, "D", [])]
                if fault in (0, 3):
                    cut = fault == 3
                    options.append((step[q], 2 + cut, "R", [names[step[q]] + text]))
                    if role[:1] and q + role[:1] in ("s", "u", "su", "ua", "au"):
                        options.append((role[:1], 0 + cut, "K", [f"{role}:{text}"]))
                for to, more, letter, line in options:
                    found = (cost + 2 * inserted + more, audit + "I" * inserted + letter, lines + made + line)
                    new[to] = min(new.get(to, found), found, key=lambda x: x[:2])
        at = new
    tail = {"": (0, "", []), "s": (4, "II", ["user:", "assistant:"]), "u": (2, "I", ["assistant:"]), "a": (0, "", [])}
    return min(((x[0] + tail[p][0], x[1] + tail[p][1], x[2] + tail[p][2]) for p, x in at.items()), key=lambda x: x[:2])


def plain(rows, ids):
    """The report by conversation, from rows of (conv_id, turn, role, text)."""
    by = {i: [] for i in ids}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    out = []
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, faulty, count = set(), [], [0, 0, 0, 0]
        for _, role, text in own:
            bare = text.rstrip(BLANK)
            fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
            count[fault] += 1
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1], b[1][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(own, own[1:]))
        cost, audit, lines = walked(faulty)
        out.append((conv, gaps, *count[1:], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_layers_against_every_edit_sequence():
    rng = random.Random(5)
    for _ in range(120):
        codes = bytes(rng.choice([0, 1, 1, 2, 2, 3]) + 4 * rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.randint(1, 3)))
        cost, rank = c.joined([c.solve(codes)[:2]])
        states = c.route([(cost, rank)], c.START, c.END_COST)
        audit = c.chunk_audit(codes, *states) + c.END_AUDIT[states[-1]]
        assert (cost[states[-1]] + c.END_COST[states[-1]], audit) == every_audit(codes, 2), codes


def test_blocks_meet_as_one(monkeypatch):
    """Blocks of one turn, of three and of 50 give the same edits, whatever the borders cut."""
    rng = random.Random(6)
    for _ in range(40):
        codes = bytes(rng.choice([0, 1, 1, 2, 2, 3]) + 4 * rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(50))
        found = set()
        for size in (1, 3, 50):
            monkeypatch.setattr(c, "BLOCK", size)
            parts = [c.joined(b[:2] for b in c._blocks(codes[at : at + 20])) for at in (0, 20, 40)]
            states = c.route(parts, c.START, c.END_COST)
            found.add("".join(c.chunk_audit(codes[20 * k : 20 * k + 20], *states[k : k + 2]) for k in range(3)) + c.END_AUDIT[states[-1]])
        rows = [(["system", "user", "assistant", "x"][k & 3], "t", k >> 2) for k in codes]
        assert found == {walked(rows)[1]}


def odd_turns():
    rng = random.Random(7)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(0, 12)):
            rows.append((conv, rng.choice([turn, turn, turn * 2, 3, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice([f"Said {rng.randint(0, 4)}.", "Again!", "Again!", "cut", " \n", "", None, "long " * 3000 + "?"])))
    return [*rows, (None, 0, "user", "No id?"), (None, 1, "assistant", "None."), (500, None, None, None), (501, 7, "user", "x."), (501, 7, "user", "x."), (501, 7, "user", "x.")]


def test_report_and_turns(spark):
    rows = odd_turns()
    df = spark.createDataFrame(rows, TURNS).withColumns({n: F.lit("x") for n in ("chunk", "kind", "digest", "codes", "place", "edit")})
    got = sorted(map(tuple, c.repair_report(df, spark.createDataFrame([*[(r[0],) for r in rows], (999,)], "conv_id long")).collect()), key=str)
    assert got == plain(rows, [999])
    assert (999, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in got
    by = {}
    for r in sorted(c.repaired_turns(df).collect(), key=lambda r: (str(r.conv_id), r.place)):
        by.setdefault(r.conv_id, []).append(r)
    for r in got:
        lines = by.get(r[0], [])
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in lines).encode()).hexdigest() == r[8]
        roles = "".join(x.role[:1] for x in lines)
        assert roles != "s" and legal(roles)
        assert "".join(x.edit for x in lines) == r[7].replace("D", "")


def test_long_and_hot_conversations(spark):
    """One conversation holds most rows, over many tasks and several chunks; a turn is repeated a thousand times."""
    rng = random.Random(8)
    rows = [(1, k, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No.", f"Number {k}.", f"cut {k}", ""])) for k in range(9000)]
    rows += [(1, 40, "user", "Same!")] * 1000 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, TURNS).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, c.repair_report(df).collect()), key=str) == plain(rows, [])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("kept", [True, False])
def test_damage_and_sql(spark, kept):
    rows = odd_turns() if kept else []
    df = spark.createDataFrame(rows, TURNS)
    con = duckdb.connect()
    con.execute("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    if rows:
        con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = con.execute(c.ORACLE_SQL).fetchall()
    assert sorted(map(tuple, c.repair_report(c.damaged(df), df).collect()), key=str) == sorted(want, key=str)


def test_string_ids(spark):
    df = spark.createDataFrame([("a-1", 0, "user", "Hi."), ("a-1", 1, "user", "You?")], "conv_id string, turn int, role string, text string")
    assert [tuple(r) for r in c.repair_report(df).select("conv_id", "illegal", "cost", "audit").collect()] == [("a-1", 1, 2, "KR")]
