"""Spelling variants: automata against all pairs, rounds of shards, chains of forms, and the registered SQL."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import spelling

DOCS = "doc_id long, text string"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k:]


def some_words(seed, n, alphabet="ab", longest=7):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(n)})


@pytest.mark.parametrize(("seed", "alphabet"), [(1, "ab"), (2, "a"), (3, "abcdeéÿ"), (4, "aé🙂\U0010ffff")])
def test_automata_against_all_pairs(seed, alphabet):
    words = some_words(seed, 150, alphabet)
    shard = [w for w in words if len(w) > 2] or words
    keys, rank = spelling.flat(shard)
    trie = spelling.opened(keys.tobytes(), rank.tobytes(), np.ones(len(shard), np.int64).tobytes(), shard)
    word, found = spelling.near(trie, words)
    got = sorted((words[w], shard[k]) for w, k in zip(word, found, strict=True))
    assert got == sorted((a, b) for a in words for b in shard if one_edit(a, b))


def brute(counts, times=5):
    out = {}
    for word, n in counts.items():
        near = [w for w in counts if one_edit(word, w)]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        good = best is not None and counts[best] >= times * n
        out[word] = (best if good else None, n, len(near), counts[best] if good else None)
    rows = []
    for word, (form, n, n_near, form_n) in out.items():
        root = word
        while out[root][0]:
            root = out[root][0]
        rows.append((word, form, root, n, n_near, form_n))
    return sorted(rows, key=str)


@pytest.mark.parametrize("round_bytes", [1, 1 << 25])
def test_variants_in_rounds(spark, monkeypatch, round_bytes):
    """Each shard a round of its own, and all in one; equal counts tie, and forms follow each other."""
    monkeypatch.setattr(spelling, "ROUND_BYTES", round_bytes)
    rng = random.Random(9)
    counts = {w: rng.choice([5, 5, 25, 125, 125, 625, 3125]) for w in some_words(5, 300, "abé", 6)}
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumns({c: F.lit("x") for c in ("near", "best", "root", "shard")})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, spelling.spelling_variants(df).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(counts)
    assert any(r[1] and r[2] != r[1] for r in got)


def odd_docs():
    rng = random.Random(10)
    base = some_words(6, 120, "abcdé", 9)
    rows = [(k, " ".join(rng.choice(base) for _ in range(rng.randint(0, 400)))) for k in range(60)]
    rows += [(61, None), (62, ""), (63, "12 .. \n"), (None, "Stonewall stonewall " * 40), (64, "ÉCOLEÉCOLE École×÷é " * 30), (65, "a" * 50_000 + " " + "letterbox " * 3000)] + [(66, "Repeated repeated repeatad")] * 9
    return rows


def test_report_against_sql_and_plain(spark):
    rows = odd_docs()
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("word", "run", "h", "n", "id", "form")})
    got = sorted(map(tuple, spelling.variant_report(df).collect()), key=str)
    counts = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    assert got == brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(con.execute(spelling.ORACLE_SQL).fetchall(), key=str) == got


def test_no_words(spark):
    assert spelling.variant_report(spark.createDataFrame([], DOCS)).collect() == []
    assert spelling.variant_report(spark.createDataFrame([(1, None), (2, "short words only")], DOCS)).collect() == []
