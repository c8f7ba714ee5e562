"""The edit log folded in batch, as a stream that is stopped and started again, and by a plain walk over the whole log."""

import random
import re

import duckdb
import pytest

from paperloom.operators import edits
from paperloom.plans import editing
from paperloom.streaming import edit_state
from tests.conftest import SF001

LOG = "paper_id long, seq long, op string, key string, text string, other string"


def tidy(text):
    return re.sub("[ \t\xa0]+", " ", text or "").strip(" ")


def walked(log):
    """edits and inserts by one walk over each paper's log, all anchors at once."""
    texts, lines = {}, {}
    by = {}
    for row in log:
        if row[0] is not None and row[1] is not None:
            by.setdefault(row[0], []).append(row)
    for paper, rows in by.items():
        own = lines.setdefault(paper, {})

        def parts(key):
            head, _, tail = key.rpartition("~")
            return (head, int(tail)) if head and tail.isdigit() else (key, -1)

        def put(key, text):
            anchor, at = parts(key)
            if at < 0:
                texts[paper, key] = text
            elif anchor in own:
                own[anchor] += [""] * (at + 1 - len(own[anchor]))
                own[anchor][at] = text

        def after(key, text):
            anchor, at = parts(key)
            own.setdefault(anchor, [])[at + 1 : at + 1] = [text]
            return f"{anchor}~{at + 1}"

        def remove(key):
            anchor, at = parts(key)
            if at < 0:
                return put(key, "")
            if anchor in own:
                del own[anchor][at : at + 1]
                if not own[anchor]:
                    del own[anchor]

        def prune(keep):
            anchor, at = parts(keep or "")
            for other in list(own):
                own[other] = [t for k, t in enumerate(own[other]) if t or (other == anchor and k == at)]
                if not own[other]:
                    del own[other]

        for _, _, op, key, text, other in sorted(rows, key=lambda r: r[1]):
            if op == "prune":
                prune(key)
            elif not key:
                continue
            elif op == "set":
                put(key, text or "")
            elif op == "insert":
                after(key, text or "")
            elif op == "remove":
                remove(key)
            elif op == "commit":
                put(key, tidy(text)) if tidy(text) or parts(key)[1] < 0 else remove(key)
                prune(None)
            elif op == "split":
                put(key, tidy(text))
                prune(after(key, tidy(other)))
            elif op == "join":
                if other:
                    remove(other)
                put(key, tidy(text))
                prune(key)
            elif op == "paste":
                found = [tidy(x) for x in (text or "").replace("\r\n", "\n").split("\n") if tidy(x)]
                if found:
                    put(key, found[0])
                    at = key
                    for x in found[1:]:
                        at = after(at, x)
                    prune(at)
    return sorted((p, k, t) for (p, k), t in texts.items()), sorted((p, a, k, t) for p, own in lines.items() for a, ts in own.items() for k, t in enumerate(ts))


def some_log(seed, n=900, papers=5):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        anchor = f"q{rng.randrange(3)}.head"
        key = rng.choice([anchor, anchor, f"{anchor}~{rng.randrange(4)}", f"{anchor}~{rng.randrange(4)}"])
        op = rng.choice(["set", "insert", "insert", "insert", "remove", "prune", "commit", "split", "join", "paste", "unknown"])
        text = rng.choice(["", f"text {seq}", f" two  words {seq} ", "a\r\n\nb\n c", None])
        other = rng.choice([None, f"q{rng.randrange(3)}.head~{rng.randrange(3)}", f"other {seq}"]) if op != "join" else rng.choice([f"q{rng.randrange(3)}.head~{rng.randrange(3)}", None])
        rows.append((rng.randrange(papers), seq, op, None if op == "prune" and rng.random() < 0.5 else key, text, other))
    return rows


def folded(spark, log):
    found, inserts = edits.fold(spark.createDataFrame(log, LOG))
    return sorted(map(tuple, found.collect())), sorted(map(tuple, inserts.collect()))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_a_walk(spark, monkeypatch, seed):
    monkeypatch.setattr(edits, "BUCKET", 37)
    log = some_log(seed)
    assert folded(spark, log) == walked(log)


def test_rules(spark):
    rows = [(1, 1, "insert", "a", "x", None), (1, 2, "insert", "a~0", "y", None), (1, 3, "insert", "a", "w", None), (1, 4, "set", "a~1", "X", None), (1, 5, "remove", "a~2", None, None), (1, 6, "remove", "b", None, None), (1, 7, "set", "c~0", "nowhere", None)]
    assert folded(spark, rows) == ([(1, "b", "")], [(1, "a", 0, "w"), (1, "a", 1, "X")])
    # An empty line stays while the cursor is in it, and goes with the next prune.
    rows += [(1, 8, "insert", "a~0", "", None), (1, 9, "prune", "a~1", None, None)]
    assert folded(spark, rows)[1] == [(1, "a", 0, "w"), (1, "a", 1, ""), (1, "a", 2, "X")]
    assert folded(spark, [*rows, (1, 10, "commit", "b", "back", None)]) == ([(1, "b", "back")], [(1, "a", 0, "w"), (1, "a", 1, "X")])
    odd = [(None, 1, "set", "a", "x", None), (1, None, "set", "a", "x", None), (1, 1, None, "a", "x", None), (1, 2, "set", None, "x", None), (1, 3, "set", "", "x", None), (1, 4, "prune", None, None, None), (1, 5, "set", "a~x", "kept", None)]
    assert folded(spark, odd) == ([(1, "a~x", "kept")], [])
    assert folded(spark, []) == ([], [])


def test_hot_anchor(spark):
    """Most of the log concerns one anchor of one paper."""
    rng = random.Random(4)
    log = [(7, seq, rng.choice(["insert", "remove", "set", "prune"]), f"a~{rng.randrange(9)}", rng.choice(["", f"t{seq}"]), None) for seq in range(20_000)] + some_log(5, 200)
    assert folded(spark, log) == walked(log)


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    log = some_log(6, 400)
    parts = [log[:150], log[150:260], log[240:400]]
    out = {}
    edit_state.use_store(spark)
    try:
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, LOG).coalesce(1).write.json(str(tmp_path / "log" / str(k)))
            stream = edit_state.edit_stream(spark.readStream.schema(LOG).json(str(tmp_path / "log" / "*")))
            # Each start is a query of its own that knows only the checkpoint.
            query = stream.writeStream.foreachBatch(lambda df, n: [out.setdefault(r.paper_id, {}).setdefault(r.seq, []).append(tuple(r)) for r in df.collect()]).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
            assert query.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    last = [r for by_seq in out.values() for r in by_seq[max(by_seq)]]
    found = sorted((r[0], r[3], r[5]) for r in last if r[2] == "edit"), sorted((r[0], r[3], r[4], r[5]) for r in last if r[2] == "insert")
    assert found == walked(log) == folded(spark, log)


@pytest.mark.parametrize("name", ["edit_fold", "rule_table_suggest"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "events"):
        con.sql(f"create view {t} as select * from '{SF001}/{t}.parquet'")
    want = con.sql(editing.ORACLES[name])
    assert sorted(map(tuple, editing.QUERIES[name](spark, SF001).select(*want.columns).collect())) == sorted(want.fetchall())
