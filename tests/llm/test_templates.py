"""Decontamination against a plain version that holds every item against every place of every document."""

import random
from collections import defaultdict

import regex

from paperloom.llm import decontaminate as d
from tests.llm.test_ops import prose

SPACE = "[ \t\n\x0b\f\r]"


def words(text):
    """(template word, word) of a text."""
    text = regex.sub(rf"(?<=[^ \t\n\x0b\f\r.!?:]{SPACE})(\p{{Lu}}\p{{Ll}}[\p{{L}}'-]*)", "\x02\\1", text.replace("\x02", " "))
    out = []
    for w in regex.sub(r"[^\p{L}\p{N} \t\n\x0b\f\r\x02]+", "", text.lower()).split():
        kind = d.NUMBER if regex.fullmatch("[0-9]+", w) else d.NAME if w[0] == "\x02" else d.UNIT if w in d.UNITS and out and out[-1][0] == d.NUMBER else None
        out.append((kind or w, w.replace("\x02", "")))
    return out


def literal(ws):
    return sum(not t.startswith("<") for t, _ in ws)


def forms(item):
    """{exact: (number of windows, [(place, words)])}"""
    ws = words(item)
    size = min(len(ws), d.WINDOW)
    every = [(k, ws[k : k + size]) for k in range(len(ws) - size + 1)] if ws else []
    strong = [(k, w) for k, w in every if literal(w) >= d.LITERALS]
    out = {}
    if strong:
        out[False] = strong
    elif literal(ws) >= d.FEW_LITERALS and len(ws) <= d.LONGEST:
        out[False] = [(0, ws)]
    if not strong and len(ws) >= d.FEW_WORDS:
        out[True] = every
    found = {k: (len(v), list(v)) for k, v in out.items()}
    if False in found and found[False][0] == 1 and not found[False][1][0][1][0][0].startswith("<"):
        at, w = found[False][1][0]
        found[False][1].append((at, [(d.NAME, w[0][1]), *w[1:]]))
    return found


def plain(docs, items):
    out = {}
    for doc, text in docs:
        ws = words(text or "")
        for item, it in items:
            best = None
            for exact, (total, own) in forms(it or "").items():
                lines = defaultdict(set)
                for at, w in own:
                    for k in range(len(ws) - len(w) + 1):
                        here = ws[k : k + len(w)]
                        if [x[1 if exact else 0] for x in here] == [x[1 if exact else 0] for x in w]:
                            pairs = () if exact else tuple((x[1], y[1]) for x, y in zip(w, here) if x[0].startswith("<"))
                            lines[k - at].add((at, pairs))
                places, slots, changed = set(), 0, False
                for found in lines.values():
                    pairs = {p for _, own_pairs in found for p in own_pairs}
                    clash = {p for p in pairs for q in pairs if (p[0] == q[0]) != (p[1] == q[1])}
                    good = [(at, own_pairs) for at, own_pairs in found if not clash & set(own_pairs)]
                    places |= {at for at, _ in good}
                    left = {p for _, own_pairs in good for p in own_pairs}
                    if good:
                        slots, changed = max(slots, len(left)), changed or any(a != b for a, b in left)
                if places and len(places) / total >= d.COVERAGE:
                    best = max(best or (False, 0.0, 0, 0, 0, False), (exact, len(places) / total, len(places), total, slots, changed))
            if best:
                out[doc, item] = best[1:]
    return out


def test_equal_to_a_plain_version(spark):
    rng = random.Random(3)
    items = [
        (1, "What is 3 plus 4?"),
        (2, "A train leaves Delhi at 9 and covers 60 km in 2 hours while Asha walks slowly beside the old river for 3 km"),
        (3, "Quiet Rivers Flow North Every Day"),
        (4, "12 km 5 hours 9 days Delhi 7 km 3 minutes and 4 hours"),
        (5, "Name the largest planet"),
        (6, "5 + 6"),
        (7, prose(5, 30)),
        (8, prose(6, 9)),
        (9, None),
        (10, ""),
        (11, "How many sides has a hexagon of 6 cm"),
    ]
    docs = []
    for k in range(150):
        item = rng.choice(items)[1] or ""
        for old, new in (("Delhi", rng.choice(["Delhi", "Paris"])), ("Asha", rng.choice(["Asha", "Paris", "Mia"])), ("60", rng.choice(["60", "9"])), ("3", rng.choice(["3", "8"])), ("4", rng.choice(["4", "8"]))):
            item = item.replace(old, new)
        item = rng.choice([item, item, item.lower(), item.upper(), item[: len(item) // 2]])
        docs.append((k, f"{prose(k, rng.randint(0, 9))}{rng.choice([' ', '. ', ': '])}{item}{rng.choice([' ', '; '])}{prose(900 + k, rng.randint(0, 9))} {rng.choice(['', item])}"))
    docs += [(500, None), (501, "what is 5 plus 6?"), (502, "see What is 70 plus 6"), (503, "quiet rivers flow north every day"), (504, "5 6")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in d.contaminated(df, bench).collect()}
    want = {k: (v[1], v[2], v[0], v[3], v[4]) for k, v in plain(docs, items).items()}
    assert got == want
    assert {k for k in want if k[0] > 500} == {(501, 1), (502, 1), (503, 3)}
    assert {r["item_id"] for r in d.unfindable(bench).collect()} == {6, 9, 10}


def test_documents_without_ids_are_apart(spark):
    item = prose(40, 60)
    half = item.split()
    docs = [(None, f"x {' '.join(half[:18])}"), (None, f"y {' '.join(half[18:36])}"), (None, item), (None, item)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r["doc_id"], r["coverage"]) for r in d.contaminated(df, bench).collect()] == [(None, 1.0)]
