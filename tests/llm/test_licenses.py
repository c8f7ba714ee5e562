"""License scans: the filters against counting every block, whole notices, odd texts, and the registered SQL."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.llm import licenses
from paperloom.llm.licenses import Template

DOCS = "doc_id long, text string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def every_block(text, templates):
    """(label, start, size, share, phrase, places) by counting all blocks."""
    words, out = words_of(text), []
    for k, t in enumerate(templates):
        own, step = set(t.text.split()), licenses.step_of(t)
        for start in range(0, len(words), step):
            block = words[start : start + 2 * step]
            share = len(own & set(block))
            if share >= licenses.needed(t):
                phrase = t.text.split()
                places = [start + i for i in range(len(block)) if block[i : i + len(phrase)] == phrase] if t.phrase else []
                out.append((t.label, start, len(block), share / len(own), t.phrase, places, k))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_filters_lose_no_block(spark, seed):
    """Small vocabularies, so that many blocks are close to the threshold; frequent and rare tokens, all shares."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(30)]
    pick = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.15)), 29)] for _ in range(n))
    templates = [Template(f"t{k}", pick(rng.choice([1, 2, 3, 5, 9, 20, 40])), rng.choice([0.3, 0.5, 0.8, 1.0])) for k in range(9)] + [Template("p", "w1 w2", 1.0, True), Template("q", "w3 w1 w0", 1.0, True)]
    rows = [(k, pick(rng.choice([0, 1, 3, 7, 8, 9, 16, 17, 60, 200]))) for k in range(60)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("template", "start", "word", "words", "block")})
    got = licenses.license_blocks(df, templates).select("text", "n_words", "license_blocks").collect()
    for r in got:
        assert sorted((tuple(x) for x in r.license_blocks), key=str) == every_block(r.text, templates)
        assert r.n_words == len(words_of(r.text))
    assert any(r.license_blocks for r in got)


def odd_docs():
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice("the of to and mit general cc software this work éa stone river".split()) for _ in range(n))
    full = [t.text for t in licenses.TEMPLATES]
    rows = [(k, f"{filler(rng.randint(0, 90))}\n{rng.choice(full)}. {filler(rng.randint(0, 90))}") for k in range(60)]
    for k in range(60):
        words = rng.choice(full).split()
        for _ in range(rng.randint(1, len(words) // 3 + 1)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((100 + k, filler(rng.randint(0, 50)) + " " + " ".join(words) + " " + filler(20)))
    rows += [(300, None), (301, ""), (302, " \n\t"), (None, "MIT  License; CC-BY 4.0"), (303, "GNU\nGeneral-Public /* License */ the mit\xa0license mitlicense"), (304, "mit license " * 20_000), (305, "MIT LICENSE"), (305, "MIT LICENSE"), (306, "apache licenses, éapache license apache license"), (307, filler(30_000) + " Apache License")]
    rows += [(400, "Released under the MIT open source license."), (401, "# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated documentation\n# files (the \"Software\"), to deal in the Software without restriction,\n# including without limitation the rights to use, copy, modify, merge,\n# publish, distribute, sublicense and/or sell copies of the Software")]
    return rows


def test_report(spark):
    rows = odd_docs()
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("n_words", "license_blocks", "places", "share", "base")})
    got = {}
    for r in licenses.license_report(df).collect():
        got.setdefault(r.doc_id, tuple(r))
    phrases = {t.label: t.text.split() for t in licenses.PHRASES}
    for doc, text in rows:
        words = words_of(text)
        places = [(i, label) for i in range(len(words)) for label, p in phrases.items() if words[i : i + len(p)] == p]
        blocks = every_block(text, licenses.TEMPLATES) if len(words) < 1000 else []
        want = (doc, len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({p[1] for p in places})))
        assert got[doc][:6] == want
        if len(words) < 1000:
            assert got[doc][6] == ",".join(sorted({p[1] for p in places} | {b[0] for b in blocks}))
            assert got[doc][7] == (1.0 if places else max((b[3] for b in blocks), default=0.0))
    assert got[400][5:7] == ("", "mit") and got[401][5:7] == ("", "mit") and got[302][1:] == (0, 0, None, None, "", "", 0.0)


def test_sql(spark):
    rows = list({r[0]: r for r in odd_docs() if r[0] is not None}.values())
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    got = licenses.license_report(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(licenses.ORACLE_SQL).fetchall(), key=str)
    assert licenses.license_report(spark.createDataFrame([], DOCS)).collect() == []


def test_no_python(spark):
    df = licenses.license_report(spark.createDataFrame([(1, "mit license")], DOCS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
