"""run() against a plain version of each stage, and each stage on odd rows."""

import random
import re

import corpus_pipeline
import pytest
import sentencepiece
from pyspark.sql import functions as F

from paperloom.llm import sentencepiece_fst

from .test_ops import BASE, DOCS, brute_components, odd_rows, prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(1)
    item = prose(900, 25)
    rows = [(k, prose(k, 60), "en", "s", 1) for k in range(40)]
    rows += [(100 + k, " ".join(w if rng.random() > 0.01 else "changed" for w in prose(k, 60).split()), "en", "s", 1) for k in range(10)]
    rows += [(200, f"{prose(201, 20)} {item} {prose(202, 20)}", "en", "s", 1), (201, prose(203, 30) + " password=abcdef123456 " + prose(204, 5), "en", "s", 1)]
    rows += [(300, None, "en", "s", 0), (301, "123 456", "en", "s", 0), (302, "", None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, prose(901, 25))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, item


def test_run(spark, corpus):
    folder, rows, item = corpus
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    kept = {k: t for k, t, *_ in rows if t and re.search(r"[^\W\d_]", t)}
    parts = brute_components(list(kept.items()))
    kept = {k: t for k, t in kept.items() if parts[k][2] and item not in t}
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.MODEL_PATH)
    assert set(got) == set(kept) and 200 not in got and 100 not in got
    for k, t in kept.items():
        spans = [m.span() for p, ok in BASE for m in re.finditer(p, t) if ok(m)]
        for s, e in sorted(spans, reverse=True):
            t = t[:s] + "[SECRET]" + t[e:]
        assert got[k]["ids"] == library.encode(t) and got[k]["round_trip"]


def test_stages_on_odd_rows(spark, corpus):
    docs = spark.createDataFrame(odd_rows(), DOCS).withColumn("score", F.lit(1))
    for name in ("root", "row", "_row", "language", "base_spans", "Markov_Spans", "cid", "key"):
        docs = docs.withColumn(name, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, corpus[0])
        assert out.columns == docs.columns, name
        assert out.count() > 0 and stage(spark, docs.limit(0), corpus[0]).count() == 0
        assert {r[0] for r in out.select("language").distinct().collect()} == {"x"}
    coded = corpus_pipeline.pieces(spark, docs, corpus[0])
    assert coded.count() == len(odd_rows()) and {tuple(r["ids"]) for r in coded.collect() if r["doc_id"] in (3, 4)} == {()}
    assert corpus_pipeline.pieces(spark, docs.limit(0), corpus[0]).count() == 0
    rows = corpus_pipeline.near_dedup(spark, docs, corpus[0]).collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 7, 10]
    assert sum(r["doc_id"] is None for r in rows) == 1


def test_rows_without_or_with_shared_ids(spark, corpus):
    item, near = corpus[2], prose(700, 90).split()
    rows = [(1, prose(701, 60)), (1, prose(702, 60)), (1, prose(702, 60)), (None, prose(703, 60)), (None, prose(703, 60)), (None, " ".join(near)), (None, " ".join([*near[:-1], "end"]))]
    rows += [(None, prose(704, 20) + " " + item + " " + prose(705, 9)), (2, prose(706, 20) + " " + item), (2, prose(707, 60)), (9, prose(708, 60)), (None, prose(708, 60) + " end"), (7, prose(708, 60) + " stop")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, corpus[0]).collect()}
    ends = {x for x in found if x in rows[5:7]}
    assert len(ends) == 1 and found == {*rows[:2], rows[3], *ends, *rows[7:10], rows[12]}
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination(spark, docs, corpus[0]).collect()]
    assert sorted(clean, key=str) == sorted(rows[:7] + rows[9:], key=str)
