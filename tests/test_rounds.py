"""Word files ask for no pages, and fitting keeps one cut a round."""

import random

from pyspark.sql import functions as F

from paperloom.operators import compose, layout
from paperloom.plans import paper, queries


def blocks(spark, sizes):
    rng = random.Random(3)
    rows = []
    for p, n in enumerate(sizes):
        for k in range(n):
            kind = "question" if k % 7 == 0 else "item"
            rows.append((p, k // 7 + 1, k % 7, kind, f"q{k // 7}.i{k}", None, "word " * rng.choice([1, 5, 40]), None, None, None, None, 0.3, "question" if kind == "question" else "sub", False, "", k + 1))
    return spark.createDataFrame(rows, compose.BLOCK + ", block_no int")


def test_word_files_ask_for_no_pages(spark, monkeypatch):
    def never(*_):
        raise AssertionError("pages were asked for")

    monkeypatch.setattr(queries, "_paper", lambda *_: None)
    monkeypatch.setattr(paper, "blocks", lambda _: blocks(spark, [3, 9]))
    monkeypatch.setattr(layout, "paginate", never)
    got = queries.docx_blocks(spark, "").groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in got} == {"paper-0-normal.docx": 3, "paper-1-normal.docx": 9, "two-paper-0-normal.docx": 7, "two-paper-1-normal.docx": 19}


def test_fitting_cuts_once_a_round(spark, monkeypatch):
    rows, cuts = blocks(spark, [1, 20, 60, 90, 110, 130, 150, 200, 400]), []
    want = layout.fits(paper.laid_out(rows))
    own = paper.cut
    monkeypatch.setattr(paper, "cut", lambda df: cuts.append(1) or own(df))
    got = paper.fitted(rows).select(*want.columns)
    assert len(cuts) <= 7
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.select(F.countDistinct("density_id")).first()[0] > 2
