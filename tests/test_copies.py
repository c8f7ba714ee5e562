"""Two copies of a paper: their sums and pages without copying a block."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import compose, layout
from paperloom.plans import paper, queries


@pytest.fixture(scope="module")
def rows(spark):
    """Papers of questions, items, options, pairs, room to write and Hindi lines; one of nothing but room, one of a single block, one that opens with room."""
    rng, out = random.Random(5), []

    def add(p, k, kind, text=None, right=None, cells=None, most=None, gap="sub"):
        out.append((p, k // 6 + 1, k % 6, kind, f"q{k}" if k % 5 else None, None, text, right, cells, cells, most, 0.3, gap, False, "", k + 1))

    for p, n in enumerate([1, 2, 9, 14, 18, 22, 26, 30, 40, 90, 200]):
        for k in range(n):
            kind = "question" if k % 6 == 0 else rng.choice(["item", "item", "options", "pair", "inline", "room"])
            if kind == "question":
                add(p, k, kind, rng.choice(["Que 1. Read:", "प्रश्न 1. पढ़िए"]), "(5)", gap="question")
            elif kind == "room":
                add(p, k, "item", "(a) ____")
            elif kind == "item":
                add(p, k, kind, rng.choice(["", "short", "word " * 40]), rng.choice([None, "[ ]"]))
            else:
                add(p, k, kind, cells=["a word", "three words here" * rng.choice([1, 6])] if kind == "pair" else ["x" * rng.choice([1, 9, 30]) for _ in range(rng.choice([1, 4, 7]))], most=2 if kind == "pair" else 5)
    add(50, 0, "item", "____")
    for k in range(80):
        add(51, k, "item", "____")
    add(52, 0, "item", "__ __")
    add(52, 1, "item", "kept")
    return spark.createDataFrame(out, compose.BLOCK + ", block_no int")


def never(*_, **__):
    raise AssertionError("a block was copied, or its page asked for")


def test_copies_that_fit(spark, rows, monkeypatch):
    """Density and pages equal those of blocks that are copied and paginated; nothing is copied, and a cut holds no text."""
    want = layout.fits(paper.laid_out(rows, twice=True), max_pages=1).select("paper_id", "density_id", "pages", "overflow").collect()
    cuts, own = [], paper.cut
    monkeypatch.setattr(queries, "_paper", lambda *_: None)
    monkeypatch.setattr(paper, "blocks", lambda _: rows)
    monkeypatch.setattr(paper, "cut", lambda df: cuts.append(own(df)) or cuts[-1])
    monkeypatch.setattr(layout, "two_up", never)
    monkeypatch.setattr(layout, "paginate", never)
    got = queries.two_up_fit(spark, "").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert len({r["density_id"] for r in got}) > 2 and max(r["pages"] for r in got) > 2
    assert not [c for df in cuts if "text" in df.columns for c in df.where(F.length("text") > 1).collect()]


def test_sums_of_copies(spark, rows, monkeypatch):
    """Numbers, heights and keys of each copy equal those of the copied blocks."""
    high = layout.with_heights(compose.at_densities(layout.measured(rows), automatic=True))
    want = layout.two_up(high).groupBy("paper_id", "rung", "copy_no").agg(F.count(F.lit(1)).alias("n"), F.sum("height_u").alias("height_u"), F.count("key").alias("n_keys")).collect()
    monkeypatch.setattr(queries, "_paper", lambda *_: None)
    monkeypatch.setattr(paper, "blocks", lambda _: rows)
    monkeypatch.setattr(layout, "two_up", never)
    got = queries.two_up(spark, "").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert {r["copy_no"] for r in got if r["paper_id"] in (50, 51)} == {0}


def test_columns_of_pairs_are_no_matter_of_density(spark, rows, capsys):
    """The first question and a question's widest pair are told once, not once a density."""
    compose.at_densities(layout.measured(rows), automatic=True).explain()
    shown = capsys.readouterr().out
    assert "rung" not in " ".join(line for line in shown.splitlines() if "Window [" in line or "Exchange" in line)


def test_copies_are_made_in_one_pass(spark, rows, capsys):
    """The first copy, the cut and the second copy come from one reading of the blocks, and their file from the same exchange; the cut is dashed and stands in the middle."""
    from paperloom.sources.word_blocks import docx_of_blocks

    high = layout.with_heights(compose.at_densities(layout.measured(rows), automatic=True).where("density_id = 'normal'"))
    own = paper.cut(high)
    two = layout.two_up(own)
    docx_of_blocks(two).explain()
    shown = capsys.readouterr().out
    assert shown.count("Scan ExistingRDD") == 1 and "Join" not in shown and shown.count("Exchange hashpartitioning") == 1
    got = two.where("paper_id = 52").orderBy("block_no").select("copy_no", "type", "text", "key", "dashed").collect()
    assert [tuple(r) for r in got] == [(0, "item", "kept", "q1", False), (1, "rule", "", None, True), (2, "item", "kept", None, False)]


def test_broken_files_among_many(spark):
    """Files that cannot be read, and one without content, are told beside those that can, over more files than are read at once."""
    from paperloom.sources.docx import FILES_EACH, docx_files, docx_of_lines

    n = FILES_EACH * 2 + 3
    good = docx_of_lines(spark.range(n).selectExpr("id as paper_id", "1L as line_no", "concat('line ', id) as flat"))
    bad = spark.createDataFrame([("bad", b"no zip"), ("none", None)], "path string, content binary")
    got = {r["path"]: (r["error"] is None, [(x["text"], x["auto_fmt"]) for x in r["lines"]]) for r in docx_files(good.unionByName(bad).coalesce(1)).collect()}
    assert got == {f"paper-{k}.docx": (True, [(f"line {k}", "")]) for k in range(n)} | {"bad": (False, []), "none": (False, [])}
