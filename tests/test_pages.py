"""Pages by pointer doubling against a plain walk."""

import random

from pyspark.sql import functions as F

from paperloom.operators import layout

BLOCKS = "paper_id long, rung int, density_id string, block_no long, height_u long, before_u long, capacity_u long"


def walked(rows):
    at = {}
    for paper, rung, _, no, height, before, room in sorted(rows):
        page, used = at.get((paper, rung), (1, None))
        if used is not None and used + height > room:
            page, used = page + 1, height - before
        else:
            used = (used or 0) + height
        at[paper, rung] = page, used
        yield paper, rung, no, page


def paged(spark, rows):
    return sorted(tuple(r) for r in layout.paginate(spark.createDataFrame(rows, BLOCKS).withColumn("next", F.lit("x"))).select("paper_id", "rung", "block_no", "page_no").collect())


def test_pages_equal_a_walk(spark):
    """Blocks taller than a page, of no height, exact fits, gaps; block numbers with holes; papers of one block and of hundreds."""
    rng = random.Random(1)
    rows = []
    for paper in range(30):
        for rung in (0, 3):
            room = rng.choice([1, 10, 100, 1000])
            for no in range(rng.choice([1, 2, 7, 300])):
                before = rng.choice([0, 0, 1, 3])
                rows.append((paper, rung, "d", 3 * no + 5, before + rng.choice([0, 1, 2, 5, 12, 150]), before, room))
    assert paged(spark, rows) == sorted(walked(rows))
    assert paged(spark, []) == []


def test_long_paper(spark):
    rng = random.Random(2)
    rows = [(1, 0, "d", no, 2 + rng.randrange(30), 2, 300) for no in range(100_000)]
    got = paged(spark, rows)
    assert got == sorted(walked(rows)) and got[-1][3] > 4000


def test_bounds_settle_rightly(spark):
    """What sums alone say of pages is what a walk finds."""
    rng = random.Random(3)
    rows = [(paper, 0, "d", no, 2 + rng.choice([1, 5, 30, 200]), 2, rng.choice([100]) ) for paper in range(300) for no in range(rng.randrange(1, 20))]
    pages = {}
    for paper, _, _, page in walked(rows):
        pages[paper] = page
    for most in (1, 2, 4):
        for r in layout.page_bounds(spark.createDataFrame(rows, BLOCKS), most).collect():
            assert r.pages is None or r.pages == pages[r.paper_id] == 1
            assert not r.hopeless or pages[r.paper_id] > most


def test_prefix_and_status(spark):
    from paperloom.operators import compose

    questions = spark.createDataFrame([(1, 1, "1", "Write", "5", "list"), (1, 2, "2", "लिखो", "", "list")], "paper_id long, q_idx int, number string, heading string, marks string, kind string")
    subs = spark.createDataFrame([], "paper_id long, q_idx int, sub_no int, label string, stem string, options array<struct<label:string,text:string>>")
    pairs = spark.createDataFrame([], "paper_id long, q_idx int, ord int, is_header boolean, label string, left string, right_label string, right string")
    items = spark.createDataFrame([], "paper_id long, q_idx int, ord int, label string, lead boolean, text string, box boolean")
    shown = lambda **more: [r.text for r in compose.question_blocks(questions, subs, pairs, items, **more).orderBy("q_idx").collect()]
    assert shown() == ["Que 1. Write", "प्रश्न 2. लिखो"] and shown(prefix="Q") == ["Q 1. Write", "Q 2. लिखो"]
    rows = spark.createDataFrame([(0, True), (3, True), (3, False)], "n int, o boolean")
    told = lambda **more: [r.s for r in rows.select(layout.status(F.col("n"), F.col("o"), **more).alias("s")).collect()]
    assert told(automatic=True) == ["no-questions", "too-long-at-the-tightest", "fits"] and told(automatic=False)[1] == "too-long-as-chosen"
    assert told(automatic=True, twice=True) == ["no-questions", "two-copies-too-long", "two-copies-fit"]
