"""Facts about papers, and queries against DuckDB."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.functions import labels, normalize, text
from paperloom.operators import build, header, nodes, segment
from paperloom.plans import paper
from paperloom.plans.oracles import ORACLES as FIRST
from paperloom.plans.queries import QUERIES
from paperloom.plans.wording_oracles import WORDING_ORACLES
from paperloom.sources import docx

from .conftest import SF001

ORACLES = FIRST | WORDING_ORACLES


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Sub:- English.", ("English", "", "", "")),
        ("Subject  G.K. | Class :- 5th | Time- 2:30 hrs | M.M. 50", ("G.K.", "5th", "2:30 hrs", "50")),
        ("Standard Examination 2026-27 | Std VI | Total Marks 100", ("", "VI", "", "100")),
        ("Sub: Marketing Time- 2:30 Class XII", ("Marketing", "XII", "2:30", "")),
        # An underscore is a word character, so "Time_" does not end the value before it.
        ("Sub: Marketing Time_ 2:30 Class XII", ("Marketing Time_ 2:30", "XII", "2:30", "")),
        ("विषय- हिन्दी | कक्षा- 8 | समय- 3 घंटे | पूर्णांक 50", ("हिन्दी", "8", "3 घंटे", "50")),
    ],
)
def test_header_line(spark, line, want):
    assert tuple(one(spark, header.header_line, line)) == want


def test_titles(spark):
    assert one(spark, header.school_name, "S.S Academy koirauna __") == "S.S. ACADEMY KOIRAUNA"
    assert one(spark, header.school_name, "ST Xavier school") == "ST XAVIER SCHOOL"
    assert one(spark, header.exam_case, "Half _ yearly Examination CBSE") == "Half Yearly Examination CBSE"
    assert one(spark, header.exam_case, "ANNUAL EXAMINATION OF THE YEAR") == "Annual Examination of the Year"


def test_measures(spark):
    assert one(spark, text.width_centi_em, "Aa1 .-") == 67 + 52 + 56 + 28 + 30 + 55
    assert one(spark, text.letter_count, "की abc 1") == 5
    t = "word " * 40
    assert one(spark, lambda c: text.line_count(c, 12.0, 6.8), t) == math.ceil((40 * (4 * 52 + 28)) * 12 / 7200 / 6.8 - 0.02)


def test_rules(spark):
    assert one(spark, normalize.articles, "a elephant and an cat, an unit and a hour") == "an elephant and a cat, a unit and an hour"
    assert one(spark, normalize.year_range, "Exam 2026 -27") == "Exam 2026-27"
    assert one(spark, normalize.boxes, "a [ ] b (_ ) c [ ]") == "a ( ) b ( ) c [ ]"
    assert one(spark, normalize.is_furniture, "Tab 3") and not one(spark, normalize.is_furniture, "Press the Tab key")


def test_labels(spark):
    assert one(spark, labels.label_of, "(iii) x") == "iii" and one(spark, labels.label_of, "1____ x") == "1" and one(spark, labels.label_of, "A, B and C") == ""
    assert [tuple(o) for o in one(spark, labels.parse_options, "A. Bug ( ) b bird [ ] tall ( )")] == [("A", "Bug"), ("b", "bird"), ("", "tall")]
    assert [tuple(o) for o in one(spark, labels.inline_items, "1. pen 2. boat 3. boy")] == [("1", "pen"), ("2", "boat"), ("3", "boy")]
    assert one(spark, labels.inline_items, "1. pen 2. boat") is None
    assert one(spark, labels.label_format, "v") == "r" and one(spark, labels.label_format, "i") == "a"


def test_headings(spark):
    assert one(spark, build.polish_heading, "write the answers?") == "Write the answers:"
    assert one(spark, build.polish_heading, "what is this?") == "What is this?"
    assert one(spark, build.polish_heading, "fill in the blanks __ .") == "Fill in the blanks:"


def test_option_runs(spark):
    """Runs that could start at each node, and those that a scan meets."""
    tick, other = "Tick the correct option", "Answer these"
    cases = [
        (tick, [("a", "red"), ("b", "blue"), ("c", "old")], [3, 0, 0], [(1, 3)]),
        (other, [("a", "red"), ("b", "blue")], [0, 0], []),
        (tick, [("b", "red"), ("c", "blue")], [0, 0], []),
        (tick, [("a", "red"), ("b", "blue"), ("b", "old")], [2, 0, 0], [(1, 2)]),
        (tick, [("1", "red"), ("2", "blue")], [0, 0], []),
        ("State true or false", [("a", "red ( )"), ("b", "blue ( )")], [0, 0], []),
        (other, [("", f"w{k} ( )") for k in range(10)], [8, 8, 8, 7, 6, 5, 4, 3, 2, 0], [(1, 8), (9, 2)]),
        (other, [("", "red ( )"), ("", "blue"), ("", "old ( )"), ("", "new ( )")], [0, 0, 2, 0], [(3, 2)]),
        (tick, [("a", "red"), ("b", "blue"), ("a", "old"), ("b", "new")], [2, 0, 2, 0], [(1, 2), (3, 2)]),
    ]
    rows = [(k, 1, n + 1, "item", label, text, False, "", None, False, heading) for k, (heading, own, _, _) in enumerate(cases) for n, (label, text) in enumerate(own)]
    df = spark.createDataFrame(rows, "paper_id long, q_idx int, node_no int, kind string, label string, text string, box boolean, auto_fmt string, options array<struct<label:string,text:string>>, lead boolean, heading string")
    runs = nodes.with_runs(df)
    met = nodes.chosen_runs(runs.select("paper_id", "q_idx", F.col("node_no").alias("at"), "run")).collect()
    found = runs.collect()
    for k, (_, _, each, chosen) in enumerate(cases):
        assert [r.run for r in sorted(found, key=lambda r: r.node_no) if r.paper_id == k] == each, k
        assert sorted((r["at"], r["run"]) for r in met if r.paper_id == k) == chosen, k


def test_docx(spark):
    data = docx.write_docx([docx.paragraph_xml("one\ttwo & three"), docx.paragraph_xml("फिर", bold=True)])
    assert docx.read_docx(data) == [("one\ttwo & three", ""), ("फिर", "")]
    with pytest.raises(ValueError, match="zip"):
        docx.read_docx(b"nothing")


@pytest.mark.parametrize("name", ["text_width", "article_fix", "question_marks", "heading_fold", "wrapped_line_join", "options_split", "pair_split", "paginate", "column_pack", "rule_suggest", "accepted_suggestions", "proper_noun_map", "name_confidence", "script_runs", "header_edits", "header_titles", "inline_items", "tabbed_items", "label_gap_fill", "order_by_label", "question_kind", "fix_cap", "stacked_options", "document_line_join", "page_numbers", "html_preview"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "documents"):
        con.sql(f"create view {t} as select * from '{SF001}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(tuple, QUERIES[name](spark, SF001).select(*columns).collect())) == sorted(tuple(r[k] for k in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["script_runs", "name_confidence", "accepted_suggestions", "unnumbered_fold", "marker_labels"])
def test_query_reads_the_whole_tables(spark, tmp_path, name):
    texts = ["A cat. Who was inky ? The name of trees", "climb trees everyday", "हिन्दी then English"]
    spark.createDataFrame([(100 + k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF001}/part.parquet").where("p_partkey < 24").write.parquet(f"{tmp_path}/part.parquet")
    rows = QUERIES[name](spark, str(tmp_path)).collect()
    if name == "script_runs":
        assert [r["piece"] for r in sorted((r for r in rows if r["id"] == 102), key=lambda r: r["k"])] == ["हिन्दी ", "then English"]
        assert {r["id"] for r in rows} >= {100, 101, 102, -1}
    elif name == "name_confidence":
        assert {(r["word"], r["confidence"]) for r in rows if r["paper_id"] == -110} == {("inky", "high"), ("trees", "high")}
        assert {r["paper_id"] for r in rows} >= {-1, -2, -110}
    elif name == "accepted_suggestions":
        assert {r["fixed"] for r in rows if r["paper_id"] == -111} == {"climb trees every day"}
        assert {r["paper_id"] for r in rows} >= {0, 1, 2, -1, -2, -110, -111, -112}
    else:
        # Three papers of twelve questions, and the literal ones.
        assert {r["paper_id"] for r in rows} >= {0, 1, 2, -1}
        nine = [r for r in rows if r["paper_id"] == 1 and r["q_idx"] == 9]
        if name == "marker_labels":
            assert [r["labels"] for r in nine] == ["1,2,3,4,5,6,7,8"] and {r["labels"] for r in rows if r["paper_id"] == -1} == {"1,2,3"}
        else:
            assert len(nine) == 8 and all(r["label"] == "" and r["text"].startswith("why ") for r in nine)


def test_question_marks(spark):
    def asked(t):
        return one(spark, lambda c: normalize.polish_fragment(c, question_mark=True), t)

    assert asked("नित्य आनंद में कौन रह सकता है") == "नित्य आनंद में कौन रह सकता है?"
    assert asked("सिरभाव किसी भी सहारे के बिना पानी की ठीक जगह बताते थे") == "सिरभाव किसी भी सहारे के बिना पानी की ठीक जगह बताते थे"
    assert asked("why is it") == "Why is it?" and asked("the boy who ran home") == "The boy who ran home"


PAPER = """Que 1. Tick the right word about ella everyday (5)
1. Ella felt tried and ella left everyday
A. ella ( ) B. the the dog ( )
Que 2. Match the words (4)
1. ella\tthe doctor advice rest
2. cat\tto leave under
Que 3. Write true and false (3)
1. Who was inky ?
2. what is the name of trees that grow here
3. they climb trees and ella saw them felt tried"""


@pytest.mark.parametrize("chosen", [[], [("felt-tired", False), ("live-under", True), ("doubled-word", True), ("name-inky", False), ("name-trees", True)]])
def test_papers_take_accepted_wording(spark, chosen):
    rows = normalize.prepare(spark.createDataFrame([(1, PAPER), (2, PAPER.replace("Ella", "ella"))], "paper_id long, raw string"))[0]
    got = paper.parse(segment.segment(rows), spark.createDataFrame(chosen, "id string, accepted boolean") if chosen else None)
    items = {(r["paper_id"], r["ord"]): r["text"] for r in got.items.where("q_idx = 3").collect()}
    tired, inky, trees = ("tried", "inky", "Trees") if chosen else ("tired", "Inky", "trees")
    for p, ella in ((1, "Ella"), (2, "ella")):
        assert [items[p, k] for k in range(3)] == [f"Who was {inky}?", f"What is the name of {trees} that grow here?", f"They climb {trees} and {ella} saw them felt {tired}"]
    headings = {(r["paper_id"], r["q_idx"]): r["heading"] for r in got.questions.collect()}
    assert headings[1, 1] == "Tick the right word about Ella every day:" and headings[2, 1] == "Tick the right word about ella every day:" and headings[1, 3] == "Write true or false:"
    sub = got.subs.where("paper_id = 1").first()
    assert sub["stem"] == f"Ella felt {tired} and Ella left every day" and [o["text"] for o in sub["options"]] == ["Ella", "The dog" if chosen else "The the dog"]
    pairs = [(r["left"], r["right"]) for r in got.pairs.where("paper_id = 1").orderBy("ord").collect()]
    assert pairs == [("Ella", "The doctor advises rest"), ("Cat", "To live under" if chosen else "To leave under")]
