"""Word files of laid-out papers, retyped headers, two copies, and the measures."""

import io
import random
import re
import zipfile

from pyspark.sql import functions as F

from paperloom.constants import DENSITIES, FUNCTION_WORDS, LETTERS, WIDTH_CLASSES
from paperloom.functions import text
from paperloom.operators import header, layout
from paperloom.plans import paper
from paperloom.plans.corpus import lines
from paperloom.operators.segment import segment
from paperloom.sources.docx import docx_lines
from paperloom.sources.word_blocks import docx_of_blocks

from .conftest import SF001


def parts(content):
    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
        return z.read("word/document.xml").decode(), z.read("word/settings.xml").decode()


def test_word_files_of_papers(spark):
    few = segment(lines(spark, SF001).where("paper_id < 4"))
    blocks = paper.blocks(paper.parse(few))
    once, twice = paper.laid_out(blocks, automatic=False), paper.laid_out(blocks, automatic=False, twice=True)
    made = {r["path"]: parts(r["content"]) for r in docx_of_blocks(once).collect()}
    assert len(made) == blocks.select("paper_id").distinct().count() * len(DENSITIES)
    for path, (xml, settings) in made.items():
        assert "suppressSpBfAfterPgBrk" in settings and 'w:w="11906" w:h="16838"' in xml
        assert '<w:sz w:val="24"/>' in xml and '<w:szCs w:val="24"/>' in xml and "Arial" in xml
        assert 'w:val="right"' in xml and "<w:tabs>" in xml and "<w:pBdr>" in xml and "<w:p/><w:p/>" not in xml
        assert ("Nirmala UI" in xml) == bool(re.search("[ऀ-ॿ]", xml))
        # Two lines of 12 points at 1.18 and a line of 1.15.
        assert ('w:before="660"' in xml) == ("spacious" in path)
    assert any("<w:br/>" in xml for xml, _ in made.values())
    normal = once.where("density_id = 'normal'")
    back = {(r["path"], r["line_no"]): r["text"] for r in docx_lines(docx_of_blocks(normal)).collect()}
    for name in {p for p, _ in back}:
        shown = [t for (p, _), t in sorted(back.items()) if p == name]
        own = [r for r in normal.orderBy("block_no").collect() if f"paper-{r['paper_id']}-normal.docx" == name]
        want = [" ".join([*(r["cells"] or [r["text"] or ""]), r["right_text"] or ""]) for r in own]
        assert " ".join(shown).split() == " ".join(want).split()
    two = {r["path"]: parts(r["content"])[0] for r in docx_of_blocks(twice).collect()}
    for path, xml in two.items():
        first = re.findall("<w:t [^>]*>([^<]+)</w:t>", made[path][0])[0]
        assert 'w:val="dashed"' in xml and xml.count(f">{first}<") >= 2 * made[path][0].count(f">{first}<") > 0


def test_two_copies_of_room_to_write(spark):
    rows = [(1, 0, "roomy", k, "item", None, "____", None, None, 0, 0, 100, 1.0, 0.0) for k in range(3)]
    df = spark.createDataFrame(rows, "paper_id long, rung int, density_id string, block_no int, type string, key string, text string, right_text string, cells array<string>, height_u long, before_u long, capacity_u long, line double, before_pt double")
    got = layout.two_up(df).collect()
    assert [(r["copy_no"], r["text"]) for r in got] == [(0, "____")] * 3


def test_unknown_density_is_the_normal_one(spark):
    rows = [(1, k, d[1], 1, 10, 100) for k, d in enumerate(DENSITIES)]
    df = spark.createDataFrame(rows, "paper_id long, rung int, density_id string, page_no int, height_u long, capacity_u long")
    assert [r["density_id"] for r in layout.fits(df, forced="none such").collect()] == ["normal"]
    assert [r["density_id"] for r in layout.fits(df, forced="ultra").collect()] == ["ultra"]


def test_retyped_headers(spark):
    headers = spark.createDataFrame([(1, "S", "E", "English", "5th", "2 hrs", "50"), (2, "S", "परीक्षा", "हिन्दी", "8", "", "")], "paper_id long, school string, exam string, subject string, class_name string, time string, max_marks string")
    cases = [
        (1, "time", "Time: 3 hrs Class: 8th M.M. 70", {"time": "3 hrs", "class_name": "8th", "max_marks": "70"}),
        # The label of the cell itself was typed away.
        (1, "time", "Class: 8th", {"time": "", "class_name": "8th"}),
        (1, "subject", "Sub: - Maths", {"subject": "Maths"}),
        (1, "max_marks", "75", {"max_marks": "75"}),
        (2, "subject", "विषय: गणित", {"subject": "गणित"}),
        (2, "exam", "", {"exam": ""}),
        (1, "school", "Time: all day school", {"school": "Time: all day school"}),
    ]
    for paper_id, field, typed, want in cases:
        lines_ = spark.createDataFrame([(paper_id, field, typed)], "paper_id long, field string, text string")
        got = {r["paper_id"]: r.asDict() for r in header.edit_headers(headers, header.line_edits(headers, lines_)).collect()}
        before = {r["paper_id"]: r.asDict() for r in headers.collect()}
        assert got == before | {paper_id: before[paper_id] | want}


def test_widths_by_classes(spark):
    rng = random.Random(2)
    known = "".join(c for c, _ in WIDTH_CLASSES) + "abcxyzéß日🙂$%&#@"
    texts = ["".join(rng.choice(known) for _ in range(rng.randint(0, 80))) for _ in range(200)] + ["", "plain words", "हिन्दी"]
    width = {c: w for cs, w in WIDTH_CLASSES for c in cs}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", text.width_centi_em(F.col("t")).alias("w"), text.letter_count(F.col("t")).alias("n")).collect():
        assert r["w"] == sum(width.get(c, 52) for c in r["t"]) and r["n"] == sum(c in LETTERS for c in r["t"])
    assert df.limit(1).select(text.width_centi_em(F.lit(None).cast("string"))).first()[0] == 0


def test_all_common_words():
    assert {"good", "day", "about", "name", "said", "following", "the"} <= set(FUNCTION_WORDS)
