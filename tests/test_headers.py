"""Header fields from whole headers, and the length of headers that the scan takes."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import normalize
from paperloom.operators import header

#: Time with and without units, tabs, spelt-out hours, Hindi, abbreviations, saints, drawn underscores, marks in full, words that begin like labels, named classes.
CASES = [
    (["GV ACADEMY RIVERTOWN", "Half yearly examination 2031-32", "Sub:- Science", "Time- 1:45 Class:- 1st M.M. 60"], {"school": "G.V. ACADEMY RIVERTOWN", "subject": "Science", "class_name": "1st", "time": "1:45", "max_marks": "60"}),
    (["G.V. ACADEMY RIVERTOWN", "YEARLY EXAMINATION", "Sub - Science", "Time - 1:45 h\tClass - 2nd (C)\tM.M.60"], {"subject": "Science", "class_name": "2nd (C)", "time": "1:45 h", "max_marks": "60"}),
    (["MOONRISE ACADEMY", "Annual examination", "Subject: Physics", "Time: 2 hours", "Class: 7th", "M.M. 90"], {"school": "MOONRISE ACADEMY", "subject": "Physics", "class_name": "7th", "time": "2 hours", "max_marks": "90"}),
    (["G.V. ACADEMY", "Yearly examination", "Sub:- Hindi", "Time- 1:45    Class:- 6th    M.M. 60"], {"subject": "Hindi", "class_name": "6th", "time": "1:45", "max_marks": "60"}),
    (["G.V. ACADEMY", "Yearly examination", "Sub:- E.V.S.", "Time- 1:45 Class:- 4th M.M. 60"], {"subject": "E.V.S.", "class_name": "4th"}),
    (["ST ANNE SCHOOL", "Yearly examination", "Sub:- Science", "Time- 1:45 Class:- 3rd M.M. 60"], {"school": "ST ANNE SCHOOL", "subject": "Science"}),
    (["G.V Academy rivertown", "Half _ yearly Examination", "Class - 9th", "Sub- Hindi", "Time_ 1:45\t\t\tMark__60"], {"school": "G.V. ACADEMY RIVERTOWN", "exam": "Half Yearly Examination", "subject": "Hindi", "class_name": "9th", "time": "1:45", "max_marks": "60"}),
    (["G.V. ACADEMY", "ANNUAL EXAMINATION 2031-32", "Subject: Physics", "Class: 11th", "Time: 2 hours", "Maximum Marks - 120"], {"exam": "Annual Examination 2031-32", "subject": "Physics", "class_name": "11th", "time": "2 hours", "max_marks": "120"}),
    (["G.V. ACADEMY", "Yearly examination", "Sub: Market Studies   Class: 12th   Total Marks: 75"], {"subject": "Market Studies", "class_name": "12th", "max_marks": "75"}),
    (["G.V. ACADEMY", "Standard Examination 2031-32", "Sub: Science", "Std. 8   Time: 1:45   M.M. 60"], {"exam": "Standard Examination 2031-32", "class_name": "8", "time": "1:45", "max_marks": "60"}),
    (["G.V. Academy", "Yearly examination", "Sub - Hindi", "Time : 1:45\tClass - L.K.G\tM.M 30"], {"subject": "Hindi", "class_name": "L.K.G", "time": "1:45", "max_marks": "30"}),
    (["जी.वी. एकेडमी", "वार्षिक परीक्षा", "विषय- गणित", "समय_ 1:45    कक्षा- 7    पूर्णांक__60"], {"subject": "गणित", "class_name": "7", "time": "1:45", "max_marks": "60"}),
    (["G.V. ACADEMY", "Yearly examination", "Time: 3 h Class: 2nd"], {"time": "", "class_name": "2nd"}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(k, n, text) for k, (lines, _) in enumerate(CASES) for n, text in enumerate(lines)]
    lines = spark.createDataFrame(rows, "paper_id long, line_no long, raw string").select("paper_id", "line_no", normalize.clean(normalize.mark_spaces(F.col("raw"))).alias("flat"))
    return {r.paper_id: r.asDict() for r in header.parse_headers(lines).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_headers(parsed, k):
    lines, want = CASES[k]
    assert {f: parsed[k][f] for f in want} == want
    # No field holds the next label.
    assert not any(w in str(parsed[k][f]).lower() for f in ("subject", "class_name", "time") for w in ("class", "time", "m.m", "marks:", "कक्षा"))


def test_long_header(spark):
    """A header of a megabyte is scanned once."""
    joined = "Sub: " + "word " * 200_000 + "| Class: 9th | Time: 2:30 M.M. 50"
    row = spark.createDataFrame([(joined,)], "t string").select(header.header_line(F.col("t")).alias("h")).first().h
    assert (row.class_name, row.time, row.max_marks, len(row.subject)) == ("9th", "2:30", "50", 999_999)
