"""Header fields of a paper (HDR)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import NOT_INITIALS, TITLE_SMALL
from ..functions import patterns as P
from ..functions.normalize import clean
from ..functions.text import collapse_spaces, has_devanagari
from .cutting import apart


def tidy_value(value: Column) -> Column:
    """Without the label's punctuation around it; an abbreviation keeps its last dot."""
    text = F.regexp_replace(clean(value), r"^[-:.– ]+", "")
    bare = F.regexp_replace(text, r"[-:.– ]+$", "")
    return F.when(text.rlike(r"\.$") & text.rlike(r"[A-Za-z]\.[A-Za-z]"), F.concat(bare, F.lit("."))).otherwise(bare)


def tidy_marks(marks: Column) -> Column:
    return F.translate(F.regexp_replace(marks, r"[ \t]+", ""), "X×", "xx")


def looks_like_class(value: Column) -> Column:
    return (F.length(value) <= 20) & value.rlike(P.CLASS)


def _free_values(joined: Column, label: str, least: str = "+") -> Column:
    """All values of a label in a joined header, from left to right: what stands behind it, up to a bar or the next field. One scan; a value is only looked ahead of, so that the next label is still there for the next match."""
    return F.regexp_extract_all(joined, F.lit(rf"(?i){label}{P.HEAD_SEP}([^|]{least}?)(?={P.NEXT_FIELD})"), 1)


def field_values(joined: Column, field: str) -> Column:
    label = P.HEAD_LABELS[field]
    if field == "time":
        found = F.regexp_extract_all(joined, F.lit(rf"(?i){label}{P.HEAD_SEP}{P.TIME_VALUE}"), 1)
    elif field == "max_marks":
        found = F.regexp_extract_all(joined, F.lit(rf"(?i){label}{P.HEAD_SEP}([0-9]{{1,3}})"), 1)
    else:
        found = _free_values(joined, label, "*" if field == "class_name" else "+")
    return F.transform(found, tidy_value)


def field(joined: Column, name: str) -> Column:
    """The first plausible value of a field; empty if there is none."""
    values = field_values(joined, name)
    good = F.filter(values, (lambda v: (v != "") & looks_like_class(v)) if name == "class_name" else (lambda v: v != ""))
    return F.coalesce(F.try_element_at(good, F.lit(1)), F.lit(""))


def header_line(text: Column) -> Column:
    """The labelled fields of a single line."""
    return F.struct(*[field(clean(text), f).alias(f) for f in ("subject", "class_name", "time", "max_marks")])


def without_rules(text: Column) -> Column:
    """Hand-drawn underscores and closing dashes go."""
    return collapse_spaces(F.regexp_replace(F.regexp_replace(text, "_+", " "), r"[ \-–—]+$", ""))


def exam_case(text: Column) -> Column:
    """Title case. Dotted initials stay, words in capitals stay unless the whole line is in capitals, small words are small but at the start."""
    line = without_rules(clean(text))
    shouting = ~line.rlike("[a-z]")
    pieces = F.regexp_extract_all(line, F.lit(r"[A-Za-z][A-Za-z'.]*|[^A-Za-z]+"), 0)

    def one(w: Column, i: Column) -> Column:
        low = F.lower(w)
        return (
            F.when(~w.rlike("^[A-Za-z]"), w)
            .when(w.rlike(r"^[A-Z]\.(?:[A-Z]\.?)+$"), w)
            .when(~shouting & w.rlike("^[A-Z][A-Z]+$"), w)
            .when((i > 0) & low.isin(TITLE_SMALL), low)
            .otherwise(F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, F.lit(2), F.length(low))))
        )

    return F.array_join(F.transform(pieces, one), "")


def school_name(text: Column) -> Column:
    """Capitals; two or three opening initials get their dots."""
    name = F.upper(without_rules(clean(text)))
    initials = F.regexp_extract(name, r"^([A-Z]{2,3})[ ]+[A-Z]", 1)
    dotted = F.concat(F.regexp_replace(initials, "([A-Z])", r"$1."), F.substring(name, F.length(initials) + 1, F.length(name)))
    name = F.when((initials != "") & ~initials.isin(NOT_INITIALS), dotted).otherwise(name)
    return F.regexp_replace(name, r"^((?:[A-Z]\.)(?:[A-Z]\.)?[A-Z])([ ]+[A-Z])", r"$1.$2")


def parse_headers(header_lines: DataFrame) -> DataFrame:
    """One row for each paper of ``header_lines(paper_id, line_no, flat)``: labelled fields from the joined lines, exam and school by their words, the school else from the first line."""
    is_exam = F.col("flat").rlike(P.EXAM_LINE)
    exam_no = F.min(F.when(is_exam, F.col("line_no")))
    grouped = header_lines.groupBy("paper_id").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "flat"))).alias("ls"),
        exam_no.alias("exam_no"),
    )
    # The line that gave the exam is not asked for the school; other lines with both words are.
    school = F.filter("ls", lambda x: (x["line_no"] != F.coalesce(F.col("exam_no"), F.lit(-1).cast("long"))) & x["flat"].rlike(P.SCHOOL_LINE))
    exam = F.filter("ls", lambda x: x["line_no"] == F.col("exam_no"))
    grouped = grouped.select(
        "paper_id",
        F.array_join(F.transform("ls", lambda x: x["flat"]), " | ").alias("joined"),
        F.coalesce(F.try_element_at(exam, F.lit(1))["flat"], F.lit("")).alias("exam_line"),
        F.coalesce(F.try_element_at(school, F.lit(1))["flat"], F.element_at("ls", 1)["flat"]).alias("school_line"),
    )
    return grouped.select(
        "paper_id",
        school_name(F.col("school_line")).alias("school"),
        exam_case(F.col("exam_line")).alias("exam"),
        *[field(F.col("joined"), f).alias(f) for f in ("subject", "class_name", "time", "max_marks")],
    )


#: Fields that a typed line can name by their labels, and what is shown before each value, in English and Hindi.
LABELLED = {"subject": ("Sub:", "विषय:"), "class_name": ("Class:", "कक्षा:"), "time": ("Time:", "समय:"), "max_marks": ("M.M.", "पूर्णांक:")}


def line_edits(headers: DataFrame, typed: DataFrame) -> DataFrame:
    """(paper_id, field, value) of header lines as a user retyped them: ``typed(paper_id, field, text)``.

    The labels in a line decide which field is which, and a field whose label was typed away is emptied. A line without labels is the field's value, less the label that was shown before it.
    """
    rows = typed.join(apart(headers.select("paper_id", (has_devanagari(F.col("subject")) | has_devanagari(F.col("exam"))).alias("hindi"))), "paper_id")
    rows = rows.withColumn("parsed", header_line(F.col("text")))
    found = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"parsed.{f}").alias("value")) for f in LABELLED]), lambda x: x["value"] != "")
    rows = rows.withColumn("found", F.when(F.col("field").isin(*LABELLED), found).otherwise(F.filter(found, lambda x: F.lit(False))))
    shown = F.lit("")
    for name, (english, hindi) in LABELLED.items():
        shown = F.when(F.col("field") == name, F.when(F.col("hindi"), hindi).otherwise(english)).otherwise(shown)
    rows = rows.withColumn("shown", shown)
    behind = F.regexp_replace(F.expr("substring(text, length(shown) + 1)"), r"^[ \t:.–-]+", "")
    value = F.when((F.col("shown") != "") & F.col("text").startswith(F.col("shown")), behind).otherwise(F.col("text"))
    own = F.array(F.struct("field", F.when(F.size("found") > 0, "").otherwise(value).alias("value")))
    named = F.exists("found", lambda x: x["field"] == F.col("field"))
    return rows.select("paper_id", F.explode(F.when(named, F.col("found")).otherwise(F.concat("found", own))).alias("e")).select("paper_id", "e.field", "e.value")


def edit_headers(headers: DataFrame, edits: DataFrame) -> DataFrame:
    """``headers`` with edits(paper_id, field, value), one for each field at the most, in place of what was read; an empty value empties the field."""
    fields = [c for c in headers.columns if c != "paper_id"]
    by_paper = edits.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_edits"))
    rows = headers.join(apart(by_paper), "paper_id", "left")
    return rows.select("paper_id", *[F.coalesce(F.try_element_at("_edits", F.lit(f)), F.col(f)).alias(f) for f in fields])
