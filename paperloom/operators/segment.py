"""From lines to questions: headings, marks, headings and lines that went on below (SEG)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import COLUMN_IN, WRAPPED_AT
from ..functions import patterns as P
from ..functions.labels import label_of
from ..functions.normalize import clean
from ..functions.text import collapse_spaces, let, width_in
from .header import tidy_marks


def heading_number(flat: Column) -> Column:
    latin = F.regexp_extract(flat, P.QUESTION, 1)
    found = F.when(latin != "", latin).otherwise(F.regexp_extract(flat, P.QUESTION, 2))
    # A heading opens with one of these; a plain search is far cheaper than the pattern.
    named = flat.contains("Q") | flat.contains("q") | flat.contains("प्रश्न")
    return F.when(named, found).otherwise(F.when(flat.isNotNull(), ""))


def marks_of(text: Column) -> Column:
    return tidy_marks(F.regexp_extract(text, P.MARKS, 1))


def without_marks(text: Column) -> Column:
    return F.regexp_replace(text, P.MARKS, "")


def could_continue(before: Column, text: Column, auto_fmt: Column) -> Column:
    """The line before is unfinished, and this one has no number, no blank and no label."""
    return F.coalesce((before != "") & ~before.rlike(P.FINISHED) & (auto_fmt == "") & let(clean(text), lambda flat: (flat != "") & ~flat.rlike(P.BLANK) & (label_of(flat) == "")), F.lit(False))


def at_edge(text: Column, font_pt: float = 12.0) -> Column:
    return width_in(text, font_pt) >= COLUMN_IN * WRAPPED_AT


def segment(lines: DataFrame) -> DataFrame:
    """``lines(paper_id, line_no, text, flat, auto_fmt)`` with q_idx (0: header), is_heading, number, heading, marks. One exchange by paper."""
    number = heading_number(F.col("flat"))
    rows = lines.withColumn("number", number)
    head = F.col("number") != ""
    rows = rows.withColumn("rest", F.when(head, F.regexp_extract("flat", P.QUESTION, 3)))
    rows = rows.withColumns({"is_heading": head, "q_idx": F.sum(head.cast("int")).over(Window.partitionBy("paper_id").orderBy("line_no")).cast("int")})
    return rows.select("paper_id", "line_no", "text", "flat", "auto_fmt", "q_idx", "is_heading", "number", F.when(head, without_marks(F.col("rest"))).alias("heading"), F.when(head, marks_of(F.col("rest"))).alias("marks"))


def fold_headings(rows: DataFrame, font_pt: float = 12.0) -> tuple[DataFrame, DataFrame]:
    """(questions, body) of segmented rows.

    A question's first body line goes on with its heading if it could and if the heading ran to the edge or the line carries the marks that
    the heading lacks; a heading that quotes verse takes it for its marks alone. Then marks still missing are lifted from the first body
    line that ends with some. All windows are by (paper, question), so the exchange by paper serves them.
    """
    by_question = Window.partitionBy("paper_id", "q_idx")
    ordered = by_question.orderBy("line_no")
    rows = rows.where("q_idx > 0").withColumn("at", F.row_number().over(ordered))
    rows = rows.withColumn("head_flat", F.first("heading").over(ordered)).withColumn("head_marks", F.first("marks").over(ordered))
    flat_head = clean(F.col("head_flat"))
    could = could_continue(flat_head, F.col("text"), F.col("auto_fmt"))
    carries = (F.col("head_marks") == "") & F.col("flat").rlike(P.MARKS)
    # Spark works out what an "and" repeats even where its first side is false, so the one line that can fold is told by a case.
    folds = F.when(could, F.when(F.col("head_flat").rlike(P.QUOTED), carries).otherwise(carries | at_edge(flat_head, font_pt)))
    rows = rows.withColumn("folded", F.coalesce(F.when(F.col("at") == 2, folds), F.lit(False)))
    tail = F.max(F.when(F.col("folded"), F.col("flat"))).over(by_question)
    rows = rows.withColumn("tail", tail)
    joined = F.when(F.col("tail").isNull(), F.col("head_flat")).otherwise(collapse_spaces(F.concat_ws(" ", clean(F.col("head_flat")), F.col("tail"))))
    rows = rows.withColumn("full", joined)
    lifted = F.when(F.col("tail").isNull(), F.lit("")).otherwise(marks_of(F.col("full")))
    rows = rows.withColumns({
        "heading2": F.when(F.col("tail").isNull(), F.col("full")).otherwise(without_marks(F.col("full"))),
        "marks2": F.when(F.col("head_marks") != "", F.col("head_marks")).otherwise(lifted),
    })
    body_line = ~F.col("is_heading") & ~F.col("folded")
    carrying = body_line & (F.col("marks2") == "") & F.col("flat").rlike(P.MARKS)
    rows = rows.withColumn("first_stray", F.min(F.when(carrying, F.col("line_no"))).over(by_question))
    stray = F.col("line_no") == F.col("first_stray")
    rows = rows.withColumn("marks3", F.coalesce(F.max(F.when(stray, marks_of(F.col("flat")))).over(by_question), F.col("marks2")))
    questions = rows.where("is_heading").select("paper_id", "q_idx", "line_no", "number", F.col("heading2").alias("heading"), F.col("marks3").alias("marks"), F.col("tail").isNotNull().alias("folded"))
    left = F.when(stray, F.trim(without_marks(F.col("text")))).otherwise(F.col("text"))
    body = rows.where(body_line).select("paper_id", "q_idx", "line_no", left.alias("text"), "auto_fmt", F.col("heading2").alias("heading"))
    body = body.where("text <> ''")
    return questions, body


def wrapped_groups(body: DataFrame, font_pt: float = 12.0) -> DataFrame:
    """``body`` with joined and group_no: which lines go on with the line above.

    A line joins if it could go on with the line above and some line of the unbroken run above it ran to the edge: widths of joined
    lines never shrink, so that running maximum stands for the sequential fold. Only above lines that could go on is a width asked for.
    """
    ordered = Window.partitionBy("paper_id", "q_idx").orderBy("line_no")
    flat = clean(F.col("text"))
    rows = body.withColumn("own", flat)
    rows = rows.withColumn("before", F.lag("own").over(ordered))
    rows = rows.withColumn("cand", could_continue(F.col("before"), F.col("text"), F.col("auto_fmt")) & ~F.col("heading").rlike(P.QUOTED))
    rows = rows.withColumn("edge_before", F.coalesce(F.when(F.col("cand"), at_edge(F.col("before"), font_pt)), F.lit(False)))
    rows = rows.withColumn("run", F.sum((~F.col("cand")).cast("int")).over(ordered))
    in_run = Window.partitionBy("paper_id", "q_idx", "run").orderBy("line_no")
    rows = rows.withColumn("joined", F.col("cand") & F.max(F.col("cand") & F.col("edge_before")).over(in_run))
    return rows.withColumn("group_no", F.sum((~F.col("joined")).cast("int")).over(ordered)).drop("own", "before", "cand", "edge_before", "run")


def join_wrapped(body: DataFrame, font_pt: float = 12.0) -> DataFrame:
    """One row for each joined line: (paper_id, q_idx, group_no, text, auto_fmt, heading)."""
    groups = wrapped_groups(body, font_pt)
    parts = F.array_sort(F.collect_list(F.struct("line_no", "text", "auto_fmt")))
    out = groups.groupBy("paper_id", "q_idx", "group_no").agg(parts.alias("parts"), F.first("heading").alias("heading"))
    return out.select("paper_id", "q_idx", "group_no", F.array_join(F.transform("parts", lambda p: F.trim(p["text"])), " ").alias("text"), F.element_at("parts", 1)["auto_fmt"].alias("auto_fmt"), "heading")
