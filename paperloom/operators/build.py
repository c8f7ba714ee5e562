"""Questions from nodes: sub-questions and options, pairs, items; wording of headings and fragments (BLD)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.labels import after_label, column_split, label_of, spaces, split_parts
from ..functions.normalize import polish_fragment
from ..functions.text import collapse_spaces, has_devanagari, script_of, unpacked
from .cutting import apart
from .language import worded
from .nodes import is_short
from .numbering import label_order, with_labels


def is_imperative(text: Column) -> Column:
    return text.rlike(P.IMPERATIVE)


def polish_heading(text: Column) -> Column:
    """First letter, no blanks, no closing punctuation, no ? behind an instruction, no full stop unless it closes an abbreviation, a colon at the end but for Devanagari."""
    out = polish_fragment(text)
    out = collapse_spaces(F.regexp_replace(F.regexp_replace(out, "__+", " "), "[ ]*,([ ]*,)+", ","))
    out = F.regexp_replace(out, r"[ ]*[-–—_:;,]+[ ]*$", "")
    asked = out.rlike(r"\?+[ ]*$") & is_imperative(out)
    out = F.when(asked, F.regexp_replace(out, r"\?+[ ]*$", "")).otherwise(out)
    stopped = out.rlike(r"\.[ ]*$") & ~out.rlike(r"[A-Za-z]\.[A-Za-z]")
    out = F.when(stopped, F.regexp_replace(out, r"[ ]*\.[ ]*$", "")).otherwise(out)
    return F.when(has_devanagari(out) | out.rlike(r"[?:।॥|]$"), out).otherwise(F.concat(out, F.lit(":")))


def heading_fixes(questions: DataFrame) -> DataFrame:
    """The question marks that instructions lost: (paper_id, q_idx, rule, before, after)."""
    lost = F.col("heading").rlike(r"\?+[ ]*[-–—_:;,]*[ ]*$") & is_imperative(polish_fragment(F.trim("heading")))
    return questions.where(lost).select("paper_id", "q_idx", F.lit("instruction punctuation").alias("rule"), collapse_spaces(F.col("heading")).alias("before"), polish_heading(F.col("heading")).alias("after"))


def polish(text: Column, stem: bool = False) -> Column:
    """A reworded fragment in its final form. A stem keeps its closing dash and gets no question mark."""
    return polish_fragment(collapse_spaces(spaces(text)), question_mark=not stem)


def reworded(text: Column) -> Column:
    """A fragment with the paper's accepted suggestions and names (columns of ``language.wording``). Staged as a column of its own before ``polish``, which reads it several times."""
    return worded(collapse_spaces(spaces(text)))


def reworded_headings(questions: DataFrame, wording: DataFrame) -> DataFrame:
    """``questions`` with their headings in final wording."""
    rows = questions.join(apart(wording), "paper_id", "left").withColumn("heading", worded(F.trim("heading")))
    return rows.withColumn("heading", polish_heading(F.col("heading"))).select(*questions.columns)


def subs(questions: DataFrame, nodes: DataFrame, wording: DataFrame) -> DataFrame:
    """(paper_id, q_idx, sub_no, label, stem, options) of mcq questions. Options go with the last stem above them; those before any stem get an empty one, which is not counted."""
    rows = nodes.join(apart(questions.where("kind = 'mcq'").select("paper_id", "q_idx", script_of(F.col("heading")).alias("script"))), ["paper_id", "q_idx"]).join(apart(wording), "paper_id", "left")
    ordered = Window.partitionBy("paper_id", "q_idx").orderBy("node_no")
    rows = rows.withColumn("stem_no", F.sum((F.col("kind") == "item").cast("int")).over(ordered))
    each = F.array_sort(F.collect_list(F.struct("node_no", "kind", "label", "text", "auto_fmt", "options")))
    out = rows.groupBy("paper_id", "q_idx", "script", "stem_no").agg(each.alias("ns"), F.first("taken").alias("taken"), F.first("names").alias("names"))
    first = F.element_at("ns", 1)
    options = F.flatten(F.transform(F.filter("ns", lambda n: n["kind"] == "options"), lambda n: n["options"]))
    out = out.withColumns({"_stem": reworded(first["text"]), "_options": F.transform(options, lambda o: F.struct(o["label"].alias("label"), reworded(o["text"]).alias("text")))})
    stem = F.when(first["kind"] == "item", polish(F.col("_stem"), stem=True)).otherwise("")
    out = out.select("paper_id", "q_idx", "script", "stem_no", stem.alias("stem"), F.when(first["kind"] == "item", first["label"]).otherwise("").alias("label"), F.when(first["kind"] == "item", first["auto_fmt"]).otherwise("").alias("auto_fmt"), F.transform("_options", lambda o: F.struct(o["label"].alias("label"), polish(o["text"]).alias("text"))).alias("options"))
    out = out.withColumns({"_labels": F.transform("options", lambda o: o["label"]), "_formats": F.transform("options", lambda o: F.lit(""))})
    out = with_labels(out, "_labels", "_formats", F.lit("option"), F.col("script"), "_made")
    out = out.withColumn("options", F.zip_with("options", "_made", lambda o, x: F.struct(x.alias("label"), o["text"].alias("text")))).drop("_labels", "_formats", "_made")
    return _relabelled(out, "stem_no", F.col("stem") != "", F.lit("d")).select("paper_id", "q_idx", (F.dense_rank().over(Window.partitionBy("paper_id", "q_idx").orderBy("stem_no")) - 1).alias("sub_no"), "label", "stem", "options")


def _relabelled(rows: DataFrame, order: str, counted: Column, default: Column) -> DataFrame:
    """``rows`` with labels made sure of among the counted ones of each question. Arrays are of one question, and each is worked out once: its rows are put together, labelled and unpacked."""
    kept = [c for c in rows.columns if c not in ("paper_id", "q_idx", "script")]
    marked = rows.withColumn("_c", F.coalesce(counted, F.lit(False)))
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_order"), "_c", *kept)))
    marked = marked.groupBy("paper_id", "q_idx", "script").agg(each.alias("_all")).withColumn("_counted", F.filter("_all", lambda x: x["_c"]))
    marked = marked.withColumns({"_labels": F.transform("_counted", lambda x: x["label"]), "_formats": F.transform("_counted", lambda x: F.coalesce(x["auto_fmt"], F.lit("")))})
    marked = with_labels(marked, "_labels", "_formats", default, F.col("script"), "_made")
    made = F.concat(F.zip_with("_counted", "_made", lambda x, label: x.withField("label", label)), F.filter("_all", lambda x: ~x["_c"]))
    out = unpacked(marked, ["paper_id", "q_idx", "script"], made, k="_k", x="_x")
    return out.select(*[c if c not in kept else F.col("_x")[c].alias(c) for c in rows.columns])


def match_rows(questions: DataFrame, nodes: DataFrame, wording: DataFrame) -> DataFrame:
    """Rows of match questions: (paper_id, q_idx, ord, label, auto_fmt, left, right_label, right, is_header, is_split, n_split, n_items)."""
    rows = nodes.join(apart(questions.where("kind = 'match'").select("paper_id", "q_idx", script_of(F.col("heading")).alias("script"))), ["paper_id", "q_idx"]).join(apart(wording), "paper_id", "left")
    own = Window.partitionBy("paper_id", "q_idx")
    rows = rows.withColumn("at", F.row_number().over(own.orderBy("node_no")))
    head = split_parts(F.col("text"), F.lit(True))
    is_header = (F.col("at") == 1) & F.col("text").rlike(P.COLUMN_HEADER) & head.isNotNull()
    cols = F.when(is_header, head).otherwise(column_split(F.col("text"), False))
    rows = rows.withColumns({"is_header": is_header, "cols": cols})
    answer = (label_of(F.col("cols.right")) != "") & (after_label(F.col("cols.right")) != "") & ~F.col("is_header")
    right = F.when(answer, after_label(F.col("cols.right"))).otherwise(F.col("cols.right"))
    rows = rows.withColumns({"_left": reworded(F.when(F.col("cols").isNull(), F.col("text")).otherwise(F.col("cols.left"))), "_right": reworded(right)})
    return rows.select(
        "paper_id", "q_idx", "script", (F.col("at") - 1).alias("ord"), "label", "auto_fmt",
        polish(F.col("_left")).alias("left"),
        F.when(F.coalesce(answer, F.lit(False)), label_of(F.col("cols.right"))).otherwise("").alias("right_label"),
        F.coalesce(polish(F.col("_right")), F.lit("")).alias("right"), "is_header", (F.col("cols").isNotNull() & ~F.col("is_header")).alias("is_split"),
        F.sum((F.col("cols").isNotNull() & ~F.col("is_header")).cast("int")).over(own).alias("n_split"),
        F.sum((~F.col("is_header")).cast("int")).over(own).alias("n_items"),
    )


def stacked_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of a match question whose columns were typed one under the other: an even number of items from four up, and labels that start again in the middle. A self-join of each half's places."""
    own = Window.partitionBy("paper_id", "q_idx").orderBy("ord")
    items = rows.where("n_split = 0 and not is_header").withColumn("k", F.row_number().over(own) - 1)
    half = F.col("n_items") / 2
    starts = F.lower("label").isin("1", "a", "क")
    facts = items.groupBy("paper_id", "q_idx").agg(F.max((F.col("k") == half) & starts).alias("again"), F.max((F.col("k") == 1) & starts).alias("second"))
    items = items.where("n_items >= 4 and n_items % 2 = 0").join(apart(facts.where("again and not second")), ["paper_id", "q_idx"])
    left = items.where(F.col("k") < half).select("paper_id", "q_idx", "k", "label", "left")
    right = items.where(F.col("k") >= half).select("paper_id", "q_idx", (F.col("k") - half).cast("int").alias("k"), F.col("left").alias("right"))
    return left.join(apart(right), ["paper_id", "q_idx", "k"]).select("paper_id", "q_idx", F.col("k").alias("ord"), "label", "left", F.lit("").alias("right_label"), "right")


def pairs(rows: DataFrame) -> DataFrame:
    """(paper_id, q_idx, ord, label, left, right_label, right, is_header) of match questions with split rows, and of stacked columns. The header row has ord -1."""
    split = _relabelled(rows.where("n_split > 0"), "ord", ~F.col("is_header"), F.when(F.col("script") == "hi", "hindi-letter").otherwise("d"))
    number = F.row_number().over(Window.partitionBy("paper_id", "q_idx", "is_header").orderBy("ord")) - 1
    split = split.select("paper_id", "q_idx", F.when(F.col("is_header"), -1).otherwise(number).alias("ord"), "label", "left", "right_label", "right", "is_header")
    return split.unionByName(stacked_pairs(rows).withColumn("is_header", F.lit(False)))


def item_rows(questions: DataFrame, nodes: DataFrame, wording: DataFrame) -> DataFrame:
    """(paper_id, q_idx, script, ord, label, auto_fmt, lead, text, box) of list questions, as typed. A quoting heading over lines without any label makes all of them leads."""
    rows = nodes.join(apart(questions.where("kind = 'list'").select("paper_id", "q_idx", script_of(F.col("heading")).alias("script"), F.col("heading").rlike(P.QUOTED).alias("quoting"))), ["paper_id", "q_idx"]).join(apart(wording), "paper_id", "left")
    own = Window.partitionBy("paper_id", "q_idx")
    bare = F.min((F.col("label") == "") & (F.col("auto_fmt") == "")).over(own)
    quoted = F.col("quoting") & bare & (F.count(F.lit(1)).over(own) > 1)
    rows = rows.withColumn("lead", F.col("lead") | quoted).withColumn("text", reworded(F.col("text")))
    return rows.select("paper_id", "q_idx", "script", (F.row_number().over(own.orderBy("node_no")) - 1).alias("ord"), "label", "auto_fmt", "lead", polish(F.col("text")).alias("text"), "box")


def items(questions: DataFrame, nodes: DataFrame, wording: DataFrame) -> DataFrame:
    """(paper_id, q_idx, ord, label, lead, text, box) of list questions: ``item_rows`` with their labels made sure of, and in order."""
    rows = _relabelled(item_rows(questions, nodes, wording), "ord", ~F.col("lead"), F.lit("d"))
    return label_order(rows.select("paper_id", "q_idx", "ord", "label", "lead", "text", "box"))


def settled_kinds(questions: DataFrame, list_items: DataFrame, match: DataFrame) -> DataFrame:
    """Final kinds: a match without columns falls back to stacked pairs or a list; a list of two short unboxed items and more, no leads, is inline."""
    short = list_items.groupBy("paper_id", "q_idx").agg((F.min(~F.col("lead") & ~F.col("box") & is_short(F.col("text"))) & (F.count(F.lit(1)) >= 2)).alias("inline"))
    stacked = stacked_pairs(match).select("paper_id", "q_idx").distinct().withColumn("stacked", F.lit(True))
    flat = match.where("n_split = 0").select("paper_id", "q_idx").distinct().withColumn("flat", F.lit(True))
    rows = questions.join(apart(short), ["paper_id", "q_idx"], "left").join(apart(stacked), ["paper_id", "q_idx"], "left").join(apart(flat), ["paper_id", "q_idx"], "left")
    kind = F.when((F.col("kind") == "list") & F.col("inline"), "inline").when((F.col("kind") == "match") & F.col("flat") & F.col("stacked").isNull(), "list").otherwise(F.col("kind"))
    return rows.select(*[c for c in questions.columns if c != "kind"], kind.alias("kind"))
