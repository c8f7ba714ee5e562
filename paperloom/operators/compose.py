"""Blocks of a paper under each density, columns and overlays of edits (CMP)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import COLUMN_GAP_IN, DENSITIES, DENSITY_COLUMNS, INDENT, INLINE_COLUMNS, LINE_DEVANAGARI, LINE_LATIN, PAGE_WIDTH_IN
from ..functions.normalize import clean
from ..functions.text import has_devanagari, shape, shape_width, width_in
from .cutting import apart


def each_density(rows: DataFrame, automatic: bool = False) -> DataFrame:
    """Every row under each density, or each of the automatic ones."""
    names = [c.split()[0] for c in DENSITY_COLUMNS.split(", ")]
    kinds = [c.split()[1] for c in DENSITY_COLUMNS.split(", ")]
    table = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in zip(names, kinds, d)]) for d in DENSITIES if not (automatic and d[2])])
    return rows.withColumn("_density", F.explode(table)).select(*rows.columns, "_density.*")


def content_width(side: Column) -> Column:
    return F.lit(PAGE_WIDTH_IN) - F.lit(2.0) * side


def line_height(text: Column, line: Column, font_pt: float = 12.0) -> Column:
    return F.when(has_devanagari(text), F.lit(font_pt * LINE_DEVANAGARI)).otherwise(F.lit(font_pt * LINE_LATIN)) * line


def question_gap(text: Column, font_pt: float = 12.0) -> Column:
    """Points, or a number of lines of this text's height, rounded half up."""
    return F.when(F.col("gap_lines") > 0, F.floor(F.col("gap_lines") * line_height(text, F.col("line"), font_pt) + F.lit(0.5)).cast("double")).otherwise(F.col("gap_question"))


def label_text(label: Column) -> Column:
    """1. for numbers, (a) for others, nothing without a label."""
    return F.when(F.coalesce(label, F.lit("")) == "", "").when(label.rlike("^[0-9]+$"), F.concat(label, F.lit(". "))).otherwise(F.concat(F.lit("("), label, F.lit(") ")))


def option_text(label: Column, text: Column) -> Column:
    shown = F.when(F.coalesce(label, F.lit("")) == "", "").otherwise(F.concat(F.lit("("), label, F.lit(") ")))
    return F.concat(clean(F.concat(shown, text)), F.lit(" ( )"))


def fits_at(widths: Column, cols: Column, available: Column) -> Column:
    """struct(cols, widths) if the widest cells of the columns and the gaps fit; else null. Slack is shared equally."""
    column = F.transform(F.sequence(F.lit(0), cols - 1), lambda c: F.array_max(F.filter(widths, lambda w, i: i % cols == c)))
    needed = F.aggregate(column, F.lit(0.0), lambda s, w: s + w)
    share = (available - needed) / cols
    return F.when(needed + F.lit(COLUMN_GAP_IN) * (cols - 1) <= available, F.struct(cols.cast("int").alias("cols"), F.transform(column, lambda w: w + share).alias("widths")))


def with_packed(df: DataFrame, cells: str, available: Column, most: Column, name: str = "packed", font_pt: float = 12.0, widths: Column | None = None) -> DataFrame:
    """``df`` with struct(cols, widths) of an array of cells: the most columns that fit, or as many as make full rows if those are fewer and fit as well; one column without widths if no more do.

    Widths and the best fit are columns of their own, as an expression within a lambda would be worked out again for every element.
    """
    if widths is None:
        widths = F.transform(F.transform(cells, shape), lambda c: shape_width(c) * F.lit(float(font_pt)) / F.lit(7200.0))
    rows = df.withColumns({"_widths": widths, "_room": available, "_most": F.least(most, F.size(cells)).cast("int")})
    tried = F.transform(F.filter(F.sequence(F.greatest(F.col("_most"), F.lit(1)), F.lit(1)), lambda c: c > 1), lambda c: fits_at(F.col("_widths"), c, F.col("_room")))
    rows = rows.withColumn("_best", F.try_element_at(F.filter(tried, lambda x: x.isNotNull()), F.lit(1)))
    n = F.size(cells)
    rows = rows.withColumn("_even", F.ceil(n / F.ceil(n / F.col("_best.cols"))).cast("int"))
    evened = F.when(F.col("_even") < F.col("_best.cols"), fits_at(F.col("_widths"), F.col("_even"), F.col("_room")))
    one = F.struct(F.lit(1).alias("cols"), F.lit(None).cast("array<double>").alias("widths"))
    out = F.when(F.col(cells).isNotNull(), F.coalesce(evened, F.col("_best"), one))
    return rows.withColumn(name, out).drop("_widths", "_room", "_most", "_best", "_even")


BLOCK = "paper_id long, q_idx int, part int, type string, key string, marks_key string, text string, right_text string, cells array<string>, cell_keys array<string>, max_cols int, indent double, gap string, bold boolean, align string"


def _block(type_: str, part: Column, key: Column, text: Column | None = None, right: Column | None = None, cells: Column | None = None, keys: Column | None = None, most: Column | None = None, indent: float = 0.0, gap: Column | None = None, bold: bool = False, align: str = "") -> list[Column]:
    none = F.lit(None)
    return [
        F.col("paper_id"), F.col("q_idx").cast("int").alias("q_idx"), part.cast("int").alias("part"), F.lit(type_).alias("type"), key.alias("key"),
        (text if text is not None else none.cast("string")).alias("text"), (right if right is not None else none.cast("string")).alias("right_text"),
        (cells if cells is not None else none.cast("array<string>")).alias("cells"), (keys if keys is not None else none.cast("array<string>")).alias("cell_keys"),
        (most if most is not None else none).cast("int").alias("max_cols"), F.lit(indent).alias("indent"), (gap if gap is not None else F.lit("none")).alias("gap"), F.lit(bold).alias("bold"), F.lit(align).alias("align"),
    ]


def header_blocks(headers: DataFrame) -> DataFrame:
    """Three centred lines, the row of time, class and marks (a field of its own is a centred line), and the rule. Labels are Hindi where the subject or exam is."""
    hindi = has_devanagari(F.col("subject")) | has_devanagari(F.col("exam"))

    def label(h: str, e: str) -> Column:
        return F.when(hindi, h).otherwise(e)

    fields = [("h.time", label("समय: ", "Time: "), "time"), ("h.class", label("कक्षा: ", "Class: "), "class_name"), ("h.marks", label("पूर्णांक: ", "M.M. "), "max_marks")]
    row = F.filter(F.array(*[F.when(F.col(c) != "", F.struct(F.lit(k).alias("key"), F.concat(p, F.col(c)).alias("text"))) for k, p, c in fields]), lambda x: x.isNotNull())
    rows = headers.withColumn("row", row).withColumn("q_idx", F.lit(0))
    lines = [("h.school", F.col("school"), F.col("school") != ""), ("h.exam", F.col("exam"), F.col("exam") != ""), ("h.subject", F.concat(label("विषय: ", "Sub: "), F.col("subject")), F.col("subject") != "")]
    out = [rows.where(keep).select(*_block("header", F.lit(k), F.lit(key), text, bold=True, align="center")) for k, (key, text, keep) in enumerate(lines)]
    only = F.element_at("row", 1)
    out.append(rows.where("size(row) = 1").select(*_block("header", F.lit(3), only["key"], only["text"], bold=True, align="center")))
    out.append(rows.where("size(row) > 1").select(*_block("header-row", F.lit(3), F.lit("h.row"), cells=F.transform("row", lambda x: x["text"]), keys=F.transform("row", lambda x: x["key"]), most=F.size("row"), bold=True)))
    out.append(rows.select(*_block("rule", F.lit(4), F.lit(None).cast("string"), F.lit(""))))
    return _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def question_blocks(questions: DataFrame, subs: DataFrame, pairs: DataFrame, items: DataFrame, prefix: str = "auto") -> DataFrame:
    """Headings with marks, stems and option rows, pairs, rows of short items, items. A heading begins with ``prefix`` and its number; by itself, the prefix follows the heading's script. ``questions(paper_id, q_idx, number, heading, marks, kind)``; q_idx counts from 1, keys from 0."""
    base = F.concat(F.lit("q"), (F.col("q_idx") - 1).cast("string"))

    def key(*parts: Column | str) -> Column:
        return F.concat(base, *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    named = F.when(has_devanagari(F.col("heading")), "प्रश्न").otherwise("Que") if prefix == "auto" else F.lit(prefix)
    begins = F.concat(named, F.lit(" "), F.col("number"), F.lit(". "))
    heads = questions.select(*_block("question", F.lit(0), key(".head"), clean(F.concat(begins, F.col("heading"))), F.when(F.col("marks") != "", F.concat(F.lit("("), F.col("marks"), F.lit(")"))), gap=F.lit("question"), bold=True))
    stems = subs.where("stem <> ''").select(*_block("sub", 1 + F.col("sub_no") * 2, key(".s", F.col("sub_no"), ".stem"), clean(F.concat(label_text(F.col("label")), F.col("stem"))), indent=INDENT["sub"], gap=F.when(F.col("sub_no") == 0, "none").otherwise("sub")))
    cells = F.filter(F.transform("options", lambda o: option_text(o["label"], o["text"])), lambda c: c != "")
    rows = subs.where("size(options) > 0").select(*_block("options", 2 + F.col("sub_no") * 2, key(".s", F.col("sub_no"), ".opts"), cells=cells, keys=F.transform("options", lambda o, i: key(".s", F.col("sub_no"), ".o", i)), most=F.size("options"), indent=INDENT["option"]))
    name = F.when(F.col("is_header"), key(".ch")).otherwise(key(".p", F.col("ord")))
    two = F.array(clean(F.concat(label_text(F.col("label")), F.col("left"))), clean(F.concat(label_text(F.col("right_label")), F.col("right"))))
    matches = pairs.select(*_block("pair", 2 + F.col("ord"), name, cells=two, keys=F.array(F.concat(name, F.lit(".l")), F.concat(name, F.lit(".r"))), most=F.lit(2), indent=INDENT["pair"]))
    kinds = items.join(apart(questions.select("paper_id", "q_idx", "kind")), ["paper_id", "q_idx"])
    text = clean(F.concat(label_text(F.col("label")), F.col("text")))
    own = kinds.where("kind <> 'inline'").select(*_block("item", 1 + F.col("ord"), key(".i", F.col("ord")), text, F.when(F.col("box"), "[ ]"), indent=INDENT["item"], gap=F.when(F.col("ord") == 0, "none").otherwise("sub")))
    each = F.array_sort(F.collect_list(F.struct("ord", text.alias("t"))))
    short = kinds.where("kind = 'inline'").groupBy("paper_id", "q_idx").agg(each.alias("xs"))
    short = short.select(*_block("inline", F.lit(1), key(".inline"), cells=F.transform("xs", lambda x: x["t"]), keys=F.transform("xs", lambda x: key(".i", x["ord"])), most=F.lit(INLINE_COLUMNS), indent=INDENT["item"]))
    return _union([heads, stems, rows, matches, own, short])


def edit_blocks(blocks: DataFrame, edits: DataFrame, inserts: DataFrame) -> DataFrame:
    """``blocks`` with edits(paper_id, key, text) laid over texts, marks and cells, and inserts(paper_id, anchor_key, ord, text) behind their anchors.

    An edit wins even if empty; an emptied cell goes, an emptied line goes, an inserted one stays. A line inserted behind a line is a line of its
    type; one behind a row of cells is an item. Both tables go to the blocks by paper, as one map each: they are what one user typed.
    """
    by_key = edits.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("key", clean(F.col("text"))))).alias("edits"))
    per_anchor = inserts.groupBy("paper_id", "anchor_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: clean(x["text"])).alias("ts"))
    added = per_anchor.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("anchor_key", "ts"))).alias("inserts"))
    rows = blocks.join(apart(by_key), "paper_id", "left").join(apart(added), "paper_id", "left")

    def edit(key: Column, text: Column) -> Column:
        return F.when(F.coalesce(F.map_contains_key("edits", F.coalesce(key, F.lit(""))), F.lit(False)), F.try_element_at("edits", key)).otherwise(text)

    def extra(key: Column) -> Column:
        return F.coalesce(F.try_element_at("inserts", key), F.array().cast("array<string>"))

    cells = F.flatten(F.zip_with("cell_keys", "cells", lambda k, c: F.concat(
        F.filter(F.array(F.struct(k.alias("key"), edit(k, c).alias("text"))), lambda x: x["text"] != ""),
        F.transform(extra(k), lambda t, i: F.struct(F.concat(k, F.lit("~"), i.cast("string")).alias("key"), t.alias("text"))),
    )))
    spliced = F.col("type").isin("options", "inline")
    plain = F.zip_with("cell_keys", "cells", lambda k, c: F.struct(k.alias("key"), edit(k, c).alias("text")))
    marks_key = F.regexp_replace("key", r"\.head$", ".marks")
    rows = rows.withColumn("_cells", F.when(spliced, cells).otherwise(plain))
    edited = rows.select(
        "paper_id", "q_idx", "part", F.lit(0).alias("sub"), "type", "key", edit(F.col("key"), F.col("text")).alias("text"),
        F.when(F.col("type") == "question", edit(marks_key, F.col("right_text"))).otherwise(F.col("right_text")).alias("right_text"),
        F.transform("_cells", lambda x: x["text"]).alias("cells"), F.transform("_cells", lambda x: x["key"]).alias("cell_keys"),
        F.when(F.col("type") == "options", F.size("_cells")).otherwise(F.col("max_cols")).alias("max_cols"), "indent", "gap", "bold", "align", F.lit(False).alias("inserted"),
    ).where("cells is null or size(cells) > 0")
    behind = rows.select("*", F.posexplode(extra(F.col("key"))).alias("_i", "_t")).select(
        "paper_id", "q_idx", "part", (F.col("_i") + 1).alias("sub"), F.when(F.col("cells").isNotNull(), "item").otherwise(F.col("type")).alias("type"),
        F.concat("key", F.lit("~"), F.col("_i").cast("string")).alias("key"), F.col("_t").alias("text"), F.lit(None).cast("string").alias("right_text"),
        F.lit(None).cast("array<string>").alias("cells"), F.lit(None).cast("array<string>").alias("cell_keys"), F.lit(None).cast("int").alias("max_cols"),
        "indent", F.lit("none").alias("gap"), (F.col("bold") & F.col("cells").isNull()).alias("bold"), F.when(F.col("cells").isNull(), F.col("align")).otherwise("").alias("align"), F.lit(True).alias("inserted"),
    )
    out = edited.unionByName(behind)
    return out.where((F.col("type") == "rule") | F.col("cells").isNotNull() | F.col("inserted") | (F.col("text") != "") | (F.coalesce("right_text", F.lit("")) != "") & (F.col("text") != ""))


def latest_edits(log: DataFrame) -> DataFrame:
    """The edit log(paper_id, seq, key, text) as the edits in force: the last writer of a key wins; a null text takes the edit back."""
    last = log.groupBy("paper_id", "key").agg(F.max_by("text", "seq").alias("text"), F.max("seq").alias("seq"), F.max(F.struct("seq", F.col("text").isNull().alias("gone"))).alias("last"))
    return last.where(~F.col("last.gone")).select("paper_id", "key", "text")


def placed(blocks: DataFrame, font_pt: float = 12.0) -> DataFrame:
    """``blocks`` with first_q, the paper's first question, and widest, the widest left cell of a question's pairs. No density changes either, so they are told before blocks are laid out at any."""
    first = F.min(F.when(F.col("type") == "question", F.col("q_idx"))).over(Window.partitionBy("paper_id"))
    left = F.element_at("_cells_wide", 1) if "_cells_wide" in blocks.columns else width_in(F.element_at("cells", 1), font_pt)
    widest = F.max(F.when(F.col("type") == "pair", left)).over(Window.partitionBy("paper_id", "q_idx"))
    return blocks.withColumn("first_q", first).withColumn("widest", widest)


def at_densities(blocks: DataFrame, automatic: bool = False, font_pt: float = 12.0) -> DataFrame:
    """Blocks under every density, or every automatic one: gap in points, columns and their widths. Blocks that are not ``placed`` yet are placed first."""
    kept = [c for c in blocks.columns if c not in ("first_q", "widest")]
    rows = each_density(blocks if "widest" in blocks.columns else placed(blocks, font_pt), automatic)
    gap = (
        F.when((F.col("gap") == "question") & (F.col("q_idx") == F.col("first_q")), F.col("gap_header"))
        .when(F.col("gap") == "question", question_gap(F.col("text"), font_pt))
        .when(F.col("gap") == "sub", F.col("gap_sub"))
        .otherwise(F.lit(0.0))
    )
    available = content_width(F.col("side")) - F.col("indent")
    content = content_width(F.col("side"))
    side = F.least(F.greatest(F.col("widest") + F.lit(0.45), content / F.lit(3.0)), content * F.lit(0.55))
    two = F.struct(F.lit(2).alias("cols"), F.array(side, content - F.lit(INDENT["pair"]) - side).alias("widths"))
    rows = rows.withColumns({"before_pt": gap, "_cells": F.when(F.col("type").isin("options", "inline"), F.col("cells"))})
    known = F.when(F.col("_cells").isNotNull(), F.col("_cells_wide")) if "_cells_wide" in blocks.columns else None
    rows = with_packed(rows, "_cells", available, F.col("max_cols"), font_pt=font_pt, widths=known)
    rows = rows.withColumn("packed", F.when(F.col("type") == "pair", two).otherwise(F.col("packed")))
    blank = F.when((F.col("gap") == "question") & (F.col("q_idx") != F.col("first_q")), F.col("gap_lines")).otherwise(0)
    return rows.select(*kept, "rung", "density_id", "top", "bottom", "side", "line", "before_pt", blank.alias("blank_lines"), F.coalesce(F.col("packed.cols"), F.when(F.col("cells").isNotNull(), F.size("cells"))).alias("cols"), F.col("packed.widths").alias("widths"))
