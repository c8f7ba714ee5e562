"""Heights, pages, the density that fits, two copies on a page, and text (LAY, SNK-01)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CUT_BREATH_PT, DENSITIES, LINE_DEVANAGARI, LINE_LATIN, MAX_BLANK_LINES, NORMAL, PAGE_HEIGHT_IN, SAFETY
from ..functions import patterns as P
from ..functions.text import has_devanagari, lines_of_width, shape, shape_width, width_in
from .compose import content_width, placed
from .cutting import apart, cut


def capacity(top: Column, bottom: Column) -> Column:
    return (F.lit(PAGE_HEIGHT_IN) - top - bottom) * F.lit(72.0) * F.lit(SAFETY)


def block_text() -> Column:
    right = F.coalesce(F.concat(F.lit(" "), F.col("right_text")), F.lit(""))
    return F.when(F.col("cells").isNotNull(), F.array_join("cells", " ")).otherwise(F.concat(F.coalesce("text", F.lit("")), right))


def measured(blocks: DataFrame, font_pt: float = 12.0) -> DataFrame:
    """``blocks`` with the measures that no density changes: _wide, _right_wide and _cells_wide in inches, and _hindi. Taken before blocks are laid out at every density."""
    shapes = F.transform("cells", shape)
    own = {"_wide": width_in(F.col("text"), font_pt), "_right_wide": width_in(F.col("right_text"), font_pt), "_shapes": shapes, "_hindi": F.coalesce(has_devanagari(block_text()), F.lit(False))}
    rows = blocks.withColumns(own)
    return rows.withColumn("_cells_wide", F.transform("_shapes", lambda c: shape_width(c) * F.lit(float(font_pt)) / F.lit(7200.0))).drop("_shapes")


MEASURES = ["_wide", "_right_wide", "_cells_wide", "_hindi"]


def thin(blocks: DataFrame) -> DataFrame:
    """``measured`` blocks for what asks for heights alone, with _write: of a text is left whether it is empty and its script, of cells how many there are, of a key that there is one. Texts are much the larger part of what is cut and shuffled."""
    script = F.when(F.col("text") == "", "").when(has_devanagari(F.col("text")), "क").when(F.col("text").isNotNull(), "x")
    rows = blocks.withColumn("_write", is_writing_room())
    bare = {"text": script, "right_text": F.when(F.col("right_text").isNotNull(), ""), "cells": F.transform("cells", lambda c: F.lit("")), "key": F.when(F.col("key").isNotNull(), "")}
    return placed(rows).withColumns(bare).select("paper_id", "q_idx", "block_no", "type", *bare, "max_cols", "indent", "gap", *MEASURES, "_write", "first_q", "widest")


def cell_lines() -> Column:
    cols = F.greatest(F.coalesce("cols", F.lit(1)), F.lit(1))
    room = lambda i: F.element_at("widths", (i % cols + 1).cast("int")) - F.lit(0.1)
    return F.transform("_cells_wide", lambda c, i: F.when(F.col("widths").isNull(), F.lit(1).cast("long")).otherwise(lines_of_width(c, room(i), c == 0.0)))


def block_lines() -> Column:
    """Lines of a measured block whose cells' lines are the column _each: the sum over its rows of cells of the most lines in a row, or those of its text beside what stands at the right."""
    n = F.size("cells")
    cols = F.greatest(F.coalesce("cols", F.lit(1)), F.lit(1))
    rows = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / cols).cast("int")), lambda r: F.array_max(F.slice("_each", (r * cols + 1).cast("int"), cols)))
    grid = F.aggregate(rows, F.lit(0).cast("long"), lambda s, x: s + x)
    beside = F.when(F.col("right_text").isNotNull(), F.col("_right_wide") + F.lit(0.25)).otherwise(F.lit(0.0))
    plain = lines_of_width(F.col("_wide"), content_width(F.col("side")) - F.col("indent") - beside, F.coalesce("text", F.lit("")) == "")
    return F.when(F.col("cells").isNotNull(), F.greatest(grid, F.lit(1).cast("long"))).otherwise(plain)


def with_heights(blocks: DataFrame, font_pt: float = 12.0) -> DataFrame:
    """Heights in points; what is added up later is whole hundredths of a thousandth, so that no order of addition matters."""
    if "_wide" not in blocks.columns:
        blocks = measured(blocks, font_pt)
    tall = F.when(F.col("_hindi"), F.lit(font_pt * LINE_DEVANAGARI)).otherwise(F.lit(font_pt * LINE_LATIN)) * F.col("line")
    height = F.when(F.col("type") == "rule", F.lit(font_pt * 0.45) * F.col("line")).otherwise(block_lines() * tall) + F.col("before_pt")
    blocks = blocks.withColumn("_each", cell_lines())
    return blocks.withColumns({"height_u": F.round(height * 100000).cast("long"), "before_u": F.round(F.col("before_pt") * 100000).cast("long"), "capacity_u": F.floor(capacity(F.col("top"), F.col("bottom")) * 100000).cast("long")}).drop("_each", *MEASURES)


def _folded(blocks: DataFrame, zero: Column, step) -> DataFrame:
    """(paper_id, rung, bs, s): the blocks of each paper under each density, folded in order."""
    each = F.array_sort(F.collect_list(F.struct("block_no", "height_u", "before_u")))
    grouped = blocks.groupBy("paper_id", "rung").agg(each.alias("bs"), F.first("capacity_u").alias("cap"))
    return grouped.select("paper_id", "rung", "bs", F.aggregate("bs", zero, step).alias("s"))


def _placed(s: Column, b: Column) -> tuple[Column, Column]:
    """Page of a block behind others, and the height used on it."""
    opens = s["open"] & (s["used"] + b["height_u"] > F.col("cap"))
    return s["page"] + opens.cast("int"), F.when(opens, b["height_u"] - b["before_u"]).otherwise(s["used"] + b["height_u"])


def _zero() -> Column:
    """Before the first block of a paper."""
    return F.struct(F.lit(1).alias("page"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("open"))


def _next_block(s: Column, b: Column) -> Column:
    page, used = _placed(s, b)
    return F.struct(page.alias("page"), used.alias("used"), F.lit(True).alias("open"))


def page_counts(blocks: DataFrame) -> DataFrame:
    """(paper_id, rung, pages) of ``blocks`` as ``paginate`` takes them, where no block needs its own page."""
    return _folded(blocks, _zero(), _next_block).select("paper_id", "rung", F.col("s.page").alias("pages"))


_PAPER = ["paper_id", "rung"]


def successors(blocks: DataFrame) -> DataFrame:
    """(paper_id, rung, block_no, place, next): the place, from 1, of each block, and the place of the block that opens the next page if this one opens a page; null behind the last.

    A page is full where the sum of all heights so far passes the sum before its first block, that block's gap and the capacity. The first such place is found for all blocks at
    once: sums and limits lie sorted on one line, and each limit takes the last sum before it.
    """
    ordered = Window.partitionBy(*_PAPER).orderBy("block_no")
    rows = blocks.select(*_PAPER, "block_no", "height_u", "before_u", "capacity_u")
    rows = rows.withColumns({"place": F.row_number().over(ordered).cast("long"), "top": F.sum("height_u").over(ordered), "n": F.count(F.lit(1)).over(Window.partitionBy(*_PAPER))})
    limit = F.col("capacity_u") + F.col("top") - F.col("height_u") + F.when(F.col("place") == 1, 0).otherwise(F.col("before_u"))
    each = F.array(F.struct(F.col("top").alias("at"), F.lit(False).alias("asks")), F.struct(limit.alias("at"), F.lit(True).alias("asks")))
    line = rows.select(*_PAPER, "block_no", "place", "n", F.explode(each).alias("x"))
    fits = F.max(F.when(~F.col("x.asks"), F.col("place"))).over(Window.partitionBy(*_PAPER).orderBy("x.at", "x.asks", "place").rowsBetween(Window.unboundedPreceding, 0))
    after = F.greatest(F.coalesce("fits", F.lit(0)), "place") + 1
    return line.withColumn("fits", fits).where("x.asks").select(*_PAPER, "block_no", "place", F.when(after <= F.col("n"), after).alias("next"))


def page_starts(nexts: DataFrame) -> DataFrame:
    """(paper_id, rung, place) of the blocks that open a page, by pointer doubling: as many rounds as the longest paper's pages have binary digits. Rounds are cut, so a lost executor repeats one."""
    hops = cut(nexts.where("next is not null").select(*_PAPER, "place", "next"))
    starts = cut(nexts.where("place = 1").select(*_PAPER, "place"))
    while True:
        further = cut(starts.join(apart(hops), [*_PAPER, "place"]).select(*_PAPER, F.col("next").alias("place")))
        if further.isEmpty():
            return starts
        starts = starts.unionByName(further)
        twice = hops.select(*_PAPER, F.col("place").alias("next"), F.col("next").alias("then"))
        hops = cut(hops.join(apart(twice), [*_PAPER, "next"]).select(*_PAPER, "place", F.col("then").alias("next")))


def paginate(blocks: DataFrame) -> DataFrame:
    """``blocks`` (with height_u, before_u, capacity_u, block_no) with page_no: greedy, a block that does not fit opens a page and loses its leading gap there.

    The recurrence resets, so it is no running sum. Every block's next page start is looked up at once, and the starts that the first block leads to are found
    by doubling; a page's number is the count of starts so far. Nothing is folded block by block, and no paper's blocks are held as an array.
    """
    nexts = cut(successors(blocks))
    starts = page_starts(nexts).withColumn("opens", F.lit(1))
    numbered = nexts.join(apart(starts), [*_PAPER, "place"], "left")
    page = F.sum(F.coalesce("opens", F.lit(0))).over(Window.partitionBy(*_PAPER).orderBy("place")).cast("int")
    return blocks.join(apart(numbered.select(*_PAPER, "block_no", page.alias("page_no"))), [*_PAPER, "block_no"])


def fits(paged: DataFrame, max_pages: int = 2, forced: str | None = None) -> DataFrame:
    """One row for each paper: the loosest density whose pages are few enough, else the tightest, with overflow; or the forced one."""
    facts = paged.groupBy("paper_id", "rung", "density_id").agg(F.max("page_no").alias("pages"), F.sum("height_u").alias("height_u"), F.first("capacity_u").alias("capacity_u"))
    if forced:
        # A density that is not known stands for the normal one.
        forced = forced if forced in {d[1] for d in DENSITIES} else NORMAL
        return facts.where(F.col("density_id") == forced).select("paper_id", "density_id", "pages", "height_u", "capacity_u", (F.col("pages") > max_pages).alias("overflow"))
    row = F.struct("rung", "density_id", "pages", "height_u", "capacity_u")
    best = facts.groupBy("paper_id").agg(F.coalesce(F.min(F.when(F.col("pages") <= max_pages, row)), F.max(row)).alias("f"))
    return best.select("paper_id", "f.density_id", "f.pages", "f.height_u", "f.capacity_u", (F.col("f.pages") > max_pages).alias("overflow"))


def status(n_questions: Column, overflow: Column, automatic: bool, twice: bool = False) -> Column:
    """What a user is told of a fitted paper. An overflow is the paper's fault where even the tightest density was tried, and the choice's where a density was asked for."""
    over = "two-copies-too-long" if twice else "too-long-at-the-tightest" if automatic else "too-long-as-chosen"
    return F.when(n_questions == 0, "no-questions").when(overflow, over).otherwise("two-copies-fit" if twice else "fits")


def _bounds(blocks: DataFrame, max_pages: int, *more: Column) -> DataFrame:
    """``page_bounds`` and further aggregates of each paper. A page takes its capacity, or one block that is taller, and each page but the first saves the gap of its first block."""
    facts = blocks.groupBy("paper_id", "density_id").agg(F.sum("height_u").alias("height_u"), F.first("capacity_u").alias("cap"), F.max("height_u").alias("tallest"), F.max("before_u").alias("widest"), *more)
    room = F.greatest("cap", "tallest") * max_pages + F.col("widest") * (max_pages - 1)
    return facts.withColumns({"capacity_u": F.col("cap"), "pages": F.when(F.col("height_u") <= F.col("cap"), 1), "hopeless": F.col("height_u") > room})


def page_bounds(blocks: DataFrame, max_pages: int = 2) -> DataFrame:
    """(paper_id, density_id, height_u, capacity_u, pages, hopeless) of blocks under one density, by sums alone: pages is 1 where all lie on one, else null; hopeless: ``max_pages`` cannot hold them."""
    return _bounds(blocks, max_pages).select("paper_id", "density_id", "height_u", "capacity_u", "pages", "hopeless")


def bounded_pages(blocks: DataFrame, max_pages: int = 2, every: bool = False) -> DataFrame:
    """(paper_id, density_id, height_u, capacity_u, pages) of blocks under one density, in one aggregation by paper: the bounds of ``page_bounds``, and where they do not tell, the blocks folded as in ``page_counts``. Pages that ``max_pages`` cannot hold are null; with ``every`` they are counted, too."""
    each = F.array_sort(F.collect_list(F.struct("block_no", "height_u", "before_u")))
    folded = F.aggregate("bs", _zero(), _next_block)["page"]
    pages = F.when(F.col("pages").isNotNull(), F.col("pages"))
    if not every:
        pages = pages.when(F.col("hopeless"), F.lit(None).cast("int"))
    return _bounds(blocks, max_pages, each.alias("bs")).select("paper_id", "density_id", "height_u", "capacity_u", pages.otherwise(folded).alias("pages"))


def is_writing_room() -> Column:
    """Every part that is not blank is, without its own label, only blanks, dots or dashes; headers and rules are none."""
    parts = F.when(F.col("cells").isNotNull(), F.col("cells")).otherwise(F.array(block_text()))
    parts = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    empty = F.forall(parts, lambda p: F.regexp_replace(p, P.ITEM_LABEL, "").rlike(P.WRITING_ROOM))
    return ~F.col("type").isin("rule", "header", "header-row") & (F.size(parts) > 0) & empty


def _cut_heights(font_pt: float = 12.0) -> tuple[Column, Column, Column]:
    """The rule of the cut, the least gap, and the gap before the cut, in hundredths of a thousandth, from total, line and capacity_u."""
    rule = F.round(F.lit(font_pt * 0.45) * F.col("line") * 100000).cast("long")
    breath = F.lit(int(CUT_BREATH_PT * 100000)).cast("long")
    return rule, breath, F.greatest(breath, F.floor(F.col("capacity_u") / 2).cast("long") - F.col("total") - rule - breath)


def two_up(blocks: DataFrame, font_pt: float = 12.0) -> DataFrame:
    """Two copies on a page: without room to write, then a cut line in the middle, then the same again without keys.

    A paper that is nothing but room to write stays as it is, a single copy. ``blocks`` have heights and block numbers. copy_no is 0, 1 for the cut and 2. The gap before the cut centres it and is ten points at least.
    """
    if "before_pt" not in blocks.columns:
        raise ValueError("two_up takes blocks of with_heights")
    own = Window.partitionBy("paper_id", "rung")
    kept = lambda c: F.when(~F.col("_room"), F.col(c))
    marked = blocks.withColumn("_room", is_writing_room())
    marked = marked.withColumns({"total": F.sum(kept("height_u")).over(own), "last": F.max(kept("block_no")).over(own), "first_no": F.min(kept("block_no")).over(own)})
    opens = F.col("block_no") == F.col("first_no")
    # Each kept block stands twice, and the cut is made of the first one: one pass over the blocks, without a join.
    copies = F.when(F.col("total").isNull(), F.array(F.lit(0))).when(~F.col("_room"), F.when(opens, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(2))))
    marked = marked.withColumn("copy_no", F.explode(copies))
    rule, breath, gap = _cut_heights(font_pt)
    empty = {c: F.lit(None).cast(blocks.schema[c].dataType) for c in ("key", "marks_key", "right_text", "cells", "cell_keys", "cols", "widths") if c in blocks.columns}
    plain = {"type": F.lit("rule"), "text": F.lit(""), "indent": F.lit(0.0), "bold": F.lit(False), "align": F.lit("")}
    cut = empty | plain | {"block_no": F.col("last") + 1, "height_u": rule + gap, "before_u": gap, "before_pt": gap / 100000.0}
    before = F.when(opens, breath).otherwise(F.col("before_u"))
    again = {"key": F.lit(None).cast("string"), "height_u": F.col("height_u") - F.col("before_u") + before, "before_u": before, "before_pt": F.when(opens, F.lit(CUT_BREATH_PT)).otherwise(F.col("before_pt")), "block_no": F.col("last") + 2 + F.col("block_no")}

    def column(c: str) -> Column:
        return F.when(F.col("copy_no") == 1, cut.get(c, F.col(c))).when(F.col("copy_no") == 2, again.get(c, F.col(c))).otherwise(F.col(c)).alias(c) if c in cut or c in again else F.col(c)

    return marked.select(*[column(c) for c in blocks.columns], "copy_no", (F.col("copy_no") == 1).alias("dashed"))


def _copies(blocks: DataFrame, *more: Column) -> DataFrame:
    """Sums of each paper and density of ``thin`` blocks with heights, as ``two_up`` copies them: of the blocks that are kept (all of a paper that is nothing but room to write, which is not doubled), and gap and height of the cut."""
    kept = lambda c: F.when(~F.col("_write"), F.col(c))
    opening = F.min_by(kept("before_u"), kept("block_no"))
    facts = blocks.groupBy("paper_id", "rung", "density_id").agg(
        F.sum("height_u").alias("every_u"), F.count(F.lit(1)).alias("n_every"), F.count("key").alias("keys_every"),
        F.sum(kept("height_u")).alias("total"), F.count(kept("height_u")).alias("n_kept"), F.count(kept("key")).alias("keys_kept"),
        opening.alias("opening_u"), F.first("capacity_u").alias("capacity_u"), F.first("line").alias("line"), *more,
    )
    rule, breath, gap = _cut_heights()
    return facts.withColumns({"gap_u": gap, "cut_u": rule + gap, "again_u": F.col("total") - F.col("opening_u") + breath})


def two_up_sums(blocks: DataFrame) -> DataFrame:
    """(paper_id, rung, copy_no, n, height_u, n_keys) of ``thin`` blocks with heights: the rows of ``two_up``, added up by copy. No block is copied, as the copies' sums follow from the first one's."""
    twice = F.col("n_kept") > 0

    def copy(no: int, n: Column, height: Column, keys: Column) -> Column:
        return F.struct(F.lit(no).alias("copy_no"), n.alias("n"), height.alias("height_u"), keys.alias("n_keys"))

    none = F.lit(0).cast("long")
    copies = F.array(copy(0, F.col("n_kept"), F.col("total"), F.col("keys_kept")), copy(1, F.lit(1).cast("long"), F.col("cut_u"), none), copy(2, F.col("n_kept"), F.col("again_u"), none))
    rows = _copies(blocks).withColumn("_copy", F.explode(F.when(twice, copies).otherwise(F.array(copy(0, F.col("n_every"), F.col("every_u"), F.col("keys_every"))))))
    return rows.select("paper_id", "rung", "_copy.*")


def _twice(facts: DataFrame) -> DataFrame:
    """``_copies`` with height and number of all blocks on the doubled paper."""
    n = F.when(F.col("n_kept") > 0, F.col("n_kept") * 2 + 1).otherwise(F.col("n_every"))
    return facts.withColumns({"height_u": F.when(F.col("n_kept") > 0, F.col("total") + F.col("cut_u") + F.col("again_u")).otherwise(F.col("every_u")), "n": n})


def two_up_on_one(blocks: DataFrame) -> DataFrame:
    """(paper_id, rung, density_id, height_u, capacity_u, pages) of the doubled papers, by sums alone: pages is 1 where all lies on one, else null."""
    facts = _twice(_copies(blocks))
    return facts.select("paper_id", "rung", "density_id", "height_u", "capacity_u", F.when((F.col("height_u") <= F.col("capacity_u")) | (F.col("n") == 1), 1).alias("pages"))


def two_up_pages(blocks: DataFrame) -> DataFrame:
    """The same with pages counted for every doubled paper: the kept blocks are folded, then the cut, then the kept ones again."""
    each = F.array_sort(F.collect_list(F.struct("block_no", "height_u", "before_u", "_write")))
    facts = _twice(_copies(blocks, each.alias("_every"))).withColumn("_kept", F.filter("_every", lambda b: ~b["_write"]))
    breath = _cut_heights()[1]

    def block(height: Column, before: Column) -> Column:
        return F.struct(height.alias("height_u"), before.alias("before_u"))

    plain = lambda b: block(b["height_u"], b["before_u"])
    again = F.transform("_kept", lambda b, i: F.when(i == 0, block(b["height_u"] - b["before_u"] + breath, breath)).otherwise(plain(b)))
    doubled = F.concat(F.transform("_kept", plain), F.array(block(F.col("cut_u"), F.col("gap_u"))), again)
    facts = facts.withColumn("bs", F.when(F.col("n_kept") > 0, doubled).otherwise(F.transform("_every", plain))).withColumn("cap", F.col("capacity_u"))
    return facts.select("paper_id", "rung", "density_id", "height_u", "capacity_u", F.aggregate("bs", _zero(), _next_block)["page"].alias("pages"))


def block_rendering() -> Column:
    """A block as text: cells by tabs, rows by lines, four spaces for each 0.3 inches of indent, the rule as dashes."""
    indent = F.repeat(F.lit("    "), F.floor(F.col("indent") / 0.3 + F.lit(0.5)).cast("int"))
    cols = F.greatest(F.coalesce("cols", F.lit(1)), F.lit(1))
    rows = F.transform(F.sequence(F.lit(0), F.floor((F.size("cells") - 1) / cols).cast("int")), lambda r: F.concat(indent, F.array_join(F.slice("cells", (r * cols + 1).cast("int"), cols), "\t")))
    return (
        F.when(F.col("type") == "rule", F.repeat(F.lit("—"), 57))
        .when(F.col("type") == "header-row", F.array_join("cells", "\t\t"))
        .when(F.col("cells").isNotNull(), F.array_join(rows, "\n"))
        .otherwise(F.concat(indent, F.coalesce("text", F.lit("")), F.coalesce(F.concat(F.lit("\t"), F.col("right_text")), F.lit(""))))
    )


def render_text(blocks: DataFrame) -> DataFrame:
    """(paper_id, rung, text): blocks in order, a blank line before gaps of four points and more, or as many as the density asks for, two at most."""
    blank = F.when(F.col("blank_lines") > 0, F.least(F.col("blank_lines"), F.lit(MAX_BLANK_LINES))).otherwise((F.col("before_pt") >= 4).cast("int"))
    first = F.min("block_no").over(Window.partitionBy("paper_id", "rung"))
    rows = blocks.withColumn("first", first)
    shown = F.concat(F.when(F.col("block_no") == F.col("first"), "").otherwise(F.repeat(F.lit("\n"), blank)), block_rendering())
    each = F.array_sort(F.collect_list(F.struct("block_no", shown.alias("t"))))
    out = rows.groupBy("paper_id", "rung").agg(F.array_join(F.transform(each, lambda x: x["t"]), "\n").alias("text"))
    return out.select("paper_id", "rung", F.regexp_replace("text", "\n{4,}", "\n\n\n").alias("text"))


#: Characters that markup writes in another way, the ampersand first.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))


def escaped(text: Column) -> Column:
    for meant, written in ESCAPES:
        text = F.replace(text, F.lit(meant), F.lit(written))
    return text


def _span(text: Column, key: Column, kind: str = "") -> Column:
    marked = F.coalesce(F.concat(F.lit(' data-edit-key="'), escaped(key), F.lit('"')), F.lit(""))
    return F.concat(F.lit(f'<span class="{kind}"' if kind else "<span"), marked, F.lit(">"), escaped(F.coalesce(text, F.lit(""))), F.lit("</span>"))


def block_markup(first: Column) -> Column:
    """A block as markup: a rule, a row or a grid of cells, or a line with what stands at its right. ``first`` on its page, it has no gap."""
    gap = F.when(first, F.lit("0.00")).otherwise((F.col("before_u") / 100000).cast("decimal(12,2)").cast("string"))
    left = F.col("indent").cast("decimal(6,2)").cast("string")
    widths = F.array_join(F.transform("widths", lambda w: F.concat(w.cast("decimal(6,2)").cast("string"), F.lit("in"))), " ")
    columns = F.coalesce(widths, F.concat(F.lit("repeat("), F.coalesce("cols", F.lit(1)).cast("string"), F.lit(",1fr)")))
    cells = F.array_join(F.transform(F.arrays_zip("cells", "cell_keys"), lambda c: _span(c["cells"], c["cell_keys"])), "")
    weight = F.when(F.col("bold"), " bold").otherwise("")
    opened = F.concat(F.lit(' style="margin-top:'), gap, F.lit("pt;margin-left:"), left, F.lit("in"))
    right = F.coalesce(_span(F.col("right_text"), F.col("marks_key"), "right"), F.lit(""))
    return (
        F.when(F.col("type") == "rule", F.concat(F.lit("<hr"), opened, F.lit('">')))
        .when(F.col("cells").isNotNull(), F.concat(F.lit('<div class="'), F.when(F.col("type") == "header-row", "row").otherwise("grid"), weight, F.lit('"'), opened, F.lit(";grid-template-columns:"), columns, F.lit('">'), cells, F.lit("</div>")))
        .otherwise(F.concat(F.lit('<p class="line'), weight, F.when(F.col("align") == "center", " center").otherwise(""), F.lit('"'), opened, F.lit('">'), _span(F.col("text"), F.col("key")), F.when(F.col("right_text").isNotNull(), right).otherwise(""), F.lit("</p>")))
    )


def html_events(paged: DataFrame) -> DataFrame:
    """(paper_id, rung, page_no, block_no, opens, markup, closes): what each block of ``paginate`` adds to its paper's preview, in order: the page that it opens, itself, and the page that it closes. No more than a block's neighbours are looked at."""
    own = Window.partitionBy(*_PAPER).orderBy("block_no")
    opens = ~F.coalesce(F.lag("page_no").over(own) == F.col("page_no"), F.lit(False))
    closes = ~F.coalesce(F.lead("page_no").over(own) == F.col("page_no"), F.lit(False))
    rows = paged.withColumns({"_opens": opens, "_closes": closes})
    page = F.col("page_no").cast("string")
    return rows.select(
        "paper_id", "rung", "page_no", "block_no",
        F.when(F.col("_opens"), F.concat(F.lit('<section class="page" data-page="'), page, F.lit('">'))).otherwise("").alias("opens"),
        block_markup(F.col("_opens")).alias("markup"),
        F.when(F.col("_closes"), F.concat(F.lit('<footer>Page '), page, F.lit("</footer></section>"))).otherwise("").alias("closes"),
    )


def html_pages(paged: DataFrame) -> DataFrame:
    """(paper_id, rung, page_no, html): the preview of each page; a paper's pages one behind the other are its preview. A page is what a group holds."""
    each = F.array_sort(F.collect_list(F.struct("block_no", F.concat("opens", "markup", "closes").alias("t"))))
    return html_events(paged).groupBy("paper_id", "rung", "page_no").agg(F.array_join(F.transform(each, lambda x: x["t"]), "").alias("html"))


def file_name(subject: Column, class_name: Column) -> Column:
    stem = F.concat_ws(" - ", F.nullif(subject, F.lit("")), F.nullif(class_name, F.lit("")))
    return F.concat(F.trim(F.regexp_replace(F.when(stem == "", "paper").otherwise(stem), r"[\\/:*?\"<>|]", "")), F.lit(" (formatted).docx"))
