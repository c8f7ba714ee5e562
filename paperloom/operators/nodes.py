"""From body lines to nodes: options, items, leads, stacked options and the kind of a question (ITM, CLS)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import MAX_RUN, SHORT_CHARS, SHORT_IN, SHORT_LETTERS
from ..functions import patterns as P
from ..functions.labels import NO_OPTIONS, after_label, column_split, inline_items, is_ambiguous, is_roman, label_format, label_of, label_position, looks_like_option, parse_options, spaces, with_tabbed_items
from ..functions.text import collapse_spaces, letter_count, unpacked, width_in
from .cutting import apart

NODE = "array<struct<kind:string,label:string,text:string,box:boolean,auto_fmt:string,options:array<struct<label:string,text:string>>>>"


def with_line_nodes(rows: DataFrame) -> DataFrame:
    """``rows(text, auto_fmt, heading, ...)`` with ``nodes``, the nodes of each line: options, else in-line items, else items in columns (not in a matching question), else one item."""
    text, fmt = F.col("text"), F.col("auto_fmt")
    rows = rows.withColumns({"_options": parse_options(text), "_box": text.rlike(P.TRUTH_BOX)})
    rows = rows.withColumn("_plain", F.when(F.col("_box"), F.trim(spaces(F.regexp_replace(text, P.TRUTH_BOX, "")))).otherwise(text))
    rows = with_tabbed_items(rows.withColumn("_inline", inline_items(spaces(F.col("_plain")))), F.col("_plain"), fmt, "_tabbed")
    rows = rows.withColumn("_tabbed", F.when(~F.col("heading").rlike(P.MATCH), F.col("_tabbed")))
    none = F.lit(None).cast(NO_OPTIONS)

    def node(label: Column, body: Column, code: Column) -> Column:
        return F.struct(F.lit("item").alias("kind"), label.alias("label"), body.alias("text"), F.col("_box").alias("box"), code.alias("auto_fmt"), none.alias("options"))

    row = F.array(F.struct(F.lit("options").alias("kind"), F.lit("").alias("label"), F.lit("").alias("text"), F.lit(False).alias("box"), fmt.alias("auto_fmt"), F.col("_options").alias("options")))
    found = (
        F.when(F.col("_options").isNotNull(), row)
        .when(F.col("_inline").isNotNull(), F.transform("_inline", lambda x: node(x["label"], x["text"], fmt)))
        .when(F.col("_tabbed").isNotNull(), F.transform("_tabbed", lambda x, i: node(x["label"], x["text"], F.when(i == 0, fmt).otherwise(""))))
        .otherwise(F.array(node(label_of(F.col("_plain")), F.trim(after_label(F.col("_plain"))), fmt)))
    )
    return rows.withColumn("nodes", found.cast(NODE)).drop("_options", "_box", "_plain", "_inline", "_tabbed")


def raw_nodes(joined: DataFrame) -> DataFrame:
    """(paper_id, q_idx, node_no, kind, label, text, box, auto_fmt, options, unnumbered, heading) of ``join_wrapped`` lines. ``unnumbered``: a plain line of a question that is otherwise numbered automatically."""
    own = Window.partitionBy("paper_id", "q_idx")
    rows = joined.withColumn("numbering", F.max(F.col("auto_fmt") != "").over(own))
    rows = unpacked(with_line_nodes(rows), ["paper_id", "q_idx", "group_no", "heading", "numbering"], "nodes", x="n")
    rows = rows.select("paper_id", "q_idx", F.row_number().over(own.orderBy("group_no", "k")).alias("node_no"), "heading", "numbering", "n.*")
    plain = F.col("numbering") & (F.col("kind") == "item") & (F.col("auto_fmt") == "") & (F.col("label") == "")
    return rows.withColumn("unnumbered", plain).drop("numbering")


def fold_unnumbered(nodes: DataFrame) -> DataFrame:
    """An unnumbered line goes on with the item above it, else it is a lead of its own. Groups are opened by every other node; lines before the first, and behind options, are leads."""
    own = Window.partitionBy("paper_id", "q_idx").orderBy("node_no")
    rows = nodes.withColumn("island", F.sum((~F.col("unnumbered")).cast("int")).over(own))
    head = Window.partitionBy("paper_id", "q_idx", "island").orderBy("node_no")
    goes_on = F.col("unnumbered") & (F.col("island") > 0) & (F.first("kind").over(head) == "item")
    rows = rows.withColumn("lead", F.col("unnumbered") & ~goes_on)
    rows = rows.withColumn("part", F.when(F.col("lead"), F.col("node_no")).otherwise(F.lit(0)))
    each = F.array_sort(F.collect_list(F.struct("node_no", "label", "text", "box", "auto_fmt", "options", "kind")))
    out = rows.groupBy("paper_id", "q_idx", "island", "part").agg(each.alias("ns"), F.first("heading").alias("heading"), F.max("lead").alias("lead"))
    first = F.element_at("ns", 1)
    text = F.when(F.size("ns") > 1, collapse_spaces(F.array_join(F.transform("ns", lambda n: n["text"]), " "))).otherwise(first["text"])
    return out.select("paper_id", "q_idx", first["node_no"].alias("node_no"), first["kind"].alias("kind"), first["label"].alias("label"), text.alias("text"), F.exists("ns", lambda n: n["box"]).alias("box"), first["auto_fmt"].alias("auto_fmt"), first["options"].alias("options"), "lead", "heading")


def option_features(nodes: DataFrame) -> DataFrame:
    """What the run scan asks of each node, worked out as columns: boxed, looks (with and without a bare limit), format and position under its own and the next label."""
    ahead = Window.partitionBy("paper_id", "q_idx").orderBy("node_no")
    is_item = F.col("kind") == "item"
    after = F.when(F.lead("kind").over(ahead) == "item", F.lead("label").over(ahead)).otherwise("")
    rows = nodes.withColumn("after", F.coalesce(after, F.lit("")))
    # Forms are columns of their own, as positions and starts read them many times.
    rows = rows.withColumns({"_form": label_format(F.col("label")), "_next": label_format(F.col("after"))})
    rows = rows.withColumn("_start", F.when(is_roman(F.col("_next")) & is_ambiguous(F.col("label")), F.col("_next")).otherwise(F.col("_form")))
    form, start = F.col("_form"), F.col("_start")
    return rows.select(
        *nodes.columns,
        (is_item & F.col("text").rlike(P.TRAILING_BOX)).alias("boxed"),
        (is_item & ~F.col("box") & looks_like_option(F.col("text"), F.lit(True))).alias("looks_bare"),
        (is_item & ~F.col("box") & looks_like_option(F.col("text"), F.lit(False))).alias("looks"),
        F.coalesce(form, F.lit("")).alias("form"),
        label_position(F.col("label"), form).alias("position"),
        F.coalesce(start, F.lit("")).alias("start_form"),
        label_position(F.col("label"), start).alias("start_position"),
    )


def with_runs(nodes: DataFrame) -> DataFrame:
    """``nodes`` with run, the length of the option run that would start there (0: none), from the node and the next MAX_RUN - 1.

    A run has two to eight members that all look like options and are all boxed or all not; lettered ones count on from the
    first, others have no label. A run that is not boxed needs a heading that asks for a choice, and the sequence's first letter. Numbers are questions, never options.
    """
    rows = option_features(nodes)
    reach = Window.partitionBy("paper_id", "q_idx").orderBy("node_no").rowsBetween(1, MAX_RUN - 1)
    rows = rows.withColumns({"next": F.collect_list(F.struct("boxed", "looks", "looks_bare", "form", "position")).over(reach), "lettered": ~F.col("start_form").isin("", "d")})

    def goes_on(x: Column, k: Column) -> Column:
        sequence = F.when(F.col("lettered"), x["looks"] & (x["form"] == F.col("start_form")) & F.coalesce(x["position"] == k + 1, F.lit(False))).otherwise(x["looks_bare"] & (x["form"] == ""))
        return sequence & (x["boxed"] == F.col("boxed"))

    rows = rows.withColumn("others", F.array_position(F.transform("next", goes_on), F.lit(False)).cast("int"))
    size = F.when(F.col("others") == 0, F.size("next") + 1).otherwise(F.col("others"))
    asked = ~F.col("heading").rlike(P.NOT_OPTIONS) & ~F.col("heading").rlike(P.MATCH)
    evidence = F.col("boxed") | (F.col("heading").rlike(P.CHOICE) & F.col("lettered") & F.coalesce(F.col("start_position") == 0, F.lit(False)))
    looks = F.when(F.col("lettered"), F.col("looks")).otherwise(F.col("looks_bare"))
    # What is at hand stands before the patterns of headings.
    starts = (F.col("start_form") != "d") & looks & (size >= 2) & evidence & asked
    return rows.select(*nodes.columns, F.when(F.coalesce(starts, F.lit(False)), size).otherwise(0).alias("run"))


def chosen_runs(runs: DataFrame) -> DataFrame:
    """(paper_id, q_idx, at, run) of the runs that a scan from the first node meets: one that begins within an earlier one is skipped. Only nodes where a run could start are folded, one question's at a time; the state is where the scan stands."""
    each = F.array_sort(F.collect_list(F.struct("at", "run")))
    zero = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<at: int, run: int>>").alias("met"))
    scan = F.aggregate("each", zero, lambda s, x: F.when(x["at"] < s["free"], s).otherwise(F.struct((x["at"] + x["run"]).alias("free"), F.concat(s["met"], F.array(x)).alias("met"))))
    return runs.where("run > 0").groupBy("paper_id", "q_idx").agg(each.alias("each")).select("paper_id", "q_idx", F.explode(scan["met"]).alias("x")).select("paper_id", "q_idx", "x.at", "x.run")


def stacked_options(nodes: DataFrame) -> DataFrame:
    """Runs of one option a line become one options node. What starts a run is told by a bounded window; the scan that skips from run to run is a fold over its candidates."""
    ordered = Window.partitionBy("paper_id", "q_idx").orderBy("node_no")
    rows = with_runs(nodes).withColumn("at", F.row_number().over(ordered))
    met = chosen_runs(rows.select("paper_id", "q_idx", "at", "run"))
    rows = rows.drop("run").join(apart(met), ["paper_id", "q_idx", "at"], "left").withColumn("run", F.coalesce("run", F.lit(0)))
    # A member belongs to the last run that started, if that reaches it.
    start = F.last(F.when(F.col("run") > 0, F.struct("at", "run")), ignorenulls=True).over(ordered)
    rows = rows.withColumn("open", start)
    inside = F.coalesce(F.col("at") < F.col("open.at") + F.col("open.run"), F.lit(False))
    rows = rows.withColumn("slot", F.when(inside, F.col("open.at")).otherwise(F.col("at"))).withColumn("inside", inside)
    each = F.array_sort(F.collect_list(F.struct("node_no", "label", "text", "box", "auto_fmt", "options", "kind", "lead")))
    out = rows.groupBy("paper_id", "q_idx", "slot").agg(each.alias("ns"), F.max("inside").alias("inside"), F.first("heading").alias("heading"))
    first = F.element_at("ns", 1)
    options = F.transform("ns", lambda n: F.struct(n["label"].alias("label"), F.trim(F.regexp_replace(n["text"], P.TRAILING_BOX, "")).alias("text")))
    return out.select(
        "paper_id", "q_idx", first["node_no"].alias("node_no"), F.when(F.col("inside"), "options").otherwise(first["kind"]).alias("kind"),
        F.when(F.col("inside"), "").otherwise(first["label"]).alias("label"), F.when(F.col("inside"), "").otherwise(first["text"]).alias("text"),
        (first["box"] & ~F.col("inside")).alias("box"), first["auto_fmt"].alias("auto_fmt"), F.when(F.col("inside"), options).otherwise(first["options"]).alias("options"),
        (first["lead"] & ~F.col("inside")).alias("lead"), "heading",
    )


def is_short(text: Column, font_pt: float = 12.0) -> Column:
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, "__+", " "), "[.?।]+$", ""))
    return F.when(F.length(bare) > SHORT_CHARS, False).otherwise((letter_count(bare) <= SHORT_LETTERS) & (width_in(bare, font_pt) <= SHORT_IN))


def question_kinds(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """``questions`` with kind, before fallbacks: any options: mcq; no nodes: plain; a matching heading: match; under two nodes: list; every node in two columns: match; else list."""
    split = F.col("kind").eqNullSafe("item") & column_split(F.col("text"), True).isNotNull()
    facts = nodes.groupBy("paper_id", "q_idx").agg(F.max(F.col("kind") == "options").alias("any_options"), F.count(F.lit(1)).alias("n"), F.min(split).alias("all_split"))
    rows = questions.join(apart(facts), ["paper_id", "q_idx"], "left")
    kind = (
        F.when(F.col("any_options"), "mcq")
        .when(F.coalesce("n", F.lit(0)) == 0, "plain")
        .when(F.col("heading").rlike(P.MATCH), "match")
        .when(F.col("n") < 2, "list")
        .when(F.col("all_split"), "match")
        .otherwise("list")
    )
    return rows.select(*questions.columns, kind.alias("kind"), F.coalesce("n", F.lit(0)).cast("long").alias("n_nodes"))


