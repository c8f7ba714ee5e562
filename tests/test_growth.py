"""What grows with the corpus is spread over tasks, is never collected for a join, and is worked out once."""

from pyspark.sql import functions as F

from paperloom.functions import labels, normalize, text
from paperloom.operators import build, language, nodes, numbering, segment
from paperloom.plans import corpus, queries

from .conftest import SF001, SF01


def plan(df, capsys) -> str:
    df.explain()
    return capsys.readouterr().out


def test_lines_are_spread_by_paper(spark):
    rows = corpus.paper_lines(spark, SF01).withColumn("task", F.spark_partition_id())
    by_paper = rows.groupBy("paper_id").agg(F.countDistinct("task").alias("n"), F.first("task").alias("task"))
    assert by_paper.where("n > 1").count() == 0 and by_paper.select("task").distinct().count() > 1


def test_lines_need_no_exchange_of_their_own(spark, capsys):
    assert plan(corpus.segmented(spark, SF01), capsys).count("Exchange hashpartitioning") == 1


def test_joins_of_papers_are_not_broadcast(spark, capsys):
    questions, body = segment.fold_headings(corpus.segmented(spark, SF001))
    rows = nodes.stacked_options(nodes.fold_unnumbered(nodes.raw_nodes(segment.join_wrapped(body))))
    shown = plan(nodes.question_kinds(questions, rows), capsys)
    assert "SortMergeJoin" in shown and "BroadcastHashJoin" not in shown


def test_arrays_are_made_once(spark, capsys):
    assert "size(" not in plan(queries.fix_audit(spark, SF001), capsys)
    rows = spark.createDataFrame([(1, ["a", None]), (2, []), (3, None)], "id long, xs array<string>")
    assert sorted(map(tuple, text.unpacked(rows, ["id"], "xs").collect())) == [(1, 0, "a"), (1, 1, None)]


def test_marks_and_articles_of_odd_texts(spark):
    """The searches that stand before the patterns leave no text out."""
    cases = [(" \t a  b\tc \r", "a\x02b\x01c"), ("a \t b", "a\x01b"), ("", ""), (None, None), ("a  b", "a\x02b"), ("\t \t", "")]
    got = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(cases)], "k int, raw string").select("k", normalize.mark_spaces(F.col("raw")).alias("m")).collect()
    assert {r["k"]: r["m"] for r in got} == {k: want for k, (_, want) in enumerate(cases)}
    cases = [("A apple and a orange", "An apple and an orange"), ("An boy an unit", "A boy a unit"), ("a hour", "an hour"), ("banana apple", "banana apple"), (None, None)]
    got = spark.createDataFrame([(k, raw) for k, (raw, _) in enumerate(cases)], "k int, raw string").select("k", normalize.articles(F.col("raw")).alias("m")).collect()
    assert {r["k"]: r["m"] for r in got} == {k: want for k, (_, want) in enumerate(cases)}


def test_headers_are_parsed_once_for_their_edits(spark, capsys):
    """What lies below the edits is the cut headers, not the corpus once for each branch that reads them."""
    shown = plan(queries.header_edits(spark, SF001), capsys)
    assert "FileScan" not in shown and shown.count("Scan ExistingRDD") >= 2


def test_words_of_papers_that_ask_for_no_name_are_not_unpacked(spark, monkeypatch):
    """Lines meet the asking papers before they become words, broadcast or shuffled, with the same rows."""
    lines = spark.createDataFrame([(1, 1, "Who was ella ?"), (1, 2, "the name of ravi and ravi"), (2, 1, "no one is asked for here"), (3, 1, "name of the king"), (None, 1, "who was sita")], "paper_id long, line_no long, flat string")
    want = {(1, "ella", "high"), (1, "ravi", "low"), (None, "sita", "high")}
    for most in (language.BROADCAST_PAPERS, 0):
        monkeypatch.setattr(language, "BROADCAST_PAPERS", most)
        rows = language.name_suggestions(lines)
        assert {(r["paper_id"], r["word"], r["confidence"]) for r in rows.collect()} == want
        assert "LeftSemi" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_only_changed_texts_are_cleaned_for_the_log(spark, capsys):
    """Each rule's entry stands behind a comparison of its texts; a change of nothing but marks is no fix."""
    rows = spark.createDataFrame([(1, 1, "a apple [ ] and b ( )"), (1, 2, "nothing here"), (1, 3, "Tab 3"), (1, 4, "x  , y"), (1, 5, "a_____ b")], "paper_id long, line_no long, raw string")
    fixes = normalize.prepare_lines(rows)[1]
    assert plan(fixes, capsys).count("CASE WHEN NOT (t") >= len(normalize.RULES)
    got = {(r["line_no"], r["rule"], r["before"], r["after"]) for r in fixes.collect()}
    assert got == {(1, "article", "a apple [ ] and b ( )", "an apple [ ] and b ( )"), (1, "tick box", "an apple [ ] and b ( )", "an apple ( ) and b ( )"), (3, "document furniture", "Tab 3", ""), (5, "blank length", "a_____ b", "a__________ b")}


def test_labels_of_a_question_are_worked_out_once(spark, capsys):
    """Items are put in order without a join with themselves, and labelled without an array of the whole question in each of its rows."""
    columns = "paper_id long, q_idx int, ord int, label string, lead boolean, text string"
    rows = spark.createDataFrame([(1, 1, 0, "", True, "note"), (1, 1, 1, "2", False, "b"), (1, 1, 2, "1", False, "a"), (1, 2, 0, "a", False, "x"), (1, 2, 1, "a", False, "y"), (1, 3, 0, "ii", False, "p"), (1, 3, 1, "i", False, "q"), (1, 4, 0, "3", False, "r"), (1, 4, 1, "1", False, "s"), (1, 5, 0, "", True, "only")], columns)
    out = numbering.label_order(rows)
    assert "Join" not in plan(out, capsys)
    assert sorted((r["q_idx"], r["ord"], r["text"]) for r in out.collect()) == [(1, 0, "note"), (1, 1, "a"), (1, 2, "b"), (2, 0, "x"), (2, 1, "y"), (3, 0, "q"), (3, 1, "p"), (4, 0, "r"), (4, 1, "s"), (5, 0, "only")]
    rows = rows.withColumns({"script": F.lit("en"), "auto_fmt": F.lit(None).cast("string")})
    made = build._relabelled(rows.withColumn("label", F.when(F.col("text").isin("a", "y"), "").otherwise(F.col("label"))), "ord", ~F.col("lead"), F.lit("d"))
    assert "Window" not in plan(made, capsys) and made.columns == rows.columns
    assert sorted((r["q_idx"], r["ord"], r["label"]) for r in made.collect()) == [(1, 0, ""), (1, 1, "2"), (1, 2, "3"), (2, 0, "a"), (2, 1, "b"), (3, 0, "ii"), (3, 1, "i"), (4, 0, "3"), (4, 1, "1"), (5, 0, "")]


def test_widths_are_asked_for_above_lines_that_could_go_on(spark, capsys):
    wide = "words that run on and on and on until the edge of the column is met by them"
    body = spark.createDataFrame([(1, 1, 1, wide, "", "h"), (1, 1, 2, "and below", "", "h"), (1, 1, 3, "1. item", "", "h"), (1, 2, 1, "short", "", "h"), (1, 2, 2, "line", "", "h")], "paper_id long, q_idx int, line_no int, text string, auto_fmt string, heading string")
    out = segment.wrapped_groups(body)
    assert "CASE WHEN cand" in plan(out, capsys)
    assert [(r["line_no"], r["joined"]) for r in out.orderBy("q_idx", "line_no").collect()] == [(1, False), (2, True), (3, False), (1, False), (2, False)]


def test_lines_without_boxes_or_labels_are_not_taken_apart(spark, capsys):
    """A plain search stands before the parts of options and items, and leaves no line out."""
    cases = ["A. x ( ) B. y ( )", "A. x [ ] B. y [ ]", "( ) ( )", "a ( ) b", "plain", "", None, "1. pen 2. boat 3. boy", "1) a 2) b 3)", "a . b", "( a ) x ( b ) y ( c ) z"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k int, t string").select("k", labels.parse_options(F.col("t")).alias("o"), labels.inline_items(F.col("t")).alias("i"))
    assert "CASE WHEN (Contains" in plan(rows, capsys)
    got = {r["k"]: (r["o"] and [tuple(x) for x in r["o"]], r["i"] and [tuple(x) for x in r["i"]]) for r in rows.collect()}
    assert got[0][0] == [("A", "x"), ("B", "y")] and got[1][0] == [("A", "x"), ("B", "y")] and all(got[k][0] is None for k in range(2, 8))
    assert got[7][1] == [("1", "pen"), ("2", "boat"), ("3", "boy")] and got[10][1] == [("a", "x"), ("b", "y"), ("c", "z")] and all(got[k][1] is None for k in (2, 3, 4, 5, 6, 8, 9))


def test_lines_of_match_pairs_are_made_once(spark, monkeypatch):
    """Nodes and wording read the same cut lines; the corpus was prepared anew for each before."""
    made = []
    prepare = normalize.prepare_lines
    monkeypatch.setattr(normalize, "prepare_lines", lambda rows: made.append(1) or prepare(rows))
    out = queries.match_pairs(spark, SF001)
    assert len(made) == 1 and out.count() > 0


def test_plain_searches_stand_before_the_rules(spark, capsys):
    """Patterns are tried on texts that hold what they cannot do without, and no other text changes."""
    texts = ["plain words", "a , b ;c", "1999 - 00", "x____y", "(  ) [ ]", "b]", "\x03dtyped", "a\x01b\x02c", "a   b\t", "  edge  ", "wait ।now", "", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    t = F.col("t")
    out = rows.select("k", normalize.spacing(t).alias("s"), normalize.year_range(t).alias("y"), normalize.blanks(t).alias("b"), normalize.boxes(t).alias("x"), normalize.auto_format(t).alias("f"), normalize.without_auto(t).alias("w"), normalize.clean(t).alias("c"))
    assert plan(out, capsys).count("CASE WHEN") >= 8
    got = {r["k"]: r for r in out.collect()}
    assert [got[k]["s"] for k in (0, 1, 10)] == ["plain words", "a, b; c", "wait।now"] and got[2]["y"] == "1999-00" and got[3]["b"] == "x__________y"
    assert got[4]["x"] == "( ) [ ]" and got[5]["x"] == "b]" and (got[6]["f"], got[6]["w"], got[6]["c"]) == ("d", "typed", "typed")
    assert [got[k]["c"] for k in (7, 8, 9)] == ["a b c", "a b", "edge"] and got[0]["f"] == "" and got[11]["f"] == ""
    assert all(got[12][c] is None for c in "sybxfwc")
    heads = spark.createDataFrame([("Que 3 x",), ("q.4",), ("प्रश्न 5",), ("no 6",), ("quite",), ("",), (None,)], "t string").select(segment.heading_number(t).alias("n"))
    assert "Contains" in plan(heads, capsys) and [r["n"] for r in heads.collect()] == ["3", "4", "5", "", "", "", None]
