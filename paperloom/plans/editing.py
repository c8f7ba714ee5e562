"""Queries over what users bring along, edit logs, rules of their own and nested Word tables, with their SQL. ``events`` is read as the log: users are papers, kinds of events are operations, values and properties give keys and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import edits, rules
from ..sources.word_nodes import lines_of_nodes
from .corpus import lines, table
from .oracles import LINES

#: Lines of a paper that the log edits.
ANCHORS = ("q0.head", "q3.i0", "q7.i0", "h.exam", "q0.marks", "q3.i1", "q1.s0.stem", "q2.head")


def edit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log(paper_id, seq, op, key, text, other) of ``events``."""
    k, v = F.regexp_extract("props", r"([0-9]+)", 1).cast("int"), F.floor("value").cast("int")
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("paper_id"), F.col("event_id").alias("seq"), "event_type", k.alias("k"), v.alias("v"))
    gesture = F.element_at(F.array(*[F.lit(g) for g in (edits.COMMIT, edits.SPLIT, edits.PASTE, edits.JOIN)]), F.floor(F.col("v") / 4).cast("int") % 4 + 1)
    op = F.when(F.col("event_type") == "click", edits.INSERT).when(F.col("event_type") == "view", edits.SET).when(F.col("event_type") == "purchase", edits.REMOVE).when(F.col("event_type") == "error", edits.PRUNE).otherwise(gesture)
    anchor = F.element_at(F.array(*[F.lit(a) for a in ANCHORS]), F.col("k") % len(ANCHORS) + 1)
    place = F.col("v") % 4 - 1
    key = F.when(place < 0, anchor).otherwise(F.concat(anchor, F.lit(edits.SEPARATOR), place.cast("string")))
    said = F.when(F.col("v") % 5 == 0, "").otherwise(F.concat("event_type", F.lit("  "), F.col("k").cast("string")))
    text = F.when(op == edits.PASTE, F.concat(F.lit("first\n\n"), said, F.lit("\r\nlast"))).otherwise(said)
    other = F.when(op == edits.JOIN, F.concat(anchor, F.lit("~1"))).otherwise(F.concat(F.lit("tail "), F.col("k").cast("string")))
    return own.select("paper_id", "seq", op.alias("op"), key.alias("key"), text.alias("text"), other.alias("other"))


def edit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts in force and the inserted lines of every paper after its whole log."""
    texts, lines = edits.fold(edit_events(spark, sf_dir))
    texts = texts.select("paper_id", F.lit("edit").alias("kind"), "key", F.lit(0).cast("long").alias("ord"), "text")
    return texts.unionByName(lines.select("paper_id", F.lit("insert").alias("kind"), F.col("anchor_key").alias("key"), F.col("ord").cast("long").alias("ord"), "text"))


_TIDY = "trim(regexp_replace({}, '[ \t\xa0]+', ' ', 'g'))"
_ANCHOR = "[" + ", ".join(f"'{a}'" for a in ANCHORS) + f"][k % {len(ANCHORS)} + 1]"

#: DuckDB: every anchor is walked from operation to operation, all prunes of its paper included.
EDIT_FOLD = rf"""
with recursive seen as (select user_id as p, event_id as seq, event_type as e, floor(value)::int as v, regexp_extract(props, '([0-9]+)', 1)::int as k from events),
log as (
  select p, seq, k, {_ANCHOR} as anchor, v % 4 - 1 as place, case when v % 5 = 0 then '' else e || '  ' || k end as text,
         case e when 'click' then 'insert' when 'view' then 'set' when 'purchase' then 'remove' when 'error' then 'prune' else ['commit', 'split', 'paste', 'join'][(v // 4) % 4 + 1] end as op from seen),
tidied as (select *, {_TIDY.format("text")} as tidy from log),
pasted as (select p, seq, anchor, place, list_filter(['first', tidy, 'last'], lambda x: x <> '') as xs from tidied where op = 'paste'),
ops(p, seq, sub, op, anchor, place, text) as (
  select p, seq, 0, op, anchor, place, text from tidied where op in ('insert', 'set', 'remove', 'prune')
  union all select p, seq, 0, case when tidy = '' and place >= 0 then 'remove' else 'set' end, anchor, place, tidy from tidied where op = 'commit'
  union all select p, seq, 1, 'prune', anchor, -1, '' from tidied where op = 'commit'
  union all select p, seq, 0, 'set', anchor, place, tidy from tidied where op = 'split'
  union all select p, seq, 1, 'insert', anchor, place, 'tail ' || k from tidied where op = 'split'
  union all select p, seq, 2, 'prune', anchor, place + 1, '' from tidied where op = 'split'
  union all select p, seq, 0, 'remove', anchor, 1, '' from tidied where op = 'join'
  union all select p, seq, 1, 'set', anchor, place, tidy from tidied where op = 'join'
  union all select p, seq, 2, 'prune', anchor, place, '' from tidied where op = 'join'
  union all select p, seq, n, case when n = 0 then 'set' else 'insert' end, anchor, case when n = 0 then place else place + n - 1 end, xs[n + 1] from (select *, unnest(range(len(xs)))::int as n from pasted)
  union all select p, seq, len(xs)::int, 'prune', anchor, place + len(xs)::int - 1, '' from pasted),
anchors as (select distinct p, anchor from ops where op = 'insert' or (op <> 'prune' and place >= 0)),
steps as (
  select a.p, a.anchor, row_number() over (partition by a.p, a.anchor order by seq, sub) as n, op, case when op = 'prune' and o.anchor <> a.anchor then -1 else place end as place, text
  from anchors a join ops o on o.p = a.p and (op = 'prune' or (o.anchor = a.anchor and (op = 'insert' or place >= 0)))),
walk(p, anchor, n, xs) as (
  select p, anchor, 0::bigint, []::varchar[] from anchors
  union all
  select w.p, w.anchor, s.n, case
    when op = 'insert' then xs[:place + 1] || [text] || xs[place + 2:]
    when op = 'prune' then list_transform(list_filter(list_zip(xs, range(len(xs))), lambda x: x[1] <> '' or x[2] = place), lambda x: x[1])
    when len(xs) = 0 then xs
    when op = 'remove' then xs[:place] || xs[place + 2:]
    else xs[:place] || list_transform(range(greatest(place - len(xs), 0)), lambda x: '') || [text] || xs[place + 2:] end
  from walk w join steps s on s.p = w.p and s.anchor = w.anchor and s.n = w.n + 1),
ended as (select p, anchor, arg_max(xs, n) as xs from walk group by p, anchor)
select p as paper_id, 'edit' as kind, anchor as key, 0::bigint as ord, arg_max(case op when 'set' then text else '' end, (seq, sub)) as text from ops where place < 0 and op in ('set', 'remove') group by p, anchor
union all
select p, 'insert', anchor, unnest(range(len(xs))), unnest(xs) from ended
"""


def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every name of a part: it is written in capitals."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    find = F.concat(F.lit(r"(?i)\b"), F.replace("p_name", F.lit(" "), F.lit(r"\s+")), F.lit(r"\b"))
    return names.select(F.concat(F.lit("name-"), "p_name").alias("id"), find.alias("find"), F.upper("p_name").alias("replace"), F.when(F.length("p_name") % 2 == 0, "high").otherwise("low").alias("confidence"))


def rule_table_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions of a table of rules for every line of the papers."""
    return rules.suggestions(lines(spark, sf_dir).select("paper_id", "line_no", "flat"), name_rules(spark, sf_dir))


_FIND = r"'(?i)\b' || replace(p_name, ' ', '\s+') || '\b'"
RULE_TABLE = f"""{LINES}, names AS (SELECT DISTINCT p_name FROM part),
near AS MATERIALIZED (SELECT paper_id, line_no, flat, p_name FROM lines JOIN names ON contains(lower(flat), split_part(p_name, ' ', 1)))
SELECT paper_id, line_no, 'name-' || p_name AS id, flat AS before, regexp_replace(flat, {_FIND}, upper(p_name), 'g') AS after, CASE WHEN length(p_name) % 2 = 0 THEN 'high' ELSE 'low' END AS confidence
FROM near WHERE regexp_matches(flat, {_FIND})"""

#: Blocks of a file, by turns: a paragraph; a table whose second cell holds a table; a content control with two lines. Each node: place within the block, parent's place (-1: the body), depth, tag, and the column or text that it says.
_TURNS = (
    ((0, -1, 1, "p", "p_name"),),
    ((0, -1, 1, "tbl", None), (1, 0, 2, "tr", None), (2, 1, 3, "tc", None), (3, 2, 4, "p", "p_brand"), (4, 1, 3, "tc", None), (5, 4, 4, "p", "' '"), (6, 4, 4, "tbl", None), (7, 6, 5, "tr", None), (8, 7, 6, "tc", None), (9, 8, 7, "p", "p_type"), (10, 7, 6, "tc", None), (11, 4, 4, "p", "p_name"), (12, 0, 2, "tr", None), (13, 12, 3, "tc", None), (14, 13, 4, "p", "p_type")),
    ((0, -1, 1, "sdt", None), (1, 0, 2, "sdtContent", None), (2, 1, 3, "p", "concat(p_name, '\\n', p_brand)"), (3, 1, 3, "tbl", None), (4, 3, 4, "tr", None), (5, 4, 5, "tc", None), (6, 5, 6, "p", "p_name")),
)


def word_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files of 30 parts each, given as tables of nodes."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("file-"), F.floor(F.col("p_partkey") / 30).cast("string")).alias("path"), (F.col("p_partkey") % 30).cast("int").alias("k"), "p_name", "p_brand", "p_type")
    null = F.lit(None).cast("string")

    def turn(rows) -> Column:
        base = (F.col("k") + 1) * 100
        return F.array(*[F.struct((base + n).alias("node"), (F.lit(0) if up < 0 else base + up).alias("parent"), F.lit(d).alias("depth"), (F.col("k") if up < 0 else F.lit(n)).alias("ord"), F.lit(tag).alias("tag"), (F.expr(said) if said else null).alias("text")) for n, up, d, tag, said in rows])

    made = F.when(F.col("k") % 3 == 0, turn(_TURNS[0])).when(F.col("k") % 3 == 1, turn(_TURNS[1])).otherwise(turn(_TURNS[2]))
    bodies = parts.select("path").distinct().select("path", F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("ord"), F.lit("body").alias("tag"), null.alias("text"))
    nodes = parts.select("path", F.explode(made).alias("n")).select("path", "n.*").unionByName(bodies)
    return lines_of_nodes(nodes.withColumn("auto_fmt", F.lit(""))).drop("auto_fmt")


#: DuckDB: what each turn's lines are, stated outright.
WORD_NODES = """WITH said AS (
  SELECT p_partkey, p_partkey // 30 AS f, unnest(xs) AS text, unnest(range(len(xs))) AS i FROM (SELECT *, CASE p_partkey % 30 % 3 WHEN 0 THEN [p_name] WHEN 1 THEN [p_brand || chr(9) || p_type || chr(9) || ' ' || p_name, p_type] ELSE [p_name, p_brand, p_name] END AS xs FROM part))
SELECT 'file-' || f AS path, row_number() OVER (PARTITION BY f ORDER BY p_partkey, i) AS line_no, text FROM said"""

QUERIES = {"edit_fold": edit_fold, "rule_table_suggest": rule_table_suggest, "word_nodes": word_nodes}
ORACLES = {"edit_fold": EDIT_FOLD, "rule_table_suggest": RULE_TABLE, "word_nodes": WORD_NODES}
