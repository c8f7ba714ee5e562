"""Suggestions and the audit of fixes (NRM-12..16, BLD-07..08, APP-02..03)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FUNCTION_WORDS, SUGGESTIONS
from ..functions.text import unpacked
from .cutting import apart, cut

#: Most papers that are broadcast to pick their lines; more of them meet the lines in a shuffle by paper.
BROADCAST_PAPERS = 100_000

#: Lines that hold what the rules look for.
SAMPLE = [
    (-1, 1, "The boy felt tried and the doctor advice  rest."),
    (-1, 2, "He should brush is teeth everyday."),
    (-1, 3, "Did he had to leave under the tree?"),
    (-1, 4, "Write true and false."),
    (-1, 5, "Everyday work is done everyday"),
    (-1, 6, "Who was ella ? Ella was a girl."),
    (-2, 1, "What is the name of raman ?"),
    (-2, 2, "Who was brave ? The brave king was kind."),
    (-2, 3, "Toto was a little"),
    (-2, 4, "two greats as friends met the the king"),
]


def sample_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE, "paper_id long, line_no long, flat string")


def audited(fixes: DataFrame) -> DataFrame:
    """Fixes whose wording changed: spaces and the length of blanks do not count."""

    def wording(c: str):
        return F.regexp_replace(F.regexp_replace(c, r"[ ]+", ""), "__+", "_")

    return fixes.where(wording("before") != wording("after"))


def rule_suggestions(lines: DataFrame) -> DataFrame:
    """(paper_id, line_no, id, before, after, confidence) for each rule that a line meets. The rules are a dozen constants, so each line is scanned in place instead of in a join."""
    rows = F.array(*[F.struct(F.lit(i).alias("id"), F.regexp_replace("flat", find, replace).alias("after"), F.lit(confidence).alias("confidence"), F.col("flat").rlike(find).alias("hit")) for i, find, replace, confidence in SUGGESTIONS])
    return unpacked(lines, ["paper_id", "line_no", "flat"], F.filter(rows, lambda r: r["hit"]), x="r").select("paper_id", "line_no", "r.id", F.col("flat").alias("before"), "r.after", "r.confidence")


def apply_accepted(lines: DataFrame, choices: DataFrame) -> DataFrame:
    """``lines`` with ``fixed``: sure rules and chosen ones applied in their order; a choice(id, accepted) of the user wins over the rule's confidence."""
    rows = lines.join(_taken(lines.sparkSession, choices, [(i, c == "high") for i, _, _, c in SUGGESTIONS]))
    return rows.withColumn("fixed", _replaced(F.col("flat"), SUGGESTIONS)).drop("taken")


def _taken(spark: SparkSession, choices: DataFrame, rules: list[tuple[str, bool]]) -> DataFrame:
    """One row with the ids of the rules taken. Of the user's choices only those of known rules count, one for each, so that what is broadcast is as short as the list of rules."""
    sure = spark.createDataFrame(rules, "id string, sure boolean")
    own = choices.join(F.broadcast(sure.select("id")), "id", "left_semi").groupBy("id").agg(F.max("accepted").alias("accepted"))
    return F.broadcast(sure.join(own, "id", "left").where(F.coalesce("accepted", "sure")).agg(F.collect_set("id").alias("taken")))


def _replaced(text: Column, rules) -> Column:
    """``text`` after the rules(id, pattern, replacement) that the column ``taken`` holds, in their order. One that is not taken is a pattern that matches nothing, so each step holds its text once."""
    never = F.lit("(?!)")
    return reduce(lambda t, r: F.regexp_replace(t, F.when(F.array_contains("taken", r[0]), F.lit(r[1])).otherwise(never), F.lit(r[2])), rules, text)


def doubled_words(lines: DataFrame) -> DataFrame:
    """(paper_id, line_no, word) of every word that follows itself."""
    words = F.filter(F.split(F.lower("flat"), r"[^a-z]+"), lambda w: w != "")
    rows = lines.select("paper_id", "line_no", words.alias("ws"))
    twice = F.filter(F.zip_with(F.slice("ws", 1, F.greatest(F.size("ws") - 1, F.lit(0))), F.slice("ws", 2, F.greatest(F.size("ws") - 1, F.lit(0))), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull())
    return rows.select("paper_id", "line_no", F.explode(twice).alias("word"))


def proper_nouns(lines: DataFrame) -> DataFrame:
    """(paper_id, word, name): words of three letters and more that a paper spells both with a capital and without, but for common ones."""
    words = F.regexp_extract_all("flat", F.lit(r"[A-Za-z]+"), 0)
    # A paper says most words more than once: each spelling is looked at once.
    rows = unpacked(lines, ["paper_id"], words, x="w").where(F.length("w") >= 3).select("paper_id", "w").distinct()
    named = F.col("w").rlike("^[A-Z][a-z]+$")
    out = rows.groupBy("paper_id", F.lower("w").alias("word")).agg(F.max(named).alias("named"), F.max(F.col("w") == F.lower("w")).alias("plain"))
    return out.where(F.col("named") & F.col("plain") & ~F.col("word").isin(FUNCTION_WORDS)).select("paper_id", "word", F.initcap("word").alias("name"))


def name_suggestions(lines: DataFrame) -> DataFrame:
    """(paper_id, line_no, word, name, confidence): a small-letter word where a name is asked for; low if the paper uses it elsewhere as a plain word, in another line or place.

    Few papers ask for a name, so what is asked is cut, and only the lines of those papers are taken apart into words.
    """
    cue = r"(?i)(?:who was|name of) ([a-z]+)"
    found = unpacked(lines, ["paper_id", "line_no"], F.array_distinct(F.regexp_extract_all("flat", F.lit(cue), 1)), x="word")
    found = cut(found.where((F.lower("word") == F.col("word")) & ~F.col("word").isin(FUNCTION_WORDS)))
    asking = found.select("paper_id").distinct()
    own = lines.join(F.broadcast(asking) if asking.count() <= BROADCAST_PAPERS else apart(asking), "paper_id", "left_semi")
    masked = F.regexp_replace("flat", cue, " ")
    other = unpacked(own, ["paper_id"], F.regexp_extract_all(masked, F.lit("[a-z]+"), 0), x="word").select("paper_id", "word").distinct().withColumn("plain", F.lit(True))
    rows = found.join(apart(other), ["paper_id", "word"], "left")
    return rows.select("paper_id", "line_no", "word", F.initcap("word").alias("name"), F.when(F.col("plain"), "low").otherwise("high").alias("confidence"))


#: The choice that takes words typed twice in a row out. Names are chosen as name-<word>.
DOUBLED, NAMED = "doubled-word", "name-"


def wording(lines: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """(paper_id, taken, names) of each paper of ``lines(paper_id, line_no, flat)``: the suggestions accepted, and the spelling of words that are names.

    Sure rules and names are accepted; a choice(id, accepted) of the user wins. A paper's names are those that it spells in two ways, and those
    accepted where a name is asked for. Doubled words go only if that is chosen.
    """
    spark = lines.sparkSession
    chosen = spark.createDataFrame([], "id string, accepted boolean") if choices is None else choices
    taken = _taken(spark, chosen, [*((i, c == "high") for i, _, _, c in SUGGESTIONS), (DOUBLED, False)])
    asked = name_suggestions(lines).withColumn("id", F.concat(F.lit(NAMED), F.col("word"))).join(chosen, "id", "left")
    asked = asked.where(F.coalesce("accepted", F.col("confidence") == "high")).select("paper_id", "word", "name")
    names = proper_nouns(lines).unionByName(asked).groupBy("paper_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "name"))).alias("names"))
    return lines.select("paper_id").distinct().join(apart(names), "paper_id", "left").join(taken)


def worded(text: Column) -> Column:
    """``text`` with the suggestions of the columns of ``wording`` applied in their order, then the paper's names. Not accepted rules are patterns that match nothing."""
    fixed = _replaced(text, [*SUGGESTIONS, (DOUBLED, r"(?i)\b([a-z]+)(?:\s+\1\b)+", "$1")])
    words = F.regexp_extract_all(fixed, F.lit(r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"), 0)
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at("names", w), w)), "")
