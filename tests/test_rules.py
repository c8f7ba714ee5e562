"""A table of rules: the index of literals loses no rule, and its size is checked."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import rules

LINES = "paper_id long, line_no long, flat string"


@pytest.mark.parametrize(
    ("pattern", "literal"),
    [("a|b", ""), ("(abc)+d", "abc"), ("(abc)*de", "de"), (r"(?i)\bRed\s+Bolts?\b", "bolt"), (r"\p{L}abc", ""), ("(", ""), (r"x\v", ""), ("(?iu)stern", ""), ("(?:one|two) three", " three"), ("ab{0}cd", "cd"), ("", "")],
)
def test_literals(pattern, literal):
    assert rules.required_literal(pattern) == literal


def test_no_rule_is_lost(spark):
    """Every rule against every line by the engine's own functions, literals or not."""
    rng = random.Random(1)
    words = "red blue small bolt ring gear anvil plate old hot".split()
    make = [lambda a, b: rf"(?i)\b{a}\s+{b}\b", lambda a, b: f"{a}|{b}", lambda a, b: f"({a} )?{b}", lambda a, b: rf"{a[:2]}\p{{L}}*", lambda a, b: rf"(?i)^{a}.*{b}$", lambda a, b: f"(?<x>{a}) {b}"]
    table = [(f"r{k}", rng.choice(make)(rng.choice(words), rng.choice(words)), rng.choice(["<$0>", "", None]), "low") for k in range(200)]
    table += [("n", None, "x", "low"), ("e", "", "x", "low"), ("r0", "bolt", "again", "high")]
    lines = [(k, 1, " ".join(rng.choice([w, w.upper(), w.title()]) for w in rng.choices(words, k=rng.randrange(6)))) for k in range(150)] + [(900, 1, None), (901, 1, ""), (902, 1, "bolt"), (902, 1, "bolt")]
    left, right = spark.createDataFrame(lines, LINES).withColumn("rule", F.lit("x")), spark.createDataFrame(table, rules.RULE)
    got = sorted(map(str, rules.suggestions(left, right).collect()))
    every = left.drop("rule").crossJoin(right).where("find <> '' and flat <> ''").where(F.rlike("flat", F.col("find")))
    want = every.select("paper_id", "line_no", "id", F.col("flat").alias("before"), F.regexp_replace("flat", F.col("find"), F.coalesce("replace", F.lit(""))).alias("after"), "confidence")
    assert got == sorted(map(str, want.collect())) and len(got) > 500
    assert rules.suggestions(left, right.where("false")).collect() == []
    assert rules.suggestions(left.where("false"), right).collect() == []


def test_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(rules, "MAX_RULES", 2)
    with pytest.raises(ValueError, match="3 rules"):
        rules.suggestions(spark.createDataFrame([(1, 1, "a")], LINES), spark.createDataFrame([(str(k), "abc", "", "low") for k in range(3)], rules.RULE))
