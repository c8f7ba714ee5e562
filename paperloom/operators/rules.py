"""Suggestion rules as a table: a user's own rules, found through an index of the literals that each has to meet (NRM-12, BLD-07)."""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rules, and most characters of their patterns, that are indexed and broadcast; a larger table is refused.
MAX_RULES, MAX_CHARACTERS = 100_000, 16 << 20
#: Shortest literal that is worth an entry of the index.
LITERAL = 3
#: What Java reads in another way: a class of vertical blanks, and letters beyond ASCII that equal others.
_OTHERWISE = re.compile(r"\\v|\(\?[a-z]*u")
RULE = "id string, find string, replace string, confidence string"


def required_literal(pattern: str) -> str:
    """The longest run of characters, in small letters, that every match of the pattern holds; empty if none is certain, or the pattern is beyond Python's dialect."""
    if _OTHERWISE.search(pattern):
        return ""
    try:
        tree = parser.parse(pattern)
    except (re.error, RecursionError, OverflowError):
        return ""
    return max(_runs(tree), key=len, default="")


def _runs(tree) -> list[str]:
    out, run = [], ""
    for op, value in tree:
        if op is sre.LITERAL and len(chr(value).lower()) == 1:
            run += chr(value).lower()
            continue
        out.append(run)
        run = ""
        if op is sre.SUBPATTERN:
            out += _runs(value[-1])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, getattr(sre, "POSSESSIVE_REPEAT", None)) and value[0] > 0:
            out += _runs(value[2])
        elif op is getattr(sre, "ATOMIC_GROUP", None):
            out += _runs(value)
    return [x for x in [*out, run] if x]


def _index(rules: list[tuple[int, str]]) -> tuple[ahocorasick.Automaton | None, list[int]]:
    """(automaton over the literals, rules without one)."""
    by: dict[str, list[int]] = {}
    for number, find in rules:
        literal = required_literal(find)
        by.setdefault(literal if len(literal) >= LITERAL else "", []).append(number)
    always = by.pop("", [])
    if not by:
        return None, always
    automaton = ahocorasick.Automaton()
    for literal, numbers in by.items():
        automaton.add_word(literal, numbers)
    automaton.make_automaton()
    return automaton, always


def suggestions(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """(paper_id, line_no, id, before, after, confidence) of each rule of ``rules(id, find, replace, confidence)`` that a line of ``lines(paper_id, line_no, flat)`` meets.

    The literals that rules cannot do without are in one automaton, broadcast below a checked size, that passes over each line once and names the rules which it could meet; only
    those patterns are tried, by the engine's own functions. Rules without a certain literal are tried on every line. Patterns are Java's. Null or empty lines
    and patterns meet nothing; repeated rules suggest each; without rules the result is empty.
    """
    spark = lines.sparkSession
    own = rules.where("find is not null and find <> ''").select("id", "find", "replace", "confidence")
    size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("find")), F.lit(0))).first()
    if size[0] > MAX_RULES or size[1] > MAX_CHARACTERS:
        raise ValueError(f"{size[0]} rules of {size[1]} characters; at most {MAX_RULES} of {MAX_CHARACTERS} are indexed at once")
    listed = [(k, *r) for k, r in enumerate(own.collect())]
    sent = spark.sparkContext.broadcast(_index([(k, find) for k, _, find, _, _ in listed]))
    fields = ["paper_id", "line_no", "flat"]
    lines = lines.where("flat <> ''").select(*fields)
    spec = ", ".join(f"{f} {lines.schema[f].dataType.simpleString()}" for f in fields) + ", rule int"

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, always = sent.value
        for batch in batches:
            at, rule = [], []
            for k, flat in enumerate(batch.column(2).to_pylist()):
                found = set(always)
                if automaton is not None:
                    for _, numbers in automaton.iter(flat.lower()):
                        found.update(numbers)
                at += [k] * len(found)
                rule += sorted(found)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.array(rule, pa.int32())], names=[*fields, "rule"])

    table = spark.createDataFrame(listed, f"rule int, {RULE}")
    tried = lines.mapInArrow(met, spec).join(F.broadcast(table), "rule").where(F.rlike("flat", F.col("find")))
    return tried.select("paper_id", "line_no", "id", F.col("flat").alias("before"), F.regexp_replace("flat", F.col("find"), F.coalesce("replace", F.lit(""))).alias("after"), "confidence")
