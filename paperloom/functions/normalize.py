"""Line normalisation as columns: marks for tabs and runs of spaces, furniture, spacing, articles, blanks, boxes and years (NRM)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import A_BEFORE_VOWEL, AN_BEFORE_CONSONANT, BLANK_LENGTH, HINDI_QUESTION_WORDS, QUESTION_WORDS
from . import patterns as P
from .text import collapse_spaces, let, unpacked


def _where(text: Column, literal: str, changed: Column) -> Column:
    """``changed`` of texts that hold the literal that the change cannot do without; a plain search is far cheaper than a pattern."""
    return F.when(text.contains(literal), changed).otherwise(text)


def _held(text: Column, literals: tuple[str, ...], change) -> Column:
    """``change`` of a text that holds one of the literals, one of which the change cannot do without. The text is worked out once."""
    return let(text, lambda t: F.when(reduce(lambda a, b: a | b, [t.contains(x) for x in literals]), change(t)).otherwise(t))


def mark_spaces(raw: Column) -> Column:
    """Trimmed; tabs with the spaces around them become one mark, runs of spaces another."""
    bare = F.trim(F.translate(raw, "\u00a0\r", "  "), F.lit(" \t"))
    return let(let(bare, lambda b: _where(b, "\t", F.regexp_replace(b, r"[ ]*\t[ \t]*", P.TAB))), lambda b: _where(b, "  ", F.regexp_replace(b, r"[ ][ ]+", P.GAP)))


def auto_format(text: Column) -> Column:
    """The format letter of an automatic number: U+0003 and the letter in front of a line."""
    return F.when(text.contains(P.AUTO), F.regexp_extract(text, r"^\x{03}([daArRb])", 1)).otherwise(F.when(text.isNotNull(), ""))


def without_auto(text: Column) -> Column:
    return _held(text, (P.AUTO,), lambda t: F.regexp_replace(t, r"^\x{03}[daArRb]", ""))


def clean(text: Column) -> Column:
    """Without automatic number and marks, spaces collapsed."""
    bare = _held(text, (P.AUTO,), lambda t: F.regexp_replace(t, r"\x{03}[daArRb]?", ""))
    plain = _held(bare, (P.TAB, P.GAP), lambda t: F.regexp_replace(t, P.SEPARATOR, " "))
    return F.trim(_held(plain, ("  ", "\t", "\u00a0"), collapse_spaces))


def is_furniture(raw: Column) -> Column:
    return F.trim(raw).rlike(P.FURNITURE)


def spacing(text: Column) -> Column:
    """No space before a closing mark, one after a comma or semicolon that a letter follows."""
    closed = _held(text, (" ,", " ;", " :", " .", " ?", " !", " ।"), lambda t: F.regexp_replace(t, r"[ ]+([,;:.?!।])", r"$1"))
    return _held(closed, (",", ";"), lambda t: F.regexp_replace(t, r"([,;])([A-Za-z\x{0900}-\x{097F}])", r"$1 $2"))


def year_range(text: Column) -> Column:
    return _held(text, ("-",), lambda t: F.regexp_replace(t, r"([0-9]{4})[ ]*-[ ]*([0-9]{2})", r"$1-$2"))


def blanks(text: Column) -> Column:
    """Every run of underscores of two and more has one length."""
    return _held(text, ("__",), lambda t: F.regexp_replace(t, "__+", "_" * BLANK_LENGTH))


def boxes(text: Column) -> Column:
    """Tick boxes of either bracket, but not a true/false box at the end of a line, become ( )."""
    def boxed(t: Column) -> Column:
        tail = F.regexp_extract(t, rf"({P.TRUTH_BOX})", 1)
        head = F.substring(t, F.lit(1), F.length(t) - F.length(tail))
        return F.concat(F.regexp_replace(head, r"\([ _\x{01}\x{02}]*\)|\[[ _\x{01}\x{02}]*\]", "( )"), F.when(tail != "", "[ ]").otherwise(""))

    return _held(text, ("(", "["), boxed)


def articles(text: Column) -> Column:
    """a and an by the next word of two letters and more: its first letter, with two lists of exceptions."""
    word = r"(?:$|[^A-Za-z])"
    vowel = "|".join(A_BEFORE_VOWEL)
    consonant = "|".join(AN_BEFORE_CONSONANT)
    begin = r"(^|[^A-Za-z0-9_'.])([Aa])"
    steps = (
        ("a ", rf"{begin} ([aeiouAEIOU][A-Za-z])", r"$1$2n $3"),
        ("an ", rf"{begin}n ([b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z][a-z])", r"$1$2 $3"),
        ("an ", rf"{begin}n ({vowel})({word})", r"$1$2 $3$4"),
        ("a ", rf"{begin} ({consonant})({word})", r"$1$2n $3$4"),
    )

    def step(article: str, find: str, put: str):
        return lambda t: F.when(t.contains(article) | t.contains(article.capitalize()), F.regexp_replace(t, find, put)).otherwise(t)

    return reduce(lambda t, s: let(t, step(*s)), steps, text)


def polish_fragment(text: Column, question_mark: bool = False) -> Column:
    """First letter in upper case; with ``question_mark``, a ? after a fragment that has no closing mark and that opens with an English question word or holds a Hindi one as a whole word."""
    out = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))
    if not question_mark:
        return out
    hindi = r"[\x{0900}-\x{0963}\x{0966}-\x{097F}]"
    opens = rf"(?i)^({'|'.join(QUESTION_WORDS)})(?:$|[^A-Za-z0-9_])"
    asks = out.rlike(rf"{opens}|(?<!{hindi})(?:{'|'.join(HINDI_QUESTION_WORDS)})(?!{hindi})") & ~out.rlike(P.FINISHED)
    return F.when(asks, F.concat(out, F.lit("?"))).otherwise(out)


def prepare(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, fixes) of ``papers(paper_id, raw)``: blank lines go, furniture goes and is logged, every rule that changes a line is logged."""
    rows = papers.select("paper_id", F.posexplode(F.split("raw", "\n")).alias("pos", "raw"))
    return prepare_lines(rows.select("paper_id", (F.col("pos") + 1).cast("long").alias("line_no"), "raw"))


RULES = [("punctuation spacing", spacing), ("year range", year_range), ("article", articles), ("blank length", blanks), ("tick box", boxes)]


def prepare_lines(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for ``rows(paper_id, line_no, raw)``."""
    marked = rows.where(F.trim("raw") != "").select("paper_id", "line_no", "raw", is_furniture(F.col("raw")).alias("furniture"), mark_spaces(F.col("raw")).alias("t0"))
    for k, (_, rule) in enumerate(RULES):
        marked = marked.withColumn(f"t{k + 1}", rule(F.col(f"t{k}")))
    last = f"t{len(RULES)}"
    lines = marked.where("not furniture").select("paper_id", "line_no", without_auto(F.col(last)).alias("text"), auto_format(F.col(last)).alias("auto_fmt"), clean(F.col(last)).alias("flat"))
    # Most rules leave most lines alone: only a text that a rule changed is cleaned for the log.
    steps = [F.when(F.col(f"t{k}") != F.col(f"t{k + 1}"), F.struct(F.lit(name).alias("rule"), clean(F.col(f"t{k}")).alias("before"), clean(F.col(f"t{k + 1}")).alias("after"), F.lit(k).alias("step"))) for k, (name, _) in enumerate(RULES)]
    gone = F.struct(F.lit("document furniture").alias("rule"), F.trim("raw").alias("before"), F.lit("").alias("after"), F.lit(-1).alias("step"))
    every = F.when(F.col("furniture"), F.array(gone)).otherwise(F.filter(F.array(*steps), lambda s: F.coalesce(s["before"] != s["after"], F.lit(False))))
    fixes = unpacked(marked, ["paper_id", "line_no"], every, x="f").select("paper_id", "line_no", "f.step", "f.rule", "f.before", "f.after")
    return lines, fixes
