"""Labels and the items on a line, as columns (ITM, NUM-01..03)."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import HINDI_ITEMS, HINDI_OPTIONS, MAX_BARE, MAX_BARE_WORDS, MAX_OPTION, MAX_PAIR, MAX_PAIR_WORDS, MAX_TABBED, MIN_JUMP, ROMAN
from . import patterns as P
from .normalize import clean
from .text import let

#: Roman numerals behind i in every mix of cases. Looked up as they are, as lower case is dear to work out for each label.
_ANY_ROMAN = ["".join(cs) for x in ROMAN[1:] for cs in product(*[(c, c.upper()) for c in x])]

NO_OPTIONS = "array<struct<label:string,text:string>>"


def _words(xs: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in xs])


def spaces(text: Column) -> Column:
    """Marks of tabs and gaps as plain spaces."""
    return F.regexp_replace(text, P.SEPARATOR, " ")


def words_in(text: Column) -> Column:
    return F.size(F.split(text, "[ ]+"))


def label_of(text: Column) -> Column:
    """The label that a text opens with, or the number glued to a blank; empty if none."""
    typed = F.regexp_extract(text, P.LABEL, 1)
    return F.when(typed != "", typed).otherwise(F.regexp_extract(text, P.GLUED_LABEL, 1))


def after_label(text: Column) -> Column:
    """The text behind its label."""
    typed = F.regexp_extract(text, P.LABEL, 1)
    glued = F.regexp_extract(text, P.GLUED_LABEL, 1)
    return F.when(typed != "", F.trim(F.regexp_replace(text, P.LABEL, ""))).when(glued != "", F.trim(F.substring(text, F.length(glued) + 1, F.length(text)))).otherwise(text)


def option_of(chunk: Column, last: Column) -> Column:
    """struct(label, text) of the text before a box; without a text where it holds none or, after the last box, no label."""
    label = label_of(chunk)
    rest = after_label(chunk)
    bare, bare_rest = F.regexp_extract(chunk, P.BARE_LABEL, 1), F.trim(F.regexp_extract(chunk, P.BARE_LABEL, 2))
    found = F.when((label != "") & (rest != ""), F.struct(label.alias("label"), rest.alias("text")))
    # A label with nothing behind it is no bare label either.
    found = found.when((label == "") & (bare != ""), F.struct(bare.alias("label"), bare_rest.alias("text")))
    return found.when(~last, F.struct(F.lit("").alias("label"), chunk.alias("text"))).otherwise(F.struct(F.lit("").alias("label"), F.lit("").alias("text")))


def parse_options(line: Column) -> Column:
    """Array of (label, text) of a line with two boxes and more and two options and more; null for other lines."""
    chunks = F.transform(F.split(line, P.EMPTY_BOX, -1), lambda c: F.trim(spaces(c)))

    def options(chunks: Column) -> Column:
        return F.filter(F.transform(chunks, lambda c, i: option_of(c, i == F.size(chunks) - 1)), lambda o: o["text"] != "")

    # Most lines have no closing bracket, and fewer have two boxes: only those are taken apart, once.
    boxes = F.size(F.regexp_extract_all(line, F.lit(P.EMPTY_BOX), 0))
    found = F.when(boxes >= 2, let(let(chunks, options), lambda o: F.when(F.size(o) >= 2, o)))
    return F.when(line.contains(")") | line.contains("]"), found)


#: A label in the middle of a line, with the space before it and behind it.
INLINE = r"\(?[ ]*([0-9]{1,2}|[A-Za-z]|[अ-ह])[ ]*[).]$"


def inline_items(text: Column) -> Column:
    """Array of (label, text) of a line with three labels and more in it; null for other lines. Text before the first label is dropped, and so are empty items.

    Words are folded one after the other: a word (or a bracket and a word) that is a label opens an item, others go on with the last one.
    """
    tokens = F.filter(F.split(F.regexp_replace(F.regexp_replace(text, r"\([ ]+", "("), r"(^|[ ])(\(?(?:[0-9]{1,2}|[A-Za-z]|[अ-ह]))[ ]+([).])([ ])", r"$1$2$3$4"), "[ ]+"), lambda w: w != "")
    empty = F.array().cast(NO_OPTIONS)

    def is_label(w: Column) -> Column:
        return w.rlike(r"^\(?([0-9]{1,2}|[A-Za-z]|[अ-ह])[).]$")

    def step(out: Column, w: Column) -> Column:
        opened = F.concat(out, F.array(F.struct(F.regexp_extract(w, r"^\(?([0-9]{1,2}|[A-Za-z]|[अ-ह])[).]$", 1).alias("label"), F.lit("").alias("text"))))
        last = F.element_at(out, -1)
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["label"].alias("label"), F.trim(F.concat_ws(" ", last["text"], w)).alias("text"))))
        return F.when(is_label(w), opened).when(F.size(out) > 0, longer).otherwise(out)

    def found(tokens: Column) -> Column:
        labels = F.size(F.filter(tokens, is_label))
        # A label needs something behind it: one that ends the line is not counted.
        ends = F.when(F.size(tokens) > 0, is_label(F.element_at(tokens, -1)).cast("int")).otherwise(0)
        return F.when(labels - ends >= 3, F.filter(F.aggregate(tokens, empty, step), lambda o: o["text"] != ""))

    # Every label closes with ) or a full stop; lines with fewer than three are not taken apart.
    closed = F.length(text) - F.length(F.replace(F.replace(text, F.lit(")"), F.lit("")), F.lit("."), F.lit("")))
    return F.when(closed >= 3, let(tokens, found))


def label_format(label: Column) -> Column:
    """d, r, R, a, A, option-hi, hindi-letter or null. A single i or I counts as a letter, v and x as roman."""
    later = _words(ROMAN[1:])
    return (
        F.when(label == "", None)
        .when(label.rlike("^[0-9]{1,2}$"), "d")
        .when(F.array_contains(later, label), "r")
        .when(label.isin(_ANY_ROMAN), "R")
        .when(label.rlike("^[a-z]$"), "a")
        .when(label.rlike("^[A-Z]$"), "A")
        .when(label.isin(HINDI_OPTIONS), "option-hi")
        .when(label.isin(HINDI_ITEMS), "hindi-letter")
    )


def label_position(label: Column, form: Column) -> Column:
    """Place in the format's sequence, from 0; -1 where the label has none."""
    roman = F.array_position(_words(ROMAN), F.lower(label)) - 1
    place = (
        F.when(form == "d", label.try_cast("int") - 1)
        .when((form == "r") | (form == "R"), roman)
        .when(form == "a", F.ascii(label) - 97)
        .when(form == "A", F.ascii(label) - 65)
        .when(form == "option-hi", F.array_position(_words(HINDI_OPTIONS), label) - 1)
        .when(form == "hindi-letter", F.array_position(_words(HINDI_ITEMS), label) - 1)
    )
    return F.coalesce(place.cast("int"), F.lit(-1))


def make_label(index: Column, form: Column, script: Column | None = None) -> Column:
    """The label at a place of a format; numbers where a sequence ends or has no letters of its own."""
    number = (index + 1).cast("string")
    small = F.char(97 + index % 26)
    roman = F.try_element_at(_words(ROMAN), (index + 1).cast("int"))
    hindi = F.coalesce(F.try_element_at(_words(HINDI_OPTIONS), (index + 1).cast("int")), number)
    option = small if script is None else F.when(script == "hi", hindi).otherwise(small)
    return (
        F.when(form == "a", small)
        .when(form == "A", F.char(65 + index % 26))
        .when(form == "r", F.coalesce(roman, number))
        .when(form == "R", F.coalesce(F.upper(roman), number))
        .when(form == "hindi-letter", F.coalesce(F.try_element_at(_words(HINDI_ITEMS), (index + 1).cast("int")), number))
        .when(form == "option", option)
        .otherwise(number)
    )


def is_roman(form: Column) -> Column:
    return F.coalesce(form.isin("r", "R"), F.lit(False))


def is_ambiguous(label: Column) -> Column:
    """A single letter that is a roman numeral as well."""
    return F.coalesce(label.isin([c for x in ROMAN if len(x) == 1 for c in (x, x.upper())]), F.lit(False))


def pair_formats(first: Column, second: Column) -> tuple[Column, Column]:
    """Formats of two neighbours, each settling the other's ambiguous letter."""
    a, b = label_format(first), label_format(second)
    to_b, to_a = is_roman(b) & is_ambiguous(first), is_roman(a) & is_ambiguous(second)
    return F.when(to_b, b).otherwise(a), F.when(to_b, b).when(to_a, a).otherwise(b)


def same_sequence(form: Column, reference: Column) -> Column:
    both = F.concat(reference, form)
    return F.coalesce((form == reference) | both.isin("ar", "ra", "AR", "RA"), F.lit(False))


def with_tabbed_items(df: DataFrame, line: Column, auto_fmt: Column, out: str) -> DataFrame:
    """``df`` with an array of (label, text) of a line typed in columns; null for other lines.

    Two parts and more of 45 characters and less; each after the first is labelled in one sequence, and its label
    lies two places and more behind the one before it (columns are read downwards), unless every part is to be written on.
    """
    rows = df.withColumn("_parts", F.filter(F.transform(F.split(line, P.SEPARATOR), lambda p: F.trim(p)), lambda p: p != ""))
    rows = rows.withColumn("_items", F.when(F.size("_parts") >= 2, F.transform("_parts", lambda p: F.struct(label_of(p).alias("label"), after_label(p).alias("text")))))
    rows = rows.withColumn("_items", F.transform("_items", lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"), label_format(x["label"]).alias("form"))))
    rows = rows.withColumn("_reference", F.when(F.coalesce(auto_fmt, F.lit("")) != "", auto_fmt).otherwise(F.element_at("_items", 1)["form"]))

    def settled(x: Column, i: Column) -> Column:
        before = F.element_at("_items", F.greatest(i, F.lit(1)))
        to_b = is_roman(x["form"]) & is_ambiguous(before["label"])
        to_a = is_roman(before["form"]) & is_ambiguous(x["label"])
        return F.struct(x["label"].alias("label"), x["text"].alias("text"), x["form"].alias("form"), before["label"].alias("before"), F.when(to_b, x["form"]).otherwise(before["form"]).alias("a"), F.when(to_b, x["form"]).when(to_a, before["form"]).otherwise(x["form"]).alias("b"))

    rows = rows.withColumn("_settled", F.transform("_items", settled))
    places = F.transform("_settled", lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text"), x["form"].alias("form"), x["before"].alias("before"), label_position(x["before"], x["a"]).alias("from"), label_position(x["label"], x["b"]).alias("to")))
    rows = rows.withColumn("_settled", places).withColumn("_room", F.forall("_parts", lambda p: p.rlike(P.BLANK_OR_BOX)))

    def good(x: Column) -> Column:
        jump = (x["before"] == "") | ((x["from"] >= 0) & (x["to"] - x["from"] >= MIN_JUMP))
        return (x["label"] != "") & (x["text"] != "") & same_sequence(x["form"], F.col("_reference")) & (F.col("_room") | jump)

    fine = F.forall(F.slice("_settled", F.lit(2), F.greatest(F.size("_parts"), F.lit(1))), good) & F.forall("_parts", lambda p: F.length(p) <= MAX_TABBED)
    rows = rows.withColumn(out, F.when(F.coalesce(fine, F.lit(False)), F.transform("_items", lambda x: F.struct(x["label"].alias("label"), x["text"].alias("text")))))
    return rows.drop("_parts", "_items", "_reference", "_settled", "_room")


def split_parts(text: Column, gaps: Column) -> Column:
    """struct(left, right): the first part and all others, at tabs or, if ``gaps``, at runs of spaces as well; null if there is one part."""
    raw = F.when(gaps, F.split(text, P.SEPARATOR)).otherwise(F.split(text, P.TAB))
    parts = F.filter(F.transform(raw, clean), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.struct(F.element_at(parts, 1).alias("left"), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), " ").alias("right")))


def column_split(text: Column, strict: bool) -> Column:
    """struct(left, right) of a line in two columns; null where it has blanks or boxes and, if strict, where it ends like a sentence or a side is no short phrase."""
    spaced = F.instr(text, P.TAB) == 0
    parts = split_parts(text, spaced if strict else F.lit(True))
    good = ~text.rlike(P.BLANK_OR_BOX)
    if strict:
        good = good & ~text.rlike(P.SENTENCE_END)
        for side in ("left", "right"):
            good = good & (F.length(parts[side]) <= MAX_PAIR) & (words_in(parts[side]) <= MAX_PAIR_WORDS) & ~parts[side].rlike(P.BLANK_OR_BOX)
    return F.when(good, parts)


def looks_like_option(text: Column, bare: Column) -> Column:
    body = F.trim(F.regexp_replace(text, P.TRAILING_BOX, ""))
    words = words_in(body)
    fits = F.when(bare, (F.length(body) <= MAX_BARE) & (words <= MAX_BARE_WORDS)).otherwise(F.length(body) <= MAX_OPTION)
    prose = body.rlike(P.BLANK_IN_LINE) | body.rlike(P.SENTENCE_TAIL) | (body.rlike(r"\.[ ]*$") & (words > 3))
    return (body != "") & ~body.rlike(P.SEPARATOR) & ~prose & fits
