"""Text measures as columns: widths in hundredths of an em, line counts, letters and script (MEA)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEVANAGARI, LETTERS, WIDTH_CLASSES


#: Classes of characters that are told apart: those of one width, and small letters. Each is written as its first character.
_CLASSES = [(c, w) for c, w in WIDTH_CLASSES if c] + [("abcdefghijklmnopqrstuvwxyz", 52)]
_HINDI = [c[0] for c, _ in _CLASSES if c[0] in DEVANAGARI]


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, wherever ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unpacked(rows: DataFrame, columns: list[str], array: Column | str, k: str = "k", x: str = "x") -> DataFrame:
    """``columns`` of rows, and place (from 0) and value of each element of an array. The outer form: for the plain one Spark asks for arrays that are not empty below all that makes
    the array, and works that out a second time at every step."""
    return rows.select(*columns, F.posexplode_outer(array).alias(k, x)).where(F.col(k).isNotNull())


def count_of(text: Column, characters: str) -> Column:
    """How many of the characters stand in the text: its length less that of the text without them."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def shape(text: Column) -> Column:
    """The text with every character of a class replaced by the first of the class, in one pass. What follows only counts single characters, which is cheap."""
    members, firsts = "".join(c[1:] for c, _ in _CLASSES), "".join(c[0] * (len(c) - 1) for c, _ in _CLASSES)
    return F.translate(text, members, firsts)


def _number(shaped: Column, first: str) -> Column:
    return F.length(shaped) - F.length(F.replace(shaped, F.lit(first), F.lit("")))


def _total(shaped: Column, weights: dict[str, int]) -> Column:
    """Sum of the characters' weights; those of Devanagari are looked for only in texts that are not ASCII."""

    def part(hindi: bool) -> Column:
        total = F.lit(0)
        for first, weight in weights.items():
            if weight and (first in _HINDI) == hindi:
                total = total + _number(shaped, first) * weight
        return total

    return part(False) + F.when(F.octet_length(shaped) == F.length(shaped), 0).otherwise(part(True))


def shape_width(shaped: Column) -> Column:
    """Width of a text in hundredths of an em, from its shape."""
    total = F.length(shaped) * 52 + _total(shaped, {c[0]: w - 52 for c, w in _CLASSES})
    return F.coalesce(total.cast("long"), F.lit(0).cast("long"))


def width_centi_em(text: Column) -> Column:
    """Sum of character widths as a whole number, so that no order of addition matters. Of the cells of an array, take ``shape`` and ``shape_width`` one after the other."""
    return shape_width(shape(text))


def width_in(text: Column, font_pt: float | Column = 12.0) -> Column:
    font = font_pt if isinstance(font_pt, Column) else F.lit(float(font_pt))
    return width_centi_em(text) * font / F.lit(7200.0)


def lines_of_width(width: Column, available_in: float | Column, empty: Column) -> Column:
    """Lines of a text of a known width in inches."""
    available = available_in if isinstance(available_in, Column) else F.lit(float(available_in))
    lines = F.greatest(F.lit(1).cast("long"), F.ceil(width / available - F.lit(0.02)))
    return F.when(empty | (available <= 0), F.lit(1).cast("long")).otherwise(lines)


def line_count(text: Column, font_pt: float, available_in: float | Column) -> Column:
    return lines_of_width(width_in(text, font_pt), available_in, F.coalesce(text, F.lit("")) == "")


def letter_count(text: Column) -> Column:
    letters = {c[0]: 1 for c, _ in _CLASSES if c[0] in LETTERS}
    return F.coalesce(_total(shape(text), letters).cast("long"), F.lit(0).cast("long"))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\x{00a0}]+", " "))


def has_devanagari(text: Column) -> Column:
    return (F.octet_length(text) != F.length(text)) & text.rlike(r"[\x{0900}-\x{097F}]")


def script_of(text: Column) -> Column:
    return F.when(has_devanagari(text), "hi").otherwise("en")


def script_runs(text: Column) -> Column:
    """Pieces of one script each. Characters that belong to no script stay with the piece before them; those at the start with the piece after."""
    latin, hindi = r"A-Za-z", r"\x{0900}-\x{097F}"
    return F.regexp_extract_all(text, F.lit(rf"[^{latin}{hindi}]*(?:[{latin}][^{hindi}]*|[{hindi}][^{latin}]*)|[^{latin}{hindi}]+"), 0)
