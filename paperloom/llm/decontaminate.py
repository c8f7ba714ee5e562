"""Benchmark decontamination by templates: typed placeholders, hash-joined windows and consistent slots [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, whole_text

WINDOW = 8
#: Words of a window that must stand for themselves.
LITERALS = 4
#: Share of an item's windows that makes a document contaminated.
COVERAGE = 0.3
#: Most benchmark windows that are broadcast; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: Literal words that a whole item needs to be found with other values, where none of its windows has LITERALS of them.
FEW_LITERALS = 3
#: Words that an item needs to be found word for word in that case.
FEW_WORDS = 4
#: Longest item in words that is one window as a whole.
LONGEST = 64
#: Most bits of the filter of openings.
FILTER_BITS = 1 << 26
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"

#: Units, spelt out and short.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds lb lbs oz ounce ounces ton tons "
    "ml l litre litres liter liters second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros rupee rupees percent degree degrees mph kmh ms watt watts volt volts"
).split()

_SPACE = " \t\n\x0b\f\r"
#: A capitalised word behind a word that does not end a sentence.
_NAME = r"(?<=[^\s.!?:]\s)(\p{Lu}\p{Ll}[\p{L}'-]*)"
_MARK = "\x02"
#: What is no letter, digit, space or mark.
_OTHER = r"[^\p{L}\p{N}\s\x02]+"


def bare(text: Column) -> Column:
    """The text in lower case, names marked, without punctuation."""
    marked = F.regexp_replace(F.translate(text, _MARK, " "), _NAME, _MARK + "$1")
    return F.trim(F.regexp_replace(F.lower(marked), _OTHER, ""), F.lit(_SPACE))


def template(bare_text: Column) -> Column:
    """The same with placeholders for numbers, names and units that follow a number. Each stands for one word, so words stay aligned with those of the bare text."""
    out = F.regexp_replace(bare_text, r"(?<!\S)[0-9]+(?!\S)", NUMBER)
    out = F.regexp_replace(out, r"(?<!\S)\x02\S+", NAME)
    return F.regexp_replace(out, rf"({NUMBER}\s+)(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?!\S)", f"$1{UNIT}")


def words_of(text: Column) -> Column:
    return F.split(text, r"\s+")


def _opening(words: Column, at: Column, exact: bool) -> Column:
    """Hash of the two words from place ``at`` on (from 1)."""
    return F.xxhash64(F.lit(exact), F.get(words, at - 1), F.get(words, at))


def _hash(words: Column, exact: bool) -> Column:
    return F.xxhash64(F.lit(exact), words)


def _is_slot(word: Column) -> Column:
    return word.startswith("<")


def _slots(words: Column, values: Column) -> Column:
    """The values of a window's placeholders."""
    pairs = F.arrays_zip(words.alias("w"), values.alias("v"))
    return F.transform(F.filter(pairs, lambda x: _is_slot(x["w"])), lambda x: x["v"])


def _literals(words: Column) -> Column:
    return F.size(words) - F.size(F.filter(words, _is_slot))


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, exact, item_pos, size, hash, opening, item_slots, item_windows) of the windows by which items are found.

    An item has windows of WINDOW template words, or one of its own length if it is shorter, of which those with LITERALS literal words count. An item
    without such a window is found by its whole template, if that has FEW_LITERALS literal words and LONGEST words at the most, and by windows
    of its words as they are (``exact``), if it has FEW_WORDS of them. A single window has a second form with a name for its first word, as that looks
    like one where the item follows other words. Items that are shorter still have no window; ``unfindable`` lists them.
    """
    own = benchmark.select(F.col(item_col).alias("item_id"), bare(whole_text(text_col)).alias("bare")).distinct()
    own = own.select("item_id", words_of(template(F.col("bare"))).alias("t"), words_of(F.translate("bare", _MARK, "")).alias("v"), "bare").where("bare <> ''")
    n = F.size("t")

    def cut(size: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.struct(i.alias("pos"), F.slice("t", i, size).alias("t"), F.slice("v", i, size).alias("v")))

    size = F.least(n, F.lit(WINDOW))
    kinds = own.select("item_id", "t", "v", F.filter(cut(size), lambda w: _literals(w["t"]) >= LITERALS).alias("strong"), cut(size).alias("every"))
    none = F.filter("every", lambda w: F.lit(False))
    whole = F.when((_literals(F.col("t")) >= FEW_LITERALS) & (n <= LONGEST), F.array(F.struct(F.lit(1).alias("pos"), F.col("t"), F.col("v")))).otherwise(none)
    weak = F.size("strong") == 0
    rows = kinds.select(
        "item_id",
        F.when(weak, whole).otherwise(F.col("strong")).alias("found"),
        F.when(weak & (n >= FEW_WORDS), F.col("every")).otherwise(none).alias("literal"),
    )
    found = rows.select("item_id", F.lit(False).alias("exact"), F.size("found").alias("item_windows"), F.explode("found").alias("w"))
    literal = rows.select("item_id", F.lit(True).alias("exact"), F.size("literal").alias("item_windows"), F.explode("literal").alias("w"))
    named = F.concat(F.array(F.lit(NAME)), F.slice("w.t", F.lit(2), F.size("w.t")))
    again = found.where((F.col("item_windows") == 1) & ~_is_slot(F.get("w.t", F.lit(0)))).withColumn("w", F.struct(F.col("w.pos").alias("pos"), named.alias("t"), F.col("w.v").alias("v")))
    rows = found.unionByName(again).unionByName(literal)
    words = F.when(F.col("exact"), F.col("w.v")).otherwise(F.col("w.t"))
    hashed = [F.when(F.col("exact"), f(True)).otherwise(f(False)) for f in (lambda e: _hash(words, e), lambda e: _opening(words, F.lit(1), e))]
    slots = F.when(~F.col("exact"), _slots(F.col("w.t"), F.col("w.v")))
    out = rows.select("item_id", "exact", F.col("w.pos").alias("item_pos"), F.size("w.t").alias("size"), hashed[0].alias("hash"), hashed[1].alias("opening"), slots.alias("item_slots"), "item_windows")
    # Items repeated under one id count together.
    totals = out.groupBy("item_id", "exact").agg(F.max("item_windows").alias("item_windows"))
    return out.drop("item_windows").distinct().join(totals, ["item_id", "exact"])


def unfindable(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id) of the items that have no window: texts of a few words, most of which are numbers, names or units."""
    return benchmark.select(F.col(item_col).alias("item_id")).distinct().join(item_windows(benchmark, item_col, text_col).select("item_id").distinct(), "item_id", "left_anti")


def _probes(opening: Column, bits: int) -> list[Column]:
    return [F.pmod(h, F.lit(bits)) for h in (opening, F.shiftrightunsigned(opening, 31))]


def opening_filter(items: DataFrame) -> tuple[list[int], int]:
    """A Bloom filter of the openings of all windows looked for, about 16 bits each: (64-bit words, number of bits). Others cannot match and are not made."""
    openings = items.select("opening").distinct()
    bits = min(FILTER_BITS, max(1 << 10, 1 << (16 * openings.count()).bit_length()))
    set_ = openings.select(F.explode(F.array(*_probes(F.col("opening"), bits))).alias("bit"))
    set_ = set_.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("value"))
    words = [0] * (bits >> 6)
    for r in set_.collect():
        words[r["word"]] = r["value"]
    return words, bits


def windows(df: DataFrame, keys: list[str], text_col: str, sizes: dict[bool, list[int]], openings: tuple[list[int], int]) -> DataFrame:
    """(keys, exact, size, pos, hash, slots) of the windows of the given sizes whose opening passes the filter; slots are the values of its placeholders, null where the text has none.

    Patterns run over whole texts, in generated code; only the windows themselves are made one by one.
    """
    t = df.select(*keys, bare(F.col(text_col)).alias("bare")).select(*keys, "bare", template(F.col("bare")).alias("t"))
    slotted = F.col("t").contains("<")
    literal = words_of(F.translate("bare", _MARK, ""))
    t = t.select(*keys, words_of(F.col("t")).alias("word"), (literal if sizes[True] else F.when(slotted, literal)).alias("value"), slotted.alias("slotted"))
    table = F.split(F.lit(",".join(map(str, openings[0]))), ",").cast("array<bigint>")

    def passes(words: Column, i: Column, exact: bool) -> Column:
        first, second = (_bit(table, p) for p in _probes(_opening(words, i, exact), openings[1]))
        return first & second

    def of(size: int, exact: bool) -> Column:
        words = F.col("value" if exact else "word")

        def one(i: Column) -> Column:
            slots = F.lit(None).cast("array<string>") if exact else F.when(F.col("slotted"), _slots(F.slice("word", i, size), F.slice("value", i, size)))
            return F.struct(F.lit(exact).alias("exact"), F.lit(size).alias("size"), i.alias("pos"), _hash(F.slice(words, i, size), exact).alias("hash"), slots.alias("slots"))

        places = F.filter(F.sequence(F.lit(1), F.size(words) - size + 1), lambda i: passes(words, i, exact))
        return F.coalesce(F.when(F.size(words) >= size, F.transform(places, one)), none)

    none = F.expr("filter(array(named_struct('exact', true, 'size', 1, 'pos', 1, 'hash', 1L, 'slots', array(''))), x -> false)")
    every = [of(size, exact) for exact in (False, True) for size in sizes[exact]] or [none]
    return t.select(*keys, F.explode(F.concat(*every) if len(every) > 1 else every[0]).alias("w")).select(*keys, "w.*")


def _bit(table: Column, place: Column) -> Column:
    return F.call_function("getbit", F.get(table, F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage, n_slots, changed) of every document that holds a benchmark item, if with other numbers, names or units.

    Windows of 8 template words are joined by hash; items that are shorter or mostly values have windows of their own (``item_windows``). Slots of one alignment (difference of
    positions) must agree: each value of the item goes with one value of the document and the other way round, and windows with a value that does not are
    left out. A pair is reported if matching windows make up the given share of the item's; ``changed`` tells that some slot has another value.

    The benchmark's windows are broadcast up to BROADCAST_WINDOWS rows (counted first), beyond that the join is a shuffle by hash. All counting is by
    (document, item), so an item that a third of all documents hold is no hot group; what is gathered for an alignment is bounded by the item's length.

    Null and empty texts hold nothing. Repeated rows of a document add nothing to it; a document without an id is known by its text and reported
    under a null id. Items repeated under one id count together. Empty tables give an empty result; other columns are ignored.
    """
    items = checkpoint(item_windows(benchmark, item_col, item_text_col))
    sizes: dict[bool, list[int]] = {False: [], True: []}
    for r in items.select("exact", "size").distinct().orderBy("size").collect():
        sizes[r["exact"]].append(r["size"])
    openings = opening_filter(items)
    items = items.drop("opening")
    if items.count() <= BROADCAST_WINDOWS:
        items = F.broadcast(items)
    text = whole_text(text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(id_col).isNull(), F.xxhash64(text)).alias("nameless"), text.alias("text"))
    found = windows(own, ["doc_id", "nameless"], "text", sizes, openings).join(items, ["exact", "hash", "size"])
    pair = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    pair = F.when(F.col("slots").isNotNull() & F.col("item_slots").isNotNull(), pair).otherwise(F.array().cast("array<struct<i:string,d:string>>"))
    keys = ["doc_id", "nameless", "item_id", "exact", "item_windows"]
    found = found.select(*keys, (F.col("pos") - F.col("item_pos")).alias("line"), F.struct("item_pos", pair.alias("pairs")).alias("w"))
    lines = found.groupBy(*keys, "line").agg(F.collect_set("w").alias("w"))
    lines = lines.withColumn("pairs", F.array_distinct(F.flatten(F.transform("w", lambda w: w["pairs"]))))
    # Pairs that share one of their two values with another pair.
    clash = F.filter("pairs", lambda p: F.exists("pairs", lambda q: (p["i"] == q["i"]) != (p["d"] == q["d"])))
    lines = lines.withColumn("clash", clash).select(*keys, F.filter("w", lambda w: ~F.arrays_overlap(w["pairs"], F.col("clash"))).alias("w"))
    lines = lines.where(F.size("w") > 0).withColumn("pairs", F.array_distinct(F.flatten(F.transform("w", lambda w: w["pairs"]))))
    lines = lines.select(*keys, F.size("pairs").alias("n_slots"), F.exists("pairs", lambda p: p["i"] != p["d"]).alias("changed"), F.explode(F.transform("w", lambda w: w["item_pos"])).alias("item_pos"))
    places = lines.groupBy(*keys, "item_pos").agg(F.max("n_slots").alias("n_slots"), F.max("changed").alias("changed"))
    out = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_windows"), F.max("n_slots").cast("long").alias("n_slots"), F.max("changed").alias("changed"))
    out = out.withColumn("coverage", F.col("n_windows") / F.col("item_windows")).where(F.col("coverage") >= coverage)
    # An item found both ways is reported as it was found word for word.
    best = F.max_by(F.struct("n_windows", F.col("item_windows").cast("long").alias("item_windows"), "coverage", "n_slots", "changed"), F.struct("exact", "coverage")).alias("best")
    return out.groupBy("doc_id", "nameless", "item_id").agg(best).select("doc_id", "item_id", "best.*")
