"""Secret scans: fixed patterns, and strings that a character Markov model of random text explains better than one of identifiers [native]."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, whole_text

#: Fixed values of the contract, in the order in which kinds are listed.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")

#: A hex run matches as a whole, and a run of capitals and digits behind AKIA too, so the least length may stand in these patterns.
_HEX, _ACCESS = r"[0-9a-f]{24,}", r"AKIA[A-Z0-9]{16,}"
_CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_SIDE = len(_ALPHABET) + 1


class Models(NamedTuple):
    """ratios: log-likelihood ratio (random over identifier) of each ordered pair of characters, in rows of _SIDE; 0 of an index is any other character."""

    ratios: list[float]


#: Ordinary parts of paths, addresses and program names, a labelled sample beside the corpus's own words.
ORDINARY = (
    "about account address agent alpha android append assets author balance batch board buffer button calendar canvas category channel check client "
    "cluster column com comment component config connection constant container context controller count create custom data database delete description "
    "device directory domain driver element enable entry event example execute factory field file filter format function general group header helper "
    "home html http https import index info install interface java kernel language license light linear linux local login main message mobile module "
    "name node number option output packages page parent password path pattern picture player policy print product program property public python "
    "query random read region release report resource result route schedule screen search select server service setting share site source spark state "
    "status store string submit system target template test text thread title transaction unit upload user usr utility value vector version view "
    "widget window write www yellow"
).split()
_MARKS = "+/_=-"
#: Share of each rule in the sample of ordinary strings.
RULES = 0.06
_CHUNK = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(values: Column, combine, kind: str = "int") -> Column:
    """For each of an array of numbers, ``combine`` (associative, with 0 as its neutral element) of all before it.

    Chunks are worked on first and their totals then, so that no array of all results is copied for every element.
    """
    zero = F.struct(F.array().cast(f"array<{kind}>").alias("out"), F.lit(0).cast(kind).alias("at"))

    def step(state: Column, x: Column) -> Column:
        return F.struct(F.concat(state["out"], F.array(state["at"])).alias("out"), combine(state["at"], x).alias("at"))

    def by_chunk(rows: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _CHUNK).cast("int")), lambda c: F.slice(rows, c * _CHUNK + 1, _CHUNK))
        return F.transform(chunks, lambda chunk: F.aggregate(chunk, zero, step))

    def joined_up(chunks: Column) -> Column:
        carried = F.aggregate(chunks, zero, lambda state, chunk: step(state, chunk["at"]))["out"]
        return F.flatten(F.zip_with(chunks, carried, lambda chunk, c: F.transform(chunk["out"], lambda x: combine(c, x))))

    return let(values, lambda rows: F.when(F.size(rows) > 0, let(by_chunk(rows), joined_up)).otherwise(F.array().cast(f"array<{kind}>")))


def spans(text: Column, pattern: str, kind: int, least: int = 1, group: int = 0) -> Column:
    """Array of (start, end, kind, value), leftmost and non-overlapping, in code points. Positions are sums of the lengths of the gaps and matches that come before."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    judged = F.regexp_extract_all(text, F.lit(pattern), group) if group else found
    empty = F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>")
    rows = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("match"), judged.alias("judged")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("size"), x["judged"].alias("value")),
    )

    def placed(rows: Column) -> Column:
        before = scan(F.transform(rows, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)

        def span(x: Column, at: Column) -> Column:
            start = at + x["gap"]
            return F.struct(start.alias("start"), (start + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))

        return F.zip_with(rows, before, span)

    return F.when(text.rlike(pattern), F.filter(let(rows, placed), lambda s: F.length(s["value"]) >= least)).otherwise(empty)


def base_spans(text: Column) -> Column:
    return F.concat(spans(text, ASSIGN, 0, 6, 2), spans(text, _ACCESS, 1), spans(text, _HEX, 2))


def _pairs(value: Column) -> Column:
    """Index of each ordered pair of neighbouring characters of a string."""
    code = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(_ALPHABET), c))
    padded = F.filter(code, lambda c: c.isNotNull())
    return F.zip_with(F.slice(padded, 1, F.greatest(F.size(padded) - 1, F.lit(0))), F.slice(padded, 2, F.greatest(F.size(padded) - 1, F.lit(0))), lambda a, b: a * _SIDE + b)


def random_strings(docs: DataFrame, each: int = 1000) -> DataFrame:
    """(value) of random strings of each usual alphabet: base64, its address form, letters and digits, base 36, hex."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    coded = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    wide = F.concat(F.conv(F.substring(digest, 1, 15), 16, 36), F.conv(F.substring(digest, 16, 15), 16, 36))
    kinds = [coded, F.translate(coded, "+/", "-_"), F.regexp_replace(coded, "[+/]", ""), wide, F.lower(wide), F.substring(digest, 1, 20)]
    return docs.sparkSession.range(each).select(F.explode(F.array(*kinds)).alias("value"))


def ordinary_strings(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(value) of ordinary strings made from ``words(value)``: words as they are, one in eight of them (by its hash) joined by each mark, in capitals and in program case; dates and numbers."""
    w = F.col("value")
    joins = [F.concat_ws(mark, w, F.lower(w), F.initcap(w), w) for mark in "-_/"] + [F.concat(F.lower(w), F.initcap(w), F.initcap(w)), F.concat_ws("_", F.upper(w), F.upper(w)), F.concat(F.lit("="), w, F.lit("=")), F.concat(w, F.lit("1")), F.concat(w, F.lit("-2"))]
    made = words.where(F.pmod(F.xxhash64("value"), F.lit(8)) == 0).select(F.explode(F.array(*joins)).alias("value"))
    days = docs.sparkSession.range(2000).select(F.date_add(F.lit("2000-01-01").cast("date"), (F.col("id") * 7).cast("int")).alias("day"))
    dates = days.select(F.explode(F.array(*[F.date_format("day", f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy_MM", "dd-MM-yyyy")])).alias("value"))
    numbers = docs.sparkSession.range(2000).select(F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12), 16, 10).alias("value"))
    return words.select("value").unionByName(made).unionByName(dates).unionByName(numbers)


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = 4000, prior: float = 0.5) -> Models:
    """Two first-order Markov models from labelled samples.

    Label "random": the values that the fixed patterns find, and random strings of the usual alphabets. Label "identifier": words of 4 to 19 characters
    outside those values and a list of ordinary program words, as they are and joined into paths, names and program case; dates, numbers, rules and the alphabet in order. The sample of texts holds
    ``sample_rows`` documents in expectation, chosen by their text's hash, the same for equal texts; it bounds the work, not what is scanned. A pair
    backs off to its second character and that to the uniform distribution, so that both models have a value without a single sample.
    At most 2 * 68 ** 2 counts reach the driver.
    """
    rows = docs.count()
    share = min(1.0, sample_rows / max(rows, 1))
    text = whole_text(text_col)
    picked = docs.where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < share * (1 << 20)).select(text.alias("t"))
    picked = picked.withColumn("base", base_spans(F.col("t")))
    secret = picked.select(F.explode(F.transform("base", lambda s: s["value"])).alias("value")).where(F.length("value") >= 16)
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", ASSIGN, " "), _ACCESS, " "), _HEX, " ")
    words = picked.select(F.explode(F.regexp_extract_all(masked, F.lit(r"[A-Za-z0-9_+/=-]{4,}"), 0)).alias("value"))
    # What could itself be judged is no sample of ordinary words.
    words = words.where(F.length("value") < 20).distinct()
    own = docs.sparkSession.range(50).select(F.explode(F.split(F.lit(" ".join(ORDINARY)), " ")).alias("value"))
    words = words.unionByName(own).unionByName(own.select(F.initcap("value").alias("value")))
    labelled = secret.unionByName(random_strings(docs)).withColumn("label", F.lit(1)).unionByName(ordinary_strings(docs, words).withColumn("label", F.lit(0)))
    pairs = labelled.select("label", F.explode(_pairs(F.col("value"))).alias("pair"))
    counts = pairs.groupBy("label", "pair").agg(F.count(F.lit(1)).alias("n")).collect()
    tables = [[0.0] * (_SIDE * _SIDE) for _ in range(2)]
    for row in counts:
        tables[row["label"]][row["pair"]] += row["n"]
    # Rules: a character repeated, two marks in turn, and the alphabet in order make up fixed shares of what follows each character.
    for a in range(1, _SIDE):
        total = sum(tables[0][a * _SIDE : (a + 1) * _SIDE]) + 16.0
        tables[0][a * _SIDE + a] += RULES * total
        for b in range(1, _SIDE):
            if _ALPHABET[a - 1] in _MARKS and _ALPHABET[b - 1] in _MARKS or ord(_ALPHABET[b - 1]) == ord(_ALPHABET[a - 1]) + 1:
                tables[0][a * _SIDE + b] += RULES * total
    logs = []
    for t in tables:
        single = [sum(t[b::_SIDE]) + prior for b in range(_SIDE)]
        share_of = [x / sum(single) for x in single]
        out: list[float] = []
        for a in range(_SIDE):
            line = t[a * _SIDE : (a + 1) * _SIDE]
            total = sum(line) + 16.0
            out += [math.log((x + 16.0 * share_of[b]) / total) for b, x in enumerate(line)]
        logs.append(out)
    return Models([round(r - w, 4) for r, w in zip(logs[1], logs[0], strict=True)])


def ratio(value: Column, models: Models) -> Column:
    """Log-likelihood ratio of a string, summed over its neighbouring characters."""
    table = F.split(F.lit(",".join(map(str, models.ratios))), ",").cast("array<double>")
    return F.aggregate(_pairs(value), F.lit(0.0), lambda s, i: s + F.element_at(table, i + 1))


def find_secrets(docs: DataFrame, models: Models, text_col: str = "text", least_ratio: float = 12.0, per_character: float = 0.6, base_col: str = "base_spans", markov_col: str = "markov_spans") -> DataFrame:
    """``docs`` with ``base_col`` and ``markov_col`` (arrays of start, end, kind, value).

    A run of 20 or more characters of the base64 and url alphabets is a secret if the random model beats the identifier
    model by ``least_ratio`` nats, and by ``per_character`` nats for each character, and it meets no base span.

    A null or empty text has no spans. Texts are scanned whole; positions are sums by chunks, and only likely runs are held against the text's assigned values. Rows are judged one by one, so ties, repeated
    rows and hot groups play no part; an empty table gives an empty result. Columns of ``docs`` are kept; one named like the new ones is an error.
    """
    if clash := {base_col.lower(), markov_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has columns {sorted(clash)} already; name others for the spans")
    text = whole_text(text_col)
    out = docs.withColumn(base_col, base_spans(text))
    base = F.col(base_col)

    def judged(assigned: Column) -> Column:
        """Hex and access spans lie within a run if they meet it, so the run's own text tells of them."""
        alone = F.filter(spans(text, _CANDIDATE, 3), lambda s: ~s["value"].rlike(f"{_HEX}|{_ACCESS}"))
        likely = F.filter(alone, lambda s: ratio(s["value"], models) >= F.greatest(F.lit(least_ratio), F.length(s["value"]) * per_character))
        return F.filter(likely, lambda s: ~F.exists(assigned, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))

    found = let(F.filter(base, lambda s: s["kind"] == 0), judged)
    return out.withColumn(markov_col, F.when(text.rlike(_CANDIDATE), found).otherwise(F.filter(base, lambda s: F.lit(False))))


def joined(spans_: Column) -> Column:
    """kind:start:end of each span by start, then kind as listed."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans_: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by one mark."""
    ordered = F.array_sort(F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def marked(rows: Column) -> Column:
        before = scan(F.transform(rows, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        placed = F.zip_with(rows, before, lambda s, at: F.struct(s["start"].alias("start"), s["end"].alias("end"), at.alias("at")))
        last = F.array_max(F.transform(rows, lambda s: s["end"]))
        return F.concat(F.array_join(let(placed, in_chunks), ""), F.substring(text, last + 1, F.length(text)))

    def in_chunks(rows: Column) -> Column:
        """The text before each span, and its mark. A chunk's part of the text is cut out first, so that the whole is not walked through for each span."""
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _CHUNK).cast("int")), lambda c: F.slice(rows, c * _CHUNK + 1, _CHUNK))

        def pieces(chunk: Column) -> Column:
            base = chunk[0]["at"]

            def piece(part: Column) -> Column:
                kept = F.transform(chunk, lambda s: F.when((s["start"] >= s["at"]) | (s["at"] == 0), F.concat(F.substring(part, s["at"] - base + 1, s["start"] - s["at"]), F.lit(mark))).otherwise(F.lit("")))
                return F.array_join(kept, "")

            return let(F.substring(text, base + 1, F.element_at(chunk, -1)["start"] - base), piece)

        return F.transform(chunks, pieces)

    return F.when(F.size(spans_) == 0, text).otherwise(let(ordered, marked))


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", models: Models | None = None) -> DataFrame:
    """One row for each document: counts of each base kind, digest of the base spans, all spans."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = find_secrets(own, models or train(own))

    def number(kind: int) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.concat("base_spans", "markov_spans")).alias("spans"),
        F.size("markov_spans").cast("long").alias("n_markov"),
    )


def redact(docs: DataFrame, text_col: str = "text", models: Models | None = None) -> DataFrame:
    """Replace every secret in the texts; other columns, whatever their names, and null and empty texts stay as they are. Repeated rows are handled alike; an empty table stays empty."""
    base, markov = fresh(docs, "base_spans"), fresh(docs, "markov_spans")
    found = find_secrets(docs, models or train(docs, text_col), text_col, base_col=base, markov_col=markov)
    clean = redacted(whole_text(text_col), F.concat(base, markov))
    return found.withColumn(text_col, F.when(F.col(text_col).isNotNull(), clean)).select(*docs.columns)
