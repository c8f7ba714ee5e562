"""License scans: an exact set-similarity join of text blocks with license templates [native].

The tokens of all templates are counted over the corpus and ordered by that count, rarest first. A block that holds a given share of a template's tokens must
hold one of its first few (prefix filter), enough tokens at all (length filter), and enough behind the first that both have (positional filter).
Blocks that pass are counted out.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text
from .secrets import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value of the contract: a word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Template(NamedTuple):
    """A block has the label if it holds the given share of the template's distinct words. A phrase also has to stand there word for word."""

    label: str
    text: str
    share: float = 0.8
    phrase: bool = False


#: Fixed values of the contract.
PHRASES = (
    Template("gpl", "gnu general public license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("cc-by", "cc by", 1.0, True),
    Template("mit", "mit license", 1.0, True),
)
#: Sentences by which public licenses are known, and short notices, of which every word has to be there.
TEMPLATES = (
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "this work is licensed under the creative commons attribution 4 0 international license"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    Template("apache", "licensed under the apache license", 1.0),
    Template("bsd", "licensed under the bsd license", 1.0),
    Template("cc-by", "licensed under cc by", 1.0),
    Template("gpl", "licensed under the gnu gpl", 1.0),
    Template("mit", "licensed under the mit license", 1.0),
    Template("mit", "released under the mit license", 1.0),
)
#: Least step of blocks in words.
STEP = 8
_BLOCK = 1 << 40


def step_of(template: Template) -> int:
    """Blocks are twice as long as this and begin at its multiples, so that any text of the template's length lies within one."""
    return max(STEP, 1 << (len(template.text.split()) - 1).bit_length())


def needed(template: Template) -> int:
    """How many distinct words of the template a block has to hold."""
    return math.ceil(round(template.share * len(set(template.text.split())), 9))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), 0)


def token_order(docs: DataFrame, templates, text_col: str = "text") -> list[str]:
    """The words of all templates, those that are rarest in the whole table first, equal ones in order. Only counts of these words, a list given by the templates, reach the driver."""
    known = sorted({w for t in templates for w in t.text.split()})
    words = docs.select(F.explode(words_of(whole_text(text_col))).alias("word")).where(F.col("word").isin(known))
    count = {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(known, key=lambda w: (count.get(w, 0), w))


def _chosen(values: list[Column], at: Column) -> Column:
    """One of a short list by its place, from 0."""
    return F.get(F.array(*values), at)


def _words(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _numbers(numbers) -> Column:
    return F.array(*[F.lit(n) for n in numbers])


def matches(words: Column, templates, order: list[str]) -> Column:
    """Array of (template, start, overlap, places) of all blocks of ``words`` that reach their template's share, and of places, in words from 0, where a phrase stands in the block."""
    rank = {w: k + 1 for k, w in enumerate(order)}
    ranks = [sorted(rank[w] for w in set(t.text.split())) for t in templates]
    need = [needed(t) for t in templates]
    prefix: dict[str, list[int]] = {}
    for k, own in enumerate(ranks):
        for r in own[: len(own) - need[k] + 1]:
            prefix.setdefault(order[r - 1], []).append(k)
    first = sorted(prefix)
    owners = F.create_map(*[x for w in first for x in (F.lit(w), _numbers(prefix[w]))])
    steps = [F.lit(step_of(t)) for t in templates]

    def blocks(i: Column) -> Column:
        """The two blocks of each template that hold word i, if the word is one of the template's first few. A block is a number: template and place."""

        def of(k: Column) -> Column:
            at = F.floor(i / _chosen(steps, k))
            return F.array(k * F.lit(_BLOCK) + at, F.when(at > 0, k * F.lit(_BLOCK) + at - 1))

        return F.flatten(F.transform(F.element_at(owners, F.get(words, i)), of))

    hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(first))
    candidates = F.filter(F.array_distinct(F.flatten(F.transform(hits, blocks))), lambda c: c.isNotNull())

    def placed(code: Column) -> Column:
        k = F.floor(code / _BLOCK).cast("int")
        start = (F.pmod(code, F.lit(_BLOCK)) * _chosen(steps, k)).cast("int")
        return F.struct(k.alias("template"), start.alias("start"), F.slice(words, start + 1, 2 * _chosen(steps, k)).alias("block"))

    def ranked(x: Column) -> Column:
        """The block's template words as ranks, rarest first."""
        known = F.filter(F.transform(F.array_distinct(x["block"]), lambda w: F.array_position(_words(order), w).cast("int")), lambda r: r > 0)
        own = _chosen([_numbers(r) for r in ranks], x["template"])
        return F.struct(x["template"].alias("template"), x["start"].alias("start"), x["block"].alias("block"), F.array_sort(known).alias("ranks"), own.alias("own"), _chosen([F.lit(n) for n in need], x["template"]).alias("need"))

    def long_enough(x: Column) -> Column:
        return F.size(x["ranks"]) >= x["need"]

    def shared(x: Column) -> Column:
        return F.struct(*[x[n].alias(n) for n in ("template", "start", "block", "ranks", "own", "need")], F.array_min(F.array_intersect(x["ranks"], x["own"])).alias("met"))

    def rest_is_enough(x: Column) -> Column:
        behind = F.least(F.size(x["ranks"]) - F.array_position(x["ranks"], x["met"]), F.size(x["own"]) - F.array_position(x["own"], x["met"]))
        return behind + 1 >= x["need"]

    phrases = [_words(t.text.split() if t.phrase else []) for t in templates]

    def counted(x: Column) -> Column:
        def standing(phrase: Column) -> Column:
            n = F.size(phrase)
            at = F.filter(F.sequence(F.lit(1), F.size(x["block"])), lambda i: F.slice(x["block"], i, n) == phrase)
            return F.when(n > 0, F.transform(at, lambda i: (x["start"] + i - 1).cast("long"))).otherwise(F.array().cast("array<bigint>"))

        overlap = F.size(F.array_intersect(x["ranks"], x["own"]))
        return F.struct(x["template"].alias("template"), x["start"].alias("start"), overlap.alias("overlap"), x["need"].alias("need"), let(_chosen(phrases, x["template"]), standing).alias("places"))

    ranked_blocks = F.filter(F.transform(F.transform(candidates, placed), ranked), long_enough)
    met = F.filter(F.transform(ranked_blocks, shared), rest_is_enough)
    found = F.filter(F.transform(met, counted), lambda x: x["overlap"] >= x["need"])
    out = F.transform(found, lambda x: F.struct(*[x[n].alias(n) for n in ("template", "start", "overlap", "places")]))
    return F.when(F.arrays_overlap(words, _words(first)), out).otherwise(F.array().cast("array<struct<template: int, start: int, overlap: int, places: array<bigint>>>"))


def license_blocks(docs: DataFrame, templates=(*PHRASES, *TEMPLATES), text_col: str = "text", words_col: str = "n_words", found_col: str = "license_blocks", order: list[str] | None = None) -> DataFrame:
    """``docs`` with their number of words, and an array of (label, start, size, share, phrase, places) of all blocks that hold a template's share of words.

    start and size in words; places are where a phrase stands word for word. Blocks of a template have twice its length, rounded up to a power of two, and begin at every
    multiple of that length, so that no text of its length is cut. Every document is scanned as a whole and by itself, without a shuffle: repeated
    rows, hot groups and null ids play no part, and a very long text costs by its length. A null or empty text has no words. An empty table gives an empty result. Columns of ``docs`` are kept;
    one named like the new ones is an error.
    """
    if clash := {words_col.lower(), found_col.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the table has columns {sorted(clash)} already; name others for the result")
    templates = tuple(templates)
    words = words_of(whole_text(text_col))
    own = docs.withColumn(found_col, words)
    own = own.withColumns({words_col: F.size(found_col).cast("long"), found_col: matches(F.col(found_col), templates, order or token_order(docs, templates, text_col))})
    label, size = [F.lit(t.label) for t in templates], [F.lit(float(len(set(t.text.split())))) for t in templates]
    phrase, steps = [F.lit(t.phrase) for t in templates], [F.lit(2 * step_of(t)) for t in templates]

    def told(x: Column) -> Column:
        k = x["template"]
        length = F.least(_chosen(steps, k), F.col(words_col).cast("int") - x["start"])
        return F.struct(_chosen(label, k).alias("label"), x["start"].alias("start"), length.alias("size"), (x["overlap"] / _chosen(size, k)).alias("share"), _chosen(phrase, k).alias("phrase"), x["places"].alias("places"), k.alias("template"))

    return own.withColumn(found_col, F.transform(found_col, told))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: words, places of phrases, labels of phrases, all labels, and a score: 1 with a phrase, else the greatest share of a template, else 0. Odd rows as in ``license_blocks``."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = license_blocks(own).select("doc_id", "n_words", "license_blocks")
    blocks = F.col("license_blocks")
    # Two blocks may hold one place; two phrases may not begin at one.
    places = F.array_distinct(F.flatten(F.transform(blocks, lambda x: F.transform(x["places"], lambda p: p * F.lit(len(PHRASES)) + x["template"]))))
    standing = F.filter(blocks, lambda x: F.size(x["places"]) > 0)
    others = F.filter(blocks, lambda x: ~x["phrase"])

    def joined(*labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*labels))), ",")

    label = lambda x: x["label"]
    found = found.select("doc_id", "n_words", places.alias("places"), F.transform(standing, label).alias("base"), F.transform(others, label).alias("more"), F.array_max(F.transform(others, lambda x: x["share"])).alias("share"))
    word = lambda place: F.floor(place / len(PHRASES))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        word(F.array_min("places")).alias("first_word"),
        word(F.array_max("places")).alias("last_word"),
        joined(F.col("base")).alias("base_labels"),
        joined(F.col("base"), F.col("more")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_TOKENS = _values((k, w) for k, t in enumerate(TEMPLATES) for w in sorted(set(t.text.split())))
_SIZES = _values((k, t.label, len(set(t.text.split())), needed(t), step_of(t)) for k, t in enumerate(TEMPLATES))
_STANDS = " or ".join("(label = '{}' and {})".format(t.label, " and ".join(f"w{n} = '{w}'" for n, w in enumerate(t.text.split()))) for t in PHRASES)

#: DuckDB over ``documents``: every block is held against every template, without filters.
ORACLE_SQL = rf"""
with listed as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as words from documents),
words as (select doc_id, unnest(words) as w0, unnest(range(len(words))) as i from listed),
tokens(t, w0) as (values {_TOKENS}),
sizes(t, label, size, need, step) as (values {_SIZES}),
held as (select doc_id, t, i // step - back as k, w0 from words join tokens using (w0) join sizes using (t), range(2) b(back) where i // step >= back),
blocks as (select doc_id, label, count(distinct w0) / size as share from held join sizes using (t) group by doc_id, t, k, label, size, need having count(distinct w0) >= need),
ahead as (select doc_id, i, w0, lead(w0, 1) over w as w1, lead(w0, 2) over w as w2, lead(w0, 3) over w as w3 from words window w as (partition by doc_id order by i)),
places as (select doc_id, i, label from ahead, (values {_values((t.label,) for t in PHRASES)}) v(label) where {_STANDS}),
base as (select doc_id, count(*) as n, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as labels from places group by doc_id),
more as (select doc_id, max(share) as share from blocks group by doc_id),
everything as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from blocks union all select doc_id, label from places) group by doc_id)
select doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_base, first_word, last_word, coalesce(base.labels, '') as base_labels, coalesce(everything.labels, '') as labels,
       case when n > 0 then 1.0::double else coalesce(share, 0)::double end as score
from listed left join base using (doc_id) left join more using (doc_id) left join everything using (doc_id)
"""
