"""Spelling variant grouping: words at distance one of each other, found by holding each word's Levenshtein automaton against shards of a trie.

The vocabulary is cut into shards of neighbouring words, each a trie in flat arrays. Shards are broadcast in rounds of a fixed size, and
every word's automaton is followed through every shard depth-first: a state with its one edit spent is walked to its end before the unspent path goes on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CRC, CRC_TABLE, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the contract: least length and count of a word, how much more frequent a form is, which runs are damaged.
LENGTH, COUNT, TIMES, DAMAGED = 6, 5, 5, 199
#: Letters of a shard, and bytes of the shards that are broadcast at once.
SHARD_LETTERS, ROUND_BYTES = 1 << 20, 32 << 20
_SHIFT = 21


def damaged_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): each run of letters, A-Z lower-cased, from LENGTH code points on. If DAMAGED divides the crc32 of ``id:run``, the run lacks one code point; a null id is the empty text."""
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(rf"[a-zÀ-ÿ]{{{LENGTH},}}"), 0)
    own = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    own = own.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return own.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LENGTH)


def word_counts(words: DataFrame, least: int = COUNT) -> DataFrame:
    """(word, n) of words that occur ``least`` times, counted before they are shuffled."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# --- Tries -------------------------------------------------------------------------------------------------------


class Trie(NamedTuple):
    """Nodes in breadth-first order, the root being 0. keys: parent and letter of nodes 1 and later, ascending, so that a child is found by its key. first: place of a node's first child in keys. rank: place of the node's word, or -1. n and words by rank."""

    keys: np.ndarray
    first: np.ndarray
    rank: np.ndarray
    n: np.ndarray
    words: list[str]


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, where each begins, and its length."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64), np.cumsum(sizes) - sizes, sizes


def flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rank) of ascending, distinct words, built level by level from the neighbours that differ."""
    codes, starts, sizes = _letters(words)
    node, keys, ranks = np.zeros(len(words), np.int64), [], [np.full(1, -1, np.int32)]
    which, depth, nodes = np.arange(len(words)), 0, 1
    while (which := which[sizes[which] > depth]).size:
        key = node[which] << _SHIFT | codes[starts[which] + depth]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        node[which] = nodes - 1 + np.cumsum(new)
        keys.append(key[new])
        nodes += len(keys[-1])
        depth += 1
        rank = np.full(len(keys[-1]), -1, np.int32)
        ended = which[sizes[which] == depth]
        rank[node[ended] - (nodes - len(rank))] = ended
        ranks.append(rank)
    return np.concatenate(keys), np.concatenate(ranks)


def opened(keys: bytes, rank: bytes, n: bytes, words: list[str]) -> Trie:
    own = np.frombuffer(keys, np.int64)
    first = np.searchsorted(own, np.arange(len(own) + 2, dtype=np.int64) << _SHIFT)
    return Trie(own, first, np.frombuffer(rank, np.int32), np.frombuffer(n, np.int64), words)


def _child(trie: Trie, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The child by this letter, and whether there is one."""
    key = node << _SHIFT | letter
    at = np.searchsorted(trie.keys, key)
    return at + 1, trie.keys[np.minimum(at, len(trie.keys) - 1)] == key


def near(trie: Trie, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, rank): each word of the trie at distance one of each given one, once.

    Of equal letters in a row only the last is deleted, and no letter is inserted in front of its like, so that no two ways lead to one neighbour.
    """
    codes, starts, sizes = _letters(words)
    codes = np.append(codes, -1)
    found_word, found_rank = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]

    def to_the_end(word: np.ndarray, node: np.ndarray, at: np.ndarray) -> None:
        """States without an edit left: letters must agree."""
        while word.size:
            over = at == sizes[word]
            rank = trie.rank[node[over]]
            found_word.append(word[over][rank >= 0])
            found_rank.append(rank[rank >= 0])
            word, node, at = word[~over], node[~over], at[~over]
            child, there = _child(trie, node, codes[starts[word] + at])
            word, node, at = word[there], child[there], at[there] + 1

    word, node, depth = np.arange(len(words)), np.zeros(len(words), np.int64), 0
    while word.size:
        inside = sizes[word] > depth
        letter = np.where(inside, codes[starts[word] + np.where(inside, depth, 0)], -1)
        last = inside & ((sizes[word] == depth + 1) | (codes[starts[word] + np.where(inside, depth + 1, 0)] != letter))
        many = trie.first[node + 1] - trie.first[node]
        row = np.repeat(np.arange(word.size), many)
        place = np.arange(row.size) - np.repeat(np.cumsum(many) - many, many) + trie.first[node][row]
        other = (trie.keys[place] & (1 << _SHIFT) - 1) != letter[row]
        row, place = row[other], place[other]
        put = inside[row]
        to_the_end(
            np.concatenate((word[last], word[row], word[row[put]])),
            np.concatenate((node[last], place + 1, place[put] + 1)),
            np.concatenate((np.full(last.sum(), depth + 1), np.full(row.size, depth), np.full(put.sum(), depth + 1))),
        )
        child, there = _child(trie, node[inside], letter[inside])
        word, node, depth = word[inside][there], child[there], depth + 1
    return np.concatenate(found_word), np.concatenate(found_rank)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (word, n) in order: one row for each shard."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    words: list[str] = []
    counts: list[int] = []
    weight = 0

    def shard() -> pa.RecordBatch:
        keys, rank = flat(words)
        row = {"shard": [number], "keys": [keys.tobytes()], "rank": [rank.tobytes()], "n": [np.array(counts, np.int64).tobytes()], "words": [words]}
        return pa.RecordBatch.from_pydict(row | {"bytes": [keys.nbytes + rank.nbytes]}, schema=pa.schema([("shard", pa.int64()), ("keys", pa.binary()), ("rank", pa.binary()), ("n", pa.binary()), ("words", pa.list_(pa.string())), ("bytes", pa.int64())]))

    for batch in batches:
        for word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words.append(word)
            counts.append(n)
            weight += len(word)
            if weight >= SHARD_LETTERS:
                yield shard()
                words, counts, weight, number = [], [], 0, number + 1
    if words:
        yield shard()


_SHARD = "shard long, keys binary, rank binary, n binary, words array<string>, bytes long"
_FOUND = "word string, near long, best struct<minus: long, form: string>"


def _matched(shards) -> object:
    """(word, near, best) of the words that have neighbours in the broadcast shards."""
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best", pa.struct([("minus", pa.int64()), ("form", pa.string())]))])

    def matched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [opened(*s) for s in shards.value]
        for batch in batches:
            words = batch.column(0).to_pylist()
            count = np.zeros(len(words), np.int64)
            best: dict[int, tuple[int, str]] = {}
            for trie in tries if words else ():
                word, rank = near(trie, words)
                count += np.bincount(word, minlength=len(words))
                order = np.lexsort((rank, -trie.n[rank], word))
                word, rank = word[order], rank[order]
                heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if word.size else ()
                for k in heads:
                    found = (-int(trie.n[rank[k]]), trie.words[rank[k]])
                    w = int(word[k])
                    best[w] = min(best.get(w, found), found)
            rows = sorted(best)
            yield pa.RecordBatch.from_arrays([pa.array([words[w] for w in rows], pa.string()), pa.array(count[rows] if rows else [], pa.int64()), pa.array([{"minus": best[w][0], "form": best[w][1]} for w in rows], schema.field(2).type)], schema=schema)

    return matched


def neighbours(counts: DataFrame) -> DataFrame:
    """(word, n, n_near, best) of each word of ``counts(word, n)``, its words distinct and not null: how many words are at distance one, and of these the most frequent one, of equals the first in order.

    Shards are built where sorted ranges of words lie and broadcast in rounds of ROUND_BYTES and one shard; each round goes over all words, and its results are written before the next.
    A task holds the round's shards, as flat arrays, and a batch of words. An empty table gives an empty result.
    """
    spark = counts.sparkSession
    words = stored(counts.select("word", "n"))
    shards = stored(words.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(_shards, _SHARD))
    rounds: list[list[int]] = []
    room = 0
    for shard, size in shards.select("shard", "bytes").orderBy("shard").collect():
        if size > room:
            rounds.append([])
            room = ROUND_BYTES
        rounds[-1].append(shard)
        room -= size
    out = words.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("struct<minus: long, form: string>").alias("best"))
    for own in rounds:
        sent = spark.sparkContext.broadcast([tuple(r) for r in shards.where(F.col("shard").isin(own)).select("keys", "rank", "n", "words").collect()])
        found = stored(words.select("word").mapInArrow(_matched(sent), _FOUND))
        sent.destroy()
        out = out.unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "near", "best"))
    return out.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms(word, form)``: the last word of each chain of forms, by pointer doubling. A chain grows by a factor at every step and so has no cycle, and is as long as a logarithm of the counts."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not step.where("moved").limit(1).count():
            return step.select("word", "root")
        now = step.select("word", "root")


def spelling_variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for ``counts(word, n)``, each word once.

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form is its most frequent near word, of equals the first in
    code-point order, if that occurs at least ``times`` as often; its root is the last of the forms that follow each other. Null words are ignored; an empty table
    gives an empty result; other columns are ignored. Work is by word and not by group, so that frequent words cost no more than others.
    """
    found = neighbours(counts.where("word is not null"))
    frequent = -F.col("best.minus") >= times * F.col("n")
    found = stored(found.select("word", "n", "n_near", F.when(frequent, F.col("best.form")).alias("form"), F.when(frequent, -F.col("best.minus")).alias("form_n")))
    chains = roots(found.where("form is not null"))
    return found.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spelling variants among the words of all texts, some of them damaged by ``damaged_runs``.

    Null, empty and letterless texts have no words; long texts are whole; repeated rows count each; a null id is the empty text; an empty table gives an empty result; other
    columns are ignored.
    """
    return spelling_variants(word_counts(damaged_runs(docs, id_col, text_col)))


#: DuckDB over ``documents``. Words are near if one lacks a code point of the other, or both lack one at the same place and agree otherwise.
ORACLE_SQL = rf"""
with recursive {CRC_TABLE},
runs as (
  select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') as run from documents),
hashed as (select run, k, {CRC.format("id || ':' || run")} as h from (select id, run, count(*) as k from runs where length(run) >= {LENGTH} group by all), crc_table),
words as materialized (
  select word, sum(k)::bigint as n from (select k, case when h % {DAMAGED} = 0 then substring(run, 1, (h % length(run))::int) || substring(run, (h % length(run))::int + 2) else run end as word from hashed)
  where length(word) >= {LENGTH} group by word having sum(k) >= {COUNT}),
less as materialized (select word, n, i, substring(word, 1, i::int) || substring(word, i::int + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)),
pairs as (
  select a.word, b.word as other, b.n as m from less a join words b on a.rest = b.word
  union select b.word, a.word, a.n from less a join words b on a.rest = b.word
  union select a.word, b.word, b.n from less a join less b on a.i = b.i and a.rest = b.rest and a.word <> b.word),
best as (select word, count(*) as n_near, arg_max(other, (m, -place)) as other, max(m) as m from (select *, row_number() over (order by encode(other)) as place from pairs) group by word),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= {TIMES} * n then other end as form, case when m >= {TIMES} * n then m end as form_n from words w left join best using (word)),
chain(word, root) as (select word, word from forms union all select c.word, f.form from chain c join forms f on f.word = c.root where f.form is not null),
last as (select c.word, c.root from chain c join forms f on f.word = c.root where f.form is null)
select word, form, root, n, n_near, form_n from forms join last using (word)
"""
