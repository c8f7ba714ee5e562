"""Language identification by unigram piece models, each text's probability summed over all segmentations."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, held_out
from .sentencepiece_fst import MODEL_PATH, SPACE, Transducer, read_model

#: Runs of letters, and of numerals that are no decimal digits; the latter are taken out of a run that holds any.
_LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
#: Longest word, with its mark, whose sums are taken beside those of others.
SHORT = 40
#: Probability of a letter that is no piece.
STRANGE = 1e-8


class Model(NamedTuple):
    languages: list[str]
    #: Probabilities of each piece, one for each language.
    pieces: dict[str, list[float]]


def vocabulary(model_path: str) -> set[str]:
    """The public vocabulary's pieces that read lower-case letters, with or without the word mark."""
    pieces = Transducer(read_model(model_path)).vocabulary
    return {p for p in pieces if (bare := p.lstrip(SPACE)) == bare.lower() and p.count(SPACE) <= 1 and (not bare or _LETTERS.fullmatch(bare))}


def words_of(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L) in lower case; everything else says nothing of the language."""
    found = _LETTERS.findall(text.lower()) if text else []
    if text and not text.isascii() and not all(map(str.isalpha, found)):
        found = [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]
    return found


class Packed(NamedTuple):
    """A model as tasks take it: pieces, and a row of probabilities for each."""

    languages: list[str]
    names: list[str]
    chances: np.ndarray


def packed(model: Model) -> Packed:
    return Packed(model.languages, list(model.pieces), np.array(list(model.pieces.values()), float).reshape(len(model.pieces), len(model.languages)))


_NOTHING: dict = {}


class Scorer:
    """Log-probabilities of words under every language: the forward sum over all segmentations. Results are kept in a table of bounded size."""

    def __init__(self, model: Model | Packed, most: int = 80_000) -> None:
        self.languages, self.names, chances = model if isinstance(model, Packed) else packed(model)
        self.most = most
        trie: dict = {}
        for number, piece in enumerate(self.names):
            node = trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = number
        self.chances = np.concatenate([chances, np.full((1, len(self.languages)), STRANGE)])
        self.steps = self._compiled(trie)
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.languages)))
        self.older: tuple[dict[str, int], np.ndarray] = ({}, self.table)

    def numbered_arcs(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, number) of the pieces in a text; -1 for a letter that is none."""
        out, n = [], len(text)
        for at in range(n):
            alone, steps = False, self.steps
            for end in range(at + 1, n + 1):
                found = steps.get(text[end - 1])
                if found is None:
                    break
                steps, piece = found
                if piece >= 0:
                    out.append((at, end, piece))
                    alone = alone or end == at + 1
            if not alone:
                out.append((at, at + 1, -1))
        return out

    def arcs(self, text: str) -> list[tuple[int, int, str]]:
        return [(at, end, self.names[piece] if piece >= 0 else "") for at, end, piece in self.numbered_arcs(text)]

    def _compiled(self, node: dict) -> dict:
        """The trie with each character leading to (next characters, number of the piece that ends there or -1). The one given is used up on the way, so that the two are never whole at once."""
        out = {}
        while node:
            c, below = node.popitem()
            piece = below.pop("", -1)
            out[c] = (self._compiled(below) if below else _NOTHING, piece)
        return out

    def forward(self, texts: list[str], most: int = 4096) -> np.ndarray:
        """Sums of many short texts, a row of logarithms each. The arcs from one place to another are taken for all texts at once.

        Sums are plain ones, unless one of them gets so small that it loses digits or vanishes: then all of its text are worked out again with scaling, as for long texts.
        """
        k, strange = len(self.languages), len(self.names)
        out = np.empty((len(texts), k))
        for low in range(0, len(texts), most):
            part = texts[low : low + most]
            sizes = np.array([len(t) if len(t) <= SHORT else 0 for t in part])
            arcs: list[dict[int, tuple[list[int], list[int]]]] = [{} for _ in range(SHORT)]
            for i, t in enumerate(part):
                for at in range(sizes[i]):
                    here, steps, alone = arcs[at], self.steps, False
                    for end in range(at + 1, sizes[i] + 1):
                        found = steps.get(t[end - 1])
                        if found is None:
                            break
                        steps, piece = found
                        if piece >= 0:
                            own = here.get(end) or here.setdefault(end, ([], []))
                            own[0].append(i)
                            own[1].append(piece)
                            alone = alone or end == at + 1
                    if not alone:
                        own = here.get(at + 1) or here.setdefault(at + 1, ([], []))
                        own[0].append(i)
                        own[1].append(strange)
            alpha = np.zeros((SHORT + 1, len(part), k))
            alpha[0] = 1.0
            for at, here in enumerate(arcs):
                for end, (who, piece) in here.items():
                    alpha[end, who] += alpha[at, who] * self.chances[piece]
            logs = np.log(np.maximum(alpha[sizes, np.arange(len(part))], 1e-300))
            for i in np.flatnonzero((sizes == 0) | (logs.min(axis=1, initial=0.0) <= -650.0)).tolist():
                logs[i] = self._sums(part[i])
            out[low : low + len(part)] = logs
        return out

    def _sums(self, text: str) -> list[float]:
        """Sums scaled for each language on its own where they get small, so that words do not vanish."""
        k, n = len(self.languages), len(text)
        alpha = [[0.0] * k for _ in range(n + 1)]
        alpha[0] = [1.0] * k
        logs = [0.0] * k
        langs = range(k)
        at_now = 0
        for at, end, part in self.numbered_arcs(text):
            if at != at_now:
                at_now = at
                for j in langs:
                    if alpha[at][j] < 1e-150:
                        for row in alpha[at : at + 40]:
                            row[j] *= 1e150
                        logs[j] -= 345.38776394910684
            here, p, there = alpha[at], self.chances[part].tolist(), alpha[end]
            for j in langs:
                there[j] += here[j] * p[j]
        return [math.log(max(a, 1e-300)) + x for a, x in zip(alpha[n], logs, strict=True)]

    def word(self, word: str) -> list[float]:
        return self.forward([SPACE + word])[0].tolist()

    def learn(self, words: list[str]) -> None:
        """Take words into the table of results. When the newer table is full it becomes the older one, from which words in use are taken over."""
        if len(self.index) > self.most:
            self.older, self.index, self.table = (self.index, self.table), {}, np.zeros((1024, len(self.languages)))
        index, (old, old_table) = self.index, self.older
        fresh = [w for w in dict.fromkeys(words) if w not in index]
        if not fresh:
            return
        size = len(index) + len(fresh)
        if size > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(size, 2 * len(self.table)) - len(self.table), self.table.shape[1]))])
        rows = self.table[len(index) : size]
        known = np.array([old.get(w, -1) for w in fresh])
        rows[known >= 0] = old_table[known[known >= 0]]
        rows[known < 0] = self.forward([SPACE + w for w, at in zip(fresh, known.tolist()) if at < 0])
        index.update(zip(fresh, range(len(index), size)))

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its posterior under equal priors) of each text."""
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        counts = [Counter(words_of(t)) for t in texts]
        self.learn([w for c in counts for w in c])
        out = []
        for c in counts:
            if not c:
                out.append((UNDETERMINED, 0.0))
                continue
            rows = np.fromiter(map(self.index.__getitem__, c), np.int64, len(c))
            total = np.fromiter(c.values(), np.float64, len(c)) @ self.table[rows]
            best = int(total.argmax())
            out.append((self.languages[best], float(1.0 / np.exp(np.maximum(total - total[best], -700.0)).sum())))
        return out


def _plus(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    high, low = (a, b) if a > b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def expectation(counts: dict[str, float], scorer: Scorer, j: int) -> dict[str, float]:
    """Expected piece counts of one language over all segmentations of its words, by forward and backward sums; those of long words are sums of logarithms, as they would vanish."""
    out: dict[str, float] = {}
    chances, number = scorer.chances[:, j].tolist(), scorer.names
    for word, n in counts.items():
        text = SPACE + word
        arcs = [(a, e, number[p] if p >= 0 else "", chances[p]) for a, e, p in scorer.numbered_arcs(text)]
        size = len(text)
        if size > 30:
            arcs = [(a, e, p, math.log(w)) for a, e, p, w in arcs]
            ahead, behind = [0.0] + [-math.inf] * size, [-math.inf] * size + [0.0]
            for a, e, _, w in arcs:
                ahead[e] = _plus(ahead[e], ahead[a] + w)
            for a, e, _, w in reversed(arcs):
                behind[a] = _plus(behind[a], behind[e] + w)
            share = [math.exp(ahead[a] + w + behind[e] - ahead[size]) * n for a, e, _, w in arcs]
        else:
            ahead, behind = [1.0] + [0.0] * size, [0.0] * size + [1.0]
            for a, e, _, w in arcs:
                ahead[e] += ahead[a] * w
            for a, e, _, w in reversed(arcs):
                behind[a] += behind[e] * w
            scale = n / ahead[size]
            share = [ahead[a] * w * behind[e] * scale for a, e, _, w in arcs]
        for (_, _, p, _), x in zip(arcs, share, strict=True):
            if p:
                out[p] = out.get(p, 0.0) + x
    return out


def train(docs: DataFrame, model_path: str = MODEL_PATH, sample_rows: int = 200, rounds: int = 3, prior: float = 200.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", all_rows: bool = False) -> Model:
    """Piece probabilities of every language by expectation maximisation.

    Learns from rows outside the held-out fold whose language is known and whose text has a letter. Of each language the ``sample_rows`` different texts of the least
    hashes are taken, or all if there are fewer, so that no language is lost to a text that many rows share; this bounds what reaches the driver: their distinct words with counts. Each language's counts
    are smoothed with ``prior`` pieces drawn from the languages' mean, so no piece of the vocabulary has probability 0.
    """
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    known = known.where(F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    if not all_rows:
        known = known.where(~held_out("doc_id"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang", "h").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], {})
    # Twice as many as asked for lie under the bound, so that the least of them are those of the whole language; with fewer texts all do.
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, 2 * sample_rows / n)))])
    under = known.where(F.pmod(F.col("h"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    under = under.groupBy("lang", "h").agg(F.first("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 20)), "h"))
    picked = under.withColumn("rank", rank).where(F.col("rank") <= sample_rows)
    words = picked.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("word"))
    by_lang: dict[str, dict[str, float]] = {lang: {} for lang in sizes}
    for r in words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).collect():
        by_lang[r["lang"]][r["word"]] = r["n"]
    languages = sorted(lang for lang, w in by_lang.items() if w)
    vocab = vocabulary(model_path)
    # The first round weighs all segmentations by their number of pieces alone.
    flat = {p: [1e-3] * len(languages) for p in vocab}
    model = Model(languages, flat)
    for _ in range(rounds):
        scorer = Scorer(model)
        found = [expectation(by_lang[lang], scorer, j) for j, lang in enumerate(languages)]
        sums = [sum(x.values()) or 1.0 for x in found]
        model = Model(languages, {})
        for p in vocab:
            own = [x.get(p, 0.0) for x in found]
            mean = (sum(c / s for c, s in zip(own, sums, strict=True)) / len(own) + 1e-7) / (1 + 1e-7 * len(vocab))
            model.pieces[p] = [(c + prior * mean) / (s + prior) for c, s in zip(own, sums, strict=True)]
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text; ``und`` with score 0 for a null text and one without letters.

    Ties go to the language that sorts first. Rows are scored one by one, nothing is shuffled; repeated rows give repeated
    rows, an empty table an empty result, and other columns are ignored. Without any training row every text is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(packed(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = scorer.texts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def predictor(spark: SparkSession, model: Model):
    """A function of a text column that gives struct(lang_pred, score), for use within a larger select."""
    shared = spark.sparkContext.broadcast(packed(model))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = shared.value
        scorer, own = held(("language", id(model)), lambda: Scorer(model)), texts.tolist()
        return pd.DataFrame([x for at in range(0, len(own), 500) for x in scorer.texts(own[at : at + 500])], columns=["lang_pred", "score"])

    return predict


def language_report(docs: DataFrame, model_path: str = MODEL_PATH) -> DataFrame:
    found = identify(docs, train(docs, model_path))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
