"""Quality classifier: gated attention over a document's passages, learned from document labels."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

PASSAGE_WORDS = 64
HASHED = 24
SHAPES = 14
WIDTH = SHAPES + HASHED
_VOWELS = frozenset("aeiouyáéíóúàèêîôûäöü")


def passages(text: str | None) -> list[list[str]]:
    """Runs of 64 words; the last may be shorter. A text without words is one empty passage."""
    words = (text or "").split()
    return [words[k : k + PASSAGE_WORDS] for k in range(0, len(words), PASSAGE_WORDS)] or [[]]


def encode_passage(words: list[str]) -> np.ndarray:
    """Shares of character kinds, of repetition and of word shapes, and hashed closing character pairs, all between 0 and about 1."""
    out = np.zeros(WIDTH, np.float32)
    n = len(words)
    if not n:
        out[0] = 1.0
        return out
    text = " ".join(words)
    size = len(text)
    letters = sum(map(str.isalpha, text))
    upper = sum(map(str.isupper, text))
    digits = sum(map(str.isdigit, text))
    counts = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:]))
    longest = max(map(len, words))
    stops = text.count(".") + text.count(",")
    out[1] = letters / size
    out[2] = upper / max(letters, 1)
    out[3] = digits / size
    out[4] = (size - letters - digits - (n - 1) - stops) / size
    out[5] = stops / n
    out[6] = len(counts) / n
    out[7] = same / n
    out[8] = max(counts.values()) / n
    out[9] = min(size / n / 20, 2.0)
    out[10] = min(longest / 40, 2.0)
    out[11] = sum(len(w) == 1 and not w.isalnum() for w in words) / n
    out[12] = sum(c in _VOWELS for c in text.lower()) / max(letters, 1)
    out[13] = min(n / PASSAGE_WORDS, 1.0)
    for w in words:
        out[SHAPES + zlib.crc32(w[-2:].encode("utf-8", "surrogatepass")) % HASHED] += 1.0 / n
    return out


def bag_of(text: str | None) -> np.ndarray:
    return np.stack([encode_passage(p) for p in passages(text)])


class Model(NamedTuple):
    """h = tanh(x We + be); a = softmax(w . (tanh(h V) * sigmoid(h U))); score = sigmoid(c . sum a h + d)."""

    shift: np.ndarray
    scale: np.ndarray
    we: np.ndarray
    be: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    d: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _forward(p: Model, x: np.ndarray, starts: np.ndarray):
    h = np.tanh(x @ p.we + p.be)
    t, g = np.tanh(h @ p.v), _sigmoid(h @ p.u)
    e = (t * g) @ p.w
    lengths = np.diff(np.append(starts, len(x)))
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), lengths))
    a = e / np.repeat(np.add.reduceat(e, starts), lengths)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return h, t, g, a, z, lengths, _sigmoid(z @ p.c + p.d)


def scores(model: Model, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(score of each bag, attention weight of each passage)."""
    if not bags:
        return np.empty(0), np.empty(0)
    starts = np.cumsum([0, *[len(b) for b in bags[:-1]]])
    x = (np.concatenate(bags) - model.shift) / model.scale
    *_, a, _, _, y = _forward(model, x.astype(np.float64), starts)
    return y, a


def gradients(p: Model, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean weighted cross-entropy by we, be, v, u, w, c and d; ``x`` holds the scaled passages of all bags, which begin at ``starts``."""
    h, t, g, a, z, lengths, y = _forward(p, x, starts)
    dy = (y - labels) * weight / len(labels)
    dz = np.repeat(dy[:, None] * p.c[None, :], lengths, axis=0)
    da = (dz * h).sum(axis=1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), lengths))
    dtg = de[:, None] * p.w[None, :]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh = (dz * a[:, None] + dt @ p.v.T + dg @ p.u.T) * (1 - h * h)
    return [x.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ dy, dy.sum()]


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 30, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on the cross-entropy of document labels; the rarer label weighs more, up to three times. Without rows of both labels every score is the share of label 1, smoothed."""
    rng = np.random.default_rng(seed)
    one = float(labels.sum()) if len(labels) else 0.0
    base = np.log((one + 1) / (len(labels) - one + 1))
    shape = [(WIDTH, hidden), (hidden,), (hidden, gate), (hidden, gate), (gate,), (hidden,), ()]
    start = [rng.normal(0, 1 / np.sqrt(max(s[0], 1)), s) if len(s) == 2 else np.zeros(s) for s in shape]
    start[4] = rng.normal(0, 0.3, gate)
    if not len(labels) or one in (0.0, float(len(labels))):
        start[6] = np.array(base)
        return Model(np.zeros(WIDTH), np.ones(WIDTH), *start)
    start[5] = rng.normal(0, 0.3, hidden)
    everything = np.concatenate(bags)
    shift, scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
    bags = [((b - shift) / scale).astype(np.float64) for b in bags]
    share = one / len(labels)
    weight = np.where(labels == 1, min(3.0, max(1.0, (1 - share) / share)), min(3.0, max(1.0, share / (1 - share))))
    m, s = [np.zeros_like(q) for q in start], [np.zeros_like(q) for q in start]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            x = np.concatenate([bags[k] for k in own])
            starts = np.cumsum([0, *[len(bags[k]) for k in own[:-1]]])
            grads = gradients(Model(shift, scale, *start), x, starts, labels[own], weight[own])
            step += 1
            for k, q in enumerate(grads):
                q = q + 1e-4 * start[k]
                m[k] = 0.9 * m[k] + 0.1 * q
                s[k] = 0.999 * s[k] + 0.001 * q * q
                start[k] = start[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return Model(shift, scale, *start)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on ``sample_rows`` labelled documents in expectation, chosen by the id's hash among labelled rows outside the held-out fold.

    The sample of ids is what is broadcast (bounded by ``sample_rows``), and the passages' encodings of those documents are what reaches the driver.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out("doc_id"))
    share = min(1.0, sample_rows / max(known.count(), 1))
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 20)) < int(share * (1 << 20))).groupBy("doc_id").agg(F.max("label").alias("label"))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag_of(t).astype(np.float32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], ["doc_id", "label", "bag"])

    kind = own.schema["doc_id"].dataType.simpleString()
    rows = own.select("doc_id", "label", "text").mapInArrow(work, f"doc_id {kind}, label int, bag binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["bag"])))
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, WIDTH) for r in rows], np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_passages, top_passage, top_weight): the score of every whole text, and the passage that weighed most.

    Null and empty texts are one empty passage and get a score as well. Rows are scored one by one, nothing is shuffled; repeated rows give
    repeated rows, an empty table an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bags = [bag_of(t) for t in part.column(1).to_pylist()]
                y, a = scores(shared.value, bags)
                top, weight, k = [], [], 0
                for b in bags:
                    own = a[k : k + len(b)]
                    top.append(int(own.argmax()))
                    weight.append(float(own.max()))
                    k += len(b)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(y.tolist(), pa.float64()), pa.array([len(b) for b in bags], pa.int64()), pa.array(top, pa.int64()), pa.array(weight, pa.float64())],
                    ["doc_id", "score", "n_passages", "top_passage", "top_weight"],
                )

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double, n_passages long, top_passage long, top_weight double")


def quality_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    found = score(docs, train(docs, labels))
    predicted = (F.col("score") >= threshold).cast("int")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", predicted.alias("predicted"), "n_passages", "top_passage", "top_weight")
