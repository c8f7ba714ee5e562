"""SentencePiece encoding and decoding by shortest paths of a weighted transducer."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) pairs of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class Transducer:
    """Normaliser, pieces and byte fallback, compiled from a SentencePiece model file.

    Arcs: every piece reads its own characters; a character that no piece reads goes through its UTF-8 bytes. States of the
    composition with an input are (position, last piece). In a unigram model an arc weighs minus the piece's
    score, and all arcs may follow each other. In a BPE model the order of merges is a restriction on neighbours:
    a sequence of pieces is the BPE segmentation of its text exactly if each pair of neighbours is that of its own text. So
    an arc weighs 1 where it may follow the last piece, and infinity elsewhere, and one path of finite weight is left.
    The shortest path in the tropical semiring (min, +) is the segmentation in both cases.

    No piece reaches across a pair of characters that stand together in no piece; inputs are cut there, which leaves
    the shortest path as it is, bounds the lattice, and lets results of recurring words be kept (in two tables of bounded size, the
    older of which is dropped when the newer is full).
    """

    def __init__(self, model: bytes, most: int = 300_000) -> None:
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds: list[int] = []
        self.kind, self.prefix, self.squeeze, self.escape = UNIGRAM, True, True, True
        byte_fallback = False
        for number, value in _fields(model):
            if number == 1:
                part = dict(_fields(value))
                self.pieces.append(part[1].decode())
                self.scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                kinds.append(part.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                self.kind, byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("only models with the identity normaliser are supported")
                self.prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"unsupported model type {self.kind}")
        self.vocabulary = {p: k for k, p in enumerate(self.pieces) if kinds[k] in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if kinds[k] == BYTE} if byte_fallback else {}
        self.byte_of = {k: b for b, k in self.bytes.items()}
        self.silent = {k for k in range(len(kinds)) if kinds[k] == 3}
        self.unknown = kinds.index(UNKNOWN)
        self.trie: dict = {}
        for piece, k in self.vocabulary.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = k
        self.together = {p[k : k + 2] for p in self.vocabulary for k in range(len(p) - 1)}
        self.by_word = not any(p[1] == SPACE and p[0] != SPACE for p in self.together)
        self.least = min(self.scores) - 10.0
        self.follows: dict[int, bool] = {}
        self.kept: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.most = most
        self.spelt = [bytes([self.byte_of[k]]) if k in self.byte_of else b"" if k in self.silent else p.replace(SPACE, " ").encode() for k, p in enumerate(self.pieces)]
        self.is_byte = [int(k in self.byte_of) for k in range(len(self.pieces))]

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def merged(self, text: str) -> list[str]:
        """Pieces after merging neighbours, best score first, leftmost first among equals. Used on short texts, to learn which pieces may stand together."""
        parts = list(text)
        while True:
            best = None
            for k in range(len(parts) - 1):
                piece = self.vocabulary.get(parts[k] + parts[k + 1])
                if piece is not None and (best is None or self.scores[piece] > best[0]):
                    best = (self.scores[piece], k)
            if best is None:
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def may_follow(self, last: int, piece: int) -> bool:
        key = (last + 1) * len(self.pieces) + piece
        found = self.follows.get(key)
        if found is None:
            own = [self.pieces[piece]] if last < 0 else [self.pieces[last], self.pieces[piece]]
            found = self.follows[key] = self.merged("".join(own)) == own
        return found

    @cached_property
    def steps(self) -> dict:
        """The trie of pieces with each character leading to (next characters, the piece that ends there or -1)."""

        def of(node: dict) -> dict:
            return {c: (of(below), below.get("", -1)) for c, below in node.items() if c}

        return of(self.trie)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.vocabulary), default=1)

    def arcs(self, text: str, at: int) -> list[tuple[int, int]]:
        """(end, piece) of the arcs that leave a position, shortest first. A character that no piece reads has an arc of its own, -2 - its code."""
        out, steps = [], self.steps
        for end, c in enumerate(text[at : at + self.longest], at + 1):
            found = steps.get(c)
            if found is None:
                break
            steps, piece = found
            if piece >= 0:
                out.append((end, piece))
        if (not out or out[0][0] > at + 1) and text[at] not in self.vocabulary:
            out.insert(0, (at + 1, -2 - ord(text[at])))
        return out

    def lightest(self, text: str) -> list[int]:
        """Shortest path for arc weights that do not depend on the arc before: positions are states, in order."""
        n = len(text)
        weight, last, back = [float("inf")] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        weight[0] = 0.0
        for at in range(n):
            if weight[at] == float("inf"):
                continue
            for end, piece in self.arcs(text, at):
                cost = weight[at] - (self.scores[piece] if piece >= 0 else self.least)
                if cost < weight[end]:
                    weight[end], last[end], back[end] = cost, piece, at
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        out.reverse()
        return out

    def finite(self, text: str) -> list[int]:
        """The path of finite weight where neighbours are restricted. The composition is expanded lazily, longest arcs first; as a position's
        prefix has one segmentation only, a position that led nowhere is not entered again, so the work is linear in the lattice."""
        n, size, follows = len(text), len(self.pieces), self.follows
        path: list[int] = []
        places = [0]
        open_arcs = [self.arcs(text, 0)]
        dead: set[int] = set()
        while places[-1] < n:
            last = path[-1] if path else -1
            base = (last + 1) * size if last >= 0 else 0
            own = open_arcs[-1]
            while own:
                end, piece = own.pop()
                if end in dead:
                    continue
                if piece >= 0:
                    may = follows.get(base + piece)
                    if may is None:
                        may = self.may_follow(last if last >= 0 else -1, piece)
                    if not may:
                        continue
                path.append(piece)
                places.append(end)
                open_arcs.append(self.arcs(text, end) if end < n else [])
                break
            else:
                open_arcs.pop()
                dead.add(places.pop())
                path.pop()
        return path

    def shortest(self, text: str) -> list[int]:
        """Piece ids of the shortest path over a text without cuts; negative ids are characters that no piece reads."""
        return self.finite(text) if self.kind == BPE else self.lightest(text)

    def _ids(self, part: str) -> list[int]:
        """Ids of a part of a text, cut where no piece reaches across."""
        ids, at, n, together = [], 0, len(part), self.together
        for k in range(1, n + 1):
            if k == n or part[k - 1 : k + 1] not in together:
                piece = part[at:k]
                own = self.kept.get(piece)
                if own is None:
                    own = []
                    for x in self.shortest(piece):
                        if x >= 0:
                            own.append(x)
                        elif self.bytes:
                            own += [self.bytes[b] for b in chr(-2 - x).encode("utf-8", "surrogatepass")]
                        else:
                            own.append(self.unknown)
                    if at and len(piece) <= 64:
                        self.kept[piece] = own
                ids += own
                at = k
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Piece ids of a whole text; none for a null or empty one."""
        text = self.normalise(text or "")
        if not text:
            return []
        if not self.by_word:
            return self._ids(text)
        # Words with their space mark; further marks of a run of spaces go in front of the mark of the next word.
        words = text.split(SPACE)
        marked = [SPACE + w for w in words[1:]]
        if "" in words[1:]:
            marked, lead = [], ""
            for w in words[1:]:
                lead += SPACE
                if w:
                    marked.append(lead + w)
                    lead = ""
            if lead:
                marked.append(lead)
        if words[0]:
            marked.insert(0, words[0])
        if len(self.kept) > self.most:
            self.older, self.kept = self.kept, {}
        kept, older, passing = self.kept, self.older, {}
        for w in set(marked):
            if w not in kept:
                ids = older.get(w)
                if ids is None:
                    ids = self._ids(w)
                (kept if len(w) <= 64 else passing)[w] = ids
        if passing:
            return [k for w in marked for k in (kept[w] if w in kept else passing[w])]
        return list(chain.from_iterable(map(kept.__getitem__, marked)))

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def compiled(model: bytes) -> Transducer:
    """One transducer for each worker process and model."""
    return held(("pieces", hash(model)), lambda: Transducer(model))


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids, round_trip) of every whole text; the text decoded again equals it where round_trip holds.

    The model file is read by the driver and sent with the tasks: its size is bounded by the vocabulary. Rows are encoded one by one, in batches; nothing
    is shuffled. Null and empty texts have no tokens and round_trip true. A text that holds the model's own space mark decodes to spaces, so
    round_trip is false for it. Repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids, bytes_, same = [], [], []
                for text in part.column(1).to_pylist():
                    own = fst.encode(text)
                    ids.append(own)
                    bytes_.append(sum(map(fst.is_byte.__getitem__, own)))
                    same.append(fst.decode(own) == (text or ""))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(bytes_, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "n_byte_tokens", "ids", "round_trip"],
                )

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_byte_tokens long, ids array<int>, round_trip boolean")


def decode_column(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str = MODEL_PATH) -> DataFrame:
    """(doc_id, text) from piece ids; null ids give null."""
    model = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = compiled(model.value)
        for batch in batches:
            texts = [None if x is None else fst.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    own = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return own.mapInArrow(work, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")
