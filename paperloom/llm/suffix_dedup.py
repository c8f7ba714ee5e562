"""Repeated byte strings over a whole corpus: sparse anchors find the places, suffix arrays and longest previous factors settle them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, id_numbers, stored, whole_text
from .minhash import mix

LENGTH = 400
GRAM = 64
#: Positions of one piece of a text; longer texts are worked on in overlapping pieces.
PIECE = 1 << 20
#: Most distinct surroundings of an anchor that one suffix array takes; runs of more of them are split into blocks of windows.
GROUP = 512
#: Windows of one block, level by level.
BLOCKS = (96, 16, 4, 1)
#: Bytes of neighbouring groups that share one suffix array.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    n = PIECE + LENGTH + 8
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def gram_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 8-byte and all GRAM-byte strings, by doubling."""
    h, size = data.astype(np.uint64), 1
    while size < 8:
        h = h[:-size] << np.uint64(8 * size) | h[size:]
        size *= 2
    h8 = h = mix(h)
    while size < GRAM:
        h = mix(h[:-size] * np.uint64(0xD6E8FEB86659FD93) + h[size:])
        size *= 2
    return h8, h


def _span_hashes(h8: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte string [start, end), from sums over its 8-byte strings."""
    up, down = _powers()
    sums = np.zeros(len(h8) + 1, np.uint64)
    np.cumsum(h8 * up[: len(h8)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends - 7] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def runs(data: bytes, length: int = LENGTH) -> list[np.ndarray]:
    """Runs of windows of ``length`` bytes that choose the same anchor.

    Every window chooses its GRAM-byte string of least hash, the leftmost among equals. The choice depends on the window's bytes
    alone, so equal windows lie at the same place around equal anchors. Returns (anchor hash, hash of the run's bytes and anchor place, first window, number of windows, anchor's offset in the run).
    """
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    wide = length - GRAM + 1
    # A piece holds PIECE - length + 1 windows, and the next piece starts with the window after them.
    for base in range(0, len(data) - length + 1, PIECE - length + 1):
        piece = np.frombuffer(data[base : base + PIECE], np.uint8)
        h8, h = gram_hashes(piece)
        windows = len(piece) - length + 1
        keyed = (h & ~np.uint64(PIECE - 1)) | np.arange(len(h), dtype=np.uint64)
        padded = np.full(-(-len(keyed) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(keyed)] = keyed
        blocks = padded.reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:windows], ahead[wide - 1 : wide - 1 + windows]) & np.uint64(PIECE - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
        count = np.diff(np.append(first, windows))
        place = anchor[first]
        offset = place - first
        spans = _span_hashes(h8, first, first + count - 1 + length)
        for k, x in enumerate((h[place], mix(spans + offset.astype(np.uint64) * np.uint64(_BASE)), first + base, count, offset)):
            out[k].append(x)
    return [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]


def _emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["k1", "k2", "ord", "n", "h", "rh", "s", "w", "a"]
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            keys = [part.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            found = [runs(t.encode("utf-8", "surrogatepass")) for t in part.column(4).to_pylist()]
            sizes = [len(x[0]) for x in found]
            columns = [np.repeat(k, sizes) for k in keys] + [np.concatenate([x[k] for x in found]).astype(np.uint64).view(np.int64) if k < 2 else np.concatenate([x[k] for x in found]).astype(np.int64) for k in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


# --- suffix arrays ----------------------------------------------------------------------------------------------


def suffix_ranks(symbols: np.ndarray, least: int) -> list[tuple[int, np.ndarray]]:
    """(size, rank of the string of that size at every position) for sizes 4, 8, ... until strings of ``least`` symbols or all suffixes are told apart. Symbols are below 2 ** 16; what is past the end is smaller than all."""
    n = len(symbols)
    x = np.zeros(n + 3, np.uint64)
    x[:n] = symbols.astype(np.uint64) + np.uint64(1)
    key = x[:n] << np.uint64(48) | x[1 : n + 1] << np.uint64(32) | x[2 : n + 2] << np.uint64(16) | x[3 : n + 3]
    distinct, rank = np.unique(key, return_inverse=True)
    levels, size = [(4, rank)], 4
    while size < least and len(distinct) < n:
        second = np.zeros(n, np.int64)
        second[: n - size] = rank[size:] + 1
        distinct, rank = np.unique(rank * np.int64(n + 1) + second, return_inverse=True)
        size *= 2
        levels.append((size, rank))
    return levels


def common_prefixes(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, to the precision of the smallest level's size; exact enough where only lengths that levels can add up to are asked for."""
    n = len(levels[0][1])
    a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
    total = np.zeros(len(a), np.int64)
    for size, rank in reversed(levels):
        for _ in range(2 if size == levels[-1][0] else 1):
            inside = (a < n) & (b < n)
            same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            step = np.where(same, size, 0)
            total += step
            a += step
            b += step
    return total


def previous_factors(positions: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest-previous-factor values. positions: starts in suffix order; lcp[k]: common prefix of the k-th and the one before it.

    For each start, the previous and the next smaller position in suffix order are its best earlier matches; the
    match is as long as the least common prefix on the way there. One pass with a stack finds both.
    """
    n = len(positions)
    out = np.zeros(n, np.int64)
    stack: list[list[int]] = []
    place, shared = positions.tolist(), lcp.tolist()
    for k in range(n + 1):
        p = place[k] if k < n else -1
        m = shared[k] if 0 < k < n else 0
        while stack and stack[-1][0] > p:
            _, at, before = stack.pop()
            # m: least common prefix towards the next smaller, before: towards the previous smaller.
            out[at] = m if m > before else before
            if before < m:
                m = before
        stack.append([p, k, m])
    return out


def repeated_windows(records: list[bytes], length: int = LENGTH, earlier_only: bool = False) -> list[np.ndarray]:
    """For each record, the sorted starts of those ``length``-byte windows that start anywhere else in the records too (or, with ``earlier_only``, earlier: in an earlier record or further left)."""
    sizes = np.array([len(r) for r in records], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    symbols = np.full(int(sizes.sum()) + len(records), 256, np.uint16)
    for at, r in zip(starts, records):
        symbols[at : at + len(r)] = np.frombuffer(r, np.uint8)
    # Windows stay within their record, so one separator is enough: no window holds it.
    levels = suffix_ranks(symbols, length)
    owner = np.repeat(np.arange(len(records)), sizes + 1)
    inside = np.arange(len(symbols)) - starts[owner]
    valid = np.flatnonzero(inside + length <= sizes[owner])
    order = valid[np.argsort(levels[-1][1][valid], kind="stable")]
    if not len(order):
        return [np.empty(0, np.int64) for _ in records]
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = common_prefixes(levels, order[:-1], order[1:])
    # Only starts that share at least ``length`` symbols with a neighbour in suffix order can be repeated.
    near = lcp >= length
    kept = near | np.append(near[1:], False)
    order, lcp = order[kept], np.where(near, lcp, 0)[kept]
    hit = previous_factors(order, lcp) >= length
    if not earlier_only:
        # The same from the right end: later matches.
        hit |= previous_factors(len(symbols) - order, lcp) >= length
    hits = np.sort(order[hit])
    cut = np.searchsorted(hits, starts)
    return [hits[a:b] - s for a, b, s in zip(cut, np.append(cut[1:], len(hits)), starts)]


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, count) of the runs of neighbouring numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    first = np.concatenate([[0], cut])
    return list(zip(starts[first].tolist(), np.diff(np.append(first, len(starts))).tolist()))


# --- the distributed operator --------------------------------------------------------------------------------------


RUN = "k1 long, k2 long, ord long, h long, s long, w long, a long, m long, content binary"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs asked for, each different run of a text once."""
    names = ["k1", "k2", "ord", "h", "s", "w", "a", "m", "content"]
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            rows: list[tuple] = []
            for k1, k2, text, asked in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                data, seen = text.encode("utf-8", "surrogatepass"), set()
                for r in sorted(asked, key=lambda r: r["s"]):
                    if (key := (r["h"], r["rh"])) not in seen:
                        seen.add(key)
                        rows.append((k1, k2, r["ord"], r["h"], r["s"], r["w"], r["a"], r["m"], data[r["s"] : r["s"] + r["w"] - 1 + LENGTH]))
            types = [pa.int64()] * 8 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def _split(size: int):
    """Blocks of up to ``size`` of the windows asked for, cut by the windows' distance from their anchor, so that equal windows lie in blocks of one name.

    Rows are (k1, k2, ord, h, run, s, w, a, content): w windows from s on, the anchor a bytes behind s, within the run that starts at ``run``.
    ch: hash of the bytes that all windows of such a block share, wherever it is cut; fh: hash of all bytes of its windows.
    """
    names = ["k1", "k2", "ord", "h", "run", "s", "w", "a", "ch", "fh"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                out: list[list] = [[] for _ in names]
                for k1, k2, ord_, h, run, s, w, a, content in zip(*(x.to_pylist() for x in batch.slice(at, 1000).columns), strict=True):
                    h8, _ = gram_hashes(np.frombuffer(content, np.uint8)[s - run : s - run + w - 1 + LENGTH])
                    block = np.arange((a - w + 1) // size, a // size + 1)
                    low, high = a - (block + 1) * size + 1, a - block * size
                    first, last = np.maximum(low, 0), np.minimum(high, w - 1)
                    core = mix(_span_hashes(h8, high, low + LENGTH) + block.astype(np.uint64) * np.uint64(_BASE))
                    full = mix(_span_hashes(h8, first, last + LENGTH) + (a - first).astype(np.uint64) * np.uint64(_BASE))
                    same = np.ones(len(block), np.int64)
                    for k, x in enumerate((k1 * same, k2 * same, ord_ * same, h * same, run * same, first + s, last - first + 1, a - first, core.view(np.int64), full.view(np.int64))):
                        out[k].append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in out], names)

    return work


def _settle(earlier_only: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (h, ord, s). Whole groups are gathered up to CHUNK bytes and share a suffix array."""

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            found = repeated_windows([r[5] for r in rows], earlier_only=earlier_only)
            out = [(r[0], r[1], r[4] + first, n) for r, x in zip(rows, found) for first, n in _ranges(x)]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["k1", "k2", "s", "w"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 8)), strict=True):
                if size >= CHUNK and row[3] != held[-1][3]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield flush(held)

    return work


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"]
    types = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            rows = []
            for k1, k2, text, hits in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                spans: list[list[int]] = []
                for s, w in sorted((r["s"], r["w"]) for r in hits or []):
                    end = s + w - 1 + LENGTH
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([s, end])
                digest, now = hashlib.sha256(), 0
                for s, end in spans:
                    digest.update(data[now:s])
                    now = end
                digest.update(data[now:])
                rows.append((k1, k2, len(data), sum(e - s for s, e in spans), len(spans), digest.hexdigest(), [s for s, _ in spans], [e for _, e in spans]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def repeated_spans(docs: DataFrame, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept, starts, ends): the bytes of each document that belong to a repeated 400-byte string.

    With ``keep_first`` the first copy of a string stays (by least id of the text, then from the left): bytes are removed only where an
    earlier match exists. Copies of one text count as one text then, and all stay. Without it every copy goes.

    1. Windows of 400 bytes are gathered into runs around anchors (about one for 170 bytes), and anchors are counted with partial aggregation. Anchors
       that occur once are done with.
    2. A run whose bytes are all around its anchor wherever that occurs is repeated as a whole; nothing of it is read again.
    3. Elsewhere one copy of each different run is fetched from its text, and a suffix array over the runs of the same anchors with its longest previous
       factors tells which windows have an earlier match, and from the right which have a later one.
    4. The runs of an anchor with more than GROUP different ones (a passage in very many places) are split, so that no group has to fit into a task. Blocks of
       96 windows, equal in the bytes that all their windows share, stay together; all alike, they are repeated, and alone they are not. Those left
       are split into blocks of 16, 4 and 1 windows: about four rows for each place where a passage ends, at every level.

    Texts are known by a 128-bit key and worked on once, however often they occur. A null text is empty; texts under 400 bytes never match. Repeated
    rows are further places and so matches of each other; ids of any type that has an order will do; an empty table gives an empty result; other columns are ignored.
    """
    if (names := id_numbers(docs, id_col)) is not None:
        numbered = docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text")).join(names, "name", "left")
        out = repeated_spans(numbered, keep_first, "number", "text")
        return out.join(names.withColumnRenamed("number", "doc_id"), "doc_id", "left").select(F.col("name").alias("doc_id"), *out.columns[1:])
    text = whole_text(text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(LENGTH), text).alias("k2"))
    # Texts without an id come last, in the order of a hash.
    ord_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned("k1", 2))
    # Hash-partitioned by the key, so that joins by it move only what is joined to them.
    texts = own.select("k1", "k2", ord_.alias("ord"), "text").groupBy("k1", "k2").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"), F.first("text").alias("text"))
    found = texts.where(F.octet_length("text") >= LENGTH)
    found = stored(found.mapInArrow(_emit_runs, "k1 long, k2 long, ord long, n long, h long, rh long, s long, w long, a long"))
    # A table of its own, so that the join below may split an anchor that very many texts share.
    anchors = found.groupBy("h").agg(F.sum("n").alias("all"), F.min("rh").alias("lo"), F.max("rh").alias("hi"), F.min("ord").alias("first")).where("all > 1")
    shared = checkpoint(found.join(checkpoint(anchors.drop("all")), "h"))

    whole = shared.where("lo = hi").select("k1", "k2", "h", "rh", "s", "w", (F.col("ord") == F.col("first")).alias("is_first"))
    mixed = shared.where("lo <> hi").select("k1", "k2", "h", "rh", "s", "w", "a", "n", "ord")
    counts = checkpoint(mixed.groupBy("h", "rh").agg(F.sum("n").alias("c"), F.min("ord").alias("rep")))
    counts = checkpoint(counts.join(counts.groupBy("h").agg(F.count(F.lit(1)).alias("m")), "h"))
    mixed = mixed.join(counts, ["h", "rh"])
    whole = whole.unionByName(mixed.where("c > 1").select("k1", "k2", "h", "rh", "s", "w", (F.col("ord") == F.col("rep")).alias("is_first")))
    if keep_first:
        # In the first text only the leftmost copy is first.
        left = whole.where("is_first").groupBy("k1", "k2", "h", "rh").agg(F.min("s").alias("left"))
        whole = whole.join(left, ["k1", "k2", "h", "rh"], "left").where("not is_first or s > left")
    whole = whole.select("k1", "k2", "s", "w")

    asked = mixed.where("ord = rep").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "rh", "s", "w", "a", "m", "ord")).alias("asked"))
    fetched = checkpoint(texts.select("k1", "k2", "text").join(asked, ["k1", "k2"]).select("k1", "k2", "text", "asked").mapInArrow(_extract, RUN))
    grouped = fetched.where(F.col("m") <= GROUP)
    grouped = grouped.repartition("h").sortWithinPartitions("h", "ord", "s").mapInArrow(_settle(keep_first), "k1 long, k2 long, s long, w long")

    def blocks_of(asked: DataFrame, size: int) -> DataFrame:
        """Blocks with the number of equal ones (c), the first of them, and the number of different ones around the same shared bytes (m)."""
        blocks = checkpoint(asked.select("k1", "k2", "ord", "h", "run", "s", "w", "a", "content").mapInArrow(_split(size), "k1 long, k2 long, ord long, h long, run long, s long, w long, a long, ch long, fh long"))
        equal = checkpoint(blocks.groupBy("h", "ch", "fh").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("ord", "s")).alias("least")))
        around = equal.groupBy("h", "ch").agg(F.count(F.lit(1)).alias("m"), F.sum("c").alias("all")).where("all > 1").drop("all")
        equal = checkpoint(equal.join(around, ["h", "ch"]))
        return checkpoint(blocks.join(equal, ["h", "ch", "fh"]))

    hot = fetched.where(F.col("m") > GROUP).select("k1", "k2", "ord", "h", F.col("s").alias("run"), "s", "w", "a", "content")
    windows, left_over = hot.select("k1", "k2", "s", "w").limit(0), hot
    if not hot.isEmpty():
        for size in BLOCKS:
            blocks = blocks_of(left_over, size)
            again = blocks.where("c > 1")
            windows = windows.unionByName((again.where(F.struct("ord", "s") > F.col("least")) if keep_first else again).select("k1", "k2", "s", "w"))
            edges = blocks.where((F.col("m") > 1) & (F.struct("ord", "s") == F.col("least"))).select("k1", "k2", "ord", "h", "run", "s", "w", "a")
            left_over = edges.join(hot.select("k1", "k2", "h", "run", "content"), ["k1", "k2", "h", "run"])

    hits = whole.unionByName(grouped).unionByName(windows)
    hits = hits.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "w")).alias("hits"))
    done = texts.select("k1", "k2", "text").join(hits, ["k1", "k2"], "left").select("k1", "k2", "text", "hits")
    done = done.mapInArrow(_apply, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")
    out = own.select("doc_id", "k1", "k2", ord_.alias("ord")).join(done, ["k1", "k2"])
    if keep_first:
        # Later copies of a whole text go as a whole.
        out = out.join(own.groupBy("k1", "k2").agg(F.min(ord_).alias("least")), ["k1", "k2"])
        later = (F.col("ord") > F.col("least")) & (F.col("n_bytes") >= LENGTH)
        gone = {"n_removed": F.col("n_bytes"), "n_spans": F.lit(1).cast("long"), "kept_sha256": F.sha2(F.lit(""), 256), "starts": F.array(F.lit(0).cast("long")), "ends": F.array("n_bytes")}
        out = out.select("doc_id", "n_bytes", *[F.when(later, x).otherwise(F.col(c)).alias(c) for c, x in gone.items()])
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), "starts", "ends")


def remove_spans(text: str | None, starts: list[int], ends: list[int]) -> str:
    """The text without the given byte spans. Half a character at a cut becomes U+FFFD."""
    data, out, now = (text or "").encode("utf-8", "surrogatepass"), [], 0
    for s, e in zip(starts, ends, strict=True):
        out.append(data[now:s])
        now = e
    return b"".join([*out, data[now:]]).decode("utf-8", "replace")
