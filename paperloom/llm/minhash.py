"""MinHash near-duplicates: banded candidates, b-bit estimates, differences to centres, exact confirmation, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, id_numbers, let_go, stored

WORDS = 5
HASHES, BITS = 256, 4
BANDS, ROWS = 24, 3
NUMERATOR, DENOMINATOR = 75, 100
#: A pair is checked on full sets unless its estimate lies 5.5 standard deviations of the estimator under the threshold.
SLACK = 0.155
#: Members of a band whose estimate with their centre is this high meet each other through their differences to it.
NEAR = 0.55
#: Members of a band that are held against each other as they are; those of a larger band meet in rare elements.
CROWD = 512
#: Most candidate pairs that are broadcast instead of shuffling the texts.
BROADCAST_PAIRS = 200_000
#: Ids of vertices without a document id start here.
NAMELESS = 1 << 62

_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_PLACE = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher on 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Distinct shingle hashes of texts. Word hashes are kept in a table of bounded size."""

    def __init__(self, most: int = 400_000) -> None:
        let_go()
        self.seen: dict[bytes, int] = {}
        self.most = most

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the 5-word shingles; with fewer words, of the whole sequence; without words, none."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(self.seen) > self.most:
            self.seen.clear()
        seen, hashed = self.seen, []
        for w in words:
            h = seen.get(w)
            if h is None:
                h = seen[w] = xxhash.xxh3_64_intdigest(w)
            hashed.append(h)
        h = np.array(hashed, np.uint64)
        n = len(h) - WORDS + 1
        if n < 1:
            return mix(np.array([(h * _PLACE[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))]))
        total = h[:n] * _PLACE[0]
        for k in range(1, WORDS):
            total += h[k : k + n] * _PLACE[k]
        return np.unique(mix(total))


def minima(shingles: np.ndarray, block: int = 4096) -> np.ndarray:
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), block):
        values = _A[:, None] * shingles[None, at : at + block] + _B[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum (after mixing, as a product's low bits are poor), side by side in 64-bit words."""
    low = (mix(least) & np.uint64((1 << BITS) - 1)).reshape(-1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    parts = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    return mix((mix(parts) * _BAND).sum(axis=1, dtype=np.uint64)).view(np.int64)


PROFILE = "doc_id long, n long, k1 long, k2 long, sig array<long>, bands array<long>"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, types = Shingler(), [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
    names = ["doc_id", "n", "k1", "k2", "sig", "bands"]
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = []
            for text in part.column(1).to_pylist():
                s = shingler.shingles(text)
                if not len(s):
                    rows.append((0, 0, 0, [], []))
                    continue
                key = xxhash.xxh3_128_digest(s.tobytes())
                least = minima(s)
                k1, k2 = np.frombuffer(key, np.int64).tolist()
                rows.append((len(s), k1, k2, packed(least).tolist(), band_keys(least).tolist()))
            columns = [part.column(0), *([r[k] for r in rows] for k in range(5))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c.cast(t) for c, t in zip(columns, types, strict=True)], names)


def _nameless(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, text) of texts without an id: the id of their set's class, where that has no other."""
    shingler = Shingler()
    for batch in batches:
        found: list[tuple[int, str]] = []
        for text in batch.column(0).to_pylist():
            s = shingler.shingles(text)
            if len(s):
                k1 = int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little")
                found.append((NAMELESS + (k1 >> 2), text))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["cid", "text"])


def profiles(docs: DataFrame) -> DataFrame:
    """Set size, 128-bit key of the set, packed signature and band keys of each document of ``docs(doc_id, text)``."""
    return docs.select("doc_id", "text").mapInArrow(_profile, PROFILE)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: bits counted where any of the BITS bits of a minimum differ, corrected for equal low bits by chance. Written out word by word, so that it stays in generated code."""
    ones = sum(1 << k for k in range(0, 64, BITS))
    wrong = None
    for word in range(HASHES * BITS // 64):
        folded = x = F.get(a, F.lit(word)).bitwiseXOR(F.get(b, F.lit(word)))
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        count = F.bit_count(folded.bitwiseAND(F.lit(ones).cast("long")))
        wrong = count if wrong is None else wrong + count
    chance = 1.0 / (1 << BITS)
    return ((1 - wrong / HASHES) - chance) / (1 - chance)


def may_link(n1: Column, sig1: Column, n2: Column, sig2: Column) -> Column:
    """Neither the set sizes (exactly) nor the estimate (but for 5.5 standard deviations) rule a link out."""
    sizes = F.least(n1, n2) * DENOMINATOR >= F.greatest(n1, n2) * NUMERATOR
    return sizes & (estimate(sig1, sig2) >= NUMERATOR / DENOMINATOR - SLACK)


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs (u, v) that may be links."""
    own = classes.select("cid", "n", "sig")
    both = pairs.join(own.toDF("u", "nu", "su"), "u").join(own.toDF("v", "nv", "sv"), "v")
    return both.where(may_link(F.col("nu"), F.col("su"), F.col("nv"), F.col("sv"))).select("u", "v").distinct()


def _met(batch: pa.RecordBatch, shingler: Shingler, state: dict) -> Iterator[tuple[int, int, bool, np.ndarray, np.ndarray]]:
    """(u, v, asks, set of u, set of v). Rows come by (v, salt), the text of v first; only its set is kept."""
    for v, salt, u, asks, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
        if (v, salt) != state.get("now"):
            state.update(now=(v, salt), sets=[])
        own = shingler.shingles(text)
        if u is None:
            state["sets"].append(own)
            continue
        for other in state["sets"]:
            yield u, v, asks, own, other


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler, state = Shingler(), {}
    for batch in batches:
        found = set()
        for u, v, _, own, other in _met(batch, shingler, state):
            common = len(np.intersect1d(own, other, assume_unique=True))
            if DENOMINATOR * common >= NUMERATOR * (len(own) + len(other) - common) > 0:
                found.add((u, v))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["u", "v"])


def answering(own: int, centre: int, apart: int) -> int:
    """How many of the ``apart`` elements of y's difference to a centre h must be listed, so that every x that is linked to y but not to h meets one of them.

    Differences D = . ^ h have D(x) ^ D(y) = x ^ y, and a similarity of 3/4 is 7 |x ^ y| <= |x| + |y|. As 7 |D(x)| > |x| + |h|,
    2 |D(x) & D(y)| = |D(x)| + |D(y)| - |x ^ y| > |D(y)| + (|h| - |y|) / 7; all but so many elements, less one, must hold a common one.
    """
    return max(0, apart - ((7 * apart + centre - own) // 14 + 1) + 1)


def _differ(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, element, cid, asks, least): the elements in which a set and its centre differ, and how many of them have to answer."""
    shingler, state = Shingler(), {}
    for batch in batches:
        found: list[list[np.ndarray]] = [[np.empty(0, np.int64)] for _ in range(5)]
        for u, v, asks, own, other in _met(batch, shingler, state):
            apart = np.concatenate([np.setdiff1d(own, other, assume_unique=True), np.setdiff1d(other, own, assume_unique=True)]).view(np.int64)
            least = answering(len(own), len(other), len(apart))
            n = len(apart) if asks or least else 0
            for k, x in enumerate((np.full(n, v), apart[:n], np.full(n, u), np.full(n, asks), np.full(n, least))):
                found[k].append(x)
        columns = [np.concatenate(x) for x in found]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(bool) if t == pa.bool_() else x, t) for x, t in zip(columns, types, strict=True)], ["hub", "element", "cid", "asks", "least"])


def _side_by_side(pairs: DataFrame, texts: DataFrame, work, schema: str, group: int) -> DataFrame:
    """``work`` over the texts of pairs (u, v, asks).

    ``pairs`` should be checkpointed: it is counted first. Up to BROADCAST_PAIRS pairs go to the texts as a broadcast of at most
    twice as many rows of five values (about 14 MB); more of them meet the texts in a shuffle by id.

    The text of v is sent once for each ``group`` partners, and each task streams them past its set, so
    that a hot v is dealt over many tasks and no task holds more than one pair of sets.
    """
    many = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("parts"))
    dealt = pairs.join(many, "v").select("v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("salt"), "u", "asks")
    own = F.col("v").alias("cid"), "v", "salt", F.lit(None).cast("long").alias("u"), F.lit(False).alias("asks")
    ends = dealt.select(F.col("u").alias("cid"), "v", "salt", "u", "asks").unionByName(dealt.select("v", "salt").distinct().select(*own))
    if pairs.count() <= BROADCAST_PAIRS:
        ends = F.broadcast(ends)
    rows = texts.join(ends, "cid").select("v", "salt", "u", "asks", "text")
    return rows.repartition("v", "salt").sortWithinPartitions("v", "salt", F.col("u").asc_nulls_first()).mapInArrow(work, schema)


def confirmed(pairs: DataFrame, texts: DataFrame, group: int = 64) -> DataFrame:
    """The pairs (u, v) that are links, checked on full sets."""
    return _side_by_side(pairs.select("u", "v", F.lit(False).alias("asks")), texts, _confirm, "u long, v long", group).distinct()


def around_centres(placed: DataFrame, texts: DataFrame, group: int = 64) -> DataFrame:
    """Candidate pairs (u, v) of different components among ``placed(cid, hub, root, asks)``: classes that are like a common centre.

    A class that is not in its centre's component asks with all elements in which it differs from the centre, the others answer with
    as many of theirs as a link between the two needs, those that the fewest around the centre have. Near copies that lie in different places around a centre share
    few such elements, so that what meets does not follow the square of the group, and no link is lost.
    """
    pairs = checkpoint(placed.where("cid <> hub").select(F.col("cid").alias("u"), F.col("hub").alias("v"), "asks"))
    rows = stored(_side_by_side(pairs, texts, _differ, "hub long, element long, cid long, asks boolean, least long", group))
    # An element that one class has meets nothing, but it counts among those that answer.
    often = rows.groupBy("hub", "element").agg(F.count(F.lit(1)).alias("c"), F.max("asks").alias("asked"))
    own = Window.partitionBy("hub", "cid")
    rows = rows.join(often, ["hub", "element"]).withColumn("rank", F.row_number().over(own.orderBy("c", "element")))
    rows = rows.where("c > 1 and asked").select("hub", "element", "cid", "asks", (F.col("rank") <= F.col("least")).alias("answers"))
    rows = stored(rows.join(placed.select("cid", "hub", "root"), ["cid", "hub"]))
    asking, answering_ = rows.where("asks").alias("a"), rows.where("answers").alias("b")
    met = asking.join(answering_, (F.col("a.hub") == F.col("b.hub")) & (F.col("a.element") == F.col("b.element")) & (F.col("a.root") != F.col("b.root")))
    return met.select(F.greatest("a.cid", "b.cid").alias("u"), F.least("a.cid", "b.cid").alias("v")).distinct()


def _elements(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, sid, n, element) from (cid, text): the elements of each text's set, known by its hash, and their number."""
    shingler = Shingler()
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            sets = [(cid, shingler.shingles(text)) for cid, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            sizes = [len(s) for _, s in sets]
            columns = [np.repeat(np.array(x, np.int64), sizes) for x in ([c for c, _ in sets], [xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 for _, s in sets], sizes)]
            columns.append(np.concatenate([s.view(np.int64) for _, s in sets]))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["cid", "sid", "n", "element"])


def sharing_rare(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidate pairs (u, v) among ``members(cid, root, hub)``: every linked pair of different components that has no common centre, exactly.

    Of n elements a set shares three quarters with any set that it is linked to. So two linked sets meet in the first n / 4 + 1 of either, whatever the order of
    elements; here those that the fewest members have come first. An element that one member has alone only takes up its place, so that
    texts around a common passage hardly meet, however many there are.
    """
    rows = stored(texts.join(members.select("cid").distinct(), "cid").select("cid", "text").mapInArrow(_elements, "cid long, sid long, n long, element long"))
    often = rows.groupBy("element").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    own = Window.partitionBy("cid", "sid")
    rows = rows.join(often, "element").withColumns({"shared": F.count(F.lit(1)).over(own), "rank": F.row_number().over(own.orderBy("c", "element"))})
    first = F.col("shared") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1
    rows = stored(rows.where(F.col("rank") <= first).select("cid", "n", "element").join(members, "cid"))
    left, right = rows.alias("a"), rows.alias("b")
    sizes = F.least("a.n", "b.n") * DENOMINATOR >= F.greatest("a.n", "b.n") * NUMERATOR
    meets = (F.col("a.element") == F.col("b.element")) & (F.col("a.root") < F.col("b.root")) & sizes & ~F.coalesce(F.col("a.hub") == F.col("b.hub"), F.lit(False))
    return left.join(right, meets).select(F.greatest("a.cid", "b.cid").alias("u"), F.least("a.cid", "b.cid").alias("v")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of documents with a Jaccard similarity of 0.75 or more on 5-word shingles.

    1. One pass makes a profile of each document. Equal sets form one class, whose id is its least document id.
    2. Classes that share a band (24 bands of 3 minima; a pair at the threshold shares none with a chance of 2e-6) are linked
       to the band's class of least id, to its smallest one (texts around a shared passage link to the shortest of them if to any) and to the one whose bands
       are shared most (the middle of a group of near copies): three candidates for each row, however large the band. Set sizes and b-bit estimates drop hopeless ones, the rest is confirmed on full sets.
    3. Where a band still holds several components, its members fall in two kinds. Those like their centre (estimate of NEAR or more) meet through
       their differences to it (``around_centres``). Any other pair is held against each other within the join by sizes and estimates, in bands of
       up to CROWD rows; members of larger ones meet in their rarest elements (``sharing_rare``). What is left is confirmed, so no link between different sets depends on the choice of centres or on the size of a band.

    A null or text without words has no shingles and is its own component. Ids are taken as names of documents: repeated rows are one
    document, and if an id comes with several texts all of them count for it. Documents without an id join components, which are named by
    the least id in them, or null if there is none; then the rows of one set are kept. Ids of any type that has an order will do; they keep it. An empty table gives an empty result; other columns are ignored.
    """
    if (names := id_numbers(docs, id_col)) is not None:
        numbered = docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text")).join(names, "name", "left")
        out = near_duplicates(numbered, "number", "text")
        component = names.select(F.col("name").alias("component"), F.col("number").alias("component_id"))
        out = out.join(names.withColumnRenamed("number", "doc_id"), "doc_id", "left").join(component, "component_id", "left")
        return out.select(F.col("name").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profile = checkpoint(profiles(own))
    nameless = F.lit(NAMELESS) + F.shiftrightunsigned("k1", 2)
    named = F.coalesce(F.min("doc_id"), F.first(nameless))
    classes = profile.where("n > 0").groupBy("k1", "k2").agg(named.alias("cid"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = checkpoint(classes)
    banded = classes.select("cid", "n", F.posexplode("bands").alias("no", "band"))
    least = F.min(F.struct("n", "cid")).alias("least")
    buckets = banded.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.min("cid").alias("v"), least).where("c > 1").select("band", "c", "v", F.col("least.cid").alias("w"))
    shared = checkpoint(banded.select("cid", "no", "band").join(buckets, "band"))
    # How many share a class's bands: in a group of near copies, most for those that are most like the others.
    liked = shared.groupBy("cid").agg(F.sum("c").alias("liked"))
    hubs = shared.select("cid", "band").join(liked, "cid").groupBy("band").agg(F.max(F.struct("liked", (-F.col("cid")).alias("minus"))).alias("most"))
    ranked = checkpoint(hubs)
    hubs = ranked.select("band", (-F.col("most.minus")).alias("x"))
    star = shared.join(hubs, "band").select(F.col("cid").alias("u"), F.explode(F.array_distinct(F.array("v", "w", "x"))).alias("v")).where("u <> v")
    star = star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    star = checkpoint(_plausible(star, classes))
    # One text stands for all rows without an id that have its set.
    unnamed = own.where("doc_id is null").select("text").mapInArrow(_nameless, "cid long, text string").groupBy("cid").agg(F.first("text").alias("text"))
    texts = own.where("doc_id is not null").select(F.col("doc_id").alias("cid"), "text").unionByName(unnamed)
    links = checkpoint(confirmed(star, texts))
    roots = connected_components(links)

    def rooted(df: DataFrame) -> DataFrame:
        return df.join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))

    # Each class takes the best centre of its bands, so that a group of near copies has one, whatever bands its members share.
    centre = F.max("most").alias("most")
    placed = rooted(shared.select("cid", "band").join(ranked, "band").groupBy("cid").agg(centre).select("cid", (-F.col("most.minus")).alias("hub")))
    of_hub = placed.groupBy("hub").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("hub")
    hub_roots = rooted(of_hub.select(F.col("hub").alias("cid"))).select(F.col("cid").alias("hub"), F.col("root").alias("hub_root"))
    own = classes.select("cid", "sig")
    near = placed.join(hub_roots, "hub").join(own, "cid").join(own.toDF("hub", "hub_sig"), "hub").where(estimate(F.col("sig"), F.col("hub_sig")) >= NEAR)
    near = checkpoint(near.select("cid", "hub", "root", (F.col("root") != F.col("hub_root")).alias("asks")).distinct())
    cross = _plausible(around_centres(near, texts), classes)

    # Bands of one component, and those of one centre's group, need no further look, and most bands are such.
    shared = rooted(shared.select("cid", "no", "band")).join(near.select("cid", "hub"), "cid", "left")
    marks = [f(c).alias(f"{f.__name__}_{c}") for c in ("root", "hub") for f in (F.min, F.max)]
    mixed = shared.groupBy("band").agg(F.count(F.lit(1)).alias("c"), F.count("hub").alias("placed"), *marks)
    mixed = mixed.where("min_root <> max_root and not (placed = c and min_hub = max_hub)").select("band", "c")
    rows = checkpoint(shared.join(mixed, "band").join(classes.select("cid", "n", "sig"), "cid"))
    crowd = checkpoint(rows.where(F.col("c") > CROWD).select("cid", "root", "hub").distinct())
    rare = _plausible(sharing_rare(crowd, texts), classes)
    rows = rows.where(F.col("c") <= CROWD)
    left, right = rows.alias("a"), rows.alias("b")
    meets = (F.col("a.band") == F.col("b.band")) & (F.col("a.root") < F.col("b.root")) & ~F.coalesce(F.col("a.hub") == F.col("b.hub"), F.lit(False))
    apart = left.join(right, meets & may_link(F.col("a.n"), F.col("a.sig"), F.col("b.n"), F.col("b.sig")))
    apart = apart.select(F.greatest("a.cid", "b.cid").alias("u"), F.least("a.cid", "b.cid").alias("v"))
    cross = checkpoint(cross.unionByName(apart).unionByName(rare).distinct().join(star, ["u", "v"], "left_anti"))
    more = checkpoint(confirmed(cross, texts))
    if not more.isEmpty():
        ends = links.select("u", "v").unionByName(more)
        roots = connected_components(ends)
    settled = rooted(classes.select("k1", "k2", "cid")).select("k1", "k2", "cid", "root")
    out = profile.select("doc_id", "n", "k1", "k2").join(settled, ["k1", "k2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.when(F.col("root") < NAMELESS, F.col("root")))
    # Where no row has an id, those of the component's first set are kept.
    kept = F.when(F.col("root") >= NAMELESS, F.col("cid") == F.col("root")).otherwise(F.col("doc_id").eqNullSafe(component))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))
