"""The edits of a paper as a fold over an ordered log: texts, inserted lines whose places shift, removed and pruned ones (APP-06, APP-07)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import clean
from .cutting import apart

#: Fixed value: what stands between a line's key and the place of a line inserted behind it.
SEPARATOR = "~"
#: Operations of the log. The last four are gestures, which expand into the first four.
SET, INSERT, REMOVE, PRUNE = "set", "insert", "remove", "prune"
COMMIT, SPLIT, JOIN, PASTE = "commit", "split", "join", "paste"
#: Consecutive orders of a paper that are looked through in one task for the prune before each.
BUCKET = 1 << 16
_FOLDED = "paper_id {}, anchor_key string, ord int, text string"


def split_key(key: Column) -> tuple[Column, Column]:
    """(anchor, place) of a key: place -1 for a composed line, from 0 for lines inserted behind it."""
    inserted = key.rlike(rf"{SEPARATOR}[0-9]+$")
    return F.when(inserted, F.regexp_replace(key, rf"{SEPARATOR}[0-9]+$", "")).otherwise(key), F.when(inserted, F.regexp_extract(key, rf"{SEPARATOR}([0-9]+)$", 1).cast("int")).otherwise(-1)


def operations(log: DataFrame) -> DataFrame:
    """(paper_id, seq, sub, op, anchor, place, text) of the log(paper_id, seq, op, key, text, other): gestures as the operations that they are made of, in the order of seq and sub.

    commit: an emptied inserted line goes, any other text is set. split: ``text`` stays and ``other`` is a new line behind it. join: the line ``other`` goes,
    ``text`` is what both say. paste: the first line of ``text`` is set, further ones are inserted behind it; empty ones are left out. Each gesture prunes empty inserted lines
    but the one that the cursor is in. Rows of a null paper, seq, op or key and unknown operations do nothing; a prune may lack a key.
    """
    anchor, place = split_key(F.coalesce("key", F.lit("")))
    own = log.select("paper_id", F.col("seq").cast("long").alias("seq"), "op", anchor.alias("anchor"), place.alias("place"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("other", F.lit("")).alias("other"))
    own = own.where(F.col("paper_id").isNotNull() & F.col("seq").isNotNull() & ((F.col("op") == PRUNE) | (log["key"].isNotNull() & (F.col("anchor") != ""))))
    tidy, second = clean(F.col("text")), clean(F.col("other"))
    pasted = F.filter(F.transform(F.split("text", r"\r?\n"), clean), lambda x: x != "")
    joined_anchor, joined_place = split_key(F.col("other"))
    own = own.withColumns({"_tidy": tidy, "_second": second, "_pasted": pasted, "_ja": joined_anchor, "_jp": joined_place})

    def one(op: str, text: Column | str = "_tidy", anchor: str = "anchor", place: Column | str = "place") -> Column:
        value = F.col(text) if isinstance(text, str) else text
        at = F.col(place) if isinstance(place, str) else place
        return F.struct(F.lit(op).alias("op"), F.col(anchor).alias("anchor"), at.cast("int").alias("place"), value.alias("text"))

    nothing = F.lit("")
    goes = (F.col("_tidy") == "") & (F.col("place") >= 0)
    # The line of each pasted row k is inserted behind the one before it, and the cursor ends in the last.
    more = F.transform(F.slice("_pasted", 2, F.greatest(F.size("_pasted") - 1, F.lit(0))), lambda t, k: F.struct(F.lit(INSERT).alias("op"), F.col("anchor").alias("anchor"), (F.col("place") + k).cast("int").alias("place"), t.alias("text")))
    moved = {
        SET: F.array(one(SET, "text")),
        INSERT: F.array(one(INSERT, "text")),
        REMOVE: F.array(one(REMOVE, nothing)),
        PRUNE: F.array(one(PRUNE, nothing)),
        COMMIT: F.array(F.when(goes, one(REMOVE, nothing)).otherwise(one(SET)), one(PRUNE, nothing, place=F.lit(-1))),
        SPLIT: F.array(one(SET), one(INSERT, "_second"), one(PRUNE, nothing, place=F.col("place") + 1)),
        JOIN: F.array(one(REMOVE, nothing, "_ja", "_jp"), one(SET), one(PRUNE, nothing)),
        PASTE: F.when(F.size("_pasted") > 0, F.concat(F.array(one(SET, F.element_at("_pasted", 1))), more, F.array(one(PRUNE, nothing, place=F.col("place") + F.size("_pasted") - 1)))),
    }
    steps = F.coalesce(*[F.when(F.col("op") == name, rows) for name, rows in moved.items()])
    out = own.select("paper_id", "seq", F.posexplode(steps).alias("sub", "x")).select("paper_id", "seq", "sub", "x.*")
    return out.where((F.col("op") == PRUNE) | (F.col("anchor") != ""))


def step(lines: list[str] | None, op: str, place: int, text: str) -> list[str] | None:
    """The lines behind an anchor after one operation; None where there are none. A prune keeps the line at ``place``."""
    if op == INSERT:
        lines = lines or []
        lines.insert(min(place + 1, len(lines)), text)
    elif lines and op == SET and place >= 0:
        lines.extend([""] * (place + 1 - len(lines)))
        lines[place] = text
    elif lines and op == REMOVE and 0 <= place < len(lines):
        del lines[place]
    elif lines and op == PRUNE:
        lines = [t for k, t in enumerate(lines) if t or k == place]
    return lines or None


def texts_in_force(ops: DataFrame) -> DataFrame:
    """(paper_id, key, text): the last text of every composed line; a removed one is empty. A partially aggregated maximum, so that no line's history meets in one task."""
    own = ops.where((F.col("place") < 0) & F.col("op").isin(SET, REMOVE))
    return own.groupBy("paper_id", F.col("anchor").alias("key")).agg(F.max(F.struct("seq", "sub", F.when(F.col("op") == SET, F.col("text")).otherwise("").alias("text"))).alias("last")).select("paper_id", "key", "last.text")


def _pruned_before(ops: DataFrame) -> DataFrame:
    """``ops`` with ``pruned``, the last prune of the paper before each operation, by its order.

    Looked for within buckets of orders, and carried over them by one row a bucket, so that a paper with a third of all rows lies in many tasks.
    """
    mark = F.when(F.col("op") == PRUNE, F.struct("seq", "sub"))
    rows = ops.withColumns({"_mark": mark, "_bucket": F.floor(F.col("seq") / F.lit(BUCKET))})
    earlier = Window.partitionBy("paper_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy("paper_id", "_bucket").agg(F.max("_mark").alias("_top")).withColumn("_carried", F.max("_top").over(earlier)).select("paper_id", "_bucket", "_carried")
    within = Window.partitionBy("paper_id", "_bucket").orderBy("seq", "sub").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_own", F.max("_mark").over(within)).join(apart(carried), ["paper_id", "_bucket"]).withColumn("pruned", F.greatest("_own", "_carried")).drop("_mark", "_bucket", "_own", "_carried")


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From rows sorted by paper, anchor and order: the lines that remain. One anchor's lines are held."""
    key, lines, last = None, None, None
    out: list[tuple] = []

    def done() -> None:
        out.extend((*key, k, t) for k, t in enumerate(lines or ()))

    def batch() -> pa.RecordBatch:
        rows, out[:] = list(out), []
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    for rows in batches:
        for paper, anchor, seq, sub, op, place, text, pruned in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            if key != (paper, anchor):
                if key:
                    done()
                key, lines, last = (paper, anchor), None, (-(1 << 63), 0)
            # A prune of the paper since this anchor's last operation; several are as one, and the anchor's own ones come by themselves.
            if pruned and (pruned["seq"], pruned["sub"]) > last:
                lines = step(lines, PRUNE, -1, "")
            lines = step(lines, op, place, text)
            last = (seq, sub)
        if len(out) > 5000:
            yield batch()
    if key:
        done()
    yield batch()


def inserted_lines(ops: DataFrame) -> DataFrame:
    """(paper_id, anchor_key, ord, text): the lines inserted behind each composed line that remain after all operations.

    Operations that move places are folded by anchor in their order, streamed through one task an anchor that holds the anchor's lines only. Prunes concern all anchors of
    a paper: each operation knows the last one before it, and every anchor gets the paper's last prune as a further row.
    """
    moving = (F.col("op") == INSERT) | (F.col("place") >= 0)
    rows = _pruned_before(ops.where(moving | (F.col("op") == PRUNE)))
    # A prune that keeps a line of an anchor is an operation of that anchor, too.
    own = rows.where(moving & (F.col("anchor") != ""))
    last = rows.where(F.col("op") == PRUNE).groupBy("paper_id").agg(F.max(F.struct("seq", "sub", "anchor", "place")).alias("l"))
    ends = own.select("paper_id", "anchor").distinct().join(apart(last), "paper_id").where((F.col("anchor") != F.col("l.anchor")) | (F.col("l.place") < 0))
    ends = ends.select("paper_id", "anchor", F.col("l.seq").alias("seq"), F.col("l.sub").alias("sub"), F.lit(PRUNE).alias("op"), F.lit(-1).alias("place"), F.lit("").alias("text"), F.lit(None).cast("struct<seq: bigint, sub: int>").alias("pruned"))
    every = own.select(*ends.columns).unionByName(ends).repartition("paper_id", "anchor").sortWithinPartitions("paper_id", "anchor", "seq", "sub")
    spec = _FOLDED.format(ops.schema["paper_id"].dataType.simpleString())
    return every.mapInArrow(_folder(spec), spec)


def _folder(spec: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(spec))
    return lambda batches: _fold(batches, schema)


def fold(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, inserts) in force after the whole log(paper_id, seq, op, key, text, other), as ``compose.edit_blocks`` takes them.

    seq orders the log of a paper; ties go by nothing else, so they should not be. Nulls and odd keys: as in ``operations``. Places past the end set further
    empty lines, removed ones past the end change nothing. Repeated rows act twice. An empty log gives two empty tables; other columns are ignored.
    """
    ops = operations(log)
    return texts_in_force(ops), inserted_lines(ops)
