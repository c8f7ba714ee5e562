"""Sharding along a Hilbert curve over several metadata dimensions [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh


def hilbert_table(bits: int, dims: int) -> list[int]:
    """The curve index of every cell, listed by the cell's coordinates written as one number of ``bits * dims`` bits.

    Built from Skilling's transposed form: undo the excess work from the top bit down,
    then Gray-decode, then interleave the bits of the axes.
    """
    out = []
    for cell in range(1 << (bits * dims)):
        x = [(cell >> (bits * (dims - 1 - d))) & ((1 << bits) - 1) for d in range(dims)]
        q = 1 << (bits - 1)
        while q > 1:
            p = q - 1
            for d in range(dims):
                if x[d] & q:
                    x[0] ^= p
                else:
                    t = (x[0] ^ x[d]) & p
                    x[0] ^= t
                    x[d] ^= t
            q >>= 1
        for d in range(1, dims):
            x[d] ^= x[d - 1]
        t, q = 0, 1 << (bits - 1)
        while q > 1:
            if x[dims - 1] & q:
                t ^= q - 1
            q >>= 1
        x = [v ^ t for v in x]
        index = 0
        for b in range(bits - 1, -1, -1):
            for v in x:
                index = index << 1 | (v >> b) & 1
        out.append(index)
    return out


def log_size(column: Column, bits: int) -> Column:
    """A size on a logarithmic scale, two steps for each doubling, cut off at the last cell."""
    return F.least(F.floor(F.log2(column.cast("double")) * 2 / (1 << max(0, 5 - bits))), F.lit((1 << bits) - 1)).cast("int")


#: A manifest has one bit for each of 2 ** MASK_BITS hashes of a category's values.
MASK_BITS = 6
_NULL = "\x00"


def _value(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(_NULL))


def hashed(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(value), 64 - bits).cast("int")


def category_cells(docs: DataFrame, column: str, bits: int) -> dict[str, int]:
    """Cells of the most frequent values of a category, 2 ** bits at the most, null as one of them: in the values' order, spread over all cells, so that the curve's coarsest turns part them."""
    top = docs.groupBy(_value(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(1 << bits).collect()
    values = sorted(r["value"] for r in top)
    return {v: (k << bits) // len(values) for k, v in enumerate(values)}


def category_cell(column: str, cells: dict[str, int], bits: int) -> Column:
    """A row's cell in a category: that of its value, or of the value's hash where that is a rare one among many."""
    if not cells:
        return hashed(_value(column), bits)
    known = F.create_map(*[x for v, c in cells.items() for x in (F.lit(v), F.lit(c))])
    return F.coalesce(F.try_element_at(known, _value(column)), hashed(_value(column), bits))


def _ranked(docs: DataFrame, n_shards: int, id_col: str, text_col: str, categories: tuple[str, str], bits: int, carried: bool = False) -> DataFrame:
    """(doc_id, size, text_crc32, hilbert, shard, slot) of all rows, and the whole row where it is to be carried along."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    first = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[category_cell(c, category_cells(docs, c, bits), bits).alias(n) for n, c in zip("xy", categories, strict=True)],
        *([F.struct("*").alias("row")] if carried else []),
    )
    cells = F.split(F.lit(",".join(map(str, hilbert_table(bits, 3)))), ",").cast("array<int>")
    where = F.col("x") * (1 << 2 * bits) + F.col("y") * (1 << bits) + log_size(F.col("size"), bits)
    base = first.select(
        "doc_id",
        "size",
        "text_crc32",
        F.element_at(cells, where.cast("int") + 1).alias("hilbert"),
        F.shiftright("text_crc32", 24).cast("int").alias("c8"),
        F.xxhash64("doc_id").alias("id_hash"),
        *(["row"] if carried else []),
    ).withColumn("d8", F.shiftrightunsigned("id_hash", 56).cast("int"))
    key = ["hilbert", "c8", "d8"]
    counts = base.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    # At most 2 ** (3 * bits) rows, so one task may put them in order.
    by_cell = counts.groupBy("hilbert").agg(F.sum("n").alias("cell_n"))
    ordered = Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)
    by_cell = by_cell.select("hilbert", F.coalesce(F.sum("cell_n").over(ordered), F.lit(0)).alias("cell_start"), F.sum("cell_n").over(Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    within = Window.partitionBy("hilbert").orderBy("c8", "d8").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, F.coalesce(F.sum("n").over(within), F.lit(0)).alias("before")).join(by_cell, "hilbert")
    starts = starts.select(*key, (F.col("before") + F.col("cell_start")).alias("start"), "total")
    placed = base.join(starts, key)
    number = F.row_number().over(Window.partitionBy(*key).orderBy("text_crc32", "id_hash", "doc_id"))
    ranked = placed.select("doc_id", "size", "text_crc32", "hilbert", "total", (F.col("start") + number - 1).alias("rank"), *(["row"] if carried else []))
    ranked = ranked.withColumn("shard", F.expr(f"cast((rank * {n_shards}) div total as int)"))
    slot = F.col("rank") - F.expr(f"(shard * total + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("slot", slot.cast("long")).drop("total", "rank")


def hilbert_shards(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, str] = ("lang", "source"), bits: int = 4) -> DataFrame:
    """Order all rows along the Hilbert curve over (two categories, size) and cut the order into runs of equal row counts.

    Law ``rows``: shard sizes differ by one row at most. Within a curve cell rows are ordered by the
    text's crc32, then by the id's hash, then by the id, so equal texts of equal metadata lie side by side.

    The rank of a row needs no global sort: it is the number of rows in earlier buckets (cell,
    8 bits of the crc, 8 bits of the id's hash; partially aggregated) plus the row's number within its bucket. A
    cell, source or text that holds a third of all rows is still split 256 ways by the id's hash.

    Frequent values of a category have cells of their own, spread in their order (``category_cells``: 2 ** bits values and counts reach the driver); rare ones go by a hash.

    Nulls: a null text has size 1 and crc 0; null is a category's value like others; null ids sort
    by the hash of null. Repeated rows each get their own slot. An empty table gives an empty result; columns
    that are not named here are ignored.
    """
    ranked = _ranked(docs, n_shards, id_col, text_col, categories, bits)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("hilbert").cast("long").alias("hilbert"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, files: int = 64, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, str] = ("lang", "source"), bits: int = 4) -> DataFrame:
    """Write whole rows in curve order: a folder for each shard under ``path``/rows, and a manifest of its files, which is returned.

    Rows are cut by ranges of (shard, slot) into about ``files`` files, each of neighbouring cells, so that many tasks write one shard. The manifest,
    under ``path``/manifest, has for each file the shard, the number of rows, and least and greatest value of both categories and of the
    size, and hashes of both categories' values: a reader with a predicate on several of them opens only the files that may meet it (``files_for``).
    Rows keep their columns; the folder's column is named shard, or has underscores appended if there is such a column already. An empty table gives an empty manifest.
    """
    ranked = _ranked(docs, n_shards, id_col, text_col, categories, bits, carried=True)
    shard = fresh(docs, "shard")
    order = ["shard", "slot"]
    rows = ranked.repartitionByRange(files, *order).sortWithinPartitions(*order).select("row.*", F.col("shard").alias(shard))
    rows.write.partitionBy(shard).parquet(f"{path}/rows")
    # An empty table leaves no files, and so no schema to be read.
    written = docs.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    size = (F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 1).cast("long")
    facts = [f(c).alias(f"{f.__name__}_{n}") for n, c in ((categories[0], F.col(categories[0])), (categories[1], F.col(categories[1])), ("size", size)) for f in (F.min, F.max)]
    nulls = [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in categories]
    # One bit for each hash of a category's values in the file: a range of values says little where the curve passes several.
    nulls += [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), hashed(_value(c), MASK_BITS))).alias(f"cells_{c}") for c in categories]
    manifest = written.groupBy(F.input_file_name().alias("file"), F.col(shard).alias("shard")).agg(F.count(F.lit(1)).alias("n_rows"), *facts, *nulls)
    manifest.write.parquet(f"{path}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{path}/manifest")


def files_for(manifest: DataFrame, **ranges: tuple) -> DataFrame:
    """The files of a manifest that may have rows with all of ``name=(least, greatest)``. A single value of a category is looked up by its hash as well."""
    for name, (low, high) in ranges.items():
        manifest = manifest.where((F.col(f"min_{name}") <= F.lit(high)) & (F.col(f"max_{name}") >= F.lit(low)))
        if low == high and f"cells_{name}" in manifest.columns:
            manifest = manifest.where(F.getbit(F.col(f"cells_{name}"), hashed(F.lit(low).cast("string"), MASK_BITS)) == 1)
    return manifest.select("file")
