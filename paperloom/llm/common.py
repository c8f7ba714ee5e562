"""Helpers that the training-data operators share: columns, folds, checkpoints and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The text, with a null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(column: str = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the id written as text is divisible by ``folds``. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds == 0


_HELD: dict = {}


def held(key, make):
    """The one large object that a worker process keeps from task to task: asked for another, it lets go of the last, so that stages do not add up in a worker that is used again."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Have a worker drop what an earlier stage held, before a stage with large tables of its own."""
    _HELD.clear()


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_checkpoints(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; make one only where there is none, as in local tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="paperloom-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that a lost executor costs no recomputation of earlier rounds."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: like a checkpoint, but compressed, for large results that are read more than once. The files stay until the folder is cleared."""
    shared_checkpoints(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_numbers(docs: DataFrame, id_col: str) -> DataFrame | None:
    """(name, number): a number for each id, in the order of the ids, where they are no integers themselves; else None. Ids are sorted by ranges and numbered where they lie."""
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return None
    names = docs.select(F.col(id_col).alias("name")).where("name is not null").distinct()
    return stored(names.orderBy("name").withColumn("number", F.monotonically_increasing_id()))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge in ``edges(u, v)``; root is the smallest node of its component.

    Alternating large-star and small-star steps. Each step is a partially aggregated
    minimum by node and an equi-join that AQE can split at a hot node, so that no node's
    neighbours are ever gathered in one task. Edges end up as a star around each root.
    Self-loops and repeated edges are allowed; null ends are ignored. An empty input gives an empty result.
    """
    edges = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    edges = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _fingerprint(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = checkpoint(small.where("u <> v").distinct())
        now = _fingerprint(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


#: DuckDB: crc32 of UTF-8 bytes, as a table of 256 remainders and a fold over bytes. ``{0}`` is the expression of a text; the table is ``crc_table``.
CRC_TABLE = """crc_table as materialized (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end) order by i) as steps from range(256) r(i))"""
CRC = "xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(hex(encode({0})))::bigint, 2), lambda k: ('0x' || substring(hex(encode({0})), k, 2))::bigint)), lambda a, b: xor(a >> 8, steps[xor(a & 255, b) + 1])))"
