"""Shards against a plain sort, and what is written."""

import random
import struct
import zlib

import xxhash
from pyspark.sql import functions as F

from paperloom.llm import sharding
from tests.llm.test_ops import odd_rows, prose

SCHEMA = "doc_id long, text string, lang string, source string, shard string"


def hashed(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, seed=42)


def plain(rows, n=16):
    table = sharding.hilbert_table(4, 3)
    cells = []
    for c in (2, 3):
        values = sorted({r[c] for r in rows}, key=lambda v: (v is not None, v))
        cells.append({v: k * 16 // len(values) for k, v in enumerate(values)})

    def key(row):
        doc, text, lang, source, _ = row
        data = (text or "").encode()
        x, y = cells[0][lang], cells[1][source]
        z = min(int(__import__("math").log2(len(data) + 1) * 2 / 2), 15)
        crc, ids = zlib.crc32(data), 42 if doc is None else hashed(struct.pack("<q", doc))
        return table[x << 8 | y << 4 | z], crc >> 24, ids >> 56, crc, ids - (1 << 64) * (ids >> 63), (doc is not None, doc or 0)

    out, total = [], len(rows)
    for rank, row in enumerate(sorted(rows, key=key)):
        shard = rank * n // total
        out.append((row[0], len((row[1] or "").encode()) + 1, zlib.crc32((row[1] or "").encode()), shard, rank - -(-shard * total // n)))
    return out


def corpus():
    rng = random.Random(6)
    rows = [(k, prose(k, rng.randint(0, 200)), rng.choice(["en", "de", None]), rng.choice(["web", "web", "web", "book", None]), "x") for k in range(400)]
    return rows + [(1000 + k, "same", "en", "web", "y") for k in range(150)] + [(None, None, None, None, None), (None, "t", "en", "web", None), (7, None, "en", "web", None)]


def test_shards_equal_a_plain_sort(spark):
    rows = corpus()
    got = sharding.hilbert_shards(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)


def test_written_shards_hold_whole_rows(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    manifest = sharding.write_shards(df, f"{tmp_path}/out", n_shards=4, files=12)
    back = spark.read.parquet(f"{tmp_path}/out/rows")
    assert sorted(map(tuple, back.select(df.columns).collect()), key=str) == sorted(rows, key=str)
    assert {r["n"] for r in back.groupBy("shard_").agg(F.count("*").alias("n")).collect()} == {len(rows) // 4, len(rows) // 4 + 1}
    assert manifest.agg(F.sum("n_rows")).first()[0] == len(rows) and manifest.count() >= 12
    # The files that a predicate needs hold all rows that meet it, and are not all files.
    need = [r["file"] for r in sharding.files_for(manifest, lang=("de", "de"), size=(1, 60)).collect()]
    found = spark.read.schema(back.schema).parquet(*need).where("lang = 'de' and octet_length(text) < 60").count()
    assert found == sum(r[2] == "de" and r[1] is not None and len(r[1]) < 60 for r in rows) and len(need) < manifest.count()
    assert sharding.write_shards(df.limit(0), f"{tmp_path}/none").count() == 0
    odd = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n long")
    assert sharding.write_shards(odd, f"{tmp_path}/odd").agg(F.sum("n_rows")).first()[0] == len(odd_rows())


def test_predicates_open_few_files(spark, tmp_path):
    """A language or source opens about as many files as it has rows for, and no row that meets the predicate is elsewhere."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    manifest = sharding.write_shards(docs, f"{tmp_path}/out", files=64)
    total = manifest.count()
    for name in ("lang", "source"):
        for value, n in docs.groupBy(name).count().collect():
            need = [r["file"] for r in sharding.files_for(manifest, **{name: (value, value)}).collect()]
            assert spark.read.schema(docs.schema).parquet(*need).where(F.col(name) == value).count() == n
            print(name, value, n, len(need), total)
            assert len(need) <= 64 * n / 1000 * 2 + 12
