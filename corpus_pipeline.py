"""From raw documents to token ids: language, near-duplicates, benchmark passages, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. A stage's
result is written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontaminate, language_id, minhash, secrets, sentencepiece_fst
from paperloom.llm.common import checkpoint, fresh, shared_checkpoints, table

#: Most ids that are broadcast to leave documents out; more of them meet the documents in a shuffle by id.
BROADCAST_IDS = 500_000


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a further column, and its name: a 62-bit hash of id and text. Rows without an id have one too, and different texts of one id have different ones."""
    key = fresh(docs, "row")
    return docs.withColumn(key, F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2)), key


def _without(keyed: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """``keyed`` without the rows of the given keys, the only column of ``rows``."""
    rows = checkpoint(rows.toDF(key).distinct())
    return keyed.join(F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows, key, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is determined: text with letters, and a posterior of one half or more.

    Null, empty and letterless texts go. Rows are judged one by one, so repeated rows stay or go together. Without training rows nothing can be determined
    and all go; an empty table stays empty. Other columns, whatever their names, are kept.
    """
    predict, found = language_id.predictor(spark, language_id.train(docs)), fresh(docs, "language")
    return docs.withColumn(found, predict(F.col("text"))).where(F.col(f"{found}.score") >= 0.5).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each component of near-duplicates.

    Rows of one id and text are one document, of which one row stays; different texts of an id are several. A component without any id keeps one of its
    texts. A null or empty text is like no other. An empty table stays empty; other columns, whatever their names, are kept.
    """
    keyed, key = _keyed(docs)
    judged = minhash.near_duplicates(keyed.select(key, "text"), id_col=key).select(F.col("doc_id").alias("row"), "component_id").distinct()
    placed = checkpoint(judged.join(keyed.select(F.col(key).alias("row"), "doc_id").distinct(), "row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))
    least = checkpoint(placed.groupBy("component_id").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id", F.col("first.row").alias("first")))
    gone = placed.join(least, "component_id").where("row <> first").select("row")
    return _without(keyed, key, gone).dropDuplicates([key]).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents that hold a benchmark item, if with other numbers, names or units.

    Null and empty texts hold none and stay, repeated rows stay or go together, rows without an id are judged by their text. With an empty benchmark all
    stay; an empty table stays empty. Other columns, whatever their names, are kept.
    """
    keyed, key = _keyed(docs)
    found = decontaminate.contaminated(keyed.select(key, "text"), table(spark, sf_dir, "benchmark"), id_col=key)
    return _without(keyed, key, found.select("doc_id")).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; all documents stay. n_chars follows the text where there is such a column.

    Null and empty texts stay as they are, repeated rows are treated alike, an empty table stays empty. Other columns, whatever their names, are kept.
    """
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids, round_trip) of every document. Null and empty texts have no tokens; every row, repeated ones too, gives a row, and an empty table none. Other columns go."""
    return sentencepiece_fst.encode_column(docs)


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("pieces", pieces),
]

#: Trained models, components and shortest paths are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Results between stages are written to the shared checkpoint folder."""
    shared_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
