"""Streams of papers: new files are read and normalised as they come, and an edit log keeps the last text of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize


def paper_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(path, line_no, text, auto_fmt, flat) of the text files that appear in a folder. Stateless: every line is its own row."""
    files = spark.readStream.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).withColumn("path", F.input_file_name())
    rows = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("k", "raw"))
    rows = rows.where((F.trim("raw") != "") & ~normalize.is_furniture(F.col("raw")))
    marked = normalize.mark_spaces(F.col("raw"))
    return rows.select("path", (F.col("k") + 1).cast("long").alias("line_no"), normalize.without_auto(marked).alias("text"), normalize.auto_format(marked).alias("auto_fmt"), normalize.clean(marked).alias("flat"))


def latest_edits_stream(log: DataFrame) -> DataFrame:
    """The edits in force of a stream(paper_id, seq, key, text): the last writer of a key wins. For output mode complete or update; state is one row for each key."""
    return log.groupBy("paper_id", "key").agg(F.max_by("text", "seq").alias("text"), F.max("seq").alias("seq"))
