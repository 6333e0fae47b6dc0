"""Word counts of a growing folder, as a stream: the same counts as in one batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.counts import word_counts


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of files as they appear, as texts."""
    lines = spark.readStream.option("lineSep", "\n").text(folder)
    return lines.select(F.concat("value", F.lit("\n")).alias("text"))


def stream_batches(spark: SparkSession, folder: str, counts_path: str, state_path: str) -> None:
    """Counts all files that are there and not yet counted, one batch after the other.

    Each batch writes its own counts under its number, so a repeated batch
    replaces itself; ``total`` sums them.
    """

    def count(batch: DataFrame, number: int) -> None:
        word_counts(batch).write.mode("overwrite").parquet(f"{counts_path}/batch={number}")

    query = (
        stream_lines(spark, folder).writeStream.foreachBatch(count)
        .option("checkpointLocation", state_path).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def total(spark: SparkSession, counts_path: str) -> DataFrame:
    found = spark.read.schema("token string, cnt long, batch int").option("basePath", counts_path).parquet(counts_path)
    return found.groupBy("token").agg(F.sum("cnt").alias("cnt"))
