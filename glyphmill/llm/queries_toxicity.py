"""Query of the toxicity scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .common import table


def held_out():
    """The rows whose labels are not learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())
    machine = toxicity.fit(docs.filter(~held_out()), labels)
    return toxicity.score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", "predicted")


QUERIES = {"op7_toxicity": op7_toxicity}
SQL: dict[str, str] = {}
