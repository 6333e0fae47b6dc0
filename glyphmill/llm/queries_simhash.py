"""Query of the SimHash near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import simhash
from .common import table


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.find_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash_dedup": op3_simhash_dedup}
SQL: dict[str, str] = {}
