"""Query of the surrogates for personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import surrogates
from .common import table


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_checked(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_pii_surrogates": op10_pii_surrogates}
SQL: dict[str, str] = {}
