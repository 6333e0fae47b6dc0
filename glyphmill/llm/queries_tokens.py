"""Query of the token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import token_files
from .common import table


def op9_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.digests(token_files.encode(docs, public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op9_rans_token_files": op9_rans_token_files}
SQL: dict[str, str] = {}
