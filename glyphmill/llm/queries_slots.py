"""Query of the sharding by virtual slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import slots
from .common import table

N_SHARDS = 24


def op1_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slots.shard_keys(table(spark, sf_dir, "documents"), N_SHARDS, next_shards=N_SHARDS + 1)
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        "next_shard",
    )


QUERIES = {"op1_slot_sharding": op1_slot_sharding}
SQL: dict[str, str] = {}
