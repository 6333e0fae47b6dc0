"""Query and SQL of the archive converter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import archives
from .common import table


def op6_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = archives.read_records(archives.archive(pages))
    return found.select(
        archives.typed("page_id", pages, "page_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        archives.typed("refers_to", pages, "page_id").alias("refers_to"),
    )


OP6_SQL = f"""
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages
), m as (
  select *, case when payload_bytes >= {archives.MIN_REVISIT} then min(page_id) over (partition by payload_digest) end as first
  from p
)
select page_id, payload_bytes, payload_digest,
       case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
       case when first is null or page_id is not distinct from first then null else first end as refers_to
from m
"""

QUERIES = {"op6_arc_to_warc": op6_arc_to_warc}
SQL = {"op6_arc_to_warc": OP6_SQL}
