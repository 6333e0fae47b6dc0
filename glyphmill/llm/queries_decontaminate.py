"""Query and SQL of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as D
from .common import table


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = D.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents
), b as (
  select cast(item_id as varchar) as id, row_number() over () as br,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark
), grams as (
  select distinct id, br, array_to_string(ws[i:i + {D.N - 1}], ' ') as g, least(len(ws), {D.N}) as n
  from (select id, br, ws, unnest(range(1, greatest(len(ws) - {D.N - 2}, 2))) as i from b where len(ws) > 0)
), sizes as (
  select distinct n from grams
), win as (
  select r, i, n, array_to_string(ws[i:i + n - 1], ' ') as g
  from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, sizes where len(ws) >= n)
), hit as (
  select r, i, win.n, id from win join grams on win.g = grams.g and win.n = grams.n
), words as (
  select r, count(distinct p)::bigint as n_hit from (select r, unnest(range(i, i + n)) as p from hit) group by r
), ids as (
  select r, count(distinct id)::bigint as n_items, string_agg(distinct id, ',' order by id) as s from hit group by r
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(s, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join ids using (r)
"""

QUERIES = {"op4_decontamination": op4_decontamination}
SQL = {"op4_decontamination": OP4_SQL}
