"""Query and SQL of the quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import quality_rules as Q
from .common import table


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return Q.apply_rules(docs).select(
        "doc_id", *Q.BASE_MEASURES, "n_stop_words", "n_lines", "base_failed", "kept"
    )


def _verdict() -> str:
    parts = []
    for r in Q.RULES:
        bound = f"cast({float(r.limit)!r} as double)" + (f" * {r.per}" if r.per else "")
        parts.append(f"cast({r.measure} as double) {r.op} {bound}")
    return " and ".join(parts)


_STOPS = ", ".join("'" + w + end + "'" for w in Q.STOP_WORDS for end in ("", ",", "."))

OP8_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), w as (
  select r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls
  from d
), win as (
  select r, i, ws[i:i + 7] as g from (select r, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) > 8)
), twice as (
  select r, i from (select r, i, count(*) over (partition by r, g) as c from win) where c > 1
), cover as (
  select r, sum(least(8, coalesce(j - i, 8)))::bigint as n
  from (select r, i, lead(i) over (partition by r order by i) as j from twice) group by r
), m as (
  select w.r, doc_id, len(ws)::bigint as n_words,
         length(array_to_string(ws, ''))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(n, 0)::bigint as n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) in ({_STOPS})))::bigint as n_stop_words,
         len(ls)::bigint as n_lines
  from w left join cover using (r)
), b as (
  select *, n_words < {Q.MIN_WORDS} or 100 * n_repeat_words > {Q.MAX_REPEAT_PERCENT} * n_words as base_failed from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines, base_failed,
       not base_failed and {_verdict()} as kept
from b
"""

QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL = {"op8_quality_rules": OP8_SQL}
