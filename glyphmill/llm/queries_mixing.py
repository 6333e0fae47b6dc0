"""Query and SQL of the mixing of sources."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from . import mixing
from .common import table


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


_TOP = int(mixing.MAX_RATE + 12 * math.sqrt(mixing.MAX_RATE) + 12)
_KEY = "coalesce(cast(doc_id as varchar), 'text ' || md5(coalesce(text, '')))"

OP5_SQL = f"""
with recursive sizes as (
  select source, sum(strlen(coalesce(text, '')))::double as b from documents group by source
), weights as (
  select source, b, round(pow(b / (select sum(b) from sizes), {mixing.TEMPERATURE}), 12) as w from sizes
), rates as (
  select source, round((select sum(b) from sizes) * w / (select sum(w) from weights) / b, 9) as rate
  from weights where b > 0
), steps(source, rate, k, p, c) as (
  select source, rate, 0, exp(-rate), exp(-rate) from rates
  union all
  select source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from steps where k < {_TOP}
), drawn as (
  select d.*, r.rate, {_KEY} as key,
         cast('0x' || substr(md5('{mixing.SEED}|' || {_KEY}), 1, 13) as bigint)::double / {float(2**52)!r} as u
  from documents d join rates r on d.source is not distinct from r.source
), counted as (
  select drawn.*, (select count(*) from steps s where s.source is not distinct from drawn.source and s.c <= drawn.u) as n
  from drawn
)
select * exclude (key, u, n, i), n as n_copies, i as copy_no,
       md5('{mixing.SEED}#' || key || '#' || cast(i as varchar)) as shuffle_key
from (select *, unnest(range(n)) as i from counted)
"""

QUERIES = {"op5_poisson_mixing": op5_poisson_mixing}
SQL = {"op5_poisson_mixing": OP5_SQL}
