"""Mixing sources to target weights by Poisson replication.

A source's rate is the number of times that its documents shall occur on
average: what its target weight asks for, divided by what it has.  Each document
draws a uniform number from a seeded hash of its id, the inverse of the Poisson
distribution with that rate turns it into a count, the document is exploded by
its count, and the copies are shuffled globally by another seeded hash.  The
draw depends on the seed and the id alone: not on partitions, order or retries.

Defined results: a null source is a source of its own.  A null text has size 0.
A document without an id draws by its text.  Repeated rows draw alike.  A source
with weight 0 vanishes; a source without a given weight keeps its share.  A
source may have any rate: its table of probabilities covers 12 standard
deviations and 12 counts around it.  Only a given total of more than 64 times
all bytes is refused.  Empty tables stay empty.  Other columns pass through; a
column with the name of an output is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, quoted, without

SEED = "glyphmill-mix"
#: Exponent of the default weights: a source's share of all bytes to this power.
TEMPERATURE = 0.7
#: Up to this rate the probabilities are summed from P(X = 0) on, as SQL does; above it, from logarithms around the
#: rate.  Also what a given total may be in times of all bytes.
MAX_RATE = 64.0
#: Copies of a document that are listed at once.
BLOCK = 100_000
OUTPUTS = ("rate", "n_copies", "copy_no", "shuffle_key")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) with 52 bits from MD5, which any SQL engine has."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + "|"), key)), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def first_step(rate: float) -> int:
    """The least k of the table of a rate; smaller counts don't occur."""
    return max(0, math.floor(rate - 12 * math.sqrt(rate) - 12)) if rate > MAX_RATE else 0


def poisson_table(rate: float) -> np.ndarray:
    """P(X <= k) for k = first_step(rate), ..., from logarithms: no power of the rate and no exp(-rate) overflows."""
    k = np.arange(first_step(rate), math.ceil(rate + 12 * math.sqrt(rate) + 12) + 1)
    steps = -np.log1p((k[1:] - rate) / rate)
    # relative to the first one, so that no logarithm of a factorial is needed; then they sum to 1
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logs - logs.max())
    return np.cumsum(p) / p.sum()


def poisson_steps(rate: Column) -> Column:
    """The cumulative Poisson probabilities of a rate, and the count ``first`` that they begin at."""

    @F.pandas_udf("first long, c array<double>")
    def far(rates: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in rates:
            tables = [poisson_table(r) if r > MAX_RATE else np.empty(0) for r in batch]
            yield pd.DataFrame({"first": [first_step(r) for r in batch], "c": tables})

    top = F.ceil(rate + 12 * F.sqrt(rate) + 12).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + p).alias("c"))

    near = F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["c"])
    return F.when(rate > MAX_RATE, far(rate)).otherwise(F.struct(F.lit(0).cast("long").alias("first"), near.alias("c")))


def source_rates(
    docs: DataFrame, source_col: str, text_col: str, weights: dict | None = None, total: float | None = None
) -> DataFrame:
    """Rows (source, source_bytes, rate), one for each source.

    ``total``: bytes to aim at, by default as many as there are.  Bytes are
    summed before the shuffle, so a source with a third of all rows is no burden;
    the table of sources is kept, so that the texts are read once here.
    """
    sizes = materialise(
        docs.groupBy(quoted(source_col).alias("source")).agg(
            F.sum(F.coalesce(F.octet_length(quoted(text_col)), F.lit(0)).cast("long")).alias("source_bytes")
        ),
        "source-sizes",
    )
    bytes_of_all = float(sizes.agg(F.sum("source_bytes")).first()[0] or 0)
    size, whole = F.col("source_bytes").cast("double"), F.lit(bytes_of_all)
    if weights is None:
        weight = F.pow(size / whole, F.lit(TEMPERATURE))
    else:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]) if weights else None
        weight = F.coalesce(given[F.col("source")], size / whole) if given is not None else size / whole
    weighed = sizes.withColumn("weight", F.round(weight, 12) if bytes_of_all else F.lit(0.0))
    all_weights = float(weighed.agg(F.sum("weight")).first()[0] or 0)
    aim = float(total) if total is not None else bytes_of_all
    if bytes_of_all and aim > MAX_RATE * bytes_of_all:
        raise ValueError(f"rate above the limit: {aim / bytes_of_all} for all sources together")
    asked = F.lit(aim) * F.col("weight") / F.lit(all_weights or 1.0) / size
    return weighed.select("source", "source_bytes", F.when(size > 0, F.round(asked, 9)).otherwise(F.lit(0.0)).alias("rate"))


def mix(
    docs: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: dict | None = None,
    total: float | None = None,
    seed: str = SEED,
    shuffle: bool = True,
) -> DataFrame:
    """``docs``, each as often as drawn, with rate, n_copies, copy_no (from 0) and shuffle_key, globally shuffled."""
    rates = source_rates(docs, source_col, text_col, weights, total)
    docs = without(docs, OUTPUTS)
    key = F.coalesce(quoted(id_col).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(quoted(text_col), F.lit("")))))
    steps = rates.select(F.col("source").alias("__gm_source"), "rate", poisson_steps(F.col("rate")).alias("__gm_steps"))
    drawn = docs.join(steps, quoted(source_col).eqNullSafe(F.col("__gm_source")))
    count = let(uniform(key, seed), lambda u: F.col("__gm_steps.first") + F.size(F.filter("__gm_steps.c", lambda c: c <= u)))
    counted = drawn.withColumn("n_copies", F.when(F.col("rate") > 0, count).otherwise(F.lit(0).cast("long"))).drop(
        "__gm_steps", "__gm_source"
    )
    last, one = F.col("n_copies") - 1, F.lit(1).cast("long")
    blocks = counted.filter("n_copies > 0").withColumn("__gm_block", F.explode(F.sequence(one - 1, last, F.lit(BLOCK).cast("long"))))
    copies = blocks.withColumn(
        "copy_no", F.explode(F.sequence("__gm_block", F.least(last, F.col("__gm_block") + (BLOCK - 1)), one))
    )
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat(F.lit(seed + "#"), key, F.lit("#"), F.col("copy_no").cast("string"))))
    columns = [*docs.columns, *OUTPUTS]
    out = keyed.select(*[quoted(c) for c in columns])
    # a uniform hash chooses the partition, another order rules inside: a global shuffle without sampling
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key") if shuffle else out
