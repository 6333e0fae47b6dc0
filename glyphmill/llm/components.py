"""Connected components of a graph given as edges, by alternating large and small stars.

Every round is a pair of grouped minima and joins over the edges; no component,
and no list of links, ever meets the driver or one task.  Each round is kept as
a table in the shared folder, so lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import delete_path, scratch_path


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root), the root being the smallest node of the component.

    ``edges``: columns u and v of one ordered type, in any direction; loops and
    repeats are ignored, nulls too.  Nodes without an edge don't occur.
    """
    spark = edges.sparkSession

    def keep(df: DataFrame) -> tuple[DataFrame, str, int, object]:
        path = scratch_path(spark, "stars")
        df.write.parquet(path)
        kept = spark.read.schema("u long, v long").parquet(path)
        facts = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return kept, path, facts.n, facts.h

    clean = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now, path, n, h = keep(clean)
    for _ in range(most_rounds):
        if n == 0:
            break
        after, new_path, new_n, new_h = keep(_small_star(_large_star(now)))
        delete_path(spark, path)
        settled = (new_n, new_h) == (n, h)
        now, path, n, h = after, new_path, new_n, new_h
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
