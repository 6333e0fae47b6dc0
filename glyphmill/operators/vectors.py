"""Vectors of a vocabulary: made, looked up, replaced, inverted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.vectors import inverse, token_vector


def vocabulary_vectors(vocabulary: DataFrame, settings: Settings) -> DataFrame:
    """(rank, token, embedding); an empty vocabulary is an error, as in training."""
    vector = token_vector(F.col("token"), F.col("rank"), settings.dim, settings.lam, settings.seed)
    return vocabulary.select("rank", "token", vector.alias("embedding"))


def look_up(keys: DataFrame, vectors: DataFrame, on: str = "token") -> DataFrame:
    """``keys`` with their embedding; an empty one for keys that have none."""
    none = F.array().cast("array<float>")
    return keys.join(vectors.select(on, "embedding"), on, "left").withColumn("embedding", F.coalesce("embedding", none))


def at_rank(vectors: DataFrame, rank: int) -> DataFrame:
    return vectors.filter(F.col("rank") == rank)


def replace_vectors(vectors: DataFrame, changes: DataFrame, on: str = "token") -> DataFrame:
    """``vectors`` with those of ``changes`` in their place; keys that are new are ignored."""
    new = changes.select(on, F.col("embedding").alias("new_embedding"))
    joined = vectors.join(new, on, "left")
    return joined.withColumn("embedding", F.coalesce("new_embedding", "embedding")).drop("new_embedding")


def inverted(vectors: DataFrame, guard: bool = True) -> DataFrame:
    return vectors.withColumn("embedding", inverse(F.col("embedding"), guard))
