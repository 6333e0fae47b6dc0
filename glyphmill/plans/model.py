"""Training runs, saved models and inference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..config import Settings
from ..operators.counts import word_counts
from ..operators.learn import learn_merges, vocabulary_tokens
from ..operators.segment import segment_sentences, strays, token_stats
from ..operators.vectors import inverted, vocabulary_vectors
from ..sources.corpus import read_lines, texts_of_lines
from ..sources.shared import own_path
from ..sources.tables import (
    load_vocabulary,
    ranked,
    read_token_counts,
    write_token_stats,
    write_unique_tokens,
    write_vectors,
)


@dataclass(frozen=True)
class Model:
    """A learned or loaded vocabulary with what was counted; parts that weren't made are None."""

    settings: Settings
    vocabulary: DataFrame
    stats: DataFrame | None = None
    counts: DataFrame | None = None
    merges: DataFrame | None = None

    @property
    def size(self) -> int:
        return self.vocabulary.count()

    def vectors(self) -> DataFrame:
        return vocabulary_vectors(self.vocabulary, self.settings)

    def inverse_vectors(self) -> DataFrame:
        return inverted(self.vectors())

    def segment(self, table: DataFrame, column: str = "text") -> DataFrame:
        return segment_sentences(table, self.vocabulary, column)

    def strays(self) -> DataFrame:
        return strays(self.stats, self.vocabulary)

    def save(self, folder: str) -> None:
        """Unique tokens, token statistics and vectors, each as headerless text."""
        if self.counts is not None:
            write_unique_tokens(self.counts, f"{folder}/unique_initial_tokens")
        if self.stats is not None:
            write_token_stats(self.stats, f"{folder}/final_token_stats")
        write_vectors(self.vectors(), f"{folder}/embeddings_only")


def _kept(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared folder and read back: used often, computed once."""
    spark, path = df.sparkSession, own_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def learn(texts: DataFrame, settings: Settings = Settings(), is_bytes: bool = False) -> Model:
    """A model of ``texts`` (column text, each as one file, or as its byte view)."""
    counts = _kept(word_counts(texts, is_bytes), "word-counts")
    merges = _kept(learn_merges(counts, settings), "merges")
    tokens = _kept(vocabulary_tokens(counts, merges), "tokens")
    vocabulary = _kept(ranked(tokens), "vocabulary")
    return Model(settings, vocabulary, token_stats(counts, vocabulary), counts, merges)


def train(spark: SparkSession, folder: str, out: str, settings: Settings = Settings()) -> Model:
    """Learns from the bytes of all files of a folder and saves the result."""
    model = learn(texts_of_lines(read_lines(spark, folder)), settings, is_bytes=True)
    model.save(out)
    return model


def train_and_segment(spark: SparkSession, folder: str, out: str, sentence: str, settings: Settings = Settings()) -> tuple[Model, list[str]]:
    """The whole chain: counts, vocabulary, statistics, vectors, all saved, and then the tokens of a sentence."""
    model = train(spark, folder, out, settings)
    row = model.segment(spark.createDataFrame([(sentence,)], "text string")).first()
    return model, list(row.tokens)


def load(spark: SparkSession, folder: str, settings: Settings = Settings()) -> Model:
    """A saved model: its vocabulary is that of its token statistics."""
    return Model(settings, load_vocabulary(spark, folder), read_token_counts(spark, f"{folder}/final_token_stats"))
