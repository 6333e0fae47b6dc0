"""Word counts, symbols and pair statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LINE_END, WORD_END
from ..functions.text import (
    adjacent_pairs,
    is_merge_candidate,
    symbols,
    training_tokens,
    with_line_ends,
)


def raw_counts(texts: DataFrame, is_bytes: bool = False) -> DataFrame:
    """(raw, cnt): letter runs, single bytes and line ends of ``texts`` (column text, or byte views there)."""
    tokens = texts.select(F.explode(with_line_ends(F.col("text"), is_bytes)).alias("raw"))
    return tokens.groupBy("raw").agg(F.count(F.lit(1)).alias("cnt"))


def word_counts(texts: DataFrame, is_bytes: bool = False) -> DataFrame:
    """(token, cnt) of training: letter runs split at case boundaries and lower-cased.

    Counted before the split, so that the split runs once for each distinct run.
    """
    pieces = F.when(F.col("raw") == LINE_END, F.array("raw")).otherwise(training_tokens(F.col("raw")))
    split = raw_counts(texts, is_bytes).select(F.explode(pieces).alias("token"), "cnt")
    return split.groupBy("token").agg(F.sum("cnt").alias("cnt"))


def merge_counts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two tables of counts as one."""
    both = first.select("token", "cnt").unionByName(second.select("token", "cnt"))
    return both.groupBy("token").agg(F.sum("cnt").alias("cnt"))


def merge_candidates(counts: DataFrame) -> DataFrame:
    return counts.filter(is_merge_candidate(F.col("token")))


def atomic_tokens(counts: DataFrame) -> DataFrame:
    return counts.filter(~is_merge_candidate(F.col("token")))


def initial_splits(counts: DataFrame) -> DataFrame:
    """(word, freq, symbols) of the words to learn from."""
    return merge_candidates(counts).select(
        F.col("token").alias("word"), F.col("cnt").alias("freq"), symbols(F.col("token")).alias("symbols")
    )


def base_vocabulary(counts: DataFrame) -> DataFrame:
    """Tokens known before any merge; without a word to learn from, the atomic tokens alone."""
    atoms = atomic_tokens(counts).select("token")
    marks = initial_splits(counts).select(F.explode(F.array_union("symbols", F.array(F.lit(WORD_END), F.lit(LINE_END)))).alias("token"))
    return atoms.union(marks).distinct()


def pair_occurrences(splits: DataFrame) -> DataFrame:
    """(word, freq, left, right) for each adjacent pair, repeats included."""
    pairs = splits.select("word", "freq", F.explode(adjacent_pairs(F.col("symbols"))).alias("p"))
    return pairs.select("word", "freq", F.col("p.left").alias("left"), F.col("p.right").alias("right"))


def pair_stats(splits: DataFrame) -> DataFrame:
    """(left, right, cnt): occurrences weighted by the words' frequencies."""
    return pair_occurrences(splits).groupBy("left", "right").agg(F.sum("freq").alias("cnt")).filter("cnt > 0")


def pair_index(splits: DataFrame) -> DataFrame:
    """(left, right, word, times): in which words a pair occurs, as rows; no list grows with the data."""
    return pair_occurrences(splits).groupBy("left", "right", "word").agg(F.count(F.lit(1)).alias("times"))


def best_pair(stats: DataFrame) -> DataFrame:
    """The pair with the highest count; the smallest of those that tie."""
    return stats.orderBy(F.desc("cnt"), "left", "right").limit(1)
