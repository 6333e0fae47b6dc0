"""Greedy longest-match segmentation over a vocabulary.

The vocabulary is bounded by the number of merges plus its base, so it is sent
to the workers as a set; a word is segmented once in a worker and kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import WORD_END
from ..functions.text import byte_view, starts_with_letter

#: Segmented words that a worker keeps: some 20 MB; a longer list fills a worker and finds little more.
MOST_KEPT = 20_000
_PIECE = re.compile(r"[A-Za-z]+|[^A-Za-z \t\n\v\f\r]")


class Segmenter:
    def __init__(self, tokens: frozenset[str]):
        # pieces are the vocabulary's own strings, not copies
        self.tokens = {t: t for t in tokens if t}
        self.longest = max(map(len, self.tokens), default=1)
        self.kept: dict[str, list[str]] = {}

    def word(self, word: str) -> list[str]:
        """Pieces of a word and its end mark: the longest known prefix each time, else one byte."""
        known = self.kept.get(word)
        if known is not None:
            return known
        out: list[str] = []
        rest, at = word + WORD_END if word else "", 0
        while at < len(rest):
            for end in range(min(len(rest), at + self.longest), at, -1):
                piece = self.tokens.get(rest[at:end])
                if piece is not None:
                    break
            else:
                end = at + 1
                piece = rest[at:end]
            out.append(piece)
            at = end
        if len(self.kept) >= MOST_KEPT:
            self.kept.clear()
        self.kept[word] = out
        return out

    def sentence(self, text: str) -> list[str]:
        """Pieces of a byte view: letter runs in lower case and unsplit, other bytes as they are."""
        out: list[str] = []
        for piece in _PIECE.findall(text):
            if "A" <= piece[0] <= "Z" or "a" <= piece[0] <= "z":
                out += self.word(piece.lower())
            else:
                out.append(piece)
        return out


#: A vocabulary is collected up to this many tokens; more is an error, not a silent cut.
MOST_TOKENS = 5_000_000


def _shared(vocabulary: DataFrame):
    rows = vocabulary.select("token").limit(MOST_TOKENS + 1).toPandas()
    if len(rows) > MOST_TOKENS:
        raise ValueError(f"a vocabulary has {MOST_TOKENS} tokens at most")
    return vocabulary.sparkSession.sparkContext.broadcast(frozenset(rows.token))


def _udf(vocabulary: DataFrame, method: str):
    shared = _shared(vocabulary)

    @F.pandas_udf("array<string>")
    def cut(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = getattr(Segmenter(shared.value), method)
        for batch in values:
            yield batch.map(lambda v: [] if v is None else of(v))

    return cut


def segment_words(words: DataFrame, vocabulary: DataFrame, column: str = "word") -> DataFrame:
    """``words`` with ``pieces``."""
    return words.withColumn("pieces", _udf(vocabulary, "word")(F.col(column)))


def segment_sentences(table: DataFrame, vocabulary: DataFrame, column: str = "text") -> DataFrame:
    """``table`` with ``tokens``, an array."""
    return table.withColumn("tokens", _udf(vocabulary, "sentence")(byte_view(F.col(column))))


def exploded(sentences: DataFrame, *keys: str) -> DataFrame:
    """One row for each token: keys, pos, token."""
    return sentences.select(*keys, F.posexplode("tokens").alias("pos", "token"))


def token_stats(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, cnt): how often the vocabulary's tokens occur in the counted words, zeros and strays included."""
    token: Column = F.col("token")
    pieces = F.when(starts_with_letter(token), _udf(vocabulary, "word")(token)).otherwise(F.array(token))
    emitted = counts.select(F.explode(pieces).alias("token"), "cnt").groupBy("token").agg(F.sum("cnt").alias("cnt"))
    return vocabulary.select("token").distinct().join(emitted, "token", "full").select("token", F.coalesce("cnt", F.lit(0)).alias("cnt"))


def strays(stats: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Counted tokens that the vocabulary lacks: none, if it was learned from the same corpus."""
    return stats.join(vocabulary.select("token"), "token", "left_anti")
