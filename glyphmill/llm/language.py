"""Language identification in two levels: the family first, then the language in it.

A text becomes counts of hashed byte n-grams (one to four bytes) of its whole
lower-cased words.  Linear support vector machines decide: one against the rest
for each family, then, within the family, one for each pair of languages; the
language with most votes wins, margins break ties.

Training uses a bounded sample of labelled rows: ``max_rows`` of them, the same
number for each language where there are enough, chosen by a hash of id and text.
Nothing else is bounded: every text is read whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0.
Equal texts get equal results.  With one language to learn, that is the answer;
with none, every text is ``und``.  Empty tables stay empty.  Columns named like
outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, without

#: Rows that the machines are fitted on, at most.
MAX_ROWS = 4000
BITS = 12
ORDERS = (1, 2, 3, 4)
SEED = "lid"
OUTPUTS = ("lang_pred", "score")

#: Families of languages by ISO 639-1 code; a code that isn't listed is a family of its own.
FAMILIES = {
    code: family
    for family, codes in {
        "germanic": "en de nl sv da no nb nn is fy af lb yi",
        "romance": "fr es it pt ro ca gl oc la",
        "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
        "baltic": "lt lv",
        "uralic": "fi et hu",
        "turkic": "tr az kk uz ky tk",
        "semitic": "ar he mt am",
        "indic": "hi bn ur mr gu pa ne",
        "celtic": "ga cy gd br",
    }.items()
    for code in codes.split()
}

_SPACED = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def family_of(lang: str) -> str:
    return FAMILIES.get(lang, lang)


def has_letter(text: str) -> bool:
    return text is not None and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams of a text's words, of unit length in the square root."""
    words = text.lower().encode("utf-8", "replace").translate(_SPACED).split()
    raw = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    size = 1 << BITS
    total = np.zeros(size, np.int64)
    rolling = np.zeros(len(raw), np.uint32)
    for k in ORDERS:
        rolling = rolling[: len(raw) - k + 1] * np.uint32(257) + raw[k - 1 :]
        slots = ((rolling + np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        total += np.bincount(slots, minlength=size)
    out = np.sqrt(total.astype(np.float32))
    norm = float(np.sqrt((out * out).sum()))
    return out / norm if norm else out


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """A linear support vector machine (squared hinge) by dual coordinate descent; y is +1 or -1.

    A last weight is the offset.  The order of the steps is seeded, so the result is fixed.
    """
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    n = len(x)
    weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    soft = 1 / (2 * c * weight)
    diagonal = (x * x).sum(axis=1) + soft
    alpha, w = np.zeros(n), np.zeros(x.shape[1])
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            gradient = y[i] * (w @ x[i]) - 1 + soft[i] * alpha[i]
            after = max(alpha[i] - gradient / diagonal[i], 0.0)
            step = after - alpha[i]
            if step:
                w += step * y[i] * x[i]
                alpha[i] = after
                moved = max(moved, abs(gradient))
        if moved < 1e-3:
            break
    return w


class Model:
    """The machines of both levels as plain arrays."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.langs = sorted(set(langs))
        self.families: dict[str, list[str]] = {}
        for lang in self.langs:
            self.families.setdefault(family_of(lang), []).append(lang)
        names = sorted(self.families)
        family = np.array([family_of(v) for v in langs])
        self.names = names
        self.first = (
            np.stack([fit_svm(x, np.where(family == f, 1.0, -1.0)) for f in names]) if len(names) > 1 else None
        )
        self.pairs: dict[tuple[str, str], np.ndarray] = {}
        for members in self.families.values():
            for a, b in combinations(members, 2):
                rows = (langs == a) | (langs == b)
                self.pairs[a, b] = fit_svm(x[rows], np.where(langs[rows] == a, 1.0, -1.0))

    def predict(self, features: np.ndarray) -> tuple[str, float]:
        v = np.append(features.astype(np.float64), 1.0)
        sure = 1.0
        if self.first is None:
            family = self.names[0]
        else:
            margins = self.first @ v
            best = int(np.argmax(margins))
            family = self.names[best]
            rest = np.partition(margins, -2)[-2]
            sure *= 1 / (1 + np.exp(-2 * (margins[best] - rest)))
        members = self.families[family]
        votes = dict.fromkeys(members, 0)
        summed = dict.fromkeys(members, 0.0)
        margin_of: dict[tuple[str, str], float] = {}
        for a, b in combinations(members, 2):
            m = float(self.pairs[a, b] @ v)
            margin_of[a, b] = m
            votes[a if m >= 0 else b] += 1
            summed[a] += m
            summed[b] -= m
        lang = max(members, key=lambda k: (votes[k], summed[k], k))
        for (a, b), m in margin_of.items():
            if lang in (a, b):
                sure *= 1 / (1 + np.exp(-4 * (m if lang == a else -m)))
        return lang, float(sure)


def training_rows(labelled: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` of the distinct (key, text_hash, lang), as many of each language as there are enough of.

    Ranks inside (language, bucket) with 256 buckets first, so that no task sorts
    a whole language; only the first ones of each go on.
    """
    rows = labelled.select("key", "text_hash", "lang").distinct().withColumn(
        "h", F.xxhash64(F.lit(SEED), "key", "text_hash")
    )
    order = ["h", "key", "text_hash"]
    by_bucket = Window.partitionBy("lang", F.pmod("h", F.lit(256))).orderBy(*order)
    few = rows.withColumn("r", F.row_number().over(by_bucket)).filter(F.col("r") <= max(1, max_rows // 16))
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return ranked.orderBy("r", "lang", *order).limit(max_rows).select("key", "text_hash", "lang")


def fit(
    labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS
) -> Model | None:
    """A model of the languages in ``lang_col``, fitted on a bounded sample; None without labelled rows.

    Repeated rows count once, so a sample has ``max_rows`` rows whatever an id holds.
    """

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch[batch.text.map(has_letter)]
            yield pd.DataFrame({"key": rows.key, "lang": rows.lang, "x": [counts(t).tobytes() for t in rows.text]})

    rows = labelled.select(
        quoted(id_col).cast("string").alias("key"), F.xxhash64(quoted(text_col)).alias("text_hash"),
        quoted(lang_col).alias("lang"), quoted(text_col).alias("text"),
    ).filter("lang is not null and key is not null")
    names = ["key", "text_hash", "lang"]
    chosen = rows.join(F.broadcast(training_rows(rows, max_rows)), names, "left_semi").dropDuplicates(names)
    found = chosen.select("key", "lang", "text").mapInPandas(vectors, "key string, lang string, x binary").toPandas()
    if found.empty:
        return None
    found = found.sort_values(["key", "lang", "x"])
    return Model(np.stack([np.frombuffer(b, dtype=np.float32) for b in found.x]), found.lang.to_numpy())


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def look(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in texts:
            rows = [
                known.predict(counts(t)) if known is not None and has_letter(t) else ("und", 0.0) for t in batch
            ]
            yield pd.DataFrame(rows, columns=list(OUTPUTS))

    found = docs.withColumn("__gm_l", look(quoted(text_col)))
    rest = without(found, OUTPUTS)
    return rest.select(
        *[quoted(c) for c in rest.columns if c != "__gm_l"], *[F.col(f"__gm_l.{c}").alias(c) for c in OUTPUTS]
    )
