"""Toxicity by a factorisation machine over hashed terms.

A text is the set of its hashed terms: its words and the beginnings of its words
(three to six characters), so that inflected forms share a term.  Terms are kept
that are 1.5 times as frequent in toxic texts as in others, or in others as in
toxic ones, and more than chance allows (a likelihood-ratio test), among all
texts or among those that hold a term kept before: what is neutral alone but
matters next to another term is found in the second way.  The machine has a weight for each term and a vector for each
term whose inner products weigh pairs of terms: an insult next to a mention of a
group may count for more, or less, than both.

It is fitted, terms and weights, on a bounded sample of labelled rows: at most
``max_rows``, half of each label where there are enough, chosen by a hash of the
id and the text.  Only the sample's texts are shuffled.

Defined results: texts are read whole, very long ones too.  A text without known terms, null or empty ones among them, gets
the score of the bias alone.  Without labels of both kinds all scores are the
share of toxic labels (0 without any).  Null labels are no labels.  Repeated
rows count once, different labels of a document each.  Equal texts get equal
scores.  Columns named like outputs are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, quoted, without

#: Rows that the machine is fitted on, at most.
MAX_ROWS = 40_000
#: Terms are hashed to so many bits: 2^BITS is the most that a machine can know.
BITS = 22
FACTORS = 8
#: How many times as frequent a term is on one side, so that small differences, such as the labels' share of a language, don't count.
LEAST_RATIO = 1.5
#: The fit works on rows of about so many terms at once.
BLOCK = 1 << 17
#: A step of the fit is made from about so many rows, or from more, so that each row is in LEAST_ROUNDS steps at least.
BATCH = 4096
LEAST_ROUNDS = 60
SEED = "tox"
OUTPUTS = ("score", "predicted")

_WORD = re.compile(r"[^\W\d_]+")


def _slot(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) >> (32 - BITS)


class Terms:
    """Hashed terms of texts; the terms of a word are kept for the next time it occurs."""

    def __init__(self, known: np.ndarray | None = None, most_words: int = 300_000):
        self.known = None if known is None else {int(s): k for k, s in enumerate(known)}
        self.words: dict[str, tuple[int, ...]] = {}
        self.most = most_words

    def _of_word(self, word: str) -> tuple[int, ...]:
        found = {_slot("w:" + word)}
        found.update(_slot(f"p{n}:" + word[:n]) for n in (3, 4, 5, 6) if len(word) > n)
        if self.known is not None:
            found = {self.known[s] for s in found if s in self.known}
        if len(self.words) >= self.most:
            self.words.clear()
        self.words[word] = out = tuple(found)
        return out

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: set[int] = set()
        get, make = self.words.get, self._of_word
        for word in set(_WORD.findall(text.lower())):
            terms = get(word)
            out.update(make(word) if terms is None else terms)
        return sorted(out)


def term_statistics(labelled: DataFrame, within: np.ndarray | None = None) -> tuple[np.ndarray, int, int]:
    """The terms that the labels speak about (hashed, best first), and the numbers of toxic and other rows.

    ``within``: only rows that hold one of these terms count.  Each task counts
    its rows, and Spark tests the sums.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        held = None if within is None else set(within.tolist())
        for batch in batches:
            seen: dict[int, list[int]] = {}
            sums = [0, 0]
            for text, label in zip(batch.text, batch.label):
                own = terms(text)
                if held is not None and held.isdisjoint(own):
                    continue
                sums[label] += 1
                for t in own:
                    seen.setdefault(t, [0, 0])[label] += 1
            keys = list(seen)
            yield pd.DataFrame(
                {"term": [*keys, -1], "other": [*(seen[k][0] for k in keys), sums[0]], "toxic": [*(seen[k][1] for k in keys), sums[1]]}
            )

    counted = (
        labelled.mapInPandas(count, "term int, other long, toxic long")
        .groupBy("term").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    )
    sums = counted.persist()
    try:
        whole = sums.filter("term = -1").first()
        if whole is None:
            return np.empty(0, np.int64), 0, 0
        n1, n0 = int(whole.toxic), int(whole.other)
        if not n1 or not n0:
            return np.empty(0, np.int64), n1, n0
        # the driver sees the terms that pass
        a, b = F.col("toxic").cast("double"), F.col("other").cast("double")
        total = float(n1 + n0)

        def part(seen: Column, expected: Column) -> Column:
            return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

        g = (
            part(a, (a + b) * n1 / total) + part(b, (a + b) * n0 / total)
            + part(n1 - a, (total - a - b) * n1 / total) + part(n0 - b, (total - a - b) * n0 / total)
        )
        # the more terms are tested, the more pass by chance; the rarest can't pass and aren't counted
        least = 8 + 2 * np.log(max(sums.filter(a + b >= 5).count(), 2))
        apart = (a * n0 >= LEAST_RATIO * b * n1) | (b * n1 >= LEAST_RATIO * a * n0)
        best = sums.filter((F.col("term") >= 0) & apart).select("term", (2 * g).alias("g")).filter(F.col("g") >= float(least))
        found = best.orderBy(F.desc("g"), "term").select("term").toArrow()
    finally:
        sums.unpersist()
    return found["term"].to_numpy().astype(np.int64), n1, n0


def _blocks(rows: list[np.ndarray]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The rows in blocks of about BLOCK terms: the first row, the rows' sizes, their terms one after the other."""
    sizes = np.array([len(r) for r in rows], np.int64)
    ends, at, out = np.cumsum(sizes), 0, []
    while at < len(rows):
        past = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        out.append((at, sizes[at:past], np.concatenate(rows[at:past]).astype(np.int32)))
        at = past
    return out


def _batches(labels: np.ndarray, steps: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The numbers of all rows, shuffled, in batches that hold equal shares of both labels."""
    turn = np.empty(len(labels))
    for own in (np.flatnonzero(labels > 0), np.flatnonzero(labels <= 0)):
        turn[rng.permutation(own)] = (np.arange(len(own)) + 0.5) / max(1, len(own))
    count = max(1, min(-(-len(labels) // BATCH), steps // LEAST_ROUNDS))
    return np.array_split(np.argsort(turn, kind="stable"), count)


class Machine:
    """A factorisation machine: bias, weights and vectors as plain arrays."""

    def __init__(self, terms: np.ndarray, bias: float):
        self.terms = terms
        self.bias = bias
        rng = np.random.default_rng(11)
        self.w = np.zeros(len(terms))
        self.v = rng.normal(0, 0.02, (len(terms), FACTORS))

    def raw(self, active: list[int] | np.ndarray) -> float:
        if not len(active):
            return self.bias
        v = self.v[active]
        s = v.sum(axis=0)
        return float(self.bias + self.w[active].sum() + 0.5 * (s @ s - (v * v).sum()))

    def score(self, active: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(active), -30, 30))))

    def fit(
        self, rows: list[np.ndarray], labels: np.ndarray, steps: int = 600, rate: float = 0.05,
        decay_w: float = 1e-6, decay_v: float = 1e-5,
    ) -> None:
        """Adam on the logistic loss over batches of the rows, all in turn; both labels weigh the same.

        In the second half the rate falls to zero, so that the last batches don't count for more than others.
        Beside the terms themselves, 4 bytes for each term of each row, memory holds numbers for one block of rows
        at a time.
        """
        weight = np.where(labels > 0, 0.5 / max(1, (labels > 0).sum()), 0.5 / max(1, (labels == 0).sum()))
        m, k = len(self.w), self.v.shape[1]
        rng = np.random.default_rng(12)
        batches = [(own, _blocks([rows[i] for i in own])) for own in _batches(labels, steps, rng)]
        rounds = -(-steps // len(batches))
        turns = np.concatenate([rng.permutation(len(batches)) for _ in range(rounds)])
        self.bias = 0.0
        moments = [np.zeros(1 + m + m * k), np.zeros(1 + m + m * k)]
        for step in range(1, steps + 1):
            own, blocks = batches[turns[step - 1]]
            v = np.ascontiguousarray(self.v.T)
            alone = self.w - 0.5 * (v * v).sum(axis=0)
            slope = np.zeros(1 + m + m * k)
            dw, dv = slope[1 : m + 1], np.zeros((k, m))
            for first, sizes, term in blocks:
                n, mine = len(sizes), own[first : first + len(sizes)]
                row, term = np.repeat(np.arange(n), sizes), term.astype(np.intp)
                s = [np.bincount(row, v[f].take(term), n) for f in range(k)]
                raw = self.bias + np.bincount(row, alone.take(term), n) + 0.5 * sum(x * x for x in s)
                error = len(batches) * weight[mine] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[mine])
                slope[0] += error.sum()
                dw += np.bincount(term, error.take(row), m)
                for f in range(k):
                    dv[f] += np.bincount(term, (error * s[f]).take(row), m)
            dv += (decay_v - dw) * v
            dw += decay_w * self.w
            slope[m + 1 :] = dv.T.ravel()
            moments[0] *= 0.9
            moments[0] += 0.1 * slope
            moments[1] *= 0.999
            moments[1] += 0.001 * slope * slope
            now = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            move = now * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
            self.bias -= move[0]
            self.w -= move[1 : m + 1]
            self.v -= move[m + 1 :].reshape(m, k)
        self._centre(np.array([self.raw(r) for r in rows]), labels, weight)

    def _centre(self, raw: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
        """Moves the bias so that score 0.5 lies in the middle of the widest of the best cuts between the labels."""
        order = np.argsort(raw, kind="stable")
        raw, mark, weight = raw[order], labels[order] > 0, weight[order]
        wrong = np.cumsum(np.where(mark, weight, 0.0)) + np.sum(weight[~mark]) - np.cumsum(np.where(mark, 0.0, weight))
        best = np.flatnonzero(wrong[:-1] <= wrong[:-1].min() + 1e-12)
        if len(best):
            at = best[np.argmax(raw[best + 1] - raw[best])]
            self.bias -= float(np.clip((raw[at] + raw[at + 1]) / 2, -3, 3))


def _sample(labelled: DataFrame, max_rows: int) -> DataFrame:
    """At most ``max_rows`` distinct (key, text_hash, label), half of each label where there are enough; ranks in 256 buckets first."""
    keyed = labelled.withColumn("h", F.xxhash64(F.lit(SEED), "key", "text_hash"))
    order = ["h", "key", "text_hash"]
    by_bucket = Window.partitionBy("label", F.pmod("h", F.lit(256))).orderBy(*order)
    few = keyed.withColumn("r", F.row_number().over(by_bucket)).filter(F.col("r") <= max(1, max_rows // 64))
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(*order)))
    return ranked.filter(F.col("r") <= max_rows).orderBy("r", "label").limit(max_rows).select("key", "text_hash", "label")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = MAX_ROWS,
) -> Machine:
    """A machine learned from ``labels`` (id, 0 or 1) of ``docs``."""
    key = quoted(id_col).cast("string")
    marks = labels.select(key.alias("key"), quoted(label_col).cast("int").alias("label"))
    marks = marks.filter("label in (0, 1) and key is not null").distinct()
    texts = docs.select(key.alias("key"), F.xxhash64(quoted(text_col)).alias("text_hash"), quoted(text_col).alias("text"))
    pairs = texts.select("key", "text_hash").distinct().join(marks, "key")
    chosen = materialise(_sample(pairs, max_rows), "labelled-sample")
    names = ["key", "text_hash", "label"]
    # max_rows rows at most, whatever an id holds: repeated rows count once
    labelled = materialise(texts.join(F.broadcast(chosen), ["key", "text_hash"]).dropDuplicates(names), "labelled-texts")
    terms, n1, n0 = term_statistics(labelled.select("text", "label"))
    if not n1 or not n0:
        share = min(max(n1 / max(n1 + n0, 1), 1e-9), 1 - 1e-9)
        return Machine(np.empty(0, np.int64), float(np.log(share / (1 - share))))
    beside, _, _ = term_statistics(labelled.select("text", "label"), terms) if len(terms) else (terms, 0, 0)
    terms = np.concatenate([terms, beside[~np.isin(beside, terms)]])
    own = docs.sparkSession.sparkContext.broadcast(terms)

    def active(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Terms(own.value)
        for batch in batches:
            yield pd.DataFrame({"key": batch.key, "label": batch.label, "x": [np.array(find(t), np.int32).tobytes() for t in batch.text]})

    rows = (
        labelled.select("key", "label", "text")
        .mapInPandas(active, "key string, label int, x binary").toPandas().sort_values(["key", "label", "x"])
    )
    machine = Machine(terms, float(np.log(n1 / n0)))
    machine.fit([np.frombuffer(b, np.int32) for b in rows.x], rows.label.to_numpy(np.float64))
    return machine


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def look(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value
        find = Terms(known.terms)
        for batch in texts:
            yield pd.Series([known.score(find(t)) for t in batch], dtype="float64")

    kept = without(docs, [c for c in OUTPUTS if c.lower() != text_col.lower()])
    return kept.withColumn("score", look(quoted(text_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
