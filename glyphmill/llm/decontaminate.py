"""Benchmark decontamination: a broadcast hash set of test n-grams meets every training window.

A benchmark item gives one window for each run of ``n`` consecutive words (a
shorter one, its whole sequence).  The windows go to the workers as a hash set
whose keys are the words themselves, so that each hash hit is verified by the
same lookup.  The set's size is bounded: ``max_windows`` windows make a block,
and a larger benchmark is scanned in as many blocks as it needs, each one a
further pass over the same rows without a shuffle.

Defined results: a null or wordless document has no words and no hits.  Null or
wordless items have no window.  An item without an id still marks words, but is
not listed.  Equal items and repeated rows count once by id.  Empty tables work.
Texts are scanned whole.  Other columns pass through; a column with the name of
an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, without

N = 10
#: Windows in one broadcast block: at some 150 bytes each, about 75 MB in a worker.
MAX_WINDOWS = 500_000
OUTPUTS = ("n_words", "n_hit", "item_ids", "hit_spans")

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(
    b if b >= 0x80 or b in _KEEP else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256)
)


def normalised(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z in lower case, ASCII other than letters and digits apart."""
    return text.translate(_TABLE).split()


def item_windows(text: bytes, n: int = N) -> set[bytes]:
    words = normalised(text)
    if not words:
        return set()
    return {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def join_spans(spans: list) -> list[list[int]]:
    """Sorted spans; those that overlap or touch become one."""
    out: list[list[int]] = []
    for s, e in sorted(map(tuple, spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return out


def scan(text: bytes, lengths: list[int], windows: dict[bytes, tuple]) -> tuple[int, list[list[int]], set]:
    """Word count, spans of hit words (start, end; merged) and ids of the items that occur."""
    words = normalised(text)
    total = len(words)
    joined = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32) if total > 1 else np.empty(0, np.int64)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    hits: list[tuple[int, int]] = []
    ids: set = set()
    for length in lengths:
        if length > total:
            continue
        found = [i for i, (s, e) in enumerate(zip(starts, ends[length - 1 :])) if joined[s:e] in windows]
        for i in found:
            ids.update(windows[joined[starts[i] : ends[i + length - 1]]])
            hits.append((i, i + length))
    return total, join_spans(hits), ids


def _blocks(benchmark: DataFrame, text_col: str, id_col: str, n: int, max_windows: int) -> list:
    """Broadcast variables, one for each block of the benchmark.

    A window's own hash chooses its block, so one huge item is split too; the
    number of blocks follows from the size of the texts, which is counted first.
    The driver holds one block at a time, and so does a worker.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(
        quoted(id_col).cast("string").alias("id"), F.encode(quoted(text_col), "UTF-8").alias("t")
    ).filter("t is not null")
    # a word has a byte and a gap at least, so half the bytes bound the number of windows
    at_most = items.agg(F.sum((F.length("t") + 1) / 2)).first()[0] or 0
    parts = max(1, int(-(-at_most // max_windows)))
    out = []
    for k in range(parts):
        windows: dict[bytes, set] = {}
        for row in items.toLocalIterator():
            for w in item_windows(bytes(row.t), n):
                if parts == 1 or xxhash.xxh64_intdigest(w) % parts == k:
                    windows.setdefault(w, set()).update([] if row.id is None else [row.id])
        if windows:
            frozen = {w: tuple(sorted(i)) for w, i in windows.items()}
            lengths = sorted({w.count(b" ") + 1 for w in frozen})
            out.append(spark.sparkContext.broadcast((lengths, frozen)))
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = N,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids (sorted strings) and hit_spans (pairs of word positions)."""
    blocks = _blocks(benchmark, item_text_col, item_col, n, max_windows)

    @F.pandas_udf("n_words long, n_hit long, item_ids array<string>, hit_spans array<array<long>>")
    def look(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            raws = [b"" if text is None else bytes(text) for text in batch]
            totals = [0] * len(raws) if blocks else [len(normalised(raw)) for raw in raws]
            merged: list[list] = [[] for _ in raws]
            ids: list[set] = [set() for _ in raws]
            for block in blocks:
                lengths, windows = block.value
                for k, raw in enumerate(raws):
                    totals[k], spans, found = scan(raw, lengths, windows)
                    merged[k] += spans
                    ids[k] |= found
                if len(blocks) > 1:
                    del windows
                    block.__dict__.pop("_value", None)
            rows = []
            for total, hits, found in zip(totals, merged, ids):
                spans = join_spans(hits)
                rows.append((total, sum(e - s for s, e in spans), sorted(found), spans))
            yield pd.DataFrame(rows, columns=list(OUTPUTS))

    found = docs.withColumn("__gm_c", look(F.encode(quoted(text_col), "UTF-8")))
    rest = without(found, OUTPUTS)
    return rest.select(
        *[quoted(c) for c in rest.columns if c != "__gm_c"], *[F.col(f"__gm_c.{c}").alias(c) for c in OUTPUTS]
    )


def cut_spans(text: bytes, spans: list[list[int]]) -> bytes:
    """A text without the bytes of the given spans of words."""
    flat = np.frombuffer(b" " + text.translate(_TABLE) + b" ", dtype=np.uint8) == 32
    edges = np.flatnonzero(flat[:-1] != flat[1:])
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : starts[s]])
        at = int(ends[e - 1])
    return b"".join([*out, text[at:]])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", remove: str = "documents", **options
) -> DataFrame:
    """``docs`` without what the benchmark shares, in their own columns.

    ``remove="documents"`` drops each document with a hit; ``"spans"`` cuts the
    hit words out of the text and keeps the rest.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    columns = docs.columns
    own = {c: f"__gm_own_{i}" for i, c in enumerate(columns)}
    away = docs.select(*[quoted(c).alias(a) for c, a in own.items()])
    found = find_contamination(away, benchmark, own[text_col], **options)
    if remove == "documents":
        return found.filter("n_hit = 0").select(*[F.col(a).alias(c) for c, a in own.items()])

    @F.pandas_udf("binary")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_spans(bytes(t), [list(x) for x in s]) for t, s in zip(texts, spans)])

    bare = F.when(
        F.col("n_hit") > 0, F.decode(cut(F.encode(F.col(own[text_col]), "UTF-8"), F.col("hit_spans")), "UTF-8")
    ).otherwise(F.col(own[text_col]))
    return found.select(*[(bare if c == text_col else F.col(a)).alias(c) for c, a in own.items()])
