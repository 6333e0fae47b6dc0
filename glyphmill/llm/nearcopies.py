"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from two searches.  The first is op3's, with all of its steps:
SimHash fingerprints, linked at four bits or fewer by the generalised pigeonhole
principle; the members of a class are verified against its smallest.  Four bits
reach the closest copies only (at similarity 0.8 about ten bits differ), so the
second finds what shares a band of minimum hashes: 32 bands of 4, so a pair at
similarity 0.8 is missed with a chance of (1 - 0.8^4)^32, 5 in 100 million, and
one above it less often, however SimHash classes it.  Candidates of both are
verified on their whole shingle sets: equal fingerprints are no copies where one
repeated phrase outweighs different texts.  Documents form classes, the connected
components.

Each member of a bucket is verified against the bucket's smallest first.  Only
buckets whose members are then in several classes give all their pairs, without
those inside a class: large clusters cost work in proportion to their size.
There is no cap; many unlike texts in one bucket cost the square of their number.

Defined results: null, empty and wordless texts are copies of each other.  Texts
shorter than a shingle are one shingle.  Words are split at ASCII white space,
ASCII letters count without case.  Equal shingle sets are one node throughout.
Null ids join classes; repeated rows share one.  Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import materialise, quoted
from .components import connected_components

SHINGLE = 5
LEAST = 0.8
BANDS = 32
ROWS = 4
SEED = 42

_RNG = np.random.default_rng(SEED)
_FACTOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of the shingles of a UTF-8 text."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(joined)]
    return np.unique(np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], dtype=np.uint64))


def node_of(hashes: np.ndarray) -> int:
    """A signed number that names a shingle set; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)) if len(hashes) else 0


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A signed key for each band of a shingle set; none for the empty one."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _FACTOR + _SHIFT).min(axis=0), out=least)
    raw = least.tobytes()
    keys = [xxhash.xxh64_intdigest(raw[k * 8 * ROWS : (k + 1) * 8 * ROWS], k) for k in range(BANDS)]
    return np.array(keys, dtype=np.uint64).view(np.int64)


def _signed(text: Column) -> Column:
    """node, n and bands of the shingle set of a text, and its fingerprint."""

    @F.pandas_udf("node long, n int, fp long, bands array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            raw = [None if t is None else bytes(t) for t in batch]
            sets = [shingle_set(t) for t in raw]
            prints = np.array([simhash.fingerprint(t) for t in raw], dtype=np.uint64).view(np.int64)
            bands = [band_keys(s) for s in sets]
            yield pd.DataFrame({"node": [node_of(s) for s in sets], "n": [len(s) for s in sets], "fp": prints, "bands": bands})

    return of(F.encode(text, "UTF-8"))


def _shingles(text: Column) -> Column:
    """The shingle set of a text as signed longs."""

    @F.pandas_udf("array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shingle_set(None if t is None else bytes(t)).view(np.int64) for t in batch])

    return of(F.encode(text, "UTF-8"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = pairs.join(left, "u").join(right, "v")
    common = F.size(F.array_intersect("a", "b"))
    return both.filter(common / (F.size("a") + F.size("b") - common) >= LEAST).select("u", "v")


def _size_fits(a: str, b: str) -> Column:
    """Sets whose sizes differ more can't be similar enough."""
    return F.least(a, b) / F.greatest(a, b) >= LEAST


def fingerprint_stars(keyed: DataFrame) -> DataFrame:
    """Pairs (u, v) of shingle sets: each with the smallest of its class of fingerprints, where the sizes fit."""
    prints = materialise(keyed.select("fp").distinct(), "fingerprints")
    if prints.isEmpty():
        return prints.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    roots = materialise(connected_components(simhash.links(prints)), "fingerprint-classes")
    classed = keyed.select("node", "n", "fp").distinct().join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    named = materialise(classed.select("node", "n", F.coalesce("root", "fp").alias("root")).distinct(), "classed-sets")
    least = named.groupBy("root").agg(F.min(F.struct("node", "n")).alias("m"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    both = named.join(least.select("root", F.col("m.node").alias("v"), F.col("m.n").alias("vn")), "root")
    return both.filter((F.col("node") != F.col("v")) & _size_fits("n", "vn")).select(F.col("node").alias("u"), "v").distinct()


def _banded(nodes: DataFrame) -> DataFrame:
    """node, n and band, a row for each band of a shingle set."""
    return nodes.select("node", "n", F.explode("bands").alias("band"))


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text_hash, root), one for each of ``docs``; root is a shingle set that names the class."""
    text = quoted(text_col)
    made = docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), _signed(text).alias("s"))
    keyed = materialise(made.select("doc_id", "text_hash", "s.node", "s.n", "s.fp", "s.bands"), "shingled")
    by_print = materialise(fingerprint_stars(keyed), "fingerprint-stars")
    nodes = keyed.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    banded = materialise(_banded(nodes), "bands")
    least = banded.groupBy("band").agg(F.min(F.struct("node", "n")).alias("m"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    buckets = materialise(
        banded.join(least.select("band", F.col("m.node").alias("v"), F.col("m.n").alias("vn")), "band"), "buckets"
    )
    members = buckets.select("node").union(by_print.select("u")).union(by_print.select("v")).distinct()
    chosen = keyed.join(members, "node", "left_semi").groupBy("node").agg(F.min("text_hash").alias("__gm_text"))
    found = docs.select(F.xxhash64(text).alias("__gm_text"), text.alias("__gm_t")).join(chosen, "__gm_text")
    sets = materialise(
        found.dropDuplicates(["node"]).select("node", _shingles(F.col("__gm_t")).alias("shingles")), "shingle-sets"
    )
    by_band = buckets.filter((F.col("node") != F.col("v")) & _size_fits("n", "vn")).select(F.col("node").alias("u"), "v")
    stars = by_band.union(by_print).distinct()
    first = materialise(_verified(stars, sets), "star-links")
    roots = materialise(connected_components(first), "star-classes")
    rooted = buckets.join(roots, "node", "left").select("band", "node", "n", F.coalesce("root", "node").alias("root"))
    mixed = rooted.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("band")
    open_buckets = materialise(rooted.join(mixed, "band", "left_semi"), "mixed-buckets")
    one = open_buckets.select("band", F.col("node").alias("u"), F.col("n").alias("un"), F.col("root").alias("ur"))
    two = open_buckets.select("band", F.col("node").alias("v"), F.col("n").alias("vn"), F.col("root").alias("vr"))
    across = one.join(two, "band").filter((F.col("u") > F.col("v")) & (F.col("ur") != F.col("vr")) & _size_fits("un", "vn"))
    rest = across.select("u", "v").distinct().join(stars, ["u", "v"], "left_anti")
    links = first.union(_verified(materialise(rest, "further-pairs"), sets))
    classes = connected_components(links)
    return keyed.join(classes, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, a row with its smallest id, in the columns of ``docs``."""
    return simhash.keep_one(docs, cluster(docs, id_col, text_col), id_col, text_col)
