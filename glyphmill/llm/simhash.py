"""SimHash near-duplicates by the generalised pigeonhole principle.

A text's fingerprint has 64 bits: a bit is set if more than half of the hashes
of its word shingles have it set.  Fingerprints that differ in ``radius`` bits or
fewer are linked, and documents form classes, the connected components.

Candidates: the 64 bits are grouped into m partitions, correlated bits together.
Thresholds t_1..t_m that sum to radius - m + 1 are enough: two fingerprints in
reach differ in at most t_i bits of at least one partition i.  The thresholds are
unequal; dynamic programming picks those with the fewest candidates, which are
counted exactly from histograms over all fingerprints.  Each fingerprint is
indexed once in a partition with t_i >= 0 and probes all values within t_i bits.
Candidates are verified on all 64 bits.

A bucket that would give more pairs than it is worth takes a way whose work is
linear and still exact: fingerprints are linked where they reach a common point
with at most radius/2 bits changed each.  At most 2081 points a fingerprint, and
no point is reached by more than 2081 fingerprints, so there is no cap.

Equal fingerprints are one node throughout: copies never make pairs.

Defined results: null, empty and wordless texts have fingerprint zero and link
like any other.  Shorter texts than a shingle are one shingle.  Null ids join
classes but never name one, unless all of its ids are null.  Repeated rows share
a class.  Empty tables stay empty.  Columns named like outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, quoted
from .components import connected_components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: A bucket whose index rows times probes exceed this takes the linear way.
HOT_PAIRS = 4_000_000
#: Histograms of at most this many bits are counted exactly.
BLOCK_BITS = 16
OUTPUTS = ("fingerprint", "component_id")

_MASK = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the uint64 hashes have each bit set, lowest bit first."""
    out = np.empty(64, np.int64)
    full = np.concatenate([hashes, np.zeros(-len(hashes) % 255, np.uint64)])
    for k in range(8):
        lanes = ((full >> np.uint64(k)) & _MASK).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        out[k::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0)
    return out


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text, unsigned."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= shingle:
        return digest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(joined)]
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends)], dtype=np.uint64)
    counts = _bit_counts(hashes)
    bits = 2 * counts > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE, seed: int = SEED) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = [fingerprint(None if t is None else bytes(t), shingle, seed) for t in batch]
            yield pd.Series(np.array(found, dtype=np.uint64).view(np.int64))

    return of(F.encode(text, "UTF-8"))


# ---------------------------------------------------------------- planning


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often two bits are both set: a sum over all rows, 64 x 64 at the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((64, 64)), 0
        for batch in batches:
            raw = np.ascontiguousarray(batch.fp.to_numpy(np.int64)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        i, j = np.indices((64, 64))
        yield pd.DataFrame({"i": [*i.ravel(), -1], "j": [*j.ravel(), -1], "n": [*both.ravel().astype(np.int64), n]})

    rows = prints.select("fp").mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both, total = np.zeros((64, 64)), 0
    for r in rows:
        if r.i < 0:
            total = r.n
        else:
            both[r.i, r.j] = r.n
    return total, both


def group_bits(total: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal width that keep correlated bits together, chosen greedily."""
    share = both / max(total, 1)
    p = np.diag(share)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs((share - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    left, out = set(range(64)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        first = max(left, key=lambda b: (sum(related[b, c] for c in left), -b))
        group = [first]
        left.discard(first)
        while len(group) < width:
            best = max(left, key=lambda b: (related[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def extract(fp: Column, bits: list[int]) -> Column:
    """The given bits of a fingerprint, packed into a long; runs of neighbours move together."""
    out, at, k = F.lit(0).cast("long"), 0, 0
    while k < len(bits):
        run = 1
        while k + run < len(bits) and bits[k + run] == bits[k] + run:
            run += 1
        piece = F.shiftrightunsigned(fp, bits[k]).bitwiseAND(F.lit((1 << run) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(piece, at))
        at, k = at + run, k + run
    return out


def _distances(counts: np.ndarray) -> np.ndarray:
    """Ordered pairs of different rows at each Hamming distance, from a histogram over 2^w values (an XOR convolution)."""
    size = len(counts)
    a = counts.astype(np.float64)
    h = 1
    while h < size:
        a = a.reshape(-1, 2, h)
        a = np.concatenate([a[:, :1] + a[:, 1:], a[:, :1] - a[:, 1:]], axis=1).reshape(-1)
        h *= 2
    a = a * a
    h = 1
    while h < size:
        a = a.reshape(-1, 2, h)
        a = np.concatenate([a[:, :1] + a[:, 1:], a[:, :1] - a[:, 1:]], axis=1).reshape(-1)
        h *= 2
    a /= size
    a[0] -= counts.sum()
    ones = np.array([bin(i).count("1") for i in range(size)])
    return np.maximum(np.bincount(ones, weights=a), 0)


def candidate_counts(prints: DataFrame, total: int, choices: list[list[list[int]]], radius: int) -> list[list[list[float]]]:
    """For each partition of each choice, the pairs that differ in at most t of its bits, t = 0..radius.

    Blocks of up to 16 bits are counted from one histogram over all fingerprints
    (2^16 values a block at most); wider partitions combine theirs as if independent.
    """
    blocks = []
    for m, groups in enumerate(choices):
        for k, g in enumerate(groups):
            width = -(-len(g) // -(-len(g) // BLOCK_BITS))
            blocks += [(m, k, g[i : i + width]) for i in range(0, len(g), width)]
    keyed = F.array(
        *[F.struct(F.lit(b).alias("b"), extract(F.col("fp"), bits).alias("v")) for b, (_, _, bits) in enumerate(blocks)]
    )
    found = prints.select(F.explode(keyed).alias("e")).groupBy("e.b", "e.v").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas()
    pairs = max(float(total) * (total - 1), 1.0)
    shares: list[list] = [[np.ones(1) for _ in groups] for groups in choices]
    for b, (m, k, bits) in enumerate(blocks):
        mine = found[found.b == b]
        counts = np.zeros(1 << len(bits))
        counts[mine.v.to_numpy(np.int64)] = mine.n.to_numpy()
        shares[m][k] = np.convolve(shares[m][k], _distances(counts) / pairs)
    return [[list(np.cumsum(d)[: radius + 1] * pairs / 2) for d in groups] for groups in shares]


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds >= -1 that sum to ``budget`` with the least total cost; costs[i][t], t = -1 is free."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, len(row)):
                total = cost + (0.0 if t < 0 else row[t])
                key = spent + t
                if key not in after or total < after[key][0]:
                    after[key] = (total, [*chosen, t])
        best = after
    return best[budget]


def balls(width: int, radius: int) -> list[int]:
    """All patterns of at most ``radius`` bits out of ``width``."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def plan(prints: DataFrame, radius: int = RADIUS, parts: tuple[int, ...] = (2, 3, 4, 5)) -> list[tuple[list[int], int]]:
    """Partitions and their thresholds: the cheapest over several numbers of partitions.

    Cost: verified candidates, plus what indexing and probing send through the shuffle.
    """
    total, both = bit_statistics(prints)
    best: tuple[float, list] | None = None
    choices = [group_bits(total, both, m) for m in parts if radius - m + 1 >= 0]
    for groups, pairs in zip(choices, candidate_counts(prints, total, choices, radius)):
        rows = [[c + 3 * total * (1 + len(balls(len(g), t))) for t, c in enumerate(p)] for g, p in zip(groups, pairs)]
        cost, chosen = allocate(rows, radius - len(groups) + 1)
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, chosen) if t >= 0])
    assert best is not None
    return best[1]


# ---------------------------------------------------------------- links


@lru_cache
def _half_ball(radius: int) -> tuple[int, ...]:
    signed = [m if m < 1 << 63 else m - (1 << 64) for m in balls(64, radius)]
    return tuple(signed)


def linear_links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges among ``prints`` that have the same components as all links within an even ``radius``.

    Two fingerprints within the radius share a point at most radius/2 from both;
    all that share one are within the radius of each other, so a star will do.
    """
    ball = F.array(*[F.lit(m).cast("long") for m in _half_ball(radius // 2)])
    points = prints.select("fp", F.explode(F.transform(ball, lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("v"), F.max("fp").alias("w")).filter("v < w").drop("w")
    return points.join(least, "point").select(F.col("fp").alias("u"), "v").filter("u <> v").distinct()


def _probes(k: int, value: Column, patterns: list[int]) -> Column:
    """The entries (partition, value) that a fingerprint looks up."""
    ball = F.array(*[F.lit(m).cast("long") for m in patterns])
    return let(
        value,
        lambda v: F.transform(ball, lambda m: F.struct(F.lit(k).alias("k"), v.bitwiseXOR(m).alias("v"))),
    )


def links(prints: DataFrame, radius: int = RADIUS, hot_pairs: int = HOT_PAIRS, chosen: list | None = None) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of fingerprints within the radius."""
    chosen = plan(prints, radius) if chosen is None else chosen
    fp = F.col("fp")
    index, probe = [], []
    for k, (bits, t) in enumerate(chosen):
        value = extract(fp, bits)
        index.append(F.struct(F.lit(k).alias("k"), value.alias("v")))
        probe.append(_probes(k, value, balls(len(bits), t)))
    indexed = prints.select(F.explode(F.array(*index)).alias("e"), fp.alias("u")).select("e.k", "e.v", "u")
    probing = prints.select(F.explode(F.concat(*probe)).alias("e"), fp.alias("w")).select("e.k", "e.v", "w")
    loads = (
        indexed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("a"))
        .join(probing.groupBy("k", "v").agg(F.count(F.lit(1)).alias("b")), ["k", "v"])
        .filter(F.col("a") * F.col("b") > hot_pairs)
        .select("k", "v")
    )
    hot = materialise(loads, "hot-buckets")
    if hot.isEmpty():
        cold_i, cold_p, extra = indexed, probing, None
    else:
        cold_i = indexed.join(hot, ["k", "v"], "left_anti")
        cold_p = probing.join(hot, ["k", "v"], "left_anti")
        members = (
            indexed.join(hot, ["k", "v"], "left_semi").select(F.col("u").alias("fp"))
            .union(probing.join(hot, ["k", "v"], "left_semi").select("w"))
            .distinct()
        )
        extra = linear_links(members, radius)
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("w"))) <= radius
    found = cold_i.join(cold_p, ["k", "v"]).filter((F.col("u") < F.col("w")) & near).select("u", F.col("w").alias("v"))
    return found if extra is None else found.union(extra)


def cluster(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    hot_pairs: int = HOT_PAIRS,
) -> DataFrame:
    """Rows (doc_id, text_hash, fp, root, component_id), one for each of ``docs``; root is a fingerprint that names the class."""
    if radius % 2:
        raise ValueError("the radius is even: the linear way halves it")
    text = quoted(text_col)
    keyed = materialise(
        docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), fingerprints(text, shingle).alias("fp")),
        "fingerprints",
    )
    prints = materialise(keyed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = connected_components(links(prints.select("fp"), radius, hot_pairs))
    rooted = prints.join(roots, prints.fp == roots.node).select("fp", "first", "root")
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "root", "component_id")
    rest = prints.join(roots, prints.fp == roots.node, "left_anti").select(
        "fp", F.col("fp").alias("root"), F.col("first").alias("component_id")
    )
    return keyed.join(named.union(rest), "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each of ``docs``."""
    found = cluster(docs, id_col, text_col, **options)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, a row with its smallest id, in the columns of ``docs``."""
    return keep_one(docs, cluster(docs, id_col, text_col, **options), id_col, text_col)


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each class; ``found`` has doc_id, text_hash and root of each of ``docs``."""
    rows = found.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("m"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "m")
    best = rows.groupBy("root").agg(F.min(order).alias("b"))
    keepers = materialise(best.select(F.col("b.doc_id").alias("__gm_id"), F.col("b.text_hash").alias("__gm_hash"), F.col("b.m").alias("__gm_m")), "keepers")
    same = quoted(id_col).eqNullSafe(F.col("__gm_id")) & (F.col("__gm_text") == F.col("__gm_hash"))
    keyed = docs.withColumn("__gm_text", F.xxhash64(quoted(text_col)))
    own = [quoted(c) for c in docs.columns]
    single = keyed.join(keepers.filter("__gm_m = 1"), same, "left_semi").select(*own)
    repeated = keepers.filter("__gm_m > 1")
    if repeated.isEmpty():
        return single
    return single.union(keyed.join(repeated, same, "left_semi").dropDuplicates([id_col, "__gm_text"]).select(*own))
