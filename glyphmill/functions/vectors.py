"""Numeric vectors: coefficients, seeded draws, inverses, the xorshift generator.

Everything is a function of its arguments: no partition, order or retry changes
a value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9
_TWO52 = float(2**52)


def coefficient(rank: Column, j: Column) -> Column:
    """sin(i + 1) + cos(j - 1), in radians, for rank i and position j from 0."""
    return F.sin(rank.cast("double") + 1.0) + F.cos(j.cast("double") - 1.0)


def unit_draw(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of MD5."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long").cast("double") / F.lit(_TWO52)


def poisson_limits(lam: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until nothing is left above 52 bits."""
    p = total = math.exp(-lam)
    out, k = [total], 0
    while total < 1 - 2**-52 and k < lam + 12 * math.sqrt(lam) + 40:
        k += 1
        p *= lam / k
        total += p
        out.append(total)
    return out


def poisson_draw(key: Column, lam: float) -> Column:
    """A Poisson count by inversion of a seeded uniform number."""
    limits = F.array(*[F.lit(x) for x in poisson_limits(lam)])
    draw = F.transform(F.array(unit_draw(key)), lambda u: F.size(F.filter(limits, lambda c: c <= u)))
    return F.get(draw, F.lit(0))


def token_vector(token: Column, rank: Column, dim: int, lam: float, seed: int) -> Column:
    """Poisson(lam) * coefficient * 0.1 + 0.01 at each position, as floats."""

    def value(j: Column) -> Column:
        key = F.concat_ws("|", F.lit(str(seed)), token, j.cast("string"))
        return (poisson_draw(key, lam) * coefficient(rank, j) * 0.1 + 0.01).cast("float")

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value)


def squared_length(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def inverse(vector: Column, guard: bool = True) -> Column:
    """v / |v|^2; the zero vector gives zeros with the guard, NaN without; empty stays empty."""
    norm = F.transform(F.array(squared_length(vector)), lambda n: n)

    def body(n: Column) -> Column:
        if guard:
            return F.transform(vector, lambda x: F.when(n <= TINY, F.lit(0.0)).otherwise(x.cast("double") / n).cast("float"))
        return F.transform(vector, lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x.cast("double") / n).cast("float"))

    return F.get(F.transform(norm, body), F.lit(0))


def _low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def xorshift32(x: Column) -> Column:
    """One step of the 32-bit xorshift generator (13, 17, 5) on a long."""
    a = _low32(x.bitwiseXOR(F.shiftleft(x, 13)))
    b = a.bitwiseXOR(F.shiftrightunsigned(a, 17))
    return _low32(b.bitwiseXOR(F.shiftleft(b, 5)))


def scaled(x: Column, low: float, high: float = 10.0) -> Column:
    """A 32-bit number moved linearly to [low, high]."""
    return F.lit(low) + x.cast("double") / F.lit(4294967295.0) * F.lit(high - low)
