"""Keyed randomness: a uniform is a function of (seed, stream, key, draw), so results don't depend on how rows are dealt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Uniforms have 48 bits.
UNIT = float(1 << 48)


def key_hash(key: Column) -> Column:
    """The first 48 bits of the key's md5, as a long."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 12), 16, 10).cast("long")


def uniform(seed: int, stream: str, key: Column, draw: Column | int = 0) -> Column:
    """A uniform in [0, 1) for each key and draw; the draws of one stream never move those of another."""
    draw = F.lit(draw) if isinstance(draw, int) else draw
    return key_hash(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), key.cast("string"), draw.cast("string"))) / F.lit(UNIT)


def normal(u: Column, v: Column) -> Column:
    """A standard normal from two uniforms (Box-Muller)."""
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def pick(u: Column, cumulative: list[tuple[object, float]]) -> Column:
    """The first value whose cumulative weight reaches u (weights are normalized here)."""
    total = sum(w for _, w in cumulative)
    out, at = None, 0.0
    for value, weight in cumulative:
        at += weight / total
        out = F.when(u <= at, F.lit(value)) if out is None else out.when(u <= at, F.lit(value))
    return out.otherwise(F.lit(cumulative[-1][0]))


def lognormal(u: Column, v: Column, mu: float, sigma: float) -> Column:
    return F.exp(mu + sigma * normal(u, v))


def poisson(u: Column, mean: float) -> Column:
    """The least k whose cumulative probability reaches u. The terms are written out, up to where a double adds no more."""
    import math

    term = total = math.exp(-mean)
    k, out = 0, F.lit(0)
    steps = []
    while total < 1 - 1e-12 and k < 1000:
        steps.append((total, k))
        k += 1
        term *= mean / k
        total += term
    return F.coalesce(F.array_min(F.transform(F.filter(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(i).alias("k")) for c, i in steps]), lambda x: u <= x["c"]), lambda x: x["k"])), F.lit(k)) if steps else out
