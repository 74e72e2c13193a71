"""Column expressions: guards, normalisers, repeatable random numbers, window positions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NULL instead of NaN and infinities."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def from_nodata(c: Column, nodata: float | None = -9999.0) -> Column:
    """NULL where a value is not finite or is the nodata value."""
    c = finite(c)
    return c if nodata is None else F.nullif(c, F.lit(nodata))


def to_nodata(c: Column, nodata: float = -9999.0) -> Column:
    return F.coalesce(finite(c), F.lit(nodata))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ramp(c: Column, low: float, high: float) -> Column:
    """0 at low or below, 1 at high or above, linear between; an empty range becomes one of width 1."""
    high = high if high > low else low + 1.0
    return clip((c - F.lit(low)) / F.lit(high - low), 0.0, 1.0)


def penetration(ground: Column, every: Column) -> Column:
    """Share of ground among all densities; the divisor is at least 1, and empty cells have 0."""
    return F.when(every > 0, ground / F.greatest(every, F.lit(1.0))).otherwise(F.lit(0.0))


def normalize_dem(z: Column, mean: Column, std: Column, fill: Column) -> Column:
    return (F.coalesce(z, fill) - mean) / std


def normalize_density(x: Column, scale: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))) / F.greatest(scale, F.lit(1.0))


def normalize_feature(x: Column, fill: Column, scale: Column) -> Column:
    return F.coalesce(x, fill, F.lit(0.0)) / F.greatest(scale, F.lit(1.0))


def normalize_ratio(x: Column) -> Column:
    return clip(F.coalesce(x, F.lit(0.0)), 0.0, 1.0)


def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) that depends on nothing but the keys: 32 bits of their md5."""
    text = F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def poisson(u: Column, mean: float) -> Column:
    """The Poisson quantile of u, exact for numbers of 32 bits: the table goes on until less than 2**-32 is left."""
    total, cdf, k = 0.0, [], 0
    while 1 - total >= 2.0**-32 and k < mean + 20 * math.sqrt(mean) + 40:
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean > 0 else 1.0
        cdf.append(total)
        k += 1
    return F.size(F.filter(F.array(*[F.lit(x) for x in cdf]), lambda x: x <= u))


def positions(length: Column, size: int, stride: int) -> Column:
    """Starts of windows that cover a length: 0, stride, ..., and one flush with the end."""
    last = (length - F.lit(size)).cast("int")
    return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride)), F.array(last))))
