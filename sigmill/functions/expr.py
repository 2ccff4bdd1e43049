"""Small column helpers that operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: str | Column, digits: int) -> Column:
    """Rounded half away from zero as the queries' SQL does it: of the binary number times 10**digits. Spark's own round goes
    by the shortest decimal form, which differs where a value lies a last bit beside a half."""
    scale = 10.0**digits
    return F.round(col(x).cast("double") * F.lit(scale)) / F.lit(scale)


def r6(x: str | Column) -> Column:
    """Rounded to 6 decimals, without a negative zero."""
    return rounded(x, 6) + F.lit(0.0)


def times_mod32(x: Column, factor: int) -> Column:
    """(x * factor) mod 2**32 of any long, for a factor below 2**32: by the halves of x, whose products fit a long."""
    two32 = F.lit(1 << 32)
    x = F.pmod(x.cast("long"), two32)
    return F.pmod(F.pmod(F.shiftright(x, 16) * F.lit(factor), two32) * F.lit(1 << 16) + x.bitwiseAND(F.lit(0xFFFF)) * F.lit(factor), two32)


def spread_hash(x: str | Column) -> Column:
    """A portable order for deterministic draws: (x * 2654435761) mod 2**32."""
    return times_mod32(col(x), 2654435761)


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def safe_ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(otherwise)).otherwise(a / b)


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson's r as an aggregate; null where a side doesn't vary."""
    s = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(s > 1e-12, F.covar_pop(a, b) / s)
