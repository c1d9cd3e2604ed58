"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def norm(c: Column) -> Column:
    return F.sqrt(total(F.transform(c, lambda x: x * x)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def l2_normalize(c: Column) -> Column:
    """A vector shorter than 1e-10 stays as it is."""
    n = norm(c)
    return F.when(n < 1e-10, c).otherwise(F.transform(c, lambda x: x / n))


def rounded(c: Column, digits: int) -> Column:
    """Values to so many decimals as SQL's round has them: scaled, halves away from zero, and what was negative keeps its sign at zero."""

    def one(x: Column) -> Column:
        y = x * 10.0**digits
        whole = F.when(F.abs(y - F.rint(y)) == 0.5, y + 0.5 * F.signum(y)).otherwise(F.rint(y))
        return F.when(F.abs(y) < float("inf"), whole / 10.0**digits).otherwise(x)

    return F.transform(c, one)


def mean(c: Column) -> Column:
    return total(c) / F.size(c)


def std_pop(c: Column) -> Column:
    m = mean(c)
    return F.sqrt(total(F.transform(c, lambda x: (x - m) * (x - m))) / F.size(c))


def peak_cap(c: Column, decibel: float = -1.0) -> Column:
    top, most = F.array_max(F.transform(c, F.abs)), 10 ** (decibel / 20)
    return F.when(top > most, F.transform(c, lambda x: x * (F.lit(most) / top))).otherwise(c)


def center_crop(c: Column, n: int) -> Column:
    return F.when(F.size(c) > n, F.slice(c, F.floor((F.size(c) - n) / 2).cast("int") + 1, n)).otherwise(c)


def flux(c: Column) -> Column:
    """First differences along the series; fewer than two values have none."""
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.zip_with(F.slice(c, F.lit(2), n), F.slice(c, F.lit(1), n), lambda b, a: b - a)


def second_peak(c: Column, reach: int = 5) -> Column:
    """The largest value more than ``reach`` places from the first largest."""
    at = F.array_position(c, F.array_max(c)) - 1
    return F.array_max(F.transform(c, lambda x, i: F.when(F.abs(i - at) <= reach, F.lit(0.0)).otherwise(x)))


def low_share(c: Column) -> Column:
    """The share of values below their mean."""
    m = mean(c)
    return F.size(F.filter(c, lambda x: x < m)) / F.size(c)


def fuse(*vectors: Column, digits: int = 8) -> Column:
    """Normalised vectors end to end, rounded."""
    return rounded(F.concat(*map(l2_normalize, vectors)), digits)
