"""Column expressions on vectors held as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(v: Column) -> Column:
    """The sum of the elements that aren't null; null if there are none."""
    return F.aggregate(v, F.lit(None).cast("double"), lambda a, x: F.coalesce(a + x, a, x))


def squared_distance(a: Column, b: Column) -> Column:
    """Over the positions that both have."""
    return _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def l2_normalized(v: Column, eps: float = 1e-12) -> Column:
    length = F.greatest(norm(v), F.lit(eps))
    return F.transform(v, lambda x: x / length)


def mean_by_position(v: Column, dim: int) -> Column:
    """Aggregate: the element-wise mean, by one partial average for each of ``dim`` positions, over the vectors that have it."""
    return F.array(*[F.avg(F.get(v, F.lit(i))) for i in range(dim)])


def blended(old: Column, new: Column, alpha: float) -> Column:
    return F.zip_with(old, new, lambda a, b: a * alpha + b * (1 - alpha))


def all_close(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)), lambda ok: ok)
