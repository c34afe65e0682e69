"""Vector functions as Column expressions. Sums run in order, in double precision."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    """A vector of any numeric element type (float, signed or unsigned byte) as doubles."""
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def _folded(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def l2sq(a: Column, b: Column, dim: int | None = None) -> Column:
    """Squared Euclidean distance; with a known dim one compiled expression, else a fold over the arrays."""
    if dim:
        diffs = [a[i] - b[i] for i in range(dim)]
        return reduce(lambda s, x: s + x, [x * x for x in diffs])
    return _folded(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def inner(a: Column, b: Column, dim: int | None = None) -> Column:
    if dim:
        return reduce(lambda s, x: s + x, [a[i] * b[i] for i in range(dim)])
    return _folded(F.zip_with(a, b, lambda x, y: x * y))


def ip_distance(a: Column, b: Column, dim: int | None = None) -> Column:
    """1 - a.b"""
    return 1 - inner(a, b, dim)


def euclidean(a: Column, b: Column, dim: int | None = None) -> Column:
    return F.sqrt(l2sq(a, b, dim))


def norm(a: Column, dim: int | None = None) -> Column:
    return F.sqrt(inner(a, a, dim))


def normalized(a: Column, dim: int | None = None) -> Column:
    """a over its length; a zero vector stays zero."""
    return F.transform(a, lambda x: x * (1 / (norm(a, dim) + 1e-30)))


def cosine_distance(a: Column, b: Column, dim: int | None = None) -> Column:
    return 1 - inner(a, b, dim) / (norm(a, dim) * norm(b, dim))


def equal_within(a: Column, b: Column, eps: float = 1e-5) -> Column:
    """Whether all elements differ by at most eps; vectors of unequal length aren't equal."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= eps), lambda x: x)
