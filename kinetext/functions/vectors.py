"""Vector math on ``array<double>`` columns, by higher-order functions; what is quadratic in two profiles goes through numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms up to this count as zero in the kinematic measures.
TINY = 1e-10


def double(e: Column) -> Column:
    return e.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def once(value: Column, f) -> Column:
    """``f`` of a value that is computed a single time, however often ``f`` uses it, also inside lambdas over arrays."""
    return F.get(F.transform(F.array(value), f), 0)


def total(vectors: Column) -> Column:
    """The sum of an array of vectors; null without any."""
    return F.aggregate(F.slice(vectors, 2, F.size(vectors)), F.get(vectors, 0), lambda s, x: F.zip_with(s, x, lambda p, q: p + q))


def scale(a: Column, by: Column) -> Column:
    return once(by, lambda b: F.transform(a, lambda x: x * b))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either norm is exactly 0; not clipped."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / (na * nb))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return once(norm(a), lambda n: F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n)))


def heatmap_unit(a: Column) -> Column:
    """Unit length; norms under TINY count as 1, so near-zero rows have similarity 0 to all, themselves included."""
    n = norm(a)
    return scale(a, 1 / F.when(n < TINY, 1.0).otherwise(n))


def angle(a: Column, b: Column) -> Column:
    """Radians; 0 if either norm is under TINY."""
    na, nb = norm(a), norm(b)
    return F.when((na < TINY) | (nb < TINY), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (na * nb)))))


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def resample(a: Column, length: Column) -> Column:
    """Linear interpolation of a profile onto ``length`` evenly spaced places from its first to its last value."""
    last = F.size(a) - 1
    at = lambda i: i * last / F.greatest(length - 1, F.lit(1))

    def value(i: Column) -> Column:
        x = at(i.cast("double"))
        lo = F.least(F.floor(x).cast("int"), last)
        hi = F.least(lo + 1, last)
        return F.get(a, lo) + (F.get(a, hi) - F.get(a, lo)) * (x - lo)

    return F.transform(F.sequence(F.lit(0), length - 1), value)


def _row_by_row(f: Callable[[np.ndarray, np.ndarray], float], a: Column, b: Column) -> Column:
    """``f`` of both arrays of each row; ``f`` is a nested function, so that workers need no module of this package."""
    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        of = lambda v: v.values.to_numpy(zero_copy_only=False).astype(float)
        return pa.array([f(of(p), of(q)) if p.is_valid and q.is_valid else None for p, q in zip(x, y)], pa.float64())

    return run(a, b)


def dtw(a: Column, b: Column) -> Column:
    """Dynamic time warping distance by absolute differences, over len(a) + len(b) - 1; infinite if either is empty.

    Goes diagonal by diagonal, three of which are held, so memory is that of a few profiles.
    """
    def warp(a, b):
        if len(a) > len(b):
            a, b = b, a  # the cells are the same either way
        n, m = len(a), len(b)
        if not n:
            return float("inf")
        back = b[::-1].copy()
        # of a diagonal, the cell in row i is at i; before the first row and column all is infinite but the start
        older, old, new = (np.full(n + 1, np.inf) for _ in range(3))
        older[0] = 0.0
        cost, near = np.empty(n), np.empty(n)
        for k in range(2, n + m + 1):
            lo, hi = max(1, k - m), min(n, k - 1)
            c, d = cost[: hi - lo + 1], near[: hi - lo + 1]
            np.abs(np.subtract(a[lo - 1 : hi], back[m - k + lo : m - k + hi + 1], out=c), out=c)
            np.fmin(old[lo : hi + 1], old[lo - 1 : hi], out=d)
            np.fmin(d, older[lo - 1 : hi], out=d)
            np.add(c, d, out=new[lo : hi + 1])
            new[lo - 1] = np.inf
            if hi < n:
                new[hi + 1] = np.inf
            older, old, new = old, new, older
        return float(old[n]) / (n + m - 1)

    return _row_by_row(warp, a, b)


def greedy_match(a: Column, b: Column) -> Column:
    """Sum over ``a``, in its order, of the distance to the nearest value of ``b`` not yet taken (the first of equally near ones), if under 1; else 1."""
    def match(a, b):
        total, free = 0.0, np.where(np.isnan(b), np.inf, b)  # what is taken goes infinitely far
        if not len(free):
            return float(len(a))
        far = np.empty_like(free)
        for p in a:
            j = int(np.abs(np.subtract(p, free, out=far), out=far).argmin())
            if far[j] < 1:
                total, free[j] = total + float(far[j]), np.inf
            else:
                total += 1.0
        return total

    return _row_by_row(match, a, b)
