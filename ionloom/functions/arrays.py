"""Array kernels on signals: JVM-side where built-in functions carry them, NumPy where they are pairwise."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Null for arrays of unequal length, empty ones and zero norms."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def pearson(a: Column, b: Column) -> Column:
    """0 where either is constant; null for unequal lengths."""
    n = F.size(a)
    cov = dot(a, b) - total(a) * total(b) / n
    va, vb = dot(a, a) - total(a) * total(a) / n, dot(b, b) - total(b) * total(b) / n
    d = F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0)))
    return F.when((n == F.size(b)) & (n > 0), F.when(d < 1e-12, 0.0).otherwise(cov / d))


def centred(a: Column) -> Column:
    """Mean 0 and length 1; null for a constant or empty array."""
    mean = total(a) / F.size(a)
    moved = F.transform(a, lambda x: x.cast("double") - mean)
    norm = F.sqrt(F.aggregate(moved, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when((F.size(a) > 0) & (norm >= 1e-12), F.transform(moved, lambda x: x / norm))


def argmax(a: Column) -> Column:
    """Place of the first largest value, 0 for an empty array; NaN is passed over."""
    ok = F.filter(a, lambda x: ~F.isnan(x.cast("double")))
    return F.coalesce(F.array_position(a, F.array_max(ok)) - 1, F.lit(0))


def top_n(a: Column, n: int) -> Column:
    """The ``n`` largest values with their places; earlier ones win ties."""
    pairs = F.transform(a, lambda x, i: F.struct((-x).alias("k"), i.alias("place")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda s: F.struct((-s.k).alias("value"), s.place.alias("place")))


def gaussian(n: Column, centre: Column, sigma: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.exp(-(i - centre) * (i - centre) / (2 * sigma * sigma)))


def cosort(keys: Column, values: Column) -> Column:
    """Pairs of two arrays in ascending order of the first."""
    return F.array_sort(F.arrays_zip(keys, values))


# NumPy kernels, used inside Arrow batches.


def np_pearson(a: np.ndarray, b: np.ndarray) -> float:
    x, y = a - a.mean(), b - b.mean()
    d = np.sqrt((x @ x) * (y @ y))
    return 0.0 if d < 1e-12 else float(x @ y / d)


def np_fwhm(profile: np.ndarray, apex: int) -> float:
    """Full width at half maximum around ``apex``, both crossings interpolated; at least 1, without signal 2."""
    if not len(profile) or profile[apex] <= 0:
        return 2.0
    half = profile[apex] / 2

    def reach(side: np.ndarray) -> float:
        under = np.flatnonzero(side[1:] <= half)
        if not len(under):
            return float(len(side) - 1)
        k = under[0]
        above, below = side[k], side[k + 1]
        return k + ((above - half) / (above - below) if abs(above - below) > 1e-12 else 0.5)

    return max(reach(profile[apex::-1]) + reach(profile[apex:]), 1.0)


def np_unit_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with mean 0 and length 1, and which rows are not constant."""
    moved = rows - rows.mean(axis=1, keepdims=True)
    norm = np.sqrt((moved**2).sum(axis=1))
    ok = norm >= 1e-12
    return moved[ok] / norm[ok, None], ok


def map_labels(fragments: Column, label: str, f) -> Column:
    """Fragments (an array of structs) with ``f`` applied to the field ``label``; the rest stays."""
    return F.transform(fragments, lambda x: x.withField(label, f(x[label])))


def drop_row(rows: Column, at: Column) -> Column:
    """An array of arrays without its row ``at`` (from 0); a place outside changes nothing, as in all of these."""
    return F.filter(rows, lambda r, i: i != at)


def swap_rows(rows: Column, a: Column, b: Column) -> Column:
    ok = (a >= 0) & (b >= 0) & (a < F.size(rows)) & (b < F.size(rows))
    return F.when(ok, F.transform(rows, lambda r, i: F.when(i == a, F.get(rows, b)).when(i == b, F.get(rows, a)).otherwise(r))).otherwise(rows)


def replace_row(rows: Column, at: Column, row: Column) -> Column:
    return F.transform(rows, lambda r, i: F.when(i == at, row).otherwise(r))


def put_value(rows: Column, at: Column, column: Column, value: Column) -> Column:
    """The value at a row and column replaced."""
    return F.transform(rows, lambda r, i: F.when(i == at, F.transform(r, lambda x, j: F.when(j == column, value).otherwise(x))).otherwise(r))
