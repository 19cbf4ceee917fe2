"""Range joins: rows whose value lies in another row's closed range.

Both sides meet in bins, so Spark joins on equality and checks the range afterwards. Ranges are binned at
the level whose bins are about as wide as they are: a narrow range takes at most two bins, a wide one a
few coarse bins, and values are copied only to the levels in use. Ranges without end have no bins; they
meet every row of their keys through bins of the whole axis.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.operators.sequence import neighbours, numbered
from ionloom.runtime import row_bytes, sized_join

#: Each level's bins are so many times as wide as those of the level below.
STEP = 16
LEVELS = 8


def range_join(values: DataFrame, ranges: DataFrame, value: str, lo: str, hi: str, keys: tuple[str, ...] = (), residual: Column | None = None, width: float | None = None, log: bool = False) -> DataFrame:
    """Inner join of ``values`` with the ``ranges`` that hold ``value`` (and agree in ``keys``).

    ``log`` bins the logarithm, so that relative widths are equal everywhere (values must be positive;
    others match nothing). ``width`` defaults to the median width of the ranges. Every pair comes once: a
    value has one bin per level and a range one level. Null or NaN values and bounds match nothing."""
    scale = (lambda c: F.log(c)) if log else (lambda c: c)
    v, a, b = F.col(value), F.col(lo), F.col(hi)
    usable = v.isNotNull() & ~F.isnan(v.cast("double"))
    if log:
        usable = usable & (v > 0)
        bounds = F.greatest(a, F.lit(1e-300))
    else:
        bounds = a
    ranges = ranges.filter(a.isNotNull() & b.isNotNull() & ~F.isnan(a.cast("double")) & ~F.isnan(b.cast("double")) & (a <= b) & ((b > 0) if log else F.lit(True)))
    size = scale(b) - scale(bounds)
    if width is None:
        width = ranges.filter(size < 1e300).select(F.percentile_approx(size, 0.5)).first()[0] or 0.0
    width = max(float(width), 1e-12)
    level = F.when(size <= width * 1.000001, 0)
    for k in range(1, LEVELS):
        level = level.when(size <= width * STEP**k, k)
    level = level.otherwise(F.lit(LEVELS))
    bin_of = lambda c, k: F.when(k == LEVELS, F.lit(0)).otherwise(F.floor(c / (width * F.pow(F.lit(float(STEP)), k)))).cast("long")
    leveled = ranges.withColumn("_il_level", level.cast("int"))
    k = F.col("_il_level")
    first, last = bin_of(scale(bounds), k), bin_of(scale(b), k)
    # One pass over the ranges tells the levels in use and the size of the binned side.
    stats = leveled.agg(F.collect_set("_il_level").alias("used"), F.sum(row_bytes(leveled) * F.when(k == LEVELS, 1).otherwise(last - first + 1)).alias("bytes")).first()
    used = sorted(stats["used"])
    right = leveled.withColumn("_il_bin", F.explode(F.when(k == LEVELS, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, last))))
    left = values.filter(usable)
    left = left.withColumn("_il_level", F.explode(F.array(*[F.lit(u) for u in used])) if len(used) > 1 else F.lit(used[0] if used else 0)).withColumn("_il_bin", bin_of(scale(v), k))
    joined = sized_join(left, right, [*keys, "_il_level", "_il_bin"], "inner", bytes_=int(stats["bytes"] or 0)).drop("_il_level", "_il_bin").filter((v >= a) & (v <= b))
    return joined if residual is None else joined.filter(residual)


def nearest(values: DataFrame, axis: DataFrame, value: str, point: str, group: tuple[str, ...] = ()) -> DataFrame:
    """``values`` with the nearest ``point`` of ``axis`` (of the same group); a tie takes the smaller, and
    values beyond the ends take the end. Axis points are turned into the ranges they are nearest in, so
    this is a range join. Rows with a null value, or without any point, are left out."""
    p = F.col(point).cast("double")
    pts = axis.select(*group, point).filter(F.col(point).isNotNull()).distinct()
    beside = _beside(pts, point, list(group))
    cells = beside.select(*group, point, F.coalesce((F.col(f"prev_{point}") + p) / 2, F.lit(float("-inf"))).alias("_il_lo"), F.coalesce((p + F.col(f"next_{point}")) / 2, F.lit(float("inf"))).alias("_il_hi"))
    # At the middle both cells hold the value; the earlier one keeps it.
    out = range_join(values, cells, value, "_il_lo", "_il_hi", group, residual=(F.col(value) > F.col("_il_lo")) | (F.col("_il_lo") == float("-inf")))
    return out.drop("_il_lo", "_il_hi")


def _beside(points: DataFrame, point: str, group: list[str]) -> DataFrame:
    """The points with those before and after; an axis of any length is spread over ranges and blocks."""
    return neighbours(numbered(points, group, [point], "_il_k"), group, "_il_k", [point]).drop("_il_k")


def overlap_join(a: DataFrame, b: DataFrame, a_range: tuple[str, str], b_range: tuple[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose closed ranges meet (and agree in ``keys``): one range holds the other's start. Every pair comes once.
    Other columns of the two sides must have different names."""
    holds = range_join(a, b, a_range[0], *b_range, keys)
    starts = range_join(b, a, b_range[0], *a_range, keys, residual=F.col(b_range[0]) > F.col(a_range[0]))
    return holds.unionByName(starts.select(*holds.columns))


def snap(values: DataFrame, grid: DataFrame, at: str, value: str, point: str) -> DataFrame:
    """(point, value): each value moves to the first grid point not before it, of several the largest stays; empty points hold 0."""
    pts = grid.select(point).filter(F.col(point).isNotNull()).distinct()
    prev = F.col(f"prev_{point}").cast("double")
    cells = _beside(pts, point, []).select(point, F.coalesce(prev, F.lit(float("-inf"))).alias("_il_lo"), F.col(point).cast("double").alias("_il_hi"))
    hit = range_join(values, cells, at, "_il_lo", "_il_hi", residual=(F.col(at) > F.col("_il_lo")) | (F.col("_il_lo") == float("-inf")))
    best = hit.groupBy(point).agg(F.max(value).alias(value))
    return pts.join(best, point, "left").select(point, F.coalesce(F.col(value), F.lit(0)).alias(value))
