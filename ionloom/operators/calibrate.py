"""Retention calibration: robust statistics, weight grid, monotone path, curve, ridge and tolerances.

Points are aggregated to a grid of at most ``bins`` squared cells by Spark; path and ridge work on that
bounded grid on the driver. The curve goes back as a small array of points.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.operators.sequence import numbered
from ionloom.runtime import sized_join, stored

MAD_TO_SD = 1.4826
LOOKBACK = 30
MIN_STEP = 1e-9


def robust_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, population sd, upper median and upper median of absolute deviations per group.

    The upper median is the value at n div 2 from 0, found by running number over ranges of the sorted
    values: a group of any size is spread over many tasks."""
    v = F.col(value).cast("double")
    ok = rows.filter(v.isNotNull() & ~F.isnan(v)).select(*by, v.alias("_v"))
    base = ok.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("sd"))

    def upper(df: DataFrame, name: str) -> DataFrame:
        seq = sized_join(numbered(df, by, ["_v"], "_k"), base.select(*by, "n"), by, "inner")
        return seq.filter(F.col("_k") == F.floor(F.col("n") / 2)).select(*by, F.col("_v").alias(name))

    med = stored(upper(ok, "median"))
    dev = sized_join(ok, med, by, "inner").select(*by, F.abs(F.col("_v") - F.col("median")).alias("_v"))
    return base.join(med, by).join(upper(dev, "mad"), by)


def mad_bounds(median: Column, mad: Column, sigmas: float, floor: float) -> tuple[Column, Column]:
    """Tolerance below and above: at least ``floor`` on either side."""
    spread = mad * (MAD_TO_SD * sigmas)
    return F.greatest(-(median - spread), F.lit(floor)), F.greatest(median + spread, F.lit(floor))


def grid(points: DataFrame, bins: int, x_range: tuple[float, float], y_range: tuple[float, float]) -> DataFrame:
    """(gx, gy, weight, cx, cy): summed weight and weighted centre of the cells in use; what lies beyond
    the range counts in the edge cell, non-finite points in none."""

    def cell(c: str, r: tuple[float, float]) -> Column:
        return F.least(F.greatest(F.floor((F.col(c) - r[0]) / (r[1] - r[0]) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")

    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    p = points.filter(finite("library") & finite("observed") & finite("weight"))
    g = p.groupBy(cell("library", x_range).alias("gx"), cell("observed", y_range).alias("gy")).agg(F.sum("weight").alias("weight"), F.sum(F.col("library") * F.col("weight")).alias("_x"), F.sum(F.col("observed") * F.col("weight")).alias("_y"))
    mid = lambda k, r: r[0] + (F.col(k) + 0.5) * (r[1] - r[0]) / bins
    return g.select("gx", "gy", "weight", F.when(F.col("weight") > 0, F.col("_x") / F.col("weight")).otherwise(mid("gx", x_range)).alias("cx"), F.when(F.col("weight") > 0, F.col("_y") / F.col("weight")).otherwise(mid("gy", y_range)).alias("cy"))


def suppress(cells: DataFrame) -> DataFrame:
    """Cells that are the heaviest of both their row and their column and weigh at least 1."""
    row, col = Window.partitionBy("gy"), Window.partitionBy("gx")
    top = F.greatest(F.max("weight").over(row), F.lit(1.0)), F.greatest(F.max("weight").over(col), F.lit(1.0))
    return cells.withColumn("_r", top[0]).withColumn("_c", top[1]).filter((F.col("weight") == F.col("_r")) & (F.col("weight") == F.col("_c"))).drop("_r", "_c")


def monotone_path(nodes: list[tuple[float, float, float]], lookback: int = LOOKBACK) -> list[tuple[float, float, float]]:
    """The heaviest chain of (x, y, weight) that rises in both, extended outwards to what still fits.

    A chain weighs its first node plus, per link, the geometric mean of the two weights over their
    distance; a link skips at most ``lookback`` nodes; of equal chains the first stays."""
    nodes = sorted(nodes)
    n = len(nodes)
    if not n:
        return []
    x, y, w = (np.array(c, dtype=float) for c in zip(*nodes))
    root = np.sqrt(w)
    best, came = w.copy(), np.full(n, -1)
    for i in range(1, n):
        a = max(0, i - lookback)
        dx, dy = x[i] - x[a:i], y[i] - y[a:i]
        d = np.hypot(dx, dy)
        ok = (dx > 0) & (dy > 0) & (d > 1e-6)
        if ok.any():
            chain = np.where(ok, best[a:i] + root[i] * root[a:i] / np.where(ok, d, 1.0), -math.inf)
            k = int(np.argmax(chain))
            if chain[k] > best[i]:
                best[i], came[i] = chain[k], a + k
    k = int(np.argmax(best)) if best.max() > 0 else 0
    path = [k]
    while came[path[-1]] >= 0:
        path.append(int(came[path[-1]]))
    path.reverse()

    def extend(order: range, at: int, sign: int) -> list[int]:
        out, cx, cy = [], x[at], y[at]
        for j in order:
            if w[j] > 0 and sign * (x[j] - cx) > 0 and sign * (y[j] - cy) > 0:
                out.append(j)
                cx, cy = x[j], y[j]
        return out

    path = extend(range(path[0] - 1, -1, -1), path[0], -1)[::-1] + path + extend(range(path[-1] + 1, n), path[-1], 1)
    return [nodes[i] for i in path]


@dataclass
class Curve:
    """Piecewise linear; beyond the ends the outermost slopes go on."""

    xs: list[float]
    ys: list[float]

    def __post_init__(self):
        if len(self.xs) < 2:
            raise ValueError("a curve needs two points")
        order = np.argsort(self.xs, kind="stable")
        self.xs, self.ys = [float(self.xs[i]) for i in order], [float(self.ys[i]) for i in order]

    def predict(self, x):
        xs, ys = np.array(self.xs), np.array(self.ys)
        slope = np.diff(ys) / np.maximum(np.diff(xs), MIN_STEP)
        i = np.clip(np.searchsorted(xs, x, side="left"), 1, len(slope))
        return ys[i - 1] + (np.asarray(x) - xs[i - 1]) * slope[i - 1]

    def column(self, x: Column) -> Column:
        """The same in the JVM: a tree of comparisons for a few points, a search of a constant array for more."""
        xs, ys = self.xs, self.ys
        slope = [(ys[i + 1] - ys[i]) / max(xs[i + 1] - xs[i], MIN_STEP) for i in range(len(xs) - 1)]
        if len(slope) > 8:
            const = lambda v: F.array(*[F.lit(t) for t in v])
            i = F.size(F.filter(const(xs[1:-1]), lambda t: t < x))
            part = F.get(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.lit(c).alias("s")) for a, b, c in zip(xs, ys, slope)]), i)
            return part.y + (x - part.x) * part.s

        def tree(a: int, b: int) -> Column:
            if a == b:
                return F.lit(ys[a]) + (x - F.lit(xs[a])) * F.lit(slope[a])
            m = (a + b) // 2
            return F.when(x <= xs[m + 1], tree(a, m)).otherwise(tree(m + 1, b))

        return tree(0, len(slope) - 1)

    def inside(self, x: Column) -> Column:
        return (x >= self.xs[0]) & (x <= self.xs[-1])


def wrmse(points: DataFrame, curve: Curve) -> DataFrame:
    """Weighted root mean square error; points outside the curve don't count, none gives null."""
    x, y, w = F.col("library"), F.col("observed"), F.col("weight")
    e = curve.column(x) - y
    return points.filter(curve.inside(x)).agg((F.sqrt(F.sum(e * e * w) / F.when(F.sum(w) != 0, F.sum(w)))).alias("wrmse"))


def blurred_grid(weight: np.ndarray) -> np.ndarray:
    """3 x 3 smoothing, the centre 0.2 and the rest 0.1, edges repeated."""
    p = np.pad(weight, 1, mode="edge")
    n, m = weight.shape
    return 0.1 * sum(p[a : a + n, b : b + m] for a in range(3) for b in range(3)) + 0.1 * weight


@dataclass
class Ridge:
    library: list[float] = field(default_factory=list)
    half_width: list[float] = field(default_factory=list)
    ridge_weight: list[float] = field(default_factory=list)
    column_weight: list[float] = field(default_factory=list)

    def half_width_at(self, x):
        return np.interp(x, self.library, self.half_width) if self.library else np.full(np.shape(x), np.nan)

    def summary(self) -> dict[str, float]:
        w, h = np.array(self.ridge_weight), np.array(self.half_width)
        return {"mean": float((w * h).sum() / w.sum()), "min": float(h.min()), "max": float(h.max()), "in_ridge": float(w.sum() / np.sum(self.column_weight))}


def ridge(weight: np.ndarray, path_cells: list[tuple[int, int]], centres: list[float], y_span: float, fraction: float = 0.1) -> Ridge:
    """How far around each path cell the smoothed column stays at or above ``fraction`` of it."""
    smooth = blurred_grid(weight)
    bins = len(smooth)
    out = Ridge()
    for (gx, gy), x in sorted(zip(path_cells, centres), key=lambda t: t[1]):
        col = smooth[:, gx]
        if col[gy] <= 0:
            continue
        low = col < fraction * col[gy]
        up, down = np.flatnonzero(low[gy + 1 :]), np.flatnonzero(low[:gy][::-1])
        hi = gy + (up[0] if len(up) else bins - 1 - gy)
        lo = gy - (down[0] if len(down) else gy)
        out.library.append(float(x))
        out.half_width.append(float((hi - lo + 1) * y_span / bins / 2))
        out.ridge_weight.append(float(col[lo : hi + 1].sum()))
        out.column_weight.append(float(col.sum()))
    return out


@dataclass
class Calibration:
    curve: Curve
    ridge: Ridge
    rt_minutes: float = 1.0
    mz_ppm: tuple[float, float] = (10.0, 10.0)
    mobility_pct: tuple[float, float] = (5.0, 5.0)

    def as_json(self) -> dict:
        return {"version": 2, "points": list(zip(self.curve.xs, self.curve.ys)), "ridge": list(zip(self.ridge.library, self.ridge.half_width)), "rt_minutes": self.rt_minutes, "mz_ppm": self.mz_ppm, "mobility_pct": self.mobility_pct}

    @staticmethod
    def from_json(o: dict) -> Calibration:
        if o.get("version") != 2:
            raise ValueError("calibration of another version")
        r = Ridge(*(list(map(float, c)) for c in zip(*o["ridge"]))) if o["ridge"] else Ridge()
        return Calibration(Curve(*(list(c) for c in zip(*o["points"]))), r, o["rt_minutes"], tuple(o["mz_ppm"]), tuple(o["mobility_pct"]))

    def apply(self, library: DataFrame, rt: str = "rt_seconds") -> DataFrame:
        """Adds rt_calibrated and rt_tolerance_minutes: the ridge there, at least half a minute."""
        x = F.col(rt)
        if self.ridge.library:
            width = Curve(self.ridge.library, self.ridge.half_width).column(F.least(F.greatest(x, F.lit(self.ridge.library[0])), F.lit(self.ridge.library[-1]))) if len(self.ridge.library) > 1 else F.lit(self.ridge.half_width[0])
            tol = F.greatest(width / 60, F.lit(0.5))
        else:
            tol = F.lit(self.rt_minutes)
        return library.withColumn("rt_calibrated", self.curve.column(x)).withColumn("rt_tolerance_minutes", tol)


def apply_each(library: DataFrame, by: dict[int, Calibration], key: str, rt: str = "rt_seconds") -> DataFrame:
    """As Calibration.apply, each row by the one its ``key`` has in ``by``; the curves are a small table."""

    def parts(c: Curve) -> tuple[list[float], list[tuple[float, float, float]]]:
        slope = [(c.ys[i + 1] - c.ys[i]) / max(c.xs[i + 1] - c.xs[i], MIN_STEP) for i in range(len(c.xs) - 1)]
        return c.xs[1:-1], list(zip(c.xs, c.ys, slope))

    def width(r: Ridge) -> tuple[float, float, list[float], list[tuple[float, float, float]]]:
        # Beyond its ends a ridge is as wide as at them.
        if len(r.library) < 2:
            return (r.library[0], r.library[0], [], [(r.library[0], r.half_width[0], 0.0)]) if r.library else (0.0, 0.0, [], [])
        return r.library[0], r.library[-1], *parts(Curve(list(r.library), list(r.half_width)))

    seg = "array<struct<x:double,y:double,s:double>>"
    kind = library.schema[key].dataType.simpleString()
    rows = [(k, *parts(c.curve), *width(c.ridge), float(c.rt_minutes)) for k, c in by.items()]
    curves = library.sparkSession.createDataFrame(rows, f"`{key}` {kind}, _k array<double>, _c {seg}, _r0 double, _r1 double, _rk array<double>, _rc {seg}, _m double")

    def at(x: Column, knots: str, segments: str) -> Column:
        p = F.get(segments, F.size(F.filter(knots, lambda t: t < x)))
        return p.y + (x - p.x) * p.s

    x = F.col(rt)
    tol = F.when(F.size("_rc") > 0, F.greatest(at(F.least(F.greatest(x, F.col("_r0")), F.col("_r1")), "_rk", "_rc") / 60, F.lit(0.5))).otherwise(F.col("_m"))
    out = sized_join(library, curves, [key], "inner").withColumn("rt_calibrated", at(x, "_k", "_c")).withColumn("rt_tolerance_minutes", tol)
    return out.drop("_k", "_c", "_r0", "_r1", "_rk", "_rc", "_m")


def fallback() -> Calibration:
    """Times as they are, one minute, 10 ppm, 5 percent."""
    return Calibration(Curve([0.0, 1.0], [0.0, 1.0]), Ridge())


def fit(points: DataFrame, bins: int = 100) -> Calibration:
    """Grid, suppression, path, curve and ridge of (library, observed, weight); the fallback where there
    are too few points. At most ``bins`` squared cells reach the driver."""
    r = points.agg(F.min("library"), F.max("library"), F.min("observed"), F.max("observed")).first()
    if r[0] is None or r[0] == r[1] or r[2] == r[3]:
        return fallback()
    cells = grid(points, bins, (r[0], r[1]), (r[2], r[3])).toPandas()
    kept = cells[(cells.weight >= 1) & (cells.weight == cells.groupby("gx").weight.transform("max")) & (cells.weight == cells.groupby("gy").weight.transform("max"))]
    path = monotone_path(list(kept[["cx", "cy", "weight"]].itertuples(index=False, name=None)))
    if len(path) < 2:
        return fallback()
    dense = np.zeros((bins, bins))
    dense[cells.gy, cells.gx] = cells.weight
    place = {(a.cx, a.cy): (int(a.gx), int(a.gy)) for a in kept.itertuples()}
    return Calibration(Curve([p[0] for p in path], [p[1] for p in path]), ridge(dense, [place[p[:2]] for p in path], [p[0] for p in path], r[3] - r[2]))


class State:
    """Points that come in batches: only the grid is kept, so a fit costs the same however many came."""

    def __init__(self, bins: int, x_range: tuple[float, float], y_range: tuple[float, float]):
        self.bins, self.x_range, self.y_range = bins, x_range, y_range
        self.reset()

    def reset(self) -> None:
        self.sums = np.zeros((3, self.bins, self.bins))

    def update(self, batch: DataFrame) -> None:
        for c in grid(batch, self.bins, self.x_range, self.y_range).collect():
            self.sums[:, c.gy, c.gx] += (c.weight, c.weight * c.cx, c.weight * c.cy)

    def fit(self) -> Curve:
        w = self.sums[0]
        keep = (w >= 1) & (w == w.max(axis=0)) & (w == w.max(axis=1)[:, None])
        nodes = [(self.sums[1, a, b] / w[a, b], self.sums[2, a, b] / w[a, b], w[a, b]) for a, b in zip(*np.nonzero(keep))]
        path = monotone_path(nodes)
        return Curve([p[0] for p in path], [p[1] for p in path])
