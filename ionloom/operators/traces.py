"""Per-cycle traces of a query and the peaks in them, as window functions over (query_id, cycle) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions.chemistry import ln_factorial

# Floors of the cosine and scribe traces, and the exponents of the apex profile.
COSINE_FLOOR, SCRIBE_FLOOR, EPSILON = 1e-3, -100.0, 1.1920929e-07
COSINE_POWER, PROFILE_OFFSET = 0.25, 0.25
MAX_STEPS = 10


def query_window() -> Window:
    return Window.partitionBy("query_id").orderBy("cycle")


def whole() -> Window:
    return Window.partitionBy("query_id")


def accumulators(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """Sums per (query_id, cycle) over ions with a positive expected height. ``cells`` (query_id, ion,
    cycle, intensity) need hold only the cells with signal; ``expected`` is (ion, expected) with or without
    a query_id."""
    on = ["query_id", "ion"] if "query_id" in expected.columns else ["ion"]
    j = cells.filter("intensity > 0").join(expected.filter("expected > 0"), on)
    obs, exp = F.col("intensity").cast("double"), F.col("expected")
    return j.groupBy("query_id", "cycle").agg(
        F.sum(obs * F.sqrt(exp)).alias("dot"), F.sum(obs * obs).alias("norm2"), F.sum(F.sqrt(obs)).alias("sqrt_sum"), F.sum(F.sqrt(obs * exp)).alias("cross"),
        F.sum(obs).alias("raw"), F.sum(F.log(F.greatest(obs, F.lit(1.0)))).alias("ln_sum"),
    )


def traces(acc: DataFrame, axis: DataFrame, totals: DataFrame) -> DataFrame:
    """(query_id, cycle, cosine, scribe, lazyscore, log_intensity) on the dense axis (query_id, cycle).

    ``totals`` is (sum_exp, sum_sqrt_exp) with or without a query_id. The squared difference of the two
    normalised spectra is expanded, so cells without signal need no rows."""
    t = axis.join(acc, ["query_id", "cycle"], "left")
    t = t.join(totals, "query_id") if "query_id" in totals.columns else t.join(F.broadcast(totals))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    cosine = F.when((z("norm2") > 0) & (F.col("sum_exp") > 0), F.least(F.greatest(F.col("dot") / (F.sqrt("norm2") * F.sqrt("sum_exp")), F.lit(COSINE_FLOOR)), F.lit(1.0))).otherwise(F.lit(COSINE_FLOOR))
    sse = F.col("raw") / F.pow("sqrt_sum", F.lit(2.0)) - 2 * F.col("cross") / (F.col("sqrt_sum") * F.col("sum_sqrt_exp")) + F.col("sum_exp") / F.pow("sum_sqrt_exp", F.lit(2.0))
    scribe = F.when((z("sqrt_sum") > 0) & (F.col("sum_sqrt_exp") > 0), -F.log(F.greatest(sse, F.lit(EPSILON)))).otherwise(F.lit(SCRIBE_FLOOR))
    return t.select("query_id", "cycle", cosine.alias("cosine"), scribe.alias("scribe"), ln_factorial(z("ln_sum")).alias("lazyscore"), F.log1p(z("raw")).alias("log_intensity"))


def blurred(v: Column, w: Window | None = None) -> Column:
    """Weights 1/4, 1/2, 1/4; at the ends the outer weight falls on the end itself; fewer than 3 rows stay."""
    w = w or query_window()
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    return F.when(n < 3, v).otherwise((F.coalesce(before, v) * 0.5 + v + F.coalesce(after, v) * 0.5) / 2)


def apex_profile(t: DataFrame, blurs: int = 2) -> DataFrame:
    """Adds apex_profile, cosine_profile and scribe_profile."""
    s = F.col("scribe") * F.col("log_intensity")
    t = t.withColumn("_s", s).withColumn("_lo", F.min("_s").over(whole())).withColumn("_hi", F.max("_s").over(whole()))
    norm = F.when(F.col("_hi") > F.col("_lo"), (F.col("_s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)
    t = t.withColumn("apex_profile", F.pow("cosine", F.lit(COSINE_POWER)) * F.col("log_intensity") * (PROFILE_OFFSET + norm))
    for _ in range(blurs):
        t = t.withColumn("apex_profile", blurred(F.col("apex_profile")))
    return t.withColumn("cosine_profile", F.pow("cosine", F.lit(3.0)) * F.col("log_intensity")).withColumn("scribe_profile", s).drop("_s", "_lo", "_hi")


def pick(t: DataFrame, value: str, name: str) -> DataFrame:
    """(query_id, <name>, <name>_value): the first largest value of each query; NaN and null are passed over."""
    ok = t.filter(F.col(value).isNotNull() & ~F.isnan(value))
    best = ok.groupBy("query_id").agg(F.max(F.struct(F.col(value).alias("v"), (-F.col("cycle")).alias("c"))).alias("b"))
    return best.select("query_id", (-F.col("b.c")).alias(name), F.col("b.v").alias(f"{name}_value"))


def steps(t: DataFrame, apex: DataFrame, name: str, trace: str = "lazyscore") -> DataFrame:
    """Adds <name>_rise and <name>_fall to ``apex``: cells from the apex on while the trace doesn't grow,
    the apex counted, at most MAX_STEPS."""
    w = query_window()
    j = t.select("query_id", "cycle", trace, F.lag(trace).over(w).alias("_b"), F.lead(trace).over(w).alias("_a")).join(apex.select("query_id", name), "query_id")
    d = F.col("cycle") - F.col(name)
    g = j.groupBy("query_id").agg(
        F.min(F.when((d > 0) & (F.col(trace) > F.col("_b")), d)).alias("_f"), F.min(F.when((d < 0) & (F.col(trace) > F.col("_a")), -d)).alias("_r"), F.max(d).alias("_n"), F.max(-d).alias("_m")
    )
    g = g.select("query_id", F.least(F.coalesce("_r", F.col("_m") + 1), F.lit(MAX_STEPS)).cast("int").alias(f"{name}_rise"), F.least(F.coalesce("_f", F.col("_n") + 1), F.lit(MAX_STEPS)).cast("int").alias(f"{name}_fall"))
    return apex.join(g, "query_id")


def masked(t: DataFrame, peaks: DataFrame, name: str, factor: int) -> DataFrame:
    """``t`` without the cycles of a peak."""
    c, a = F.col("cycle"), F.col(name)
    p = peaks.select("query_id", name, f"{name}_rise", f"{name}_fall")
    return t.join(p, "query_id").filter((c < a - F.col(f"{name}_rise") * factor) | (c > a + F.col(f"{name}_fall") * factor)).drop(name, f"{name}_rise", f"{name}_fall")


def peaks(t: DataFrame, value: str = "apex_profile") -> DataFrame:
    """The best peak of each query, and how far the second and third lie below it (null if there is none)."""
    first = steps(t, pick(t, value, "apex"), "apex")
    rest = masked(t, first, "apex", 2)
    second = steps(t, pick(rest, value, "second"), "second")
    third = pick(masked(rest, second, "second", 1), value, "third")
    out = first.join(second.select("query_id", "second_value"), "query_id", "left").join(third.select("query_id", "third_value"), "query_id", "left")
    return out.select("query_id", "apex", "apex_value", "apex_rise", "apex_fall", (F.col("apex_value") - F.col("second_value")).alias("delta_next"), (F.col("apex_value") - F.col("third_value")).alias("delta_second_next"))


def baseline(t: DataFrame, peaks_: DataFrame) -> DataFrame:
    """(query_id, lambda, lazy_z, lazy_ratio): mean lazyscore around the peak (4 widths, without the inner 2),
    at least 1, and the apex against it."""
    d = F.col("cycle") - F.col("apex")
    r, f = F.col("apex_rise"), F.col("apex_fall")
    j = t.join(peaks_.select("query_id", "apex", "apex_rise", "apex_fall"), "query_id")
    ring = (d >= -4 * r) & (d <= 4 * f) & ((d < -2 * r) | (d > 2 * f))
    g = j.groupBy("query_id").agg(F.sum(F.when(ring, F.col("lazyscore"))).alias("_s"), F.count(F.when(ring, 1)).alias("_n"), F.max(F.when(d == 0, F.col("lazyscore"))).alias("_x"))
    lam = F.greatest(F.coalesce(F.col("_s") / F.when(F.col("_n") > 0, F.col("_n")), F.lit(1.0)), F.lit(1.0))
    g = g.withColumn("lambda", lam)
    return g.select("query_id", "lambda", (F.col("_x") / F.greatest(F.sqrt("lambda"), F.lit(1.0))).alias("lazy_z"), (F.col("_x") / F.col("lambda")).alias("lazy_ratio"))


def rolling_cosine(t: DataFrame, a: str, b: str, half: int) -> DataFrame:
    """Adds rolling: cosine of two columns in a centred window; null where the window isn't whole or empty."""
    w = query_window().rowsBetween(-half, half)
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    n, norm = F.count(F.lit(1)).over(w), F.sqrt(F.sum(x * x).over(w)) * F.sqrt(F.sum(y * y).over(w))
    return t.withColumn("rolling", F.when((n == 2 * half + 1) & (norm > 0), F.sum(x * y).over(w) / norm))


def convolve_rows(t: DataFrame, value: str, kernel: list[float], name: str) -> DataFrame:
    """Adds the valid part of a convolution with an odd kernel; rows whose window isn't whole hold 0."""
    w, half = query_window(), len(kernel) // 2
    at = lambda k: F.col(value) if k == 0 else (F.lag(value, k) if k > 0 else F.lead(value, -k)).over(w)
    terms = [at(k) * c for k, c in zip(range(half, -half - 1, -1), kernel)]
    return t.withColumn(name, F.coalesce(sum(terms[1:], terms[0]), F.lit(0.0)))


def convolve_grid(grid: DataFrame, bins: int, centre: float = 0.2, side: float = 0.1) -> DataFrame:
    """3 x 3 smoothing of a sparse grid (gx, gy, weight) with clamped edges: each cell sends its weight to
    the cells around it, and what would leave the grid is what its edge cells see twice."""
    three = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    edge = lambda c: F.explode(F.filter(F.transform(three, lambda k: F.col(c) - k), lambda t: (t >= 0) & (t < bins)))
    sends = grid.withColumn("tx", edge("gx")).withColumn("ty", edge("gy"))
    hits = lambda t, c: F.aggregate(three, F.lit(0), lambda acc, k: acc + F.when(F.least(F.greatest(F.col(t) + k, F.lit(0)), F.lit(bins - 1)) == F.col(c), 1).otherwise(0))
    n = hits("tx", "gx") * hits("ty", "gy")
    own = F.when((F.col("tx") == F.col("gx")) & (F.col("ty") == F.col("gy")), centre - side).otherwise(0.0)
    return sends.groupBy("tx", "ty").agg(F.sum(F.col("weight") * (n * side + own)).alias("weight")).withColumnsRenamed({"tx": "gx", "ty": "gy"})


def polynomial_smoothed(v: Column, window: int, order: int) -> Column:
    """An array smoothed by weights that fall from 1 in the middle as a power of the distance; places left of the
    start read the first value, places beyond the end don't count. Windows that are even, below 3 or longer than the
    array, and orders not below the window, leave it as it is."""
    if window < 3 or window % 2 == 0 or order >= window:
        return v
    half = window // 2
    weights = F.array(*[F.lit(max(0.0, 1.0 - (abs(k - half) / half) ** max(1, order))) for k in range(window)])
    n = F.size(v)

    def at(i: Column) -> Column:
        inside = F.filter(F.transform(weights, lambda w, j: F.struct(F.greatest(i + j - half, F.lit(0)).alias("p"), w.alias("w"))), lambda s: s.p < n)
        return F.aggregate(inside, F.lit(0.0), lambda acc, s: acc + s.w * F.get(v, s.p)) / F.aggregate(inside, F.lit(0.0), lambda acc, s: acc + s.w)

    return F.when(n >= window, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), at)).otherwise(v)


def gaussian_smoothed(v: Column, sigma: float) -> Column:
    """An array smoothed by a Gaussian of radius ceil(3 sigma); places left of the start read the first value."""
    import math

    r = math.ceil(3 * sigma)
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    weights = F.array(*[F.lit(x) for x in k])
    n = F.size(v)

    def at(i: Column) -> Column:
        inside = F.filter(F.transform(weights, lambda w, j: F.struct((F.greatest(i + j - r, F.lit(0))).alias("p"), w.alias("w"))), lambda s: s.p < n)
        total = F.aggregate(inside, F.lit(0.0), lambda acc, s: acc + s.w)
        return F.aggregate(inside, F.lit(0.0), lambda acc, s: acc + s.w * F.get(v, s.p)) / total

    return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), at)
