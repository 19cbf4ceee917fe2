"""Aggregations of the peaks that fall into query ranges.

``matches`` rows are (query_id, ion, cycle, mz, mobility, intensity, ...), one per peak and ion; a peak in
several windows of a query comes once per window, and a peak may serve several ions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def point_intensity(matches: DataFrame) -> DataFrame:
    """One sum over all ions of a query."""
    return matches.groupBy("query_id").agg(F.sum("intensity").alias("intensity"))


def spectrum(ions: DataFrame, matches: DataFrame) -> DataFrame:
    """Sum per ion; ions without a peak have 0."""
    sums = matches.groupBy("query_id", "ion").agg(F.sum("intensity").alias("intensity"))
    return ions.select("query_id", "ion").join(sums, ["query_id", "ion"], "left").select("query_id", "ion", F.coalesce("intensity", F.lit(0)).alias("intensity"))


def spectrum_stats(ions: DataFrame, matches: DataFrame) -> DataFrame:
    """Weight and intensity-weighted mean m/z and mobility per ion; null means no peak. Sums merge, so
    partial results are combined where the peaks lie."""
    w = F.col("intensity")
    stats = matches.filter(w > 0).groupBy("query_id", "ion").agg(F.sum(w).alias("weight"), F.sum(w * F.col("mz")).alias("_mz"), F.sum(w * F.col("mobility")).alias("_im"), F.count(F.lit(1)).alias("n_peaks"))
    out = ions.select("query_id", "ion").join(stats, ["query_id", "ion"], "left")
    return out.select("query_id", "ion", F.coalesce("weight", F.lit(0)).alias("weight"), (F.col("_mz") / F.col("weight")).alias("mz"), (F.col("_im") / F.col("weight")).alias("mobility"), F.coalesce("n_peaks", F.lit(0)).alias("n_peaks"))


def chromatograms(ions: DataFrame, matches: DataFrame) -> DataFrame:
    """A dense array of sums per ion over the cycles cycle_lo..cycle_hi of its query, 0 where no peak is.

    Cells are summed before the shuffle; the array is then built from the few cells there are."""
    cells = matches.groupBy("query_id", "ion", "cycle").agg(F.sum("intensity").alias("intensity"))
    maps = cells.groupBy("query_id", "ion").agg(F.map_from_entries(F.collect_list(F.struct(F.col("cycle").cast("int"), F.col("intensity").cast("double")))).alias("_m"))
    out = ions.select("query_id", "ion", F.col("cycle_lo").cast("int").alias("cycle_lo"), F.col("cycle_hi").cast("int").alias("cycle_hi")).join(maps, ["query_id", "ion"], "left")
    axis = F.sequence("cycle_lo", "cycle_hi")
    dense = F.when(F.col("_m").isNull(), F.transform(axis, lambda c: F.lit(0.0))).otherwise(F.transform(axis, lambda c: F.coalesce(F.try_element_at(F.col("_m"), c), F.lit(0.0))))
    return out.select("query_id", "ion", "cycle_lo", dense.alias("chromatogram"))


def trimmed(chroms: DataFrame, cycles: DataFrame) -> DataFrame:
    """Output form: each query's ions cut to the span of cycles with signal, ions without any dropped, with
    the times of the span. ``cycles`` (cycle, rt_ms) is the run's axis."""
    v = F.col("chromatogram")
    first = F.array_position(F.transform(v, lambda x: x > 0), True)
    last = F.size(v) - F.array_position(F.reverse(F.transform(v, lambda x: x > 0)), True) + 1
    live = chroms.withColumn("_a", first.cast("int")).withColumn("_b", last.cast("int")).filter("_a > 0")
    span = live.groupBy("query_id").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b"))
    cut = live.drop("_a", "_b").join(span, "query_id").select("query_id", "ion", (F.col("cycle_lo") + F.col("_a") - 1).alias("cycle_lo"), F.slice(v, F.col("_a"), F.col("_b") - F.col("_a") + 1).alias("chromatogram"))
    ends = cycles.select(F.col("cycle").alias("cycle_lo"), (F.col("rt_ms") / 1000).alias("rt_start"))
    return cut.join(ends, "cycle_lo", "left")


def transposed(chroms: DataFrame) -> DataFrame:
    """From one array per ion to one array per cycle (ions in ascending order)."""
    rows = chroms.select("query_id", "ion", "cycle_lo", F.posexplode("chromatogram").alias("k", "intensity"))
    got = rows.groupBy("query_id", (F.col("cycle_lo") + F.col("k")).alias("cycle")).agg(F.array_sort(F.collect_list(F.struct("ion", "intensity"))).alias("_s"))
    return got.select("query_id", "cycle", F.col("_s.ion").alias("ions"), F.col("_s.intensity").alias("intensities"))


def match_counters(ions: DataFrame, matches: DataFrame) -> DataFrame:
    """Peaks and windows that matched, per query."""
    got = matches.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_peaks"), F.countDistinct("window_id").alias("n_windows"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return ions.select("query_id").distinct().join(got, "query_id", "left").select("query_id", zero("n_peaks"), zero("n_windows"))


def funnel(pairs: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """(stage, n): how many rows pass each stage and all before it, in one pass."""
    passed, aggs = F.lit(True), []
    for name, cond in stages.items():
        passed = passed & F.coalesce(cond, F.lit(False))
        aggs.append(F.count(F.when(passed, 1)).alias(name))
    one = pairs.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).alias("n")) for n in stages])))


# Why a query can't be scored, in the order of the gates.
SKIP_REASONS = (
    "no_expected_fragments", "fragmented_range", "rt_out_of_bounds", "fragments_outside_scan_range", "no_observed_signal", "apex_empty_data",
    "apex_insufficient_data", "apex_non_finite_score", "calibrant_nan_score", "finalize_error", "invariant_violation",
)


def skip_reason(n_fragments: Column = None, in_scan_range: Column = None, in_rt_range: Column = None, n_windows: Column = None, n_peaks: Column = None, apex_empty: Column = None, too_short: Column = None, not_finite: Column = None, calibrant_nan: Column = None, not_finished: Column = None, broken: Column = None) -> Column:
    """The first gate that a query fails; null if it passes those given."""
    none = lambda c: None if c is None else c == 0
    fails = (none(n_fragments), None if in_scan_range is None else ~in_scan_range, None if in_rt_range is None else ~in_rt_range, none(n_windows), none(n_peaks), apex_empty, too_short, not_finite, calibrant_nan, not_finished, broken)
    out = F.lit(None).cast("string")
    for name, fail in reversed(list(zip(SKIP_REASONS, fails))):
        if fail is not None:
            out = F.when(fail, name).otherwise(out)
    return out


#: Aggregations by name: functions of (ions, matches). A caller's own are added with ``aggregator``.
AGGREGATORS = {"point": lambda ions, matches: point_intensity(matches), "spectrum": spectrum, "stats": spectrum_stats, "chromatogram": chromatograms, "counters": match_counters}


def aggregator(name: str):
    """Registers a function of (ions, matches) as an aggregation."""

    def add(f):
        AGGREGATORS[name] = f
        return f

    return add


def aggregate(name: str, ions: DataFrame, matches: DataFrame) -> DataFrame:
    return AGGREGATORS[name](ions, matches)
