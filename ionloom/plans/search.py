"""Searching runs with a library: prescore, calibrate, score, compete, rescore.

The best entries of the first look over a whole run give its curve of retention. They are then looked at again
near their apex, and the spread of their errors gives the run's tolerances of mass and mobility, with which all
entries are scored. At each apex a second look takes the mobility seen there, also one isotope up.

Many runs are searched by one job; a run is a column. Each phase is one plan; what passes between phases
is a table in the shared folder, or a curve of a few points.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions.chemistry import averagine, bare, carbons_sulphurs, ion_parts, isotope_envelope, shifted
from ionloom.functions.ranges import NEUTRON, Tolerance, Width, window_overlaps
from ionloom.operators import calibrate, extract, fdr, features, interval, traces
from ionloom.plans import rescoring
from ionloom.runtime import sized_join, stored

TOP_FRAGMENTS = 8
CALIBRANTS = 2000
# How calibrants are looked at again.
AGAIN_PPM, AGAIN_PERCENT, AGAIN_SECONDS = 50.0, 5.0, 5.0
#: Cycles that a query's time window must have.
LEAST_CYCLES = 3
# Fixed value: how far from the mobility seen at the apex the second look goes.
SECOND_PERCENT = 3.0
SHAPE = ("im0", "im1", "mz_lo0", "mz_lo1", "mz_hi0", "mz_hi1")


@dataclass(frozen=True)
class Settings:
    tolerance: Tolerance = Tolerance()
    decoys: str = "if_missing"  # never, if_missing, force
    calibrants: int = CALIBRANTS
    bins: int = 60
    max_q: float = 0.5
    rounds: int = rescoring.ROUNDS
    has_mobility: bool = True  # False: mobility restricts nothing and gives no scores


def variants(library: DataFrame, decoys: str) -> DataFrame:
    """Adds variant: 0 the entry itself, 1 and 2 its mass-shifted decoys, made row by row and never stored.
    ``force`` drops decoys the library brings; ``if_missing`` makes decoys only for a library without."""
    if decoys == "force":
        library = library.filter("is_target")
    make = decoys == "force" or (decoys == "if_missing" and library.filter("not is_target").isEmpty())
    v = F.explode(F.array(*[F.lit(i) for i in ((0, 1, 2) if make else (0,))]))
    out = library.withColumn("variant", v)
    return out.withColumn("is_target", F.col("is_target") & (F.col("variant") == 0))


def query_table(library: DataFrame, n_runs: int, settings: Settings) -> DataFrame:
    """One row per run, entry and variant: query_id, ranges and the fragments kept (the eight highest)."""
    top = F.slice(F.sort_array(F.transform("fragments", lambda f, i: F.struct(f.intensity.alias("h"), (-i).alias("p"), f.alias("f"))), asc=False), 1, TOP_FRAGMENTS)
    q = variants(library, settings.decoys).filter(F.size("fragments") > 0).withColumn("fragments", F.transform(top, lambda s: s.f))
    q = q.withColumn("run_no", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_runs - 1).cast("long"))))
    q = q.withColumn("query_id", F.col("run_no") * (1 << 40) + F.col("library_id") * 4 + F.col("variant"))
    lo, hi = mobility_range(settings)
    sign = F.when(F.col("variant") == 1, 14.0).when(F.col("variant") == 2, -14.0).otherwise(0.0)
    return q.withColumn("mono", F.col("precursor_mz") + sign / F.col("charge")).withColumn("im_lo", lo).withColumn("im_hi", hi)


def ions_of(queries: DataFrame, windows: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, run_no, window_id, ion, level, expected, center, bounds): fragments in every window that
    isolates their precursor, and three isotopes of the precursor in the survey (window -1)."""
    w = settings.tolerance.quad
    hit, a, b = window_overlaps(F.col("q_lo"), F.col("q_hi"), F.col("im_lo"), F.col("im_hi"), {c: F.col(c) for c in SHAPE})
    tol = [c for c in ("ppm_lo", "ppm_hi") if c in queries.columns]
    keep = ["query_id", "run_no", "im_lo", "im_hi", "cycle_lo", "cycle_hi", *tol]
    # Precursors meet their windows before fragments are rows, in a join of ranges of m/z.
    pre = queries.select(*keep, "variant", (F.col("mono") - w.lo).alias("q_lo"), (F.col("mono") + 2 * NEUTRON / F.col("charge") + w.hi).alias("q_hi"), "fragments")
    shapes = windows.select(F.col("run_no"), "window_id", *SHAPE, F.least("mz_lo0", "mz_lo1").alias("w_lo"), F.greatest("mz_hi0", "mz_hi1").alias("w_hi"))
    met = interval.overlap_join(pre, shapes, ("q_lo", "q_hi"), ("w_lo", "w_hi"), ("run_no",)).withColumn("_a", a).withColumn("_b", b).filter(hit)
    f = met.withColumn("im_lo", F.greatest("im_lo", "_a")).withColumn("im_hi", F.least("im_hi", "_b")).select(*keep, "variant", "window_id", F.explode("fragments").alias("f"))
    f = f.select("*", ion_parts(F.col("f.label")).alias("p"))
    ms2 = f.select(*keep, "window_id", F.lit(2).alias("level"), (NEUTRON / F.coalesce("p.charge", F.lit(1))).alias("step"), F.col("f.label").alias("ion"), F.col("f.intensity").alias("expected"), shifted(F.col("f.mz"), F.col("p.ordinal"), F.coalesce("p.charge", F.lit(1)), F.col("variant")).alias("center"))
    # In steps, each a column of its own, so that no atom count is written out more than once.
    plain = queries.withColumn("_seq", bare(F.col("sequence")))
    c, s = carbons_sulphurs(F.col("_seq"))
    ac, as_ = averagine(F.col("mono") * F.col("charge"))
    atoms = plain.withColumn("_c", F.coalesce(c, ac)).withColumn("_s", F.coalesce(s, as_))
    ms1 = atoms.select(*keep, "mono", "charge", F.posexplode(isotope_envelope(F.col("_c"), F.col("_s"))).alias("k", "expected"))
    ms1 = ms1.withColumn("ion", F.concat(F.lit("p"), F.col("k").cast("string"))).withColumn("center", F.col("mono") + F.col("k") * NEUTRON / F.col("charge")).withColumn("window_id", F.lit(-1)).withColumn("level", F.lit(1)).withColumn("step", NEUTRON / F.col("charge"))
    cols = [*keep, "window_id", "ion", "level", "step", "expected", "center"]
    both = ms2.select(*[F.col(x).cast("int") if x == "window_id" else F.col(x) for x in cols]).unionByName(ms1.select(*cols))
    return around(both, settings)


def around(ions: DataFrame, settings: Settings) -> DataFrame:
    """Adds the bounds of m/z: of the run's own tolerance where the rows carry one."""
    c = F.col("center")
    lo, hi = (c * (1 - F.col("ppm_lo") / 1e6), c * (1 + F.col("ppm_hi") / 1e6)) if "ppm_lo" in ions.columns else settings.tolerance.ms.around(c)
    return ions.withColumn("mz_lo", lo.cast("float").cast("double")).withColumn("mz_hi", hi.cast("float").cast("double"))


def matched(ions: DataFrame, peaks: DataFrame) -> DataFrame:
    p = peaks.filter("intensity > 0").withColumn("mz", F.col("mz").cast("float").cast("double"))
    return interval.range_join(p, ions, "mz", "mz_lo", "mz_hi", ("run_no", "window_id"), residual=F.col("cycle").between(F.col("cycle_lo"), F.col("cycle_hi")) & F.coalesce("mobility", F.lit(0.0)).between(F.col("im_lo"), F.col("im_hi")), log=True)


def elution(queries: DataFrame, ions: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(traces, cells) of queries with any fragment signal."""
    cells = stored(matches.groupBy("query_id", "ion", "level", "cycle").agg(F.sum("intensity").alias("intensity")))
    expected = ions.filter("level = 2").select("query_id", "ion", "expected").distinct()
    live = cells.filter("level = 2").select("query_id").distinct()
    totals = expected.join(live, "query_id").groupBy("query_id").agg(F.sum("expected").alias("sum_exp"), F.sum(F.sqrt("expected")).alias("sum_sqrt_exp"))
    axis = queries.join(live, "query_id").select("query_id", F.explode(F.sequence(F.col("cycle_lo").cast("int"), F.col("cycle_hi").cast("int"))).alias("cycle"))
    t = traces.traces(traces.accumulators(cells.filter("level = 2"), expected), axis, totals)
    return stored(traces.apex_profile(t)), cells


def prescore(queries: DataFrame, windows: DataFrame, peaks: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, apex, apex_value) over the whole run."""
    ions = stored(ions_of(queries, windows, settings))
    t, _ = elution(queries, ions, matched(ions, peaks))
    return traces.pick(t, "apex_profile", "apex")


def calibrants(prescored: DataFrame, queries: DataFrame, cycles: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, run_no, rt_seconds, observed): the best targets of each run; scores that are no number don't count."""
    s = F.col("apex_value").cast("double")
    found = prescored.join(queries.filter("is_target").select("query_id", "run_no", "rt_seconds"), "query_id").filter((s > 0) & (s < float("inf")) & ~F.isnan(s))
    # Each task keeps only its best of a run.
    rank = F.row_number().over(Window.partitionBy("run_no").orderBy(F.desc("apex_value"), F.asc("query_id")))
    best = found.withColumn("_rn", rank).filter(F.col("_rn") <= settings.calibrants).drop("_rn")
    pts = sized_join(best.withColumnRenamed("apex", "cycle"), cycles.select("run_no", "cycle", "rt_ms"), ["run_no", "cycle"], "inner")
    return stored(pts.select("query_id", "run_no", "rt_seconds", (F.col("rt_ms") / 1000).alias("observed")))


def calibration(prescored: DataFrame, queries: DataFrame, cycles: DataFrame, settings: Settings) -> dict[int, calibrate.Calibration]:
    """The curve from library to run times of each run number, from that run's best candidates."""
    return curves(calibrants(prescored, queries, cycles, settings), cycles, settings)


def curves(best: DataFrame, cycles: DataFrame, settings: Settings) -> dict[int, calibrate.Calibration]:
    pts = best.select("run_no", F.col("rt_seconds").alias("library"), "observed", F.lit(1.0).alias("weight"))
    # Runs are few: their numbers are rows of cycles' runs.
    return {r[0]: calibrate.fit(pts.filter(F.col("run_no") == r[0]).drop("run_no"), settings.bins) for r in cycles.select("run_no").distinct().collect()}


def seen_again(best: DataFrame, queries: DataFrame, windows: DataFrame, peaks: DataFrame, cycles: DataFrame, by_run: dict[int, calibrate.Calibration], settings: Settings) -> DataFrame:
    """(run_no, is_target, mobility, obs_mobility, ms2_ppm) of the calibrants on their run's ridge, looked at again around
    the time they were seen at."""
    on = calibrate.apply_each(best, by_run, "run_no").filter(F.abs(F.col("observed") - F.col("rt_calibrated")) <= F.col("rt_tolerance_minutes") * 60)
    q = sized_join(queries.drop("cycle_lo", "cycle_hi"), on.select("query_id", "observed"), ["query_id"], "inner")
    q = to_cycles(q.withColumn("_lo", (F.col("observed") - AGAIN_SECONDS) * 1000).withColumn("_hi", (F.col("observed") + AGAIN_SECONDS) * 1000), cycles)
    wide = replace(settings, tolerance=replace(settings.tolerance, ms=Width("ppm", AGAIN_PPM, AGAIN_PPM), mobility=Width("percent", AGAIN_PERCENT, AGAIN_PERCENT)))
    lo, hi = mobility_range(wide)
    q = stored(q.withColumn("im_lo", lo).withColumn("im_hi", hi))
    m = matched(ions_of(q, windows, wide).filter("level = 2"), peaks)
    w = F.col("intensity")
    seen = m.groupBy("query_id").agg((F.sum(w * (F.col("mz") - F.col("center")) / F.col("center")) / F.sum(w) * 1e6).alias("ms2_ppm"), (F.sum(F.log1p(w) * F.col("mobility")) / F.sum(F.log1p(w))).alias("obs_mobility"))
    return q.select("query_id", "run_no", "is_target", "mobility").join(seen, "query_id")


def mobility_range(settings: Settings):
    return settings.tolerance.mobility.around(F.col("mobility")) if settings.has_mobility else (F.lit(float("-inf")), F.lit(float("inf")))


def with_tolerances(queries: DataFrame, by_run: dict[int, calibrate.Calibration], settings: Settings) -> DataFrame:
    """The run's own bounds of mobility, and its tolerance of mass as ppm_lo and ppm_hi."""
    rows = [(k, *map(float, c.mz_ppm), *map(float, c.mobility_pct)) for k, c in by_run.items()]
    t = queries.sparkSession.createDataFrame(rows, "run_no long, ppm_lo double, ppm_hi double, _p0 double, _p1 double")
    out = sized_join(queries, t, ["run_no"], "inner")
    if settings.has_mobility:
        out = out.withColumn("im_lo", F.col("mobility") * (1 - F.col("_p0") / 100)).withColumn("im_hi", F.col("mobility") * (1 + F.col("_p1") / 100))
    return out.drop("_p0", "_p1")


def score(queries: DataFrame, windows: DataFrame, peaks: DataFrame, settings: Settings, report: dict | None = None) -> DataFrame:
    """One row per query with signal: peak, features, main score, errors of mass and mobility at the apex."""
    ions = stored(ions_of(queries, windows, settings))
    m = stored(matched(ions, peaks).select("query_id", "ion", "level", "center", "mz", "mobility", "intensity", "cycle"))
    t, cells = elution(queries, ions, m)
    pk = stored(traces.peaks(t))
    base = traces.baseline(t, pk)
    dense_ions = ions.select("query_id", "ion", "level", "expected", "cycle_lo", "cycle_hi").distinct().join(pk.select("query_id"), "query_id")
    chrom = extract.chromatograms(dense_ions, cells).join(dense_ions.select("query_id", "ion", "level", "expected", "cycle_lo"), ["query_id", "ion", "cycle_lo"])
    per = chrom.groupBy("query_id", "cycle_lo").agg(F.array_sort(F.collect_list(F.struct("level", "ion", "chromatogram", "expected"))).alias("i"))
    prof = t.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("cycle", "cosine_profile", "scribe_profile"))).alias("p"))
    level = lambda n: F.filter("i", lambda x: x.level == n)
    rows = per.join(prof, "query_id").join(pk.select("query_id", "apex"), "query_id").select(
        "query_id", (F.col("apex") - F.col("cycle_lo")).alias("apex"), F.transform(level(2), lambda x: x.chromatogram).alias("fragments"), F.transform(level(2), lambda x: x.expected).alias("expected"),
        F.transform(level(1), lambda x: x.chromatogram).alias("precursors"), F.transform(level(1), lambda x: x.expected).alias("expected_precursors"), F.col("p.cosine_profile").alias("cosine_profile"), F.col("p.scribe_profile").alias("scribe_profile"),
    )
    second = stored(secondary(m, pk))
    out = pk.join(features.scores(rows), "query_id").join(base, "query_id").join(second, "query_id", "left").join(one_isotope_up(ions, pk, second, peaks, settings), "query_id", "left")
    out = stored(queries.drop("fragments").join(out, "query_id").withColumn("isotope_ratio", F.coalesce("isotope_intensity", F.lit(0.0)) / F.when(F.col("ms2_intensity") > 0, F.col("ms2_intensity"))))
    if report is not None:
        report["skipped"] = skipped(queries, ions, m, t, pk, out)
    return out


def skipped(queries: DataFrame, ions: DataFrame, matches: DataFrame, traces_: DataFrame, peaks_: DataFrame, scored: DataFrame) -> dict[str, int]:
    """Queries by the first gate of the scoring that they fail; each is counted once."""
    flag = lambda d, name: d.select("query_id").distinct().withColumn(name, F.lit(True))
    q = queries.select("query_id", (F.col("cycle_hi") - F.col("cycle_lo") + 1).alias("_cycles"))
    for d, name in ((ions.filter("level = 2"), "_win"), (matches, "_any"), (matches.filter("level = 2"), "_ms2"), (peaks_, "_peak"), (scored, "_done")):
        q = q.join(flag(d, name), "query_id", "left")
    bad = traces_.groupBy("query_id").agg(F.max((F.isnan("apex_profile") | (F.abs("apex_profile") == float("inf"))).cast("int")).alias("_bad"))
    q = q.join(bad, "query_id", "left")
    reason = extract.skip_reason(
        n_windows=F.when(F.col("_win"), 1).otherwise(0), n_peaks=F.when(F.col("_any"), 1).otherwise(0), apex_empty=F.col("_ms2").isNull(), too_short=F.col("_cycles") < LEAST_CYCLES,
        not_finite=F.col("_peak").isNull() & (F.col("_bad") == 1), not_finished=F.col("_peak").isNotNull() & F.col("_done").isNull(), broken=F.col("_peak").isNull() & F.col("_done").isNotNull(),
    )
    got = {r[0]: r[1] for r in q.groupBy(reason.alias("r")).count().collect() if r[0]}
    return {k: got.get(k, 0) for k in extract.SKIP_REASONS}


def one_isotope_up(ions: DataFrame, peaks_: DataFrame, second: DataFrame, run: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, isotope_intensity): the second look again with every fragment one isotope up."""
    at = peaks_.select("query_id", "apex", "apex_rise", "apex_fall").join(second.select("query_id", "obs_mobility"), "query_id")
    up = ions.filter("level = 2").drop("cycle_lo", "cycle_hi", "mz_lo", "mz_hi").join(at, "query_id").withColumn("center", F.col("center") + F.col("step"))
    up = up.withColumn("cycle_lo", F.col("apex") - F.col("apex_rise")).withColumn("cycle_hi", F.col("apex") + F.col("apex_fall"))
    if settings.has_mobility:
        up = up.withColumn("im_lo", F.greatest("im_lo", F.col("obs_mobility") * (1 - SECOND_PERCENT / 100))).withColumn("im_hi", F.least("im_hi", F.col("obs_mobility") * (1 + SECOND_PERCENT / 100)))
    return matched(around(up, settings), run).groupBy("query_id").agg(F.sum("intensity").alias("isotope_intensity"))




def secondary(matches: DataFrame, peaks_: DataFrame, pct: float = SECOND_PERCENT) -> DataFrame:
    """A second look at the apex: first the query's mobility there, then only peaks within ``pct`` of it.

    The second look reads the matches of the first, of which it is a part, instead of the run."""
    near = matches.join(peaks_.select("query_id", "apex", "apex_rise", "apex_fall"), "query_id").filter(F.col("cycle").between(F.col("apex") - F.col("apex_rise"), F.col("apex") + F.col("apex_fall")))
    w = F.col("intensity")
    mob = near.groupBy("query_id").agg((F.sum(F.log1p(w) * F.col("mobility")) / F.sum(F.log1p(w))).alias("obs_mobility"))
    kept = near.join(mob, "query_id").filter(F.abs(F.col("mobility") - F.col("obs_mobility")) <= F.col("obs_mobility") * pct / 100)
    err = (F.col("mz") - F.col("center")) / F.col("center") * 1e6
    mean = lambda level: (F.sum(F.when(F.col("level") == level, w * err)) / F.sum(F.when(F.col("level") == level, w)))
    return kept.groupBy("query_id").agg(F.first("obs_mobility").alias("obs_mobility"), mean(1).alias("ms1_ppm"), mean(2).alias("ms2_ppm"), F.count(F.when(F.col("level") == 2, 1)).alias("n_ms2_peaks"), F.sum(F.when(F.col("level") == 2, w)).alias("ms2_intensity"))


def tolerances(scored: DataFrame, settings: Settings) -> dict[int, tuple[tuple[float, float], tuple[float, float]]]:
    """(ppm, mobility percent) of each run number from the spread of its targets' errors, never below 1 ppm
    and half a percent; runs without errors have none."""
    ok = scored.filter("is_target and ms2_ppm is not null").select("run_no", "ms2_ppm", ((F.col("obs_mobility") - F.col("mobility")) / F.col("mobility") * 100).alias("pct"))
    out = []
    for c, sigmas, floor in (("ms2_ppm", 1.5, 1.0), ("pct", 3.0, 0.5)):
        s = calibrate.robust_stats(ok, ["run_no"], c)
        lo, hi = calibrate.mad_bounds(F.col("median"), F.col("mad"), sigmas, floor)
        out.append({r[0]: (r[1], r[2]) for r in s.select("run_no", lo, hi).collect()})
    return {k: (out[0].get(k, (10.0, 10.0)), out[1].get(k, (10.0, 10.0))) for k in out[0] | out[1]}


def with_windows(queries: DataFrame, cycles: DataFrame, by_run: dict[int, calibrate.Calibration] | None) -> DataFrame:
    """Adds cycle_lo and cycle_hi: the whole run, or the cycles around the time calibrated for that run."""
    ends = cycles.groupBy("run_no").agg(F.min("cycle").alias("_a"), F.max("cycle").alias("_b"), F.min("rt_ms").alias("_t0"), F.max("rt_ms").alias("_t1"))
    q = sized_join(queries, ends, ["run_no"], "inner")
    if by_run is None:
        return q.withColumn("cycle_lo", F.col("_a")).withColumn("cycle_hi", F.col("_b")).drop("_a", "_b", "_t0", "_t1")
    q = calibrate.apply_each(q, by_run, "run_no")
    lo, hi = (F.col("rt_calibrated") - F.col("rt_tolerance_minutes") * 60) * 1000, (F.col("rt_calibrated") + F.col("rt_tolerance_minutes") * 60) * 1000
    return to_cycles(q.withColumn("_lo", lo).withColumn("_hi", hi).filter("_hi >= _t0 and _lo <= _t1").drop("_a", "_b", "_t0", "_t1"), cycles)


def to_cycles(q: DataFrame, cycles: DataFrame) -> DataFrame:
    """Adds cycle_lo and cycle_hi for the times _lo and _hi (milliseconds), which go."""
    # On the run's own time axis, which may be uneven; of cycles at one time all count.
    axis = cycles.select("run_no", F.col("rt_ms").cast("double").alias("_p"), "cycle").groupBy("run_no", "_p").agg(F.min("cycle").alias("cycle_lo"), F.max("cycle").alias("cycle_hi"))
    for x, name in (("_lo", "cycle_lo"), ("_hi", "cycle_hi")):
        q = interval.nearest(q, axis, x, "_p", ("run_no",))
        q = sized_join(q, axis.select("run_no", "_p", F.col(name).cast("int").alias(name)), ["run_no", "_p"], "inner").drop("_p")
    return q.drop("_lo", "_hi")


ML_FEATURES = [
    "base_score", *features.WEIGHTS, "main_score", "apex_value", "delta_next", "delta_second_next", "apex_rise", "apex_fall", "lambda", "lazy_z", "lazy_ratio", "ms1_ppm_abs", "ms2_ppm_abs", "n_ms2_peaks", "isotope_ratio",
    "mobility_pct_abs", "rt_error_abs", "precursor_mz_bin", "charge", "main_over_delta_next", "main_times_delta_next", "split_x_coverage", "delta_group", "delta_group_ratio",
]
MOBILITY_FEATURES = ["obs_mobility", "mobility_pct_abs"]


def search(library: DataFrame, peaks: DataFrame, cycles: DataFrame, windows: DataFrame, settings: Settings = Settings(), report: dict | None = None) -> tuple[DataFrame, calibrate.Calibration | dict[str, calibrate.Calibration]]:
    """(results with q-values, calibration: of several runs one by run_id). Peaks, cycles and windows carry run_id;
    runs get numbers. ``report`` is filled with the queries skipped, by reason, and the targets at 1, 5 and 10 percent."""
    from ionloom.operators.sequence import numbered

    runs = stored(numbered(cycles.select("run_id").distinct().withColumn("one", F.lit(1)), ["one"], ["run_id"], "run_no").drop("one"))
    tag = lambda d: sized_join(d, runs, ["run_id"], "inner")
    peaks, cycles, windows = tag(peaks), stored(tag(cycles)), stored(tag(windows))
    n_runs = runs.count()
    queries = stored(sized_join(query_table(library, n_runs, settings), runs, ["run_no"], "inner"))
    wide = with_windows(queries, cycles, None)
    pre = stored(prescore(wide, windows, peaks, settings))
    best = calibrants(pre, wide, cycles, settings)
    by_run = curves(best, cycles, settings)
    again = stored(seen_again(best, wide, windows, peaks, cycles, by_run, settings))
    for k, t in tolerances(again, settings).items():
        by_run[k].mz_ppm, by_run[k].mobility_pct = t
    narrow = stored(with_tolerances(with_windows(queries, cycles, by_run), by_run, settings))
    scored = score(narrow, windows, peaks, settings, report)
    once = fdr.consecutive_dedup(scored.withColumn("_s", F.concat_ws(":", "run_no", "sequence")), "_s", "charge", "mono", "main_score").drop("_s")
    won = fdr.competition(once.withColumn("_g", F.struct("run_no", "decoy_group")), "_g", "charge", "main_score", "query_id").drop("_g")
    obs = sized_join(won.withColumnRenamed("apex", "cycle"), cycles.select("run_no", "cycle", "rt_ms"), ["run_no", "cycle"], "left").withColumnRenamed("cycle", "apex")
    table = features.derived(obs.withColumn("obs_rt_seconds", F.col("rt_ms") / 1000)).withColumn("rt_error_abs", F.abs("rt_error")).withColumn("ms1_ppm_abs", F.abs("ms1_ppm")).withColumn("ms2_ppm_abs", F.abs("ms2_ppm"))
    table = table.withColumn("mobility_pct_abs", F.abs(F.col("obs_mobility") - F.col("mobility")) / F.col("mobility") * 100).withColumn("precursor_mz_bin", features.mz_bin(F.col("precursor_mz")))
    table = stored(table if settings.has_mobility else features.neutralised(table, MOBILITY_FEATURES))
    ranked = rescoring.rescore(table, ML_FEATURES, "is_target", "query_id", rounds=settings.rounds)
    out = fdr.q_values(ranked, "discriminant_score", "is_target", "query_id")
    if report is not None:
        v = pre.select(F.sum(F.isnan(F.col("apex_value").cast("double")).cast("long"))).first()[0] or 0
        empty = library.filter("fragments is null or size(fragments) = 0").count() * n_runs
        ends = windows.groupBy("run_no").agg(F.min(F.least("mz_lo0", "mz_lo1")).alias("_w0"), F.max(F.greatest("mz_hi0", "mz_hi1")).alias("_w1"))
        outside = sized_join(queries.select("query_id", "run_no", "mono"), ends, ["run_no"], "inner").filter("mono < _w0 or mono > _w1").select("query_id")
        late = queries.join(narrow.select("query_id"), "query_id", "left_anti").join(outside, "query_id", "left_anti").count()
        gone = outside.join(narrow.select("query_id"), "query_id", "left_semi").count()
        report["skipped"] |= {"no_expected_fragments": empty, "fragmented_range": outside.count(), "rt_out_of_bounds": late, "calibrant_nan_score": v}
        # What lies outside all windows also has no ions; it counts where it fails first.
        report["skipped"]["fragments_outside_scan_range"] -= gone
        report["scored"] = scored.count()
        report["targets"] = {str(r.threshold): r.n_targets for r in fdr.threshold_report(out, (0.01, 0.05, 0.1)).collect()}
    return out, next(iter(by_run.values())) if n_runs == 1 else {r.run_id: by_run[r.run_no] for r in runs.collect()}


__all__ = ["Settings", "Width", "search"]
