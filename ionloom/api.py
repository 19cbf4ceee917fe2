"""A run as an object: spectra, chromatograms and statistics of elution groups, and its time axis."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions.ranges import NEUTRON, Tolerance, Width, around_by, isotope_mz, window_overlaps
from ionloom.operators import extract, interval
from ionloom.runtime import sized_join
from ionloom.sources import peaks as peak_source

DIMENSIONS = ("ms", "rt", "mobility", "quad")
GROUP = "id long, precursor_mz double, charge int, mobility double, rt_seconds double, isotopes array<int>, fragments array<struct<label:string,mz:double>>"


class Run:
    """Peaks (ms_level, window_id, mz, intensity, mobility, cycle), a time axis (cycle, rt_ms) and isolation
    windows (window_id, im0, im1, mz_lo0, mz_lo1, mz_hi0, mz_hi1); without windows every one is searched."""

    def __init__(self, peaks: DataFrame, cycles: DataFrame, windows: DataFrame | None = None, has_mobility: bool = True, cached: bool = False):
        self.peaks = peaks.cache() if cached else peaks
        self.cycles, self.windows, self.has_mobility, self.cached = cycles, windows, has_mobility, cached
        self._axis: list[int] | None = None

    @staticmethod
    def open(spark: SparkSession, path: str, cached: bool = False) -> Run:
        peaks, cycles, windows, meta = peak_source.read_index(spark, path)
        return Run(peaks.withColumnsRenamed({"mobility_ook0": "mobility", "cycle_index": "cycle"}), cycles, windows, meta.get("mobility_kind", "Ook0") == "Ook0", cached)

    @property
    def is_lazy(self) -> bool:
        return not self.cached

    # The axis of one run is its number of cycles: thousands.
    def rt_values_ms(self) -> list[int]:
        if self._axis is None:
            self._axis = [r[0] for r in self.cycles.orderBy("cycle").select("rt_ms").collect()]
        return self._axis

    def num_cycles(self) -> int:
        return len(self.rt_values_ms())

    def rt_range_ms(self) -> tuple[int, int]:
        return self.rt_values_ms()[0], self.rt_values_ms()[-1]

    def cycle_index_to_rt_ms(self, cycle: int) -> int:
        if not 0 <= cycle < self.num_cycles():
            raise IndexError(cycle)
        return self.rt_values_ms()[cycle]

    def rt_seconds_to_cycle_index(self, rt_seconds: float) -> int:
        """The nearest cycle; a tie takes the earlier, beyond the ends the end."""
        ms = rt_seconds * 1000
        return min(range(self.num_cycles()), key=lambda i: (abs(self.rt_values_ms()[i] - ms), i))

    def _around(self, groups: DataFrame, x: Column, dim: str, t: Tolerance) -> tuple[Column, Column]:
        """Bounds by the group's own width where it has one, else by ``t``."""
        own = F.col(f"tol_{dim}")
        return around_by(x, own.kind, own.lo, own.hi) if f"tol_{dim}" in groups.columns else getattr(t, dim).around(x)

    def ions(self, groups: DataFrame, t: Tolerance) -> DataFrame:
        """Every precursor isotope and fragment of the groups with its bounds. Groups may carry their own widths in
        columns tol_ms, tol_rt, tol_mobility and tol_quad, each struct<kind, lo, hi>."""
        own = [f"tol_{d}" for d in DIMENSIONS if f"tol_{d}" in groups.columns]
        g = groups.select(F.col("id").alias("query_id"), "precursor_mz", "charge", "mobility", "rt_seconds", F.coalesce("isotopes", F.array(F.lit(0))).alias("isotopes"), "fragments", *own)
        im = self._around(g, F.col("mobility"), "mobility", t) if self.has_mobility else (F.lit(float("-inf")), F.lit(float("inf")))
        first, last = self.rt_range_ms()
        minutes = self._around(g, F.col("rt_seconds") / 60.0, "rt", t)
        # Whole milliseconds, cut off; open bounds are the run's ends.
        ms = lambda c, end: F.when(c.isNull() | (F.abs(c) == float("inf")), F.lit(end)).otherwise(F.greatest(F.lit(0), F.floor(c * 60_000.0).cast("long")))
        g = g.withColumn("im_lo", F.coalesce(im[0], F.lit(float("-inf")))).withColumn("im_hi", F.coalesce(im[1], F.lit(float("inf"))))
        g = g.withColumn("_lo", ms(minutes[0], first)).withColumn("_hi", ms(minutes[1], last)).filter(f"_hi >= {first} and _lo <= {last}")
        q_lo, q_hi = self._around(g, F.col("precursor_mz"), "quad", t)
        g = g.withColumn("q_lo", q_lo).withColumn("q_hi", q_hi + 2 * NEUTRON / F.col("charge"))
        for side, name in (("_lo", "cycle_lo"), ("_hi", "cycle_hi")):
            at = g.select("query_id", F.col(side).cast("double").alias("_x"))
            near = interval.nearest(at, self.cycles.select("cycle", F.col("rt_ms").cast("double").alias("rt_ms")), "_x", "rt_ms").select("query_id", "rt_ms")
            g = g.join(sized_join(near, self.cycles.select(F.col("rt_ms").cast("double").alias("rt_ms"), F.col("cycle").alias(name)), ["rt_ms"], "inner").select("query_id", name), "query_id")
        keep = ["q_lo", "q_hi", "im_lo", "im_hi", "cycle_lo", "cycle_hi", *[c for c in own if c == "tol_ms"]]
        ms1 = g.select("*", F.explode("isotopes").alias("_i")).select("query_id", F.concat(F.lit("p"), F.col("_i").cast("string")).alias("ion"), F.lit(1).alias("ms_level"), isotope_mz(F.col("precursor_mz"), F.col("_i"), F.col("charge")).alias("center"), *keep)
        ms2 = g.select("*", F.explode("fragments").alias("_f")).select("query_id", F.col("_f.label").alias("ion"), F.lit(2).alias("ms_level"), F.col("_f.mz").alias("center"), *keep)
        both = ms1.unionByName(ms2)
        lo, hi = self._around(both, F.col("center"), "ms", t)
        return both.withColumn("mz_lo", lo.cast("float").cast("double")).withColumn("mz_hi", hi.cast("float").cast("double")).drop("tol_ms")

    def matches(self, ions: DataFrame) -> DataFrame:
        p = self.peaks.filter("intensity > 0").withColumn("mz", F.col("mz").cast("double")).withColumn("ms_level", F.col("ms_level").cast("int"))
        residual = F.col("cycle").between(F.col("cycle_lo"), F.col("cycle_hi")) & F.col("mobility").between(F.col("im_lo"), F.col("im_hi")) if self.has_mobility else F.col("cycle").between(F.col("cycle_lo"), F.col("cycle_hi"))
        if self.windows is None:
            return interval.range_join(p, ions, "mz", "mz_lo", "mz_hi", ("ms_level",), residual=residual, log=True)
        shape = ("im0", "im1", "mz_lo0", "mz_lo1", "mz_hi0", "mz_hi1")
        hit, a, b = window_overlaps(F.col("q_lo"), F.col("q_hi"), F.col("im_lo"), F.col("im_hi"), {c: F.col(c) for c in shape})
        # Groups meet windows by m/z first, then by shape.
        w = self.windows.select("window_id", *shape, F.least("mz_lo0", "mz_lo1").alias("w_lo"), F.greatest("mz_hi0", "mz_hi1").alias("w_hi"))
        ms2 = interval.overlap_join(ions.filter("ms_level = 2"), w, ("q_lo", "q_hi"), ("w_lo", "w_hi")).withColumn("_a", a).withColumn("_b", b).filter(hit)
        ms2 = ms2.withColumn("im_lo", F.greatest("im_lo", "_a")).withColumn("im_hi", F.least("im_hi", "_b")).drop("_a", "_b", "w_lo", "w_hi", *shape)
        both = ms2.unionByName(ions.filter("ms_level = 1").withColumn("window_id", F.lit(-1)))
        p = p.withColumn("window_id", F.when(F.col("ms_level") == 1, -1).otherwise(F.col("window_id")))
        return interval.range_join(p, both, "mz", "mz_lo", "mz_hi", ("ms_level", "window_id"), residual=residual, log=True)

    def query_point(self, groups: DataFrame, t: Tolerance = Tolerance()) -> DataFrame:
        return extract.point_intensity(self.matches(self.ions(groups, t)))

    def query_spectrum(self, groups: DataFrame, t: Tolerance = Tolerance()) -> DataFrame:
        ions = self.ions(groups, t)
        return extract.spectrum(ions, self.matches(ions))

    def query_mz_mobility(self, groups: DataFrame, t: Tolerance = Tolerance()) -> DataFrame:
        ions = self.ions(groups, t)
        return extract.spectrum_stats(ions, self.matches(ions))

    def query_chromatogram(self, groups: DataFrame, t: Tolerance = Tolerance()) -> DataFrame:
        ions = self.ions(groups, t)
        return extract.chromatograms(ions, self.matches(ions))

    def query_chromatogram_into(self, groups: DataFrame, cycle_lo: int, cycle_hi: int, t: Tolerance = Tolerance()) -> DataFrame:
        """Chromatograms on a given window of cycles: the tolerance's window is cut to it, and groups whose
        windows don't meet give nothing."""
        ions = self.ions(groups, t)
        cut = ions.withColumn("cycle_lo", F.greatest("cycle_lo", F.lit(cycle_lo))).withColumn("cycle_hi", F.least("cycle_hi", F.lit(cycle_hi))).filter("cycle_lo <= cycle_hi")
        whole = cut.withColumns({"cycle_lo": F.lit(cycle_lo), "cycle_hi": F.lit(cycle_hi)})
        return extract.chromatograms(whole, self.matches(cut))

    def mobility_view(self, groups: DataFrame, t: Tolerance = Tolerance()) -> DataFrame:
        """Mass and mobility of each ion around the groups' time: 5 seconds to either side, twice the mobility."""
        return self.query_mz_mobility(groups, t.widened_mobility(2).with_rt(Width("minutes", 5 / 60, 5 / 60)))

    def query_chromatograms_batch(self, groups: DataFrame, tolerances: list[tuple[int, Tolerance]]) -> DataFrame:
        """Chromatograms of groups with a tolerance each: (id, tolerance) pairs, joined to the groups as columns."""
        width = "struct<kind:string,lo:double,hi:double>"
        rows = [(i, *[(w.kind, float(w.lo), float(w.hi)) for w in (getattr(t, d) for d in DIMENSIONS)]) for i, t in tolerances]
        own = groups.sparkSession.createDataFrame(rows, "id long, " + ", ".join(f"tol_{d} {width}" for d in DIMENSIONS))
        return self.query_chromatogram(sized_join(groups, own, ["id"], "inner"))

    def query_chromatograms_iter(self, groups: Iterable[dict], t: Tolerance = Tolerance(), chunk: int = 256) -> Iterator[list]:
        """Answers to an iterable of groups, a chunk at a time."""
        spark, block = self.peaks.sparkSession, []
        for g in groups:
            block.append(g)
            if len(block) == chunk:
                yield self.query_chromatogram(spark.createDataFrame(block, GROUP), t).collect()
                block = []
        if block:
            yield self.query_chromatogram(spark.createDataFrame(block, GROUP), t).collect()
