"""Interval queries and their aggregations, over peaks and ions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.functions import arrays, ranges
from ionloom.functions.ranges import Tolerance, Width
from ionloom.operators import extract, interval
from ionloom.queries import standins as S
from ionloom.queries.standins import BASE, IONS, PEAKS
from ionloom.runtime import stored, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"{BASE} SELECT query_id, ion, peak_id FROM matches")
def j01_range_join(spark: SparkSession, sf: str) -> DataFrame:
    """Ion and peak pairs by m/z, cycle and mobility at once."""
    return S.matches(spark, sf).select("query_id", "ion", "peak_id")


@query(f"{BASE} SELECT query_id, CAST(sum(intensity) AS BIGINT) AS intensity FROM matches GROUP BY 1")
def a01_point_intensity(spark: SparkSession, sf: str) -> DataFrame:
    return extract.point_intensity(S.matches(spark, sf))


CHROM = f"""{BASE}, cell AS (SELECT query_id, ion, cycle // 30 AS cycle, CAST(sum(intensity) AS DOUBLE) AS intensity FROM matches GROUP BY 1, 2, 3),
dense AS (SELECT i.query_id, i.ion, CAST(k AS INTEGER) AS cycle FROM ions i, range(100) AS r(k) WHERE k BETWEEN i.cycle_lo // 30 AND i.cycle_hi // 30),
chrom AS (SELECT d.query_id, d.ion, d.cycle, coalesce(c.intensity, 0) AS intensity FROM dense d LEFT JOIN cell c ON d.query_id = c.query_id AND d.ion = c.ion AND d.cycle = c.cycle)"""


def _chroms(spark: SparkSession, sf: str) -> DataFrame:
    coarse = lambda df, *cols: df.select("*").withColumns({c: F.floor(F.col(c) / 30).cast("int") for c in cols})
    return extract.chromatograms(coarse(S.ions(spark, sf), "cycle_lo", "cycle_hi"), coarse(S.matches(spark, sf), "cycle"))


@query(f"{CHROM} SELECT query_id, ion, cycle, intensity FROM chrom")
def a02_chromatogram(spark: SparkSession, sf: str) -> DataFrame:
    """Dense chromatograms, one row per cell."""
    rows = _chroms(spark, sf).select("query_id", "ion", "cycle_lo", F.posexplode("chromatogram").alias("k", "intensity"))
    return rows.select("query_id", "ion", (F.col("cycle_lo") + F.col("k")).alias("cycle"), "intensity")


@query(f"{BASE}, s AS (SELECT query_id, ion, sum(intensity) AS i FROM matches GROUP BY 1, 2) SELECT ions.query_id, ions.ion, CAST(coalesce(i, 0) AS BIGINT) AS intensity FROM ions LEFT JOIN s ON ions.query_id = s.query_id AND ions.ion = s.ion")
def a03_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return extract.spectrum(S.ions(spark, sf), S.matches(spark, sf))


@query(f"""{BASE}, s AS (SELECT query_id, ion, sum(intensity) AS w, sum(intensity * mz) AS m, sum(intensity * mobility) AS o, count(*) AS n FROM matches WHERE intensity > 0 GROUP BY 1, 2)
SELECT ions.query_id, ions.ion, CAST(coalesce(w, 0) AS BIGINT) AS weight, round(m / w, 7) AS mz, round(o / w, 6) AS mobility, coalesce(n, 0) AS n_peaks FROM ions LEFT JOIN s ON ions.query_id = s.query_id AND ions.ion = s.ion""")
def a04_spectrum_stats(spark: SparkSession, sf: str) -> DataFrame:
    got = extract.spectrum_stats(S.ions(spark, sf), S.matches(spark, sf))
    return got.withColumn("mz", F.round("mz", 7)).withColumn("mobility", F.round("mobility", 6))


@query(f"""WITH {PEAKS} SELECT window_id, count(*) AS n, round(sum(intensity * mz) / sum(intensity), 4) AS mean, min(mz) AS lo, max(mz) AS hi FROM peaks WHERE intensity > 0 GROUP BY 1""")
def a05_weighted_mean(spark: SparkSession, sf: str) -> DataFrame:
    p = S.peaks(spark, sf).filter("intensity > 0")
    return p.groupBy("window_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("intensity") * F.col("mz")) / F.sum("intensity"), 4).alias("mean"), F.min("mz").alias("lo"), F.max("mz").alias("hi"))


@query(f"""WITH {PEAKS}, part_stats AS (SELECT window_id, cycle, sum(intensity) AS w, sum(intensity * mobility) AS x FROM peaks GROUP BY 1, 2)
SELECT window_id, CAST(sum(w) AS BIGINT) AS weight, round(sum(x) / sum(w), 8) AS mobility FROM part_stats GROUP BY 1""")
def a06_merged_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Weights add and means combine: partial statistics per cycle merged per window."""
    part = S.peaks(spark, sf).groupBy("window_id", "cycle").agg(F.sum("intensity").alias("w"), F.sum(F.col("intensity") * F.col("mobility")).alias("x"))
    return part.groupBy("window_id").agg(F.sum("w").alias("weight"), F.round(F.sum("x") / F.sum("w"), 8).alias("mobility"))


@query(f"{BASE} SELECT query_id, count(*) AS n, CAST(sum(peak_id) AS BIGINT) AS id_sum FROM matches GROUP BY 1")
def a07_raw_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """The peaks of each query as an array, told by size and sum of ids."""
    g = S.matches(spark, sf).groupBy("query_id").agg(F.collect_list("peak_id").alias("ids"))
    return g.select("query_id", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@query(f"""{BASE}, g AS (SELECT query_id, count(*) AS n, count(DISTINCT window_id) AS w FROM matches GROUP BY 1), q AS (SELECT DISTINCT query_id FROM ions)
SELECT q.query_id, coalesce(n, 0) AS n_peaks, coalesce(w, 0) AS n_windows FROM q LEFT JOIN g ON q.query_id = g.query_id""")
def a08_match_counters(spark: SparkSession, sf: str) -> DataFrame:
    return extract.match_counters(S.ions(spark, sf), S.matches(spark, sf))


@query(f"WITH {PEAKS} SELECT peak_id FROM peaks WHERE mz BETWEEN 20000 AND 20500 AND mobility BETWEEN 0.02 AND 0.05 AND cycle BETWEEN 300 AND 1500")
def f04_combined_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Closed ranges of m/z, mobility and cycle, all reaching the scan."""
    li = table(spark, sf, "lineitem")
    day = F.col("l_shipdate").cast("date")
    start = F.lit("1995-01-02").cast("date")
    kept = li.filter(F.col("l_extendedprice").between(20000, 20500) & F.col("l_discount").between(0.02, 0.05) & (F.datediff(day, start).between(300, 1500)))
    return kept.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("peak_id"))


WINDOWS = """win AS (
  SELECT l_returnflag || l_linestatus AS window_id, CAST(0.0 AS DOUBLE) AS im0, CAST(0.1 AS DOUBLE) AS im1, CAST(min(l_extendedprice) AS DOUBLE) AS mz_lo0, CAST(quantile_disc(l_extendedprice, 0.25) AS DOUBLE) AS mz_lo1,
         CAST(quantile_disc(l_extendedprice, 0.5) AS DOUBLE) AS mz_hi0, CAST(max(l_extendedprice) AS DOUBLE) AS mz_hi1 FROM lineitem GROUP BY 1)"""


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    """A slanted isolation band per window, from the data's own spread."""
    p = S.peaks(spark, sf)
    return p.groupBy("window_id").agg(F.lit(0.0).alias("im0"), F.lit(0.1).alias("im1"), F.min("mz").alias("mz_lo0"), F.expr("percentile_disc(0.25) within group (order by mz)").alias("mz_lo1"), F.expr("percentile_disc(0.5) within group (order by mz)").alias("mz_hi0"), F.max("mz").alias("mz_hi1"))


SHAPE = ("im0", "im1", "mz_lo0", "mz_lo1", "mz_hi0", "mz_hi1")


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), (F.col("p_retailprice") * F.col("p_size")).alias("mono"), (1 + F.col("p_size") % 3).alias("charge"))
    lo, hi = ranges.quad_range(F.col("mono"), F.col("charge"), F.array(F.lit(-1), F.lit(0), F.lit(1), F.lit(2)), Width("absolute", 5, 5))
    q = q.select("query_id", lo.alias("q_lo"), hi.alias("q_hi"))
    # Worked out once; the join looks at both sides several times.
    w = stored(_windows(spark, sf).withColumn("w_lo", F.least("mz_lo0", "mz_lo1")).withColumn("w_hi", F.greatest("mz_hi0", "mz_hi1")))
    j = interval.overlap_join(q, w, ("q_lo", "q_hi"), ("w_lo", "w_hi")).drop("w_lo", "w_hi")
    hit, a, b = ranges.window_overlaps(F.col("q_lo"), F.col("q_hi"), F.lit(0.02), F.lit(0.08), {c: F.col(c) for c in SHAPE})
    return j.withColumn("im_from", a).withColumn("im_to", b).filter(hit)


HITS = f"""{WINDOWS}, q AS (SELECT p_partkey AS query_id, p_retailprice * p_size AS mono, 1 + p_size % 3 AS charge FROM part),
qr AS (SELECT query_id, mono - 5 AS q_lo, mono + 2 * CAST(1.0033548378 AS DOUBLE) / charge + 5 AS q_hi FROM q),
e AS (SELECT *, CAST(0.02 AS DOUBLE) AS a, CAST(0.08 AS DOUBLE) AS b, mz_lo0 + (mz_lo1 - mz_lo0) * (CAST(0.02 AS DOUBLE) - im0) / (im1 - im0) AS la, mz_lo0 + (mz_lo1 - mz_lo0) * (CAST(0.08 AS DOUBLE) - im0) / (im1 - im0) AS lb,
  mz_hi0 + (mz_hi1 - mz_hi0) * (CAST(0.02 AS DOUBLE) - im0) / (im1 - im0) AS ha, mz_hi0 + (mz_hi1 - mz_hi0) * (CAST(0.08 AS DOUBLE) - im0) / (im1 - im0) AS hb FROM qr, win),
c AS (SELECT query_id, window_id,
  greatest(CASE WHEN la <= q_hi THEN a WHEN lb <= q_hi THEN a + (b - a) * (q_hi - la) / (lb - la) ELSE 'inf'::DOUBLE END, CASE WHEN ha >= q_lo THEN a WHEN hb >= q_lo THEN a + (b - a) * (q_lo - ha) / (hb - ha) ELSE 'inf'::DOUBLE END) AS im_from,
  least(CASE WHEN lb <= q_hi THEN b WHEN la <= q_hi THEN a + (b - a) * (q_hi - la) / (lb - la) ELSE '-inf'::DOUBLE END, CASE WHEN hb >= q_lo THEN b WHEN ha >= q_lo THEN a + (b - a) * (q_lo - ha) / (hb - ha) ELSE '-inf'::DOUBLE END) AS im_to FROM e)"""


@query(f"WITH {HITS} SELECT query_id, window_id, round(im_from, 6) AS im_from, round(im_to, 6) AS im_to FROM c WHERE im_from <= im_to")
def f08_window_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Isolation windows a query meets, and the mobilities in which it does."""
    return _hits(spark, sf).select("query_id", "window_id", F.round("im_from", 6).alias("im_from"), F.round("im_to", 6).alias("im_to"))


@query(f"WITH {HITS} SELECT query_id, round(min(im_from), 6) AS im_from, round(max(im_to), 6) AS im_to, count(*) AS n_windows FROM c WHERE im_from <= im_to GROUP BY 1")
def f09_mobility_subrange(spark: SparkSession, sf: str) -> DataFrame:
    """Mobility range of a query over all windows it meets."""
    return _hits(spark, sf).groupBy("query_id").agg(F.round(F.min("im_from"), 6).alias("im_from"), F.round(F.max("im_to"), 6).alias("im_to"), F.count(F.lit(1)).alias("n_windows"))


@query(f"""WITH {PEAKS}, {IONS}, {HITS}, hit AS (SELECT * FROM c WHERE im_from <= im_to)
SELECT i.query_id, i.ion, count(*) AS n_peaks, CAST(sum(p.intensity) AS BIGINT) AS intensity FROM ions i JOIN hit h ON i.query_id = h.query_id JOIN peaks p
ON p.window_id = h.window_id AND p.mz BETWEEN i.mz_lo AND i.mz_hi AND p.cycle BETWEEN i.cycle_lo AND i.cycle_hi AND p.mobility BETWEEN greatest(i.im_lo, h.im_from) AND least(i.im_hi, h.im_to) GROUP BY 1, 2""")
def j02_fragment_query(spark: SparkSession, sf: str) -> DataFrame:
    """Ions by window: the mobility range is cut to what the window isolates."""
    h = stored(_hits(spark, sf).select("query_id", "window_id", "im_from", "im_to"))
    i = S.ions(spark, sf).join(h, "query_id").withColumn("im_lo", F.greatest("im_lo", "im_from")).withColumn("im_hi", F.least("im_hi", "im_to"))
    i = i.select("query_id", "ion", "window_id", "mz_lo", "mz_hi", "cycle_lo", "cycle_hi", "im_lo", "im_hi")
    m = interval.range_join(S.peaks(spark, sf).drop("peak_id"), i, "mz", "mz_lo", "mz_hi", ("window_id",), residual=S.residual(), log=True, width=4e-4)
    return m.groupBy("query_id", "ion").agg(F.count(F.lit(1)).alias("n_peaks"), F.sum("intensity").alias("intensity"))


@query(f"""WITH {PEAKS}, hull AS (SELECT min(mz) AS lo, max(mz) AS hi FROM peaks) SELECT p_partkey AS query_id FROM part, hull WHERE p_retailprice * p_size + 2 >= lo AND p_retailprice * p_size - 2 <= hi""")
def f10_fragmented_range(spark: SparkSession, sf: str) -> DataFrame:
    """Precursors within the run's m/z hull."""
    lo, hi = S.peaks(spark, sf).agg(F.min("mz"), F.max("mz")).first()
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), (F.col("p_retailprice") * F.col("p_size")).alias("m"))
    return q.filter(ranges.overlaps(F.col("m") - 2, F.col("m") + 2, F.lit(lo), F.lit(hi))).select("query_id")


SKIP = f"""{BASE}, g AS (SELECT query_id, count(*) AS n, count(DISTINCT window_id) AS w FROM matches GROUP BY 1), hull AS (SELECT min(mz) AS lo, max(mz) AS hi, max(cycle) AS last FROM peaks),
s AS (SELECT q.p_partkey AS query_id, CASE WHEN p_size % 17 = 0 THEN 'no_expected_fragments' WHEN NOT (p_retailprice * p_size <= hi AND p_retailprice * p_size >= lo) THEN 'fragmented_range'
  WHEN NOT ((p_partkey * 37) % 2000 <= last - 900) THEN 'rt_out_of_bounds' WHEN coalesce(w, 0) = 0 THEN 'fragments_outside_scan_range' WHEN coalesce(n, 0) = 0 THEN 'no_observed_signal' END AS reason
  FROM part q LEFT JOIN g ON q.p_partkey = g.query_id, hull)"""


@query(f"{SKIP} SELECT coalesce(reason, 'scored') AS reason, count(*) AS n FROM s GROUP BY 1")
def f19_skip_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Queries by the first gate they fail."""
    lo, hi, last = S.peaks(spark, sf).agg(F.min("mz"), F.max("mz"), F.max("cycle")).first()
    n = extract.match_counters(S.ions(spark, sf), S.matches(spark, sf))
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), (F.col("p_retailprice") * F.col("p_size")).alias("m"), "p_size", ((F.col("p_partkey") * 37) % 2000).alias("first"))
    q = q.join(n, "query_id", "left")
    reason = extract.skip_reason(F.when(F.col("p_size") % 17 == 0, 0).otherwise(1), F.col("m").between(lo, hi), F.col("first") <= F.lit(last) - 900, F.coalesce("n_windows", F.lit(0)), F.coalesce("n_peaks", F.lit(0)))
    return q.groupBy(F.coalesce(reason, F.lit("scored")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE}, s AS (SELECT query_id, ion, sum(intensity) AS i FROM matches GROUP BY 1, 2) SELECT query_id, ion, CAST(i AS BIGINT) AS intensity FROM s WHERE i > 60")
def f14_drop_weak_ions(spark: SparkSession, sf: str) -> DataFrame:
    """Ions whose signal is above a floor; those without any never come out."""
    return S.matches(spark, sf).groupBy("query_id", "ion").agg(F.sum("intensity").alias("intensity")).filter("intensity > 60")


TOPF = "SELECT l_orderkey AS query_id, l_linenumber AS pos, CAST(l_quantity AS BIGINT) AS expected, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) - 1 AS rank FROM lineitem"


@query(f"SELECT query_id, pos, expected, CAST(rank AS INTEGER) AS rank FROM ({TOPF}) WHERE rank < 3")
def f15_top_fragments(spark: SparkSession, sf: str) -> DataFrame:
    """The three highest expected fragments per query, stable on ties."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber")
    r = table(spark, sf, "lineitem").withColumn("rank", F.row_number().over(w) - 1).filter("rank < 3")
    return r.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("pos"), F.col("l_quantity").cast("long").alias("expected"), "rank")


@query("SELECT o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_totalprice > 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 2000")
def t03_calibrants(spark: SparkSession, sf: str) -> DataFrame:
    """The 2,000 best positive scores of the run."""
    from ionloom.operators.fdr import top_scores

    return top_scores(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")))


@query("""WITH r AS (SELECT o_custkey AS query_id, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT query_id, round(max(CASE WHEN k = 1 THEN v END), 2) AS top_0, round(max(CASE WHEN k = 2 THEN v END), 2) AS top_1, round(max(CASE WHEN k = 3 THEN v END), 2) AS top_2 FROM r GROUP BY 1""")
def t04_padded_top(spark: SparkSession, sf: str) -> DataFrame:
    """The three largest values per group as columns, null where there are fewer."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    k = table(spark, sf, "orders").withColumn("k", F.row_number().over(w)).filter("k <= 3")
    return k.groupBy(F.col("o_custkey").alias("query_id")).agg(*[F.round(F.max(F.when(F.col("k") == i + 1, F.col("o_totalprice"))), 2).alias(f"top_{i}") for i in range(3)])


@query("""SELECT vec_id, CAST(s.place AS INTEGER) AS place, s.v AS value FROM (SELECT vec_id, unnest(list_sort(list_transform(embedding, lambda x, i: {'k': -x, 'place': i - 1, 'v': x}))[1:5]) AS s FROM embeddings)""")
def t05_top_of_array(spark: SparkSession, sf: str) -> DataFrame:
    """The five largest components of each vector with their places."""
    e = table(spark, sf, "embeddings").select("vec_id", F.explode(arrays.top_n(F.col("embedding"), 5)).alias("s"))
    return e.select("vec_id", "s.place", "s.value")


GRID = """pts AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem), num AS (SELECT CAST(date_diff('day', DATE '1995-01-02', d) AS INTEGER) AS point FROM pts)"""


@query(f"""WITH {GRID}, v AS (SELECT o_orderkey, CAST(date_diff('day', DATE '1995-01-02', CAST(o_orderdate AS DATE)) AS INTEGER) AS x FROM orders),
c AS (SELECT o_orderkey, point, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(x - point), point) AS k FROM (
  SELECT * FROM v ASOF JOIN num ON v.x >= num.point UNION ALL SELECT * FROM v ASOF JOIN num ON v.x <= num.point)) SELECT o_orderkey, point FROM c WHERE k = 1""")
def j06_nearest_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest point of a time axis; ties take the earlier, values beyond the ends the end."""
    start = F.lit("1995-01-02").cast("date")
    pts = table(spark, sf, "lineitem").select(F.datediff(F.col("l_shipdate").cast("date"), start).alias("point"))
    v = table(spark, sf, "orders").select("o_orderkey", F.datediff(F.col("o_orderdate").cast("date"), start).alias("x"))
    return interval.nearest(v, pts, "x", "point").select("o_orderkey", "point")


@query("""WITH g AS (SELECT CAST(k * 5000 AS DOUBLE) AS point FROM range(0, 22) AS r(k)), s AS (SELECT g.point, max(l_quantity) AS v FROM lineitem ASOF JOIN g ON l_extendedprice <= g.point GROUP BY 1)
SELECT g.point, coalesce(v, 0) AS value FROM g LEFT JOIN s ON g.point = s.point""")
def j12_snap(spark: SparkSession, sf: str) -> DataFrame:
    """Values moved forward onto a grid, the largest kept."""
    g = spark.range(22).select((F.col("id") * 5000).cast("double").alias("point"))
    v = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("at"), F.col("l_quantity").alias("value"))
    return interval.snap(v, g, "at", "value", "point")


CELLS_SQL = f"WITH {S.CELLS}"


@query(f"{CELLS_SQL} SELECT c.query_id, c.cycle, c.ion, c.intensity, coalesce(e.expected, 0) AS expected FROM cells c LEFT JOIN (SELECT * FROM expected WHERE ion <> 'error') e ON c.ion = e.ion")
def j07_expected_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Expected heights by label, 0 where there are none."""
    e = S.expected(spark).filter("ion <> 'error'")
    return S.cells(spark, sf).join(F.broadcast(e), "ion", "left").select("query_id", "cycle", "ion", "intensity", F.coalesce("expected", F.lit(0.0)).alias("expected"))


@query(f"{CELLS_SQL}, m AS (SELECT DISTINCT ion FROM cells) SELECT m.ion FROM m ANTI JOIN (SELECT * FROM expected WHERE ion <> 'error') e ON m.ion = e.ion")
def j08_missing_intensities(spark: SparkSession, sf: str) -> DataFrame:
    """Labels without an expected height: a strict load fails if there is any."""
    return S.cells(spark, sf).select("ion").distinct().join(F.broadcast(S.expected(spark).filter("ion <> 'error'")), "ion", "left_anti")


@query(f"""WITH {PEAKS}, {IONS}, shifted AS (SELECT query_id, ion + 1 AS ion, (center + CAST(1.0033548378 AS DOUBLE) / charge) AS c, cycle_lo, cycle_hi, im_lo, im_hi FROM ions)
SELECT s.query_id, s.ion, count(*) AS n_peaks FROM shifted s JOIN peaks p ON p.mz BETWEEN s.c * (1 - CAST(200 AS DOUBLE) / 1e6) AND s.c * (1 + CAST(200 AS DOUBLE) / 1e6) AND p.cycle BETWEEN s.cycle_lo AND s.cycle_hi AND p.mobility BETWEEN s.im_lo AND s.im_hi GROUP BY 1, 2""")
def j14_isotope_shift(spark: SparkSession, sf: str) -> DataFrame:
    """The same query one isotope up."""
    i = S.ions(spark, sf).withColumn("center", ranges.isotope_mz(F.col("center"), F.lit(1), F.col("charge"))).withColumn("ion", F.col("ion") + 1)
    lo, hi = S.PPM.around(F.col("center"))
    i = i.withColumn("mz_lo", lo).withColumn("mz_hi", hi)
    m = interval.range_join(S.peaks(spark, sf), i, "mz", "mz_lo", "mz_hi", residual=S.residual(), log=True, width=4e-4)
    return m.groupBy("query_id", "ion").agg(F.count(F.lit(1)).alias("n_peaks"))


@query("""SELECT p_partkey AS query_id, round(m * (1 - 20 / 1e6), 6) AS mz_lo, round(m * (1 + 20 / 1e6), 6) AS mz_hi, round(im * 0.97, 6) AS im_lo, round(im * 1.03, 6) AS im_hi,
CAST(greatest(0, floor((rt / 60.0 - 0.5) * 60000.0)) AS BIGINT) AS rt_lo_ms, CAST(floor((rt / 60.0 + 0.5) * 60000.0) AS BIGINT) AS rt_hi_ms, round(m - 0.1, 6) AS q_lo, round(m + 2 * 1.0033548378 / z + 0.1, 6) AS q_hi
FROM (SELECT p_partkey, p_retailprice * p_size AS m, 0.6 + p_size / 100.0 AS im, CAST((p_partkey * 13) % 5400 AS DOUBLE) AS rt, 1 + p_size % 3 AS z FROM part)""")
def x01_tolerance_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Default tolerances as bounds of m/z, mobility, retention and isolation."""
    t = Tolerance().with_rt(Width("minutes", 0.5, 0.5))
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), (F.col("p_retailprice") * F.col("p_size")).alias("m"), (0.6 + F.col("p_size") / 100.0).alias("im"), ((F.col("p_partkey") * 13) % 5400).cast("double").alias("rt"), (1 + F.col("p_size") % 3).alias("z"))
    mz, im, rt = t.ms.around(F.col("m")), t.mobility.around(F.col("im")), ranges.rt_range_ms(F.col("rt"), t.rt)
    quad = ranges.quad_range(F.col("m"), F.col("z"), F.array(F.lit(0), F.lit(1), F.lit(2)), t.quad)
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return q.select("query_id", r6(mz[0], "mz_lo"), r6(mz[1], "mz_hi"), r6(im[0], "im_lo"), r6(im[1], "im_hi"), rt[0].alias("rt_lo_ms"), rt[1].alias("rt_hi_ms"), r6(quad[0], "q_lo"), r6(quad[1], "q_hi"))


@query(f"""{CHROM}, live AS (SELECT query_id, ion, min(cycle) FILTER (intensity > 0) AS a, max(cycle) FILTER (intensity > 0) AS b FROM chrom GROUP BY 1, 2), span AS (SELECT query_id, min(a) AS a, max(b) AS b FROM live WHERE a IS NOT NULL GROUP BY 1)
SELECT c.query_id, c.ion, CAST(c.cycle AS INTEGER) AS cycle, c.intensity FROM chrom c JOIN live l ON c.query_id = l.query_id AND c.ion = l.ion AND l.a IS NOT NULL JOIN span s ON c.query_id = s.query_id AND c.cycle BETWEEN s.a AND s.b""")
def out01_chromatogram(spark: SparkSession, sf: str) -> DataFrame:
    """Chromatograms cut to the span with signal, empty ions dropped."""
    cycles = spark.range(100).select(F.col("id").cast("int").alias("cycle"), (F.col("id") * 1000).alias("rt_ms"))
    t = extract.trimmed(_chroms(spark, sf), cycles).select("query_id", "ion", "cycle_lo", F.posexplode("chromatogram").alias("k", "intensity"))
    return t.select("query_id", "ion", (F.col("cycle_lo") + F.col("k")).alias("cycle"), "intensity")


@query(f"{CHROM} SELECT query_id, cycle, string_agg(CAST(CAST(intensity AS BIGINT) AS VARCHAR), ',' ORDER BY ion) AS spectrum FROM chrom GROUP BY 1, 2")
def out04_transpose(spark: SparkSession, sf: str) -> DataFrame:
    """One array per cycle instead of one per ion."""
    t = extract.transposed(_chroms(spark, sf))
    return t.select("query_id", "cycle", F.array_join(F.transform("intensities", lambda x: x.cast("long").cast("string")), ",").alias("spectrum"))


@query(f"{CHROM}, pick AS (SELECT query_id, min(cycle) AS at, max(cycle) AS last FROM chrom WHERE cycle >= 20 GROUP BY 1), ends AS (SELECT query_id, max(cycle) AS last FROM chrom GROUP BY 1) SELECT c.query_id, c.ion, c.cycle, c.intensity FROM chrom c JOIN ends e ON c.query_id = e.query_id LEFT JOIN pick p ON c.query_id = p.query_id WHERE c.cycle = coalesce(p.at, e.last)")
def out05_spectrum_at(spark: SparkSession, sf: str) -> DataFrame:
    """The spectrum at the first cycle not before a time, the last one if there is none."""
    c = _chroms(spark, sf)
    k = F.least(F.greatest(F.lit(20) - F.col("cycle_lo"), F.lit(0)), F.size("chromatogram") - 1)
    return c.select("query_id", "ion", (F.col("cycle_lo") + k).alias("cycle"), F.get("chromatogram", k).alias("intensity"))


@query(f"""WITH {PEAKS}, {IONS}, c AS (SELECT i.*, p.cycle, p.mobility FROM ions i JOIN peaks p ON p.mz BETWEEN i.mz_lo AND i.mz_hi)
SELECT 'mz' AS stage, count(*) AS n FROM c UNION ALL SELECT 'cycle', count(*) FROM c WHERE cycle BETWEEN cycle_lo AND cycle_hi UNION ALL SELECT 'mobility', count(*) FROM c WHERE cycle BETWEEN cycle_lo AND cycle_hi AND mobility BETWEEN im_lo AND im_hi""")
def h16_filter_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """How many pairs of ion and peak pass each filter of the combined scan."""
    pairs = interval.range_join(S.peaks(spark, sf), S.ions(spark, sf), "mz", "mz_lo", "mz_hi", log=True, width=4e-4)
    return extract.funnel(pairs, {"mz": F.lit(True), "cycle": F.col("cycle").between(F.col("cycle_lo"), F.col("cycle_hi")), "mobility": F.col("mobility").between(F.col("im_lo"), F.col("im_hi"))})
