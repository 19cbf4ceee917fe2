"""Calibration, target-decoy statistics, centroids and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.operators import calibrate, centroid, fdr
from ionloom.queries import standins as S
from ionloom.queries.standins import BASE
from ionloom.queries.series import OG, order_grid
from ionloom.runtime import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as candidates: priced, a tenth of them decoys and those a little worse."""
    o = table(spark, sf, "orders")
    target = F.col("o_orderkey") % 5 != 0
    return o.select(F.col("o_orderkey").alias("id"), target.alias("is_target"), F.round(F.col("o_totalprice") * F.when(target, 1.0).otherwise(0.8) / 100).cast("long").alias("score"), (F.col("o_orderkey") % 1000).alias("decoy_group"), (F.col("o_custkey") % 3 + 1).alias("charge"))


SCORED = "scored AS (SELECT o_orderkey AS id, o_orderkey % 5 <> 0 AS is_target, CAST(round(o_totalprice * CASE WHEN o_orderkey % 5 <> 0 THEN 1.0 ELSE 0.8 END / 100) AS BIGINT) AS score, o_orderkey % 1000 AS decoy_group, o_custkey % 3 + 1 AS charge FROM orders)"
QV = f"""{SCORED}, run AS (SELECT *, sum(CASE WHEN is_target THEN 1 ELSE 0 END) OVER w AS t, sum(CASE WHEN is_target THEN 0 ELSE 1 END) OVER w AS d FROM scored WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
q0 AS (SELECT *, least(1.0, min(CASE WHEN t > 0 THEN (d + 1)::DOUBLE / t ELSE 'inf'::DOUBLE END) OVER (ORDER BY score DESC, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM run),
qv AS (SELECT id, is_target, score, first_value(q) OVER (PARTITION BY score ORDER BY id) AS q_value FROM q0)"""


@query(f"WITH {QV} SELECT id, round(q_value, 8) AS q_value FROM qv")
def w19_q_values(spark: SparkSession, sf: str) -> DataFrame:
    return fdr.q_values(scored(spark, sf)).select("id", F.round("q_value", 8).alias("q_value"))


@query(f"WITH {QV} SELECT x AS threshold, count(*) FILTER (q_value <= x AND is_target) AS n_targets, count(*) FILTER (q_value <= x AND NOT is_target) AS n_decoys FROM qv, (VALUES (0.01::DOUBLE), (0.05), (0.1), (0.5), (1.0)) v(x) GROUP BY 1")
def a19_threshold_report(spark: SparkSession, sf: str) -> DataFrame:
    return fdr.threshold_report(fdr.q_values(scored(spark, sf)))


@query(f"WITH {QV} SELECT id, score FROM qv WHERE q_value <= 0.25")
def f17_q_filter(spark: SparkSession, sf: str) -> DataFrame:
    return fdr.q_values(scored(spark, sf)).filter("q_value <= 0.25").select("id", "score")


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS s2 FROM scored WINDOW w AS (PARTITION BY decoy_group, charge ORDER BY score DESC, id))
SELECT decoy_group, charge, id, score, (score - s2)::DOUBLE AS delta_group, round(s2 / score::DOUBLE, 8) AS delta_group_ratio FROM r WHERE k = 1""")
def w20_competition(spark: SparkSession, sf: str) -> DataFrame:
    """One winner per group and charge, against its second."""
    return fdr.competition(scored(spark, sf)).select("decoy_group", "charge", "id", "score", F.col("delta_group").cast("double").alias("delta_group"), F.round("delta_group_ratio", 8).alias("delta_group_ratio"))


@query("""WITH s AS (SELECT eg_id AS id, precursor_sequence AS sequence, precursor_charge AS charge, precursor_mono_mz AS mz, NOT decoy AS is_target, CAST(eg_id % 7 AS INTEGER) AS score FROM elution_groups),
l AS (SELECT *, lag(charge) OVER w IS NOT DISTINCT FROM charge AND lag(mz) OVER w IS NOT DISTINCT FROM mz AND row_number() OVER w > 1 AS same FROM s WINDOW w AS (PARTITION BY sequence ORDER BY score DESC, is_target DESC, mz, charge)) SELECT sequence, charge, mz, score, is_target, count(*) AS n FROM l WHERE NOT same GROUP BY ALL""")
def w21_sequence_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring equals go, interleaved charges stay."""
    s = table(spark, sf, "elution_groups").select(F.col("precursor_sequence").alias("sequence"), F.col("precursor_charge").alias("charge"), F.col("precursor_mono_mz").alias("mz"), (~F.col("decoy")).alias("is_target"), (F.col("eg_id") % 7).cast("int").alias("score"))
    return fdr.consecutive_dedup(s).groupBy("sequence", "charge", "mz", "score", "is_target").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(l_suppkey % 3 AS INTEGER) AS fold, 'price' AS feature, round(avg(l_extendedprice), 4) AS mean, 0.0::DOUBLE AS non_finite FROM lineitem GROUP BY 1 UNION ALL SELECT CAST(l_suppkey % 3 AS INTEGER), 'ratio', round(avg(l_tax / l_discount) FILTER (l_discount > 0), 6), round(avg(CASE WHEN l_discount > 0 THEN 0.0 ELSE 1.0 END), 6) FROM lineitem GROUP BY 1")
def a20_fold_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the finite values and share of the rest, per fold and feature."""
    li = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 3).cast("int").alias("fold"), F.col("l_extendedprice").alias("price"), F.try_divide(F.col("l_tax"), F.col("l_discount")).alias("ratio"))
    got = fdr.feature_stats(li, ["price", "ratio"])
    return got.select("fold", "feature", F.when(F.col("feature") == "price", F.round("mean", 4)).otherwise(F.round("mean", 6)).alias("mean"), F.round("non_finite", 6).alias("non_finite"))


@query(f"""WITH {SCORED}, r AS (SELECT is_target, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM scored)
SELECT round((sum(rk) FILTER (is_target) - count(*) FILTER (is_target) * (count(*) FILTER (is_target) + 1) / 2.0) / (count(*) FILTER (is_target) * count(*) FILTER (NOT is_target)), 8) AS auc FROM r""")
def a22_auc(spark: SparkSession, sf: str) -> DataFrame:
    return fdr.auc(scored(spark, sf).withColumnRenamed("is_target", "positive")).select(F.round("auc", 8).alias("auc"))


@query("""WITH b AS (SELECT l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem), m AS (SELECT l_suppkey, v AS median FROM b WHERE i = n // 2),
d AS (SELECT b.l_suppkey, abs(v - median) AS a, row_number() OVER (PARTITION BY b.l_suppkey ORDER BY abs(v - median)) - 1 AS i, n FROM b JOIN m ON b.l_suppkey = m.l_suppkey), mad AS (SELECT l_suppkey, a AS mad FROM d WHERE i = n // 2),
s AS (SELECT l_suppkey, count(*) AS n, avg(l_extendedprice) AS mean, stddev_pop(l_extendedprice) AS sd FROM lineitem GROUP BY 1)
SELECT s.l_suppkey, s.n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(median, 2) AS median, round(mad, 2) AS mad, round(greatest(-(median - mad * 1.4826 * 1.5), 5.0), 7) AS lo, round(greatest(median + mad * 1.4826 * 1.5, 5.0), 7) AS hi FROM s JOIN m ON s.l_suppkey = m.l_suppkey JOIN mad ON s.l_suppkey = mad.l_suppkey""")
def a12_robust_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Mean, spread, upper median, its absolute deviation, and the tolerances from them."""
    g = calibrate.robust_stats(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice")
    lo, hi = calibrate.mad_bounds(F.col("median"), F.col("mad"), 1.5, 5.0)
    return g.select("l_suppkey", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), F.round("median", 2).alias("median"), F.round("mad", 2).alias("mad"), F.round(lo, 7).alias("lo"), F.round(hi, 7).alias("hi"))


@query(f"WITH {OG} SELECT gx, gy, CAST(weight AS DOUBLE) AS weight FROM g")
def a16_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Weight grid, edge cells taking what lies beyond."""
    return order_grid(spark, sf).select("gx", "gy", "weight")


@query(f"WITH {OG} SELECT gx, gy, CAST(weight AS DOUBLE) AS weight FROM (SELECT *, greatest(max(weight) OVER (PARTITION BY gy), 1) AS r, greatest(max(weight) OVER (PARTITION BY gx), 1) AS c FROM g) WHERE weight = r AND weight = c")
def m01_suppression(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.suppress(order_grid(spark, sf)).select("gx", "gy", "weight")


def rt_points(spark: SparkSession, sf: str) -> DataFrame:
    """Library and observed times of sample rows, in minutes, weights 1."""
    from ionloom.operators import units

    s = table(spark, sf, "sample_lib")
    v = units.retention_values(s, table(spark, sf, "elution_groups").limit(0))
    t = units.to_milliseconds(v, table(spark, sf, "library_sources"), units.DEFAULTS)
    return t.groupBy("rec_id").agg(F.max(F.when(F.col("field_name") == "irt", F.col("rt_ms"))).alias("a"), F.max(F.when(F.col("field_name") == "tr_recalibrated", F.col("rt_ms"))).alias("b")).na.drop().select((F.col("a") / 60000).alias("library"), (F.col("b") / 60000).alias("observed"), F.lit(1.0).alias("weight"))


@query()
def m02_calibration_curve(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted curve and ridge of library against recalibrated times (M2-M5, H9)."""
    c = calibrate.fit(rt_points(spark, sf), 60)
    width = c.ridge.half_width_at(c.curve.xs)
    return spark.createDataFrame([(float(x), float(y), float(w)) for x, y, w in zip(c.curve.xs, c.curve.ys, width)], "library double, observed double, half_width double")


@query()
def m08_calibrated_library(spark: SparkSession, sf: str) -> DataFrame:
    """Every group's time through the curve, with its tolerance."""
    c = calibrate.fit(rt_points(spark, sf), 60)
    e = table(spark, sf, "elution_groups").filter("rt_seconds is not null and not isnan(rt_seconds)").select("eg_id", "rt_seconds")
    return c.apply(e)


@query()
def a21_wrmse(spark: SparkSession, sf: str) -> DataFrame:
    """Error of the curve on its own points; those outside don't count."""
    p = rt_points(spark, sf)
    return calibrate.wrmse(p, calibrate.fit(p, 60).curve)


CURVE = calibrate.Curve([1000.0, 20000.0, 60000.0, 100000.0], [0.0, 40.0, 55.0, 90.0])
_SEGMENTS = " ".join(f"WHEN x <= {b} THEN CAST({c} AS DOUBLE) + (x - {a}) * (CAST({d} AS DOUBLE) - {c}) / ({b} - {a})" for a, b, c, d in zip(CURVE.xs, CURVE.xs[1:], CURVE.ys, CURVE.ys[1:]))


@query(f"""SELECT round(sqrt(sum((p - y) * (p - y) * w) / sum(w)), 8) AS wrmse FROM (SELECT l_quantity AS y, l_linenumber AS w, CASE {_SEGMENTS} END AS p FROM (SELECT *, l_extendedprice AS x FROM lineitem) WHERE x BETWEEN {CURVE.xs[0]} AND {CURVE.xs[-1]})""")
def a21_given_curve(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted error of a given curve; points beyond its ends don't count."""
    p = table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("library"), F.col("l_quantity").alias("observed"), F.col("l_linenumber").cast("double").alias("weight"))
    return calibrate.wrmse(p, CURVE).select(F.round("wrmse", 8).alias("wrmse"))



@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN x <= 20000 THEN 0.0 + (x - 1000) * (40.0 / 19000) WHEN x <= 60000 THEN 40.0 + (x - 20000) * (15.0 / 40000) ELSE 55.0 + (x - 60000) * (35.0 / 40000) END, 9) AS y FROM (SELECT *, l_extendedprice AS x FROM lineitem)""")
def x29_curve_predict(spark: SparkSession, sf: str) -> DataFrame:
    """A piecewise linear curve inside the JVM, extrapolated at both ends."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(CURVE.column(F.col("l_extendedprice")), 9).alias("y"))


@query(f"""{BASE}, t AS (SELECT query_id, ion, sum(intensity) AS w, sum(intensity * mobility) / sum(intensity) AS im FROM matches WHERE intensity > 0 GROUP BY 1, 2)
SELECT query_id, round(CASE WHEN sum(log2(w)) > 0 THEN sum(im * log2(w)) / sum(log2(w)) ELSE 0 END, 6) AS mobility FROM t GROUP BY 1""")
def a13_query_mobility(spark: SparkSession, sf: str) -> DataFrame:
    """A query's mobility: its ions' means weighted by the logarithm of their signal."""
    m = S.matches(spark, sf).filter("intensity > 0").groupBy("query_id", "ion").agg(F.sum("intensity").alias("w"), (F.sum(F.col("intensity") * F.col("mobility")) / F.sum("intensity")).alias("im"))
    lw = F.log2(F.col("w"))
    return m.groupBy("query_id").agg(F.round(F.when(F.sum(lw) > 0, F.sum(F.col("im") * lw) / F.sum(lw)).otherwise(0.0), 6).alias("mobility"))


@query(f"""{BASE}, t AS (SELECT query_id, ion, any_value(center) AS c, sum(intensity) AS w, sum(intensity * mz) / sum(intensity) AS m FROM matches WHERE intensity > 0 GROUP BY 1, 2)
SELECT query_id, round(sum(w * (m - c) / c * 1e6) / sum(w), 4) AS ms1_ppm FROM t GROUP BY 1""")
def a14_ms1_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Signal-weighted m/z error over a query's isotopes."""
    m = S.matches(spark, sf).filter("intensity > 0").groupBy("query_id", "ion").agg(F.max("center").alias("c"), F.sum("intensity").alias("w"), (F.sum(F.col("intensity") * F.col("mz")) / F.sum("intensity")).alias("m"))
    return m.groupBy("query_id").agg(F.round(F.sum(F.col("w") * (F.col("m") - F.col("c")) / F.col("c") * 1e6) / F.sum("w"), 4).alias("ms1_ppm"))


@query(f"""{BASE}, t AS (SELECT query_id, ion, sum(intensity) AS w, sum(intensity * mobility) / sum(intensity) AS im FROM matches WHERE intensity > 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, ion) AS k FROM t),
d AS (SELECT query_id, sum(w * im) FILTER (ion = 0) / sum(w) FILTER (ion = 0) AS a, sum(w * im) FILTER (k <= 2) / sum(w) FILTER (k <= 2) AS b FROM r GROUP BY 1) SELECT query_id, round(a - b, 6) + 0.0 AS delta FROM d WHERE a IS NOT NULL""")
def a15_mobility_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Mobility of the first ion against that of the two strongest."""
    m = S.matches(spark, sf).filter("intensity > 0").groupBy("query_id", "ion").agg(F.sum("intensity").alias("w"), (F.sum(F.col("intensity") * F.col("mobility")) / F.sum("intensity")).alias("im"))
    r = m.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("w"), "ion")))
    part = lambda c: F.sum(F.when(c, F.col("w") * F.col("im"))) / F.sum(F.when(c, F.col("w")))
    return r.groupBy("query_id").agg(part(F.col("ion") == 0).alias("a"), part(F.col("k") <= 2).alias("b")).filter("a is not null").select("query_id", F.round(F.col("a") - F.col("b"), 6).alias("delta"))


@query()
def m12_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks of each day as a frame, gathered into clusters."""
    p = S.peaks(spark, sf).select(F.col("cycle").cast("long").alias("frame_id"), "mz", "mobility", F.col("intensity").cast("double").alias("intensity"))
    return centroid.centroid_frames(p, ppm=5000, pct=50)


@query(f"WITH {S.PEAKS} SELECT CAST(cycle AS BIGINT) AS frame_id, count(*) AS n_peaks, CAST(sum(intensity) AS BIGINT) AS intensity FROM peaks GROUP BY 1")
def m12_conserved(spark: SparkSession, sf: str) -> DataFrame:
    """Frames that ended with every peak taken hold each peak and its intensity once; where one stops early, rows differ."""
    c = m12_centroids(spark, sf).filter("reason = 'all_taken'")
    return c.groupBy("frame_id").agg(F.sum("n_peaks").alias("n_peaks"), F.round(F.sum("intensity")).cast("long").alias("intensity"))


@query()
def h15_centroid_summary(spark: SparkSession, sf: str) -> DataFrame:
    return centroid.summary(m12_centroids(spark, sf))


@query(f"WITH {SCORED} SELECT (id - id % 3) % 3 AS zero, count(*) AS n FROM scored GROUP BY 1")
def t10_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Stable folds of the candidates; that they are three and hold everything is what is told."""
    f = scored(spark, sf).withColumn("fold", fdr.fold("id", "charge")).filter(F.col("fold").isin(0, 1, 2))
    return f.groupBy(((F.col("id") - F.col("id") % 3) % 3).alias("zero")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT eg_id, CAST(round(precursor_mono_mz / 5.0) * 5.0 AS DOUBLE) AS mz_bin, round(ln(1 + greatest(rt_seconds, 0)), 6) AS log_rt FROM elution_groups WHERE precursor_mono_mz IS NOT NULL AND rt_seconds IS NOT NULL AND NOT isnan(rt_seconds)")
def x39_feature_transforms(spark: SparkSession, sf: str) -> DataFrame:
    from ionloom.operators import features

    e = table(spark, sf, "elution_groups").filter("precursor_mono_mz is not null and rt_seconds is not null and not isnan(rt_seconds)")
    return e.select("eg_id", features.mz_bin(F.col("precursor_mono_mz")).alias("mz_bin"), F.round(features.transforms(F.col("rt_seconds"), "ln1p"), 6).alias("log_rt"))


@query("SELECT eg_id, precursor_charge FROM elution_groups WHERE contains(CAST(eg_id AS VARCHAR), '77')")
def f20_id_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose id holds a text."""
    return table(spark, sf, "elution_groups").filter(F.col("eg_id").cast("string").contains("77")).select("eg_id", "precursor_charge")


@query(f"WITH {QV} SELECT CAST(charge AS BIGINT) AS charge, x AS threshold, count(*) FILTER (q_value <= x AND qv.is_target) AS n FROM qv JOIN scored USING (id), (VALUES (0.05::DOUBLE), (0.2), (1.0)) v(x) GROUP BY 1, 2")
def h18_ids_by_charge(spark: SparkSession, sf: str) -> DataFrame:
    """Identifications by charge along the q-value curve."""
    q = fdr.q_values(scored(spark, sf), "score").withColumn("threshold", F.explode(F.array(F.lit(0.05), F.lit(0.2), F.lit(1.0))))
    return q.groupBy("charge", "threshold").agg(F.count(F.when((F.col("q_value") <= F.col("threshold")) & F.col("is_target"), 1)).alias("n"))
