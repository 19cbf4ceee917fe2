"""Peaks, ions and traces made of the star-schema tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions.ranges import Width, isotope_mz
from ionloom.runtime import stored, table

PPM = Width("ppm", 200, 200)
EXPECTED = {"click": 1.0, "view": 0.8, "purchase": 0.5, "signup": 0.3, "error": 0.1}


def peaks(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("peak_id"), F.col("l_extendedprice").alias("mz"), F.col("l_quantity").cast("long").alias("intensity"), F.col("l_discount").alias("mobility"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date")).alias("cycle"), F.concat("l_returnflag", "l_linestatus").alias("window_id"),
    )


PEAKS = """peaks AS (
  SELECT l_orderkey * 8 + l_linenumber AS peak_id, l_extendedprice AS mz, CAST(l_quantity AS BIGINT) AS intensity, l_discount AS mobility,
         CAST(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) AS INTEGER) AS cycle, l_returnflag || l_linestatus AS window_id FROM lineitem)"""


def ions(spark: SparkSession, sf: str) -> DataFrame:
    """Three isotopes of each query, with ranges of m/z, cycle and mobility."""
    q = table(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), (F.col("p_retailprice") * F.col("p_size")).alias("mono"), (1 + F.col("p_size") % 3).alias("charge"), ((F.col("p_partkey") * 37) % 2000).cast("int").alias("cycle_lo"))
    i = q.withColumn("ion", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    i = i.withColumn("center", isotope_mz(F.col("mono"), F.col("ion"), F.col("charge")))
    lo, hi = PPM.around(F.col("center"))
    return i.select("query_id", "ion", "charge", "mono", "center", lo.alias("mz_lo"), hi.alias("mz_hi"), "cycle_lo", (F.col("cycle_lo") + 365).alias("cycle_hi"), F.lit(0.01).alias("im_lo"), F.lit(0.09).alias("im_hi"))


IONS = """iso AS (
  SELECT p_partkey AS query_id, p_retailprice * p_size AS mono, 1 + p_size % 3 AS charge, CAST((p_partkey * 37) % 2000 AS INTEGER) AS cycle_lo, ion
  FROM part, (VALUES (0), (1), (2)) AS v(ion)),
ctr AS (SELECT *, mono + ion * CAST(1.0033548378 AS DOUBLE) / charge AS center FROM iso),
ions AS (SELECT query_id, ion, charge, mono, center, center * (1 - CAST(200 AS DOUBLE) / 1e6) AS mz_lo, center * (1 + CAST(200 AS DOUBLE) / 1e6) AS mz_hi,
  cycle_lo, cycle_lo + 365 AS cycle_hi, CAST(0.01 AS DOUBLE) AS im_lo, CAST(0.09 AS DOUBLE) AS im_hi FROM ctr)"""


def residual():
    return F.col("cycle").between(F.col("cycle_lo"), F.col("cycle_hi")) & F.col("mobility").between(F.col("im_lo"), F.col("im_hi"))


MATCHES = """matches AS (
  SELECT i.query_id, i.ion, i.center, i.charge, i.cycle_lo, i.cycle_hi, p.peak_id, p.mz, p.intensity, p.mobility, p.cycle, p.window_id FROM ions i JOIN peaks p
  ON p.mz BETWEEN i.mz_lo AND i.mz_hi AND p.cycle BETWEEN i.cycle_lo AND i.cycle_hi AND p.mobility BETWEEN i.im_lo AND i.im_hi)"""
BASE = f"WITH {PEAKS}, {IONS}, {MATCHES}"


def matches(spark: SparkSession, sf: str) -> DataFrame:
    from ionloom.operators.interval import range_join

    return range_join(peaks(spark, sf), ions(spark, sf), "mz", "mz_lo", "mz_hi", residual=residual(), log=True, width=4e-4)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Signal of each user and kind of event in bins of six hours."""
    e = table(spark, sf, "events")
    bin_ = F.floor(F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / 21600).cast("int")
    return e.groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("ion"), bin_.alias("cycle")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("intensity"))


CELLS = """cells AS (
  SELECT user_id AS query_id, event_type AS ion, CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) / 21600.0) AS INTEGER) AS cycle,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS intensity FROM events GROUP BY 1, 2, 3),
expected AS (SELECT * FROM (VALUES ('click', CAST(1.0 AS DOUBLE)), ('view', 0.8), ('purchase', 0.5), ('signup', 0.3), ('error', 0.1)) AS v(ion, expected))"""


def expected(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXPECTED.items()), "ion string, expected double")


def axis(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("query_id")).distinct().withColumn("cycle", F.explode(F.sequence(F.lit(0), F.lit(119))))


def event_traces(spark: SparkSession, sf: str) -> DataFrame:
    from ionloom.operators import traces

    e = expected(spark)
    totals = e.agg(F.sum("expected").alias("sum_exp"), F.sum(F.sqrt("expected")).alias("sum_sqrt_exp"))
    return stored(traces.apex_profile(traces.traces(traces.accumulators(cells(spark, sf), e), axis(spark, sf), totals)))


ACC = f"""{CELLS},
acc AS (
  SELECT c.query_id, c.cycle, sum(c.intensity * sqrt(e.expected)) AS dot, sum(CAST(c.intensity AS DOUBLE) * c.intensity) AS norm2, sum(sqrt(c.intensity)) AS sqrt_sum,
         sum(sqrt(c.intensity * e.expected)) AS cross_sum, sum(CAST(c.intensity AS DOUBLE)) AS raw, sum(ln(greatest(CAST(c.intensity AS DOUBLE), 1.0))) AS ln_sum
  FROM cells c JOIN expected e ON c.ion = e.ion WHERE c.intensity > 0 GROUP BY 1, 2)"""
TRACES = f"""{ACC},
tot AS (SELECT sum(expected) AS sum_exp, sum(sqrt(expected)) AS sum_sqrt_exp FROM expected),
axis AS (SELECT DISTINCT user_id AS query_id, CAST(k AS INTEGER) AS cycle FROM events, range(120) AS r(k)),
dense AS (SELECT a.query_id, a.cycle, acc.* EXCLUDE (query_id, cycle), tot.*, coalesce(ln_sum, 0) AS lns FROM axis a LEFT JOIN acc ON a.query_id = acc.query_id AND a.cycle = acc.cycle, tot),
traces AS (
  SELECT query_id, cycle,
    CASE WHEN coalesce(norm2, 0) > 0 THEN least(greatest(dot / (sqrt(norm2) * sqrt(sum_exp)), 1e-3), 1.0) ELSE 1e-3 END AS cosine,
    CASE WHEN coalesce(sqrt_sum, 0) > 0 THEN -ln(greatest(raw / pow(sqrt_sum, 2) - 2 * cross_sum / (sqrt_sum * sum_sqrt_exp) + sum_exp / pow(sum_sqrt_exp, 2), 1.1920929e-07)) ELSE -100.0 END AS scribe,
    CASE WHEN lns < 1 THEN 0.0 ELSE lns * ln(lns) - lns + 0.5 * ln(lns) + 0.918938533204672742 END AS lazyscore,
    ln(1 + coalesce(raw, 0)) AS log_intensity FROM dense),
prof0 AS (SELECT *, scribe * log_intensity AS s, min(scribe * log_intensity) OVER (PARTITION BY query_id) AS s_lo, max(scribe * log_intensity) OVER (PARTITION BY query_id) AS s_hi FROM traces),
prof1 AS (SELECT *, pow(cosine, 0.25) * log_intensity * (0.25 + CASE WHEN s_hi > s_lo THEN (s - s_lo) / (s_hi - s_lo) ELSE 0.5 END) AS p1 FROM prof0),
prof2 AS (SELECT *, (coalesce(lag(p1) OVER w, p1) * 0.5 + p1 + coalesce(lead(p1) OVER w, p1) * 0.5) / 2 AS p2 FROM prof1 WINDOW w AS (PARTITION BY query_id ORDER BY cycle)),
prof AS (SELECT *, (coalesce(lag(p2) OVER w, p2) * 0.5 + p2 + coalesce(lead(p2) OVER w, p2) * 0.5) / 2 AS apex_profile, pow(cosine, 3.0) * log_intensity AS cosine_profile, s AS scribe_profile FROM prof2 WINDOW w AS (PARTITION BY query_id ORDER BY cycle))"""
