"""Whole plans: stored index, streams, library building, rescoring, model refit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators import fdr
from ionloom.plans import library, rescoring, search
from ionloom.queries import standins as S
from ionloom.queries.peptide import proteins
from ionloom.queries.standins import BASE, PEAKS
from ionloom.runtime import scratch, table
from ionloom.sources import peaks as peak_source
from ionloom.sources import simulator
from ionloom.streaming import micro

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"WITH {PEAKS} SELECT window_id, count(*) AS n, CAST(sum(intensity) AS BIGINT) AS intensity FROM peaks WHERE mz BETWEEN 20000 AND 40000 GROUP BY 1")
def k01_stored_index(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks written clustered by m/z and read back by a range that reaches the files."""
    path = scratch(spark)
    names = {w: i for i, w in enumerate(("AF", "AO", "NF", "NO", "RF", "RO"))}
    number = F.coalesce(*[F.when(F.col("window_id") == w, i) for w, i in names.items()], F.lit(-1))
    p = S.peaks(spark, sf).select(F.lit("run").alias("run_id"), F.lit(2).cast("byte").alias("ms_level"), number.cast("int").alias("window_id"), F.col("mz").cast("float").alias("mz"), F.col("intensity").cast("float").alias("intensity"), F.col("mobility").cast("float").alias("mobility_ook0"), F.col("cycle").alias("cycle_index"))
    cycles = p.select("run_id", F.col("cycle_index").alias("cycle")).distinct()
    peak_source.write_index(p, cycles, p.select("run_id", "window_id").distinct(), path)
    got = peak_source.read_index(spark, path)[0].filter(F.col("mz").between(20000, 40000))
    back = F.element_at(F.array(*[F.lit(w) for w in names]), F.col("window_id") + 1)
    return got.groupBy(back.alias("window_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").cast("long").alias("intensity"))


@query(f"WITH {PEAKS} SELECT window_id, count(*) AS n FROM peaks WHERE mz BETWEEN 20000 AND 20100 GROUP BY 1")
def t02_rebucket(spark: SparkSession, sf: str) -> DataFrame:
    """A stored index written anew with smaller row groups gives the same peaks."""
    path = scratch(spark)
    p = S.peaks(spark, sf).select(F.lit("run").alias("run_id"), F.lit(2).cast("byte").alias("ms_level"), F.lit(0).alias("window_id"), F.col("mz").cast("float").alias("mz"), F.col("intensity").cast("float").alias("intensity"), F.lit(0.0).cast("float").alias("mobility_ook0"), F.col("cycle").alias("cycle_index"), F.col("window_id").alias("name"))
    peak_source.write_index(p.drop("name"), p.select("run_id", F.col("cycle_index").alias("cycle")).distinct(), p.select("run_id", "window_id").distinct(), path)
    peak_source.rebucket(spark, path, f"{path}-small", 16, 1 << 18)
    got = peak_source.read_index(spark, f"{path}-small")[0].filter(F.col("mz").between(20000, 20100))
    many = p.groupBy("mz", "cycle_index", "intensity").agg(F.count(F.lit(1)).alias("k"))
    counted = got.groupBy("mz", "cycle_index", "intensity").agg(F.count(F.lit(1)).alias("k"))
    same = counted.join(many, ["mz", "cycle_index", "intensity", "k"])
    return p.join(same, ["mz", "cycle_index", "intensity"]).groupBy(F.col("name").alias("window_id")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE}, s AS (SELECT i.query_id, i.ion, sum(p.intensity) AS i FROM ions i JOIN peaks p ON p.mz BETWEEN i.mz_lo AND i.mz_hi AND p.cycle BETWEEN i.cycle_lo AND i.cycle_hi GROUP BY 1, 2) SELECT ions.query_id, ions.ion, CAST(coalesce(i, 0) AS BIGINT) AS intensity FROM ions LEFT JOIN s ON ions.query_id = s.query_id AND ions.ion = s.ion")
def st01_streamed_spectra(spark: SparkSession, sf: str) -> DataFrame:
    """Queries that arrive as a stream of files, answered batch by batch against the stored peaks."""
    path = scratch(spark)
    ions = S.ions(spark, sf).select("query_id", "ion", "mz_lo", "mz_hi", "cycle_lo", "cycle_hi")
    ions.repartition(3, "query_id").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(ions.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    micro.answer(stream, S.peaks(spark, sf), lambda df, i: df.write.mode("append").parquet(f"{path}/out"), f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS weight, round(avg(value), 6) AS mean, min(value) AS lo, max(value) AS hi FROM events WHERE value > 0 GROUP BY 1, 2""")
def st02_running_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Running statistics per hour, as the stream's state computes them, over the stored events."""
    e = table(spark, sf, "events").withColumn("one", F.lit(1)).filter("value > 0")
    s = micro.running_stats(e, "ts", "event_type", "value", "one")
    return s.withColumn("mean", F.round("mean", 6))


@query()
def s23_built_library(spark: SparkSession, sf: str) -> DataFrame:
    """Library entries of all texts read as proteins: digest, modify, decoys, predict, filter."""
    settings = library.Build(variable=(("M", "[UNIMOD:35]"),))
    return library.build(proteins(spark, sf), settings).select("sequence", "charge", "decoy", "decoy_group", F.round("precursor_mz", 4).alias("precursor_mz"), F.size("fragments").alias("n_fragments"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "fragment_ions").filter("fragment_intensity > 0 and not isnan(fragment_intensity)").groupBy("eg_id").agg(F.count(F.lit(1)).alias("n"), F.max("fragment_intensity").alias("top"), F.avg("fragment_mz").alias("mean_mz"))
    e = table(spark, sf, "elution_groups").select(F.col("eg_id").alias("id"), "eg_id", (~F.col("decoy")).alias("is_target"), F.col("precursor_mono_mz").alias("mz"), F.col("precursor_charge").alias("charge"), F.col("mobility_ook0").alias("mobility"))
    return e.join(f, "eg_id", "left").drop("eg_id")


FEATURES = ["n", "top", "mean_mz", "mz", "charge", "mobility"]


@query()
def m10_rescored(spark: SparkSession, sf: str) -> DataFrame:
    """Cross-validated boosting of targets against decoys, with q-values."""
    r = rescoring.rescore(candidates(spark, sf), FEATURES)
    return fdr.q_values(r, "discriminant_score").select("id", "is_target", "discriminant_score", "q_value")


@query()
def m11_importances(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(rescoring.importances(candidates(spark, sf), FEATURES), "feature string, gain double")


@query()
def m16_mobility_refit(spark: SparkSession, sf: str) -> DataFrame:
    """The mobility model fitted anew to the table's own values."""
    e = table(spark, sf, "elution_groups").select(F.col("precursor_mono_mz").alias("mz"), F.col("precursor_charge").alias("charge"), F.col("mobility_ook0").cast("double").alias("mobility")).filter("mobility > 0 and not isnan(mobility)")
    coef, intercept, mape = rescoring.refit_mobility(e)
    return spark.createDataFrame([(*map(float, coef), float(intercept), float(mape))], "a double, b double, c double, d double, e double, intercept double, mape double")


@query("SELECT what, TRUE AS holds FROM (VALUES ('recovered_at_1_percent'), ('wrong_below_2_percent'), ('curve_of_the_run'), ('narrower_mass'), ('narrower_mobility'), ('every_query_accounted_for')) v(what)")
def z11_search(spark: SparkSession, sf: str) -> DataFrame:
    """A search of a simulated run with known contents, its own calibration and tolerances: what must hold of it."""
    lib, peaks, cycles, windows, there = simulator.frames(spark, 160, present=0.85, noise=12_000)
    report: dict = {}
    settings = search.Settings(bins=40)
    results, cal = search.search(lib, peaks, cycles, windows, settings, report)
    found = simulator.recovered(results, there)[0.01]
    n = lib.count() * 3
    checks = [
        ("recovered_at_1_percent", found["sensitivity"] >= 0.8), ("wrong_below_2_percent", found["wrong_share"] <= 0.02), ("curve_of_the_run", abs(float(cal.curve.predict(300.0)) - (300 * 1.02 + 8)) < 5),
        ("narrower_mass", sum(cal.mz_ppm) < settings.tolerance.ms.lo + settings.tolerance.ms.hi), ("narrower_mobility", sum(cal.mobility_pct) < settings.tolerance.mobility.lo + settings.tolerance.mobility.hi),
        ("every_query_accounted_for", report["scored"] + sum(report["skipped"].values()) - report["skipped"]["calibrant_nan_score"] == n),
    ]
    return spark.createDataFrame([(k, bool(v)) for k, v in checks], "what string, holds boolean")
