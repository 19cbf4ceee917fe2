import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ionloom.operators import calibrate
from ionloom.plans import library as L
from ionloom.plans import rescoring
from ionloom.plans.search import Settings, search
from ionloom.sources import simulator
from ionloom.streaming import micro


def test_search_recovers_simulated_entries(spark):
    lib, peaks, cycles, windows, there = simulator.frames(spark, 60, present=0.6, noise=8000)
    results, cal = search(lib, peaks, cycles, windows, Settings(bins=40, rounds=5))
    p = results.toPandas()
    ok = p[p.is_target & (p.q_value <= 0.1)]
    assert len(ok) >= 0.8 * len(there) and sum(i in there for i in ok.library_id) >= 0.9 * len(ok)
    assert abs(float(cal.curve.predict(300.0)) - (300 * 1.02 + 8)) < 10
    hits = ok[ok.library_id.isin(there)]
    assert (hits.obs_rt_seconds - (hits.rt_seconds * 1.02 + 8)).abs().median() < 3


def test_search_of_two_runs_at_once(spark):
    lib = simulator.library(25)
    frames = [simulator.run(lib, present=0.9, seed=k, noise=2000, offset=o) for k, o in ((7, 8.0), (8, 20.0))]
    peaks, cycles, windows = (spark.createDataFrame(pd.concat([f[i] for f in frames], ignore_index=True)) for i in range(3))
    library = spark.createDataFrame(lib.to_dict("records"), simulator.LIBRARY_SCHEMA)
    p = search(library, peaks, cycles, windows, Settings(bins=30, rounds=2, decoys="never"))[0].toPandas()
    for k, (run_id, g) in enumerate(sorted(p.groupby("run_id"))):
        there = g[g.library_id.isin(frames[k][3])]
        assert len(there) >= 0.7 * len(frames[k][3]), run_id
    assert p.groupby(["run_id", "decoy_group", "charge"]).size().max() == 1


def test_each_run_has_its_own_calibration(spark):
    from ionloom.plans.search import calibration, with_windows

    # The weak run 1 has another gradient than the strong run 0, which alone would fill the calibrants.
    pts = [(run * 1000 + i, run, float(i), 100.0 - 90 * run, int(i * (2 - run) + 50 * run)) for run in (0, 1) for i in range(10, 200)]
    q = spark.createDataFrame([(a, r, x, True) for a, r, x, _, _ in pts], "query_id long, run_no long, rt_seconds double, is_target boolean")
    pre = spark.createDataFrame([(a, v, c) for a, _, _, v, c in pts], "query_id long, apex_value double, apex int")
    cycles = spark.createDataFrame([(r, c, c * 1000) for r in (0, 1) for c in range(500)], "run_no long, cycle int, rt_ms long")
    by = calibration(pre, q, cycles, Settings(calibrants=150, bins=40))
    assert abs(by[0].curve.predict(100.0) - 200) < 3 and abs(by[1].curve.predict(100.0) - 150) < 3
    got = with_windows(q.filter("rt_seconds = 100"), cycles, by).orderBy("run_no").collect()
    assert [abs(r.rt_calibrated - t) < 3 for r, t in zip(got, (200, 150))] == [True, True] and got[0].cycle_lo > got[1].cycle_lo
    for k, c in by.items():
        one = c.apply(q.filter(F.col("run_no") == k)).orderBy("query_id").select("rt_calibrated", "rt_tolerance_minutes").collect()
        each = calibrate.apply_each(q.filter(F.col("run_no") == k), by, "run_no").orderBy("query_id").select("rt_calibrated", "rt_tolerance_minutes").collect()
        assert [tuple(pytest.approx(v) for v in r) for r in one] == [tuple(r) for r in each]


def test_windows_follow_an_uneven_time_axis(spark):
    from ionloom.plans.search import with_windows

    # One cycle a second with a pause of 1,000 s after 100 of them, and a second run without.
    cycles = spark.createDataFrame([(r, c, c * 1000 + (1_000_000 if c >= 100 and r == 0 else 0)) for r in (0, 1) for c in range(300)], "run_no long, cycle int, rt_ms long")
    q = spark.createDataFrame([(1, 0, 50.0), (2, 0, 1150.0), (3, 1, 150.0), (4, 1, 10.0), (5, 1, 900.0)], "query_id long, run_no long, rt_seconds double")
    same = {k: calibrate.Calibration(calibrate.Curve([0.0, 1.0], [0.0, 1.0]), calibrate.Ridge(), 0.5) for k in (0, 1)}
    got = with_windows(q, cycles, same).orderBy("query_id").select("query_id", "cycle_lo", "cycle_hi").collect()
    assert [tuple(r) for r in got] == [(1, 20, 80), (2, 120, 180), (3, 120, 180), (4, 0, 40)]


def test_rescoring_ranks(spark):
    rows = [(i, bool(i % 2), float(i % 2) + (i * 7919 % 100) / 120, None if i % 9 == 0 else float(i % 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, is_target boolean, a double, b double")
    r = rescoring.rescore(df, ["a", "b"], rounds=5, depth=3).toPandas()
    assert len(r) == 600 and r[r.is_target].discriminant_score.mean() > r[~r.is_target].discriminant_score.mean() + 0.5
    assert rescoring.importances(df, ["a", "b"], rounds=5)[0][0] == "a"
    one = df.filter("is_target")
    assert rescoring.rescore(one, ["a"], rounds=2).agg(F.max("discriminant_score")).first()[0] == 0.0


def test_boosting_goes_on_until_it_brings_nothing(spark):
    from pyspark.ml.feature import VectorAssembler

    d = spark.range(300).select(F.col("id"), (F.sin(F.col("id") * 1.7) + F.sin(F.col("id") * 0.1) > 0).cast("double").alias("_y"), F.lit(1.0).alias("_w"), F.sin(F.col("id") * 1.7).alias("a"), F.sin(F.col("id") * 0.1).alias("b"))
    v = VectorAssembler(inputCols=["a", "b"], outputCol="_v").transform(d).cache()
    train, rest = v.filter("id % 2 = 0"), v.filter("id % 2 = 1")
    m = rescoring._boosted(train, rest, 40, 2, patience=4)
    loss = m.evaluateEachIteration(rest)
    assert len(loss) > 8 and loss[-1] == min(loss)
    assert (rescoring.ROUNDS, rescoring.DEPTH, rescoring.PATIENCE, Settings().rounds) == (1000, 6, 100, 1000)


def test_mobility_refit(spark):
    from ionloom.functions.chemistry import one_over_k0

    d = spark.range(400).select((400 + F.col("id") * 2.0).alias("mz"), (F.col("id") % 3 + 1).cast("int").alias("charge"))
    assert rescoring.refit_mobility(d.withColumn("mobility", one_over_k0(F.col("mz"), F.col("charge"))))[2] < 1.5


def test_build_library(spark):
    prot = spark.createDataFrame([("a", "MPEPTIDEKAAAGGGCCKSAMPLERLLLLLLK"), ("b", "PEPTIDEKBBBBBBBK"), ("c", None)], "protein_id string, sequence string")
    b = L.Build(missed=0, variable=(("M", "[UNIMOD:35]"),), charges=(2, 2), fragment_mz=(100, 2000), precursor_mz=(200, 2000))
    got = L.build(prot, b).toPandas()
    t = got[~got.decoy]
    assert {"SAMPLER", "SAM[UNIMOD:35]PLER", "PEPTIDEK", "AAAGGGC[UNIMOD:4]C[UNIMOD:4]K"} <= set(t.sequence)
    assert got.groupby("decoy_group").decoy.nunique().max() == 2 and (got.fragments.map(len) <= 12).all()
    assert "B" not in "".join(got.sequence)
    assert L.build(prot.limit(0), b).count() == 0
    for bad in ({"decoys": "x"}, {"charges": (3, 2)}):
        with pytest.raises(ValueError):
            L.Build(**bad)


def test_service_tensors():
    f = pd.DataFrame({"sequence": ["AK", "CK"], "charge": [1, 2]})
    r = L.request_tensors(f)
    assert [x["name"] for x in r["inputs"]] == ["peptide_sequences", "precursor_charges", "collision_energies"] and len(L.request_tensors(f, intensities=False)["inputs"]) == 1
    resp = {"outputs": [{"name": "annotation", "shape": [2, 2], "data": ["y1+1", "y1+2", "b2+1", "b3+1"]}, {"name": "mz", "shape": [2, 2], "data": [1, 2, 3, 4]}, {"name": "intensities", "shape": [2, 2], "data": [0.5, 0.25, 0, 1]}]}
    assert L.response_fragments(resp) == [[{"label": "y1", "mz": 1.0, "intensity": 0.5}, {"label": "y1^2", "mz": 2.0, "intensity": 0.25}], [{"label": "b3", "mz": 4.0, "intensity": 1.0}]]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a", 99.0, 101.0, 0, 5), (2, "a", 500.0, 501.0, 0, 5)], "query_id long, ion string, mz_lo double, mz_hi double, cycle_lo int, cycle_hi int").write.parquet(str(src))
    peaks = spark.createDataFrame([(100.0, 7, 3), (100.5, 2, 9)], "mz double, intensity long, cycle int")
    seen = {}
    q = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    micro.answer(q, peaks, lambda df, i: seen.update({r.query_id: r.intensity for r in df.collect()}), str(tmp_path / "cp1")).awaitTermination()
    assert seen == {1: 7, 2: 0}

    pts = tmp_path / "pts"
    spark.createDataFrame([(float(x), 2.0 * x, 1.0) for x in range(5, 100, 10)], "library double, observed double, weight double").write.parquet(str(pts))
    fits = []
    micro.calibrating(spark.readStream.schema("library double, observed double, weight double").parquet(str(pts)), calibrate.State(10, (0.0, 100.0), (0.0, 200.0)), lambda c, i: fits.append(c), str(tmp_path / "cp2")).awaitTermination()
    assert float(fits[-1].predict(50.0)) == pytest.approx(100.0)

    sc = tmp_path / "sc"
    spark.createDataFrame([(float(i % 10), i) for i in range(100)], "score double, id long").repartition(4).write.parquet(str(sc))
    best: dict = {}
    micro.top_scores(spark.readStream.schema("score double, id long").option("maxFilesPerTrigger", 1).parquet(str(sc)), 3, best, str(tmp_path / "cp3")).awaitTermination()
    assert best["best"] == [(9.0, 9), (9.0, 19), (9.0, 29)]


def test_running_stats_stream(spark, tmp_path):
    src = tmp_path / "ev"
    rows = [("2024-01-01 00:05:00", "k", 1.0, 1.0), ("2024-01-01 00:50:00", "k", 4.0, 2.0), ("2024-01-01 03:00:00", "k", 9.0, 1.0)]
    spark.createDataFrame(rows, "t string, key string, v double, w double").selectExpr("cast(t as timestamp) t", "key", "v", "w").write.parquet(str(src))
    s = micro.running_stats(spark.readStream.schema("t timestamp, key string, v double, w double").parquet(str(src)), "t", "key", "v", "w")
    q = s.writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted((r.mean, r.lo, r.hi) for r in spark.table("stats").collect()) == [(3.0, 1.0, 4.0), (9.0, 9.0, 9.0)]


def test_command_line(spark, tmp_path):
    from ionloom.__main__ import main

    main(["write-template", str(tmp_path / "t")])
    assert json.loads((tmp_path / "t" / "tolerance_narrow.json").read_text())["ms"] == {"ppm": [10.0, 10.0]}
    (tmp_path / "p.txt").write_text("PEPTIDEK\nSAMPLERSAMPLER\n")
    main(["build-library", "--peptides", str(tmp_path / "p.txt"), "--output", str(tmp_path / "lib")])
    assert spark.read.parquet(str(tmp_path / "lib")).count() > 0
    with pytest.raises(SystemExit):
        main(["search"])


def test_search_scores_within_its_own_tolerances(spark):
    """Tolerances come from the calibrants, are narrower than the given ones, and are what the scores are made with."""
    from ionloom.plans import search as S

    lib, peaks, cycles, windows, there = simulator.frames(spark, 60, present=0.8, noise=4000)
    report = {}
    results, cal = search(lib, peaks, cycles, windows, Settings(bins=40, rounds=3), report)
    assert 1.0 <= cal.mz_ppm[0] < 10 and cal.mz_ppm[1] < 10 and max(cal.mobility_pct) < 2.5
    assert report["scored"] + sum(report["skipped"].values()) - report["skipped"]["calibrant_nan_score"] == 180
    q = S.with_tolerances(spark.createDataFrame([(0, 1.0)], "run_no long, mobility double"), {0: cal}, Settings()).first()
    assert (q.ppm_lo, q.ppm_hi) == cal.mz_ppm and q.im_lo == pytest.approx(1 - cal.mobility_pct[0] / 100) and q.im_hi == pytest.approx(1 + cal.mobility_pct[1] / 100)
    got = simulator.recovered(results, there)
    assert got[0.1]["sensitivity"] >= 0.7
    two = spark.createDataFrame([(1, True, 2.0), (-1, True, 1.0)], "library_id long, is_target boolean, discriminant_score double")
    assert simulator.auc(two, {1}) == 1.0 and simulator.auc(two, {-1}) == 0.0
    assert results.filter("isotope_ratio is not null").count() > 0
    assert results.groupBy("decoy_group", "charge").count().filter("count > 1").isEmpty()


def test_search_without_mobility(spark):
    lib, peaks, cycles, windows, there = simulator.frames(spark, 40, present=0.9, noise=1000)
    flat = peaks.withColumn("mobility", F.lit(None).cast("double"))
    results, _ = search(lib, flat, cycles, windows.withColumns({"im0": F.lit(float("-inf")), "im1": F.lit(float("inf"))}), Settings(bins=40, rounds=2, has_mobility=False, decoys="never"))
    assert results.filter("mobility_pct_abs is not null").isEmpty() and results.filter("is_target").count() >= 0.7 * len(there)
