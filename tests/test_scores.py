import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.operators import calibrate, centroid, features, fdr, matching, peptides, traces


def test_area_uniqueness_value():
    x = np.zeros(21)
    x[8:13] = [1, 5, 10, 5, 1]
    assert features.area_uniqueness(x, 10) == pytest.approx(4422)


def test_coelution_matches_pairwise():
    rng = np.random.default_rng(0)
    f, e = rng.random((5, 60)), rng.random(5)
    w = slice(10, 51)
    r = np.corrcoef(f[:, w])
    num = sum(e[i] * e[j] * r[i, j] for i in range(5) for j in range(i + 1, 5)) / sum(e[i] * e[j] for i in range(5) for j in range(i + 1, 5))
    assert features.coelution(f, e, 30)[1] == pytest.approx(num)
    d = np.corrcoef(np.diff(f[:, 20:41], axis=1))
    assert features.coelution(f, e, 30)[2] == pytest.approx(np.mean([d[i, j] for i in range(5) for j in range(i + 1, 5)]))
    assert features.coelution(f[:1], e[:1], 30) == (1.0, 0.0, 0.0)


def test_perfect_peak_features():
    n, apex = 61, 30
    shape = np.exp(-0.5 * ((np.arange(n) - apex) / 2) ** 2)
    exp = np.array([1.0, 0.5, 0.25, 0.8])
    f = features.apex_features(apex, exp[:, None] * shape * 100, exp, np.array([1, 0.6, 0.3])[:, None] * shape, np.array([1, 0.6, 0.3]), shape)
    for k in ("ratio_cv", "fragment_coverage", "fragment_apex_agreement", "isotope_correlation", "precursor_coelution"):
        assert f[k] == pytest.approx(1, abs=1e-6), k
    assert f["gaussian_correlation"] > 0.99 and f["peak_shape"] > 0.99 and f["xic_quality"] > 0.95
    assert features.weighted_score(1.0, {k: 0.0 for k in features.WEIGHTS}) == pytest.approx(0.32 * 0.43 * 0.27 * 0.65)


def test_scores_edge_cases(spark):
    rows = [(1, 0, [[0.0, 0.0]], [1.0], [], [], [0.0, 0.0], [0.0, 0.0]), (2, 1, [[1.0, 2.0, 1.0]], [0.0], [[1.0, 1.0, 1.0]], [1.0], [0.1, 1.0, 0.1], [0.0, 1.0, 0.0]), (3, None, [], [], [], [], [], [])]
    df = spark.createDataFrame(rows, "query_id long, apex int, fragments array<array<double>>, expected array<double>, precursors array<array<double>>, expected_precursors array<double>, cosine_profile array<double>, scribe_profile array<double>")
    got = {r.query_id: r.main_score for r in features.scores(df).collect()}
    assert set(got) == {1, 2} and all(np.isfinite(list(got.values())))


def series(spark, values):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "query_id long, cycle int, lazyscore double").withColumn("apex_profile", F.col("lazyscore"))


def test_steps_and_peaks(spark):
    t = series(spark, [0.0, 1, 0.5, 3, 9, 9, 2, 4, 1, 0, 0, 5, 0])
    p = traces.peaks(t).first()
    assert (p.apex, p.apex_value, p.apex_rise, p.apex_fall) == (4, 9.0, 3, 3)
    assert (p.delta_next, p.delta_second_next) == (4.0, None) or p.delta_next == 4.0
    alone = traces.peaks(series(spark, [1.0])).first()
    assert (alone.apex, alone.apex_rise, alone.apex_fall, alone.delta_next) == (0, 1, 1, None)


def test_blur_and_convolution(spark):
    t = series(spark, [0.0, 0, 4, 0, 0])
    assert [r.b for r in t.select("cycle", traces.blurred(F.col("lazyscore")).alias("b")).orderBy("cycle").collect()] == [0, 1, 2, 1, 0]
    assert [r.b for r in series(spark, [4.0, 0]).select(traces.blurred(F.col("lazyscore")).alias("b")).collect()] == [4, 0]
    c = traces.convolve_rows(t, "lazyscore", [1.0, 2.0, 3.0], "c").orderBy("cycle").collect()
    assert [r.c for r in c] == [0, 12, 8, 4, 0]


def test_grid_convolution_matches_dense(spark):
    rng = np.random.default_rng(1)
    w = rng.integers(0, 3, (7, 7)).astype(float)
    cells = spark.createDataFrame([(int(x), int(y), float(w[y, x])) for y in range(7) for x in range(7) if w[y, x]], "gx int, gy int, weight double")
    got = np.zeros((7, 7))
    for r in traces.convolve_grid(cells, 7).collect():
        got[r.gy, r.gx] = r.weight
    assert got == pytest.approx(calibrate.blurred_grid(w))


@pytest.mark.parametrize("slope", [1.0, 2.0])
def test_calibration_lines(spark, slope):
    pts = spark.createDataFrame([(float(x), slope * x, 1.0) for x in range(5, 100, 10)] + [(float("nan"), 1.0, 1.0), (1.0, None, 1.0)], "library double, observed double, weight double")
    c = calibrate.fit(pts.na.drop().filter("not isnan(library)"), 10)
    assert c.curve.predict([5.0, 37.0, 95.0, 110.0]) == pytest.approx(slope * np.array([5.0, 37, 95, 110]))
    assert calibrate.wrmse(pts, c.curve).first()[0] == pytest.approx(0, abs=1e-9)
    for x in (-3.0, 5.0, 12.0, 200.0):
        assert spark.range(1).select(c.curve.column(F.lit(x))).first()[0] == pytest.approx(float(c.curve.predict(x)))
    assert calibrate.Calibration.from_json(c.as_json()).curve.ys == c.curve.ys


def test_calibration_fallbacks(spark):
    empty = spark.createDataFrame([], "library double, observed double, weight double")
    one = spark.createDataFrame([(1.0, 1.0, 1.0)] * 3, "library double, observed double, weight double")
    for df in (empty, one):
        assert calibrate.fit(df, 10).curve.xs == [0.0, 1.0]
    assert calibrate.wrmse(empty, calibrate.fallback().curve).first()[0] is None
    with pytest.raises(ValueError):
        calibrate.Curve([1.0], [1.0])


def test_path_against_full_search():
    rng = np.random.default_rng(4)
    for _ in range(30):
        nodes = sorted({(float(rng.integers(0, 8)), float(rng.integers(0, 8)), float(rng.integers(1, 5))) for _ in range(8)})
        path = calibrate.monotone_path(nodes, 30)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(path, path[1:]))

        def weight(p):
            return p[0][2] + sum((a[2] * b[2]) ** 0.5 / np.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(p, p[1:]))

        best = max(weight([n for k, n in enumerate(nodes) if m >> k & 1]) for m in range(1, 1 << len(nodes)) if (lambda s: all(a[0] < b[0] and a[1] < b[1] for a, b in zip(s, s[1:])))([n for k, n in enumerate(nodes) if m >> k & 1]))
        # The heaviest chain is part of the path; extensions may follow on either side.
        assert max(weight(path[i:j]) for i in range(len(path)) for j in range(i + 1, len(path) + 1)) >= best - 1e-9


def test_state_in_batches(spark):
    s = calibrate.State(10, (0.0, 100.0), (0.0, 100.0))
    for part in ([5, 15, 25, 35], [45, 55, 65], [75, 85, 95]):
        s.update(spark.createDataFrame([(float(x), float(x), 1.0) for x in part], "library double, observed double, weight double"))
    assert s.fit().predict(50.0) == pytest.approx(50.0)
    s.reset()
    with pytest.raises(ValueError):
        s.fit()


def test_robust_stats(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 100)] + [("b", 5.0), ("a", None), ("a", float("nan"))], "g string, v double")
    got = {r.g: (r.n, r.median, r.mad) for r in calibrate.robust_stats(df, ["g"], "v").collect()}
    assert got == {"a": (4, 3.0, 2.0), "b": (1, 5.0, 0.0)}


def test_q_values_by_hand(spark):
    rows = [(1, 9.0, True), (2, 8.0, True), (3, 7.0, False), (4, 7.0, True), (5, 6.0, True), (6, 1.0, False), (7, None, True)]
    q = {r.id: r.q_value for r in fdr.q_values(spark.createDataFrame(rows, "id long, score double, is_target boolean")).collect()}
    t = d = 0
    raw = []
    for i, s, y in rows[:6]:
        t, d = t + y, d + (not y)
        raw.append((i, s, min(1.0, (d + 1) / t)))
    want, low = {}, 1.0
    for i, s, v in reversed(raw):
        low = min(low, v)
        want[i] = low
    want[4] = want[3]
    assert q == pytest.approx(want)
    assert fdr.q_values(spark.createDataFrame([], "id long, score double, is_target boolean")).count() == 0


def test_dedup_and_competition(spark):
    rows = [(1, "P", 2, 500.0, 5.0, False, 0), (2, "P", 2, 500.0, 5.0, True, 0), (3, "P", 3, 400.0, 4.0, True, 0), (4, "P", 2, 500.0, 3.0, False, 0)]
    df = spark.createDataFrame(rows, "id long, sequence string, charge int, mz double, score double, is_target boolean, decoy_group long")
    assert {r.id for r in fdr.consecutive_dedup(df).collect()} == {2, 3, 4}
    w = {(r.charge): (r.id, r.delta_group, r.delta_group_ratio) for r in fdr.competition(df).collect()}
    assert w[2] == (1, 0.0, 1.0) and w[3] == (3, None, None)


def test_auc_and_centroids(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True), (0.0, False)], "score double, positive boolean")
    assert fdr.auc(df).first()[0] == pytest.approx(0.875)
    rows, why = centroid.centroids(np.array([100.0, 100.0005, 200.0]), np.array([1.0, 1.01, 1.0]), np.array([10.0, 30.0, 0.5]), 10, 3, 100, 0)
    assert why == "all_taken" and sorted((round(r[0], 4), r[2], r[3]) for r in rows) == [(100.0004, 40.0, 2), (200.0, 0.5, 1)]
    assert centroid.centroids(np.arange(100.0, 200), np.ones(100), np.ones(100), 1, 1, 10, 0)[1] == "max_peaks"
    assert centroid.centroids(np.arange(100.0, 200), np.ones(100), np.ones(100), 1, 1, 1000, 5)[1] == "early_stop"
    empty = spark.createDataFrame([], "frame_id long, mz double, mobility double, intensity double")
    assert centroid.centroid_frames(empty).count() == 0


def test_digestion(spark):
    p = spark.createDataFrame([("a", "PEPTIKDEPINK"), ("b", ""), ("c", None), ("d", "KPK")], "protein_id string, sequence string")
    got = lambda **kw: sorted(r.peptide for r in peptides.digest(p.filter("protein_id = 'a'"), shortest=3, longest=7, **kw).collect())
    assert got(missed=0) == ["DEPINK", "PEPTIK"]
    assert got(missed=1, c_terminal=False) == ["KDEPIN", "KDEPINK", "PEPTI"]
    assert sorted(r.peptide for r in peptides.digest(p, 0, 1, 20).collect()) == ["DEPINK", "KPK", "PEPTIK"]


def test_variable_mods_and_lookup(spark):
    m = spark.createDataFrame([("MAM",), ("AAA",), ("",), (None,)], "peptide string")
    assert sorted(r.modified for r in peptides.variable_mods(m, "M", "*", 2).collect()) == ["AAA", "M*AM", "M*AM*", "MAM", "MAM*"]
    pr = spark.createDataFrame([(1, "AAPEPTIDEKK"), (2, "PEPTIDERR"), (3, "XPEPTID"), (4, None)], "protein_id long, sequence string")
    q = spark.createDataFrame([("PEPTIDE",), ("ZZZZZ",), ("AB",)], "peptide string")
    assert sorted((r.peptide, r.protein_id) for r in peptides.containing_proteins(q, pr).collect()) == [("PEPTIDE", 1), ("PEPTIDE", 2)]


def test_shared_counts_and_matching(spark):
    assert matching.shared_count(np.array([1, 2, 3, 10]), np.array([2, 2, 11])) == 3
    lib = lambda rows: spark.createDataFrame(rows, "id long, mz double, charge int, rt_seconds double, fragment_keys array<long>")
    a, b = lib([(1, 500.001, 2, 10.0, [1, 5, 9, 20, 30])]), lib([(7, 500.002, 2, 30.0, [1, 5, 9, 20, 30]), (8, 500.0, 2, 11.0, [2, 6, 9, 20, 31]), (9, 500.0, 3, 10.0, [1, 5, 9, 20, 30])])
    assert [tuple(r) for r in matching.match_libraries(a, b).collect()] == [(1, 8, 5, 1.0)]


def test_model_columns(spark):
    df = spark.createDataFrame([(10.0, 2.0, 3.0, 0.5, 11.0, 9.0, 0.9), (10.0, 0.0, 3.0, 0.5, 11.0, 9.0, 0.9)], "main_score double, delta_next double, base_score double, fragment_coverage double, obs_rt_seconds double, rt_calibrated double, obs_mobility double")
    r = features.neutralised(features.derived(df), ["obs_mobility", "none"]).collect()
    assert (r[0].main_over_delta_next, r[0].main_times_delta_next, r[0].split_x_coverage, r[0].rt_error, r[0].obs_mobility) == (5.0, 20.0, 1.5, 2.0, None) and r[1].main_over_delta_next is None
    a = lambda *v: F.array(*[F.lit(x).cast("double") for x in v])
    got = spark.range(1).select(features.mean_abs(a(1.0, -3.0, 0.0, float("nan"))), features.mean_abs(a(0.0)), features.mz_bin(F.lit(501.2)), features.transforms(F.lit(-2.0), "ln1p"), features.transforms(F.lit(1.6), "round")).first()
    assert tuple(got) == (2.0, None, 500.0, 0.0, 2.0)
    with pytest.raises(ValueError):
        features.transforms(F.lit(1), "x")


def test_registered_aggregation(spark):
    from ionloom.operators import extract

    @extract.aggregator("highest")
    def highest(ions, matches):
        return matches.groupBy("query_id").agg(F.max("intensity").alias("top"))

    m = spark.createDataFrame([(1, 5), (1, 9)], "query_id long, intensity long")
    assert extract.aggregate("highest", m, m).first().top == 9
