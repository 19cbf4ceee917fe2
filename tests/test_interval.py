import random

from pyspark.sql import functions as F

from ionloom.operators import extract
from ionloom.operators.interval import nearest, range_join, snap
from ionloom.operators.sequence import neighbours, numbered, running_sums


def test_range_join_against_nested_loop(spark):
    rng = random.Random(1)
    vals = [(i, rng.choice("ab"), rng.choice([None, float("nan"), 0.0, -3.0, *[rng.uniform(1, 1000) for _ in range(12)]])) for i in range(800)]
    rngs = []
    for j in range(200):
        a = rng.uniform(-50, 1000)
        w = rng.choice([0.0, 0.5, 5.0, 300.0, float("inf")])
        rngs.append((j, rng.choice("ab"), rng.choice([a, a, a, None]), a + w))
    rngs += [(900, "a", float("-inf"), float("inf")), (901, "b", 5.0, 1.0), (902, "a", 7.0, 7.0)]
    vals.append((9999, "a", 7.0))
    v, r = spark.createDataFrame(vals, "i long, k string, x double"), spark.createDataFrame(rngs, "j long, k string, lo double, hi double")
    for log in (False, True):
        want = sorted((i, j) for i, k, x in vals for j, kk, lo, hi in rngs if k == kk and x is not None and lo is not None and lo <= x <= hi and (not log or x > 0))
        got = sorted((a.i, a.j) for a in range_join(v, r, "x", "lo", "hi", ("k",), log=log).collect())
        assert got == want
        for width in (0.01, 3.0, 5000.0):
            assert sorted((a.i, a.j) for a in range_join(v, r, "x", "lo", "hi", ("k",), log=log, width=width).collect()) == want
    assert range_join(v.limit(0), r, "x", "lo", "hi", ("k",)).count() == 0 and range_join(v, r.limit(0), "x", "lo", "hi", ("k",)).count() == 0


def test_salted_range_join(spark, monkeypatch):
    import ionloom.runtime as rt

    monkeypatch.setattr(rt, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(rt, "HOT_ROWS", 5)
    v, r = spark.range(1000).select(F.col("id").alias("i"), (F.col("id") % 50).cast("double").alias("x")), spark.range(50).select(F.col("id").alias("j"), (F.col("id") - 0.5).alias("lo"), (F.col("id") + 0.5).alias("hi"))
    assert range_join(v, r, "x", "lo", "hi").count() == 1000


def test_nearest_and_snap(spark):
    axis = spark.createDataFrame([(0,), (10,), (20,), (20,), (None,)], "p int")
    v = spark.createDataFrame([(i, x) for i, x in enumerate([-5.0, 5.0, 5.1, 15.0, 99.0, None])], "i int, x double")
    assert sorted((r.i, r.p) for r in nearest(v, axis, "x", "p").collect()) == [(0, 0), (1, 0), (2, 10), (3, 10), (4, 20)]
    g = spark.createDataFrame([(float(x),) for x in range(5)], "point double")
    s = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (9.0, 4.0)], "at double, value double")
    assert [r.value for r in snap(s, g, "at", "value", "point").orderBy("point").collect()] == [0, 1, 2, 3, 0]


def test_numbers_sums_and_neighbours(spark):
    rows = [(g, i * 7 % 1001) for g, n in (("hot", 1000), ("a", 3), ("b", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, t int").repartition(5)
    seq = numbered(df, ["g"], ["t"])
    got = seq.collect()
    for g in ("hot", "a", "b"):
        mine = sorted((r.t, r.seq) for r in got if r.g == g)
        assert [s for _, s in mine] == list(range(len(mine)))
    nb = {(r.g, r.seq): (r.prev_t, r.next_t) for r in neighbours(seq, ["g"], "seq", ["t"], block=16).collect()}
    ts = {(r.g, r.seq): r.t for r in got}
    assert len(nb) == len(got) and all(v == (ts.get((g, s - 1)), ts.get((g, s + 1))) for (g, s), v in nb.items())
    sums = {r.seq: r.total for r in running_sums(seq.filter("g = 'hot'"), [F.asc("seq")], {"total": F.lit(1)}).collect()}
    assert sums == {i: i + 1 for i in range(1000)}


def test_extraction_small(spark):
    ions = spark.createDataFrame([(1, "a", 0, 3), (1, "b", 0, 3), (2, "a", 5, 5)], "query_id long, ion string, cycle_lo int, cycle_hi int")
    m = spark.createDataFrame([(1, "a", 1, 100.0, 1.0, 2, "w"), (1, "a", 1, 102.0, 1.2, 6, "x"), (1, "a", 3, 101.0, 1.0, 0, "w")], "query_id long, ion string, cycle int, mz double, mobility double, intensity long, window_id string")
    assert {(r.query_id, r.ion): r.intensity for r in extract.spectrum(ions, m).collect()} == {(1, "a"): 8, (1, "b"): 0, (2, "a"): 0}
    st = {(r.query_id, r.ion): r for r in extract.spectrum_stats(ions, m).collect()}
    assert st[1, "a"].mz == 101.5 and abs(st[1, "a"].mobility - 1.15) < 1e-12 and st[1, "b"].mz is None and st[2, "a"].weight == 0
    ch = {(r.query_id, r.ion): r.chromatogram for r in extract.chromatograms(ions, m).collect()}
    assert ch == {(1, "a"): [0, 8, 0, 0], (1, "b"): [0, 0, 0, 0], (2, "a"): [0]}
    assert {(r.query_id, r.n_peaks, r.n_windows) for r in extract.match_counters(ions, m).collect()} == {(1, 3, 2), (2, 0, 0)}


def test_hot_keys_are_split(spark):
    from ionloom.runtime import hot_keys, sized_join

    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(7, "seven"), (11, "eleven"), (11, "again"), (None, "none")], "k long, name string")
    assert {r.k for r in hot_keys(big, ["k"], 100).collect()} == {None, 7}
    plain = sorted(map(repr, big.join(small, "k", "left").collect()))
    assert sorted(map(repr, sized_join(big, small, ["k"], "left", limit=0, least=100).select("k", "v", "name").collect())) == plain
    assert sized_join(big, small, ["k"], "inner", limit=0, least=100).count() == 1003
