import os
import random

import pytest
from pyspark.sql import functions as F

import ionloom.runtime as rt
from ionloom.functions import arrays
from ionloom.functions.chemistry import neutron_offset, peptide_mass
from ionloom.operators import extract, fdr, matching
from ionloom.operators.interval import nearest, overlap_join, snap


class Fake:
    """A session without the setting, on a cluster."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master = "spark://host:7077"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        rt.shared_dir(Fake)


def test_stored_tables_are_measured_and_released(spark):
    df = spark.range(1000).select("id", F.lit("abc").alias("t"), F.array(F.lit(1), F.lit(2)).alias("a"), (F.col("id") % 3).alias("k"))
    s = rt.stored(df, most=F.max("id"))
    assert s._il_rows == 1000 and s._il_bytes == rt.measured(df) == 1000 * (16 * 4 + 6 + 16) and s._il_seen == {"most": 999}
    assert rt.stored(df, ("k",)).filter("k = 1").count() == 333
    path = s._il_path.removeprefix("file:")
    assert os.path.exists(path)
    rt.release(spark, s)
    assert not os.path.exists(path) and s._il_path not in rt._scratch
    empty = rt.stored(df.limit(0))
    assert (empty._il_rows, empty._il_bytes, empty.count()) == (0, 0, 0)


def test_a_small_side_is_worked_out_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    small = spark.range(50).repartition(1).mapInArrow(seen, "id long").withColumn("v", F.col("id") * 2)
    assert rt.sized_join(spark.range(200), small, ["id"], "inner").count() == 50
    assert runs.value == 50


def test_hot_keys_are_counted_in_one_pass_and_split(spark, monkeypatch):
    monkeypatch.setattr(rt, "HOT_ROWS", 50)
    big = spark.range(3000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") + 10_000).alias("k"), "id")
    assert [r[0] for r in rt.hot_keys(big, ["k"], 50).collect()] == [7]
    small = spark.createDataFrame([(7, "x"), (10_009, "y"), (7, "z")], "k long, v string")
    for limit in (0, None):
        got = sorted((r.id, r.v) for r in rt.sized_join(big, small, ["k"], "inner", limit=limit).collect())
        assert got == sorted([(i, v) for i in range(0, 3000, 2) for v in "xz"] + [(9, "y")])


def test_overlap_join_against_nested_loop(spark, monkeypatch):
    rng = random.Random(4)
    make = lambda n: [(i, rng.choice("ab"), a, a + rng.choice([0.0, 1.0, 40.0, 300.0])) for i, a in ((i, float(rng.randint(0, 400))) for i in range(n))]
    a, b = make(120), make(80)
    # Half of one side is the same range.
    b += [(1000 + i, "a", 5.0, 9.0) for i in range(80)]
    da, db = spark.createDataFrame(a, "i long, k string, a0 double, a1 double"), spark.createDataFrame(b, "j long, k string, b0 double, b1 double")
    want = sorted((i, j) for i, k, x0, x1 in a for j, kk, y0, y1 in b if k == kk and x0 <= y1 and y0 <= x1)
    assert sorted((r.i, r.j) for r in overlap_join(da, db, ("a0", "a1"), ("b0", "b1"), ("k",)).collect()) == want
    monkeypatch.setattr(rt, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(rt, "HOT_ROWS", 10)
    assert sorted((r.i, r.j) for r in overlap_join(da, db, ("a0", "a1"), ("b0", "b1"), ("k",)).collect()) == want
    assert overlap_join(da.limit(0), db, ("a0", "a1"), ("b0", "b1"), ("k",)).count() == 0


def test_long_axes_are_no_single_task(spark):
    axis = spark.range(0, 20_000, 2).select(F.col("id").cast("int").alias("p"))
    v = spark.createDataFrame([(1, 7.2), (2, -5.0), (3, 30_000.0)], "i int, x double")
    assert sorted((r.i, r.p) for r in nearest(v, axis, "x", "p").collect()) == [(1, 8), (2, 0), (3, 19_998)]
    got = {r.p: r.x for r in snap(v.select("i", "x"), axis, "x", "x", "p").filter("x <> 0").collect()}
    assert got == {0: -5.0, 8: 7.2}
    assert "SinglePartition" not in nearest(v, axis, "x", "p")._jdf.queryExecution().executedPlan().toString()


def test_scores_and_sequences_that_half_of_the_rows_share(spark, monkeypatch):
    monkeypatch.setattr(rt, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(rt, "HOT_ROWS", 50)
    rows = [(i, 0.0 if i % 2 else float(i), i % 4 != 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, score double, is_target boolean")
    got = {r.id: r.q_value for r in fdr.q_values(df).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    t = d = 0
    raw = []
    for _, _, target in order:
        t, d = t + target, d + (not target)
        raw.append((d + 1) / t if t else float("inf"))
    for k in range(len(raw) - 2, -1, -1):
        raw[k] = min(raw[k], raw[k + 1])
    first = {}
    for (i, s, _), q in zip(order, raw):
        first.setdefault(s, min(1.0, q))
    assert got == {i: pytest.approx(first[s]) for i, s, _ in rows}
    seq = [("A" if i % 2 else f"S{i}", 2 + i % 3 // 2, 500.0 + i % 5, float(i % 7), i % 3 == 0, i) for i in range(300)]
    ds = spark.createDataFrame(seq, "sequence string, charge int, mz double, score double, is_target boolean, id long")
    kept, last = [], None
    for r in sorted(seq, key=lambda r: (r[0], -r[3], not r[4], r[2], r[1])):
        if last is None or r[:3] != last[:3]:
            kept.append(r[:5])
        last = r
    assert sorted(tuple(r)[:5] for r in fdr.consecutive_dedup(ds).collect()) == sorted(kept)
    lib = lambda n, k: spark.createDataFrame([(i, 500.0, 2, 1.0 * i, [1, 2, 3, 4 + i]) for i in range(n)], "id long, mz double, charge int, rt_seconds double, fragment_keys array<long>")
    m = matching.match_libraries(lib(60, 0), lib(3, 1), 3)
    assert m.count() == 60


def test_funnel_rows_and_labels(spark):
    df = spark.range(10).select("id", F.when(F.col("id") == 4, None).otherwise(F.col("id")).alias("x"))
    assert [tuple(r) for r in extract.funnel(df, {"a": F.col("id") > 1, "b": F.col("x") < 6}).collect()] == [("a", 8), ("b", 3)]
    one = spark.range(1).select(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))).alias("m"))
    m, at = F.col("m"), F.lit
    got = one.select(arrays.drop_row(m, at(5)), arrays.swap_rows(m, at(0), at(1)), arrays.swap_rows(m, at(0), at(2)), arrays.replace_row(m, at(1), F.array(at(9), at(9))), arrays.put_value(m, at(0), at(1), at(7))).first()
    assert list(got) == [[[1, 2], [3, 4]], [[3, 4], [1, 2]], [[1, 2], [3, 4]], [[1, 2], [9, 9]], [[1, 7], [3, 4]]]
    r = spark.range(1).select(neutron_offset(F.lit(1), F.lit(1)), neutron_offset(F.lit(100), F.lit(100)), peptide_mass(F.lit("K[UNIMOD:737]")), peptide_mass(F.lit("K[+1.5]")), peptide_mass(F.lit("K")), peptide_mass(F.lit("K[UNIMOD:99999]"))).first()
    assert r[0] == 2 and r[1] is None and r[2] - r[4] == pytest.approx(229.162932) and r[3] - r[4] == pytest.approx(1.5) and r[5] is None


def test_skip_reasons_in_their_order(spark):
    one = spark.range(1)
    ask = lambda **kw: one.select(extract.skip_reason(**{k: F.lit(v) for k, v in kw.items()})).first()[0]
    assert ask(n_fragments=0, n_peaks=0) == "no_expected_fragments" and ask(n_fragments=1, in_scan_range=False, n_windows=0) == "fragmented_range"
    assert ask(n_windows=1, n_peaks=1, apex_empty=False, too_short=True) == "apex_insufficient_data" and ask(not_finished=False, broken=True) == "invariant_violation" and ask(n_peaks=3) is None
    assert len(extract.SKIP_REASONS) == 11
