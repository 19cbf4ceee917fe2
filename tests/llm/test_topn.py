import math
import random

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ionloom.llm.topn import LoserTree, merge_runs, top_items

SCHEMA = "ion_row_id long, eg_id long, run_id string, fragment_label string, fragment_mz double, fragment_intensity float, loaded_at timestamp, grp int, rank string, seq int"


def brute(rows, n=8):
    latest = {}
    for r in rows:
        if r[1] is None or r[0] is None:
            continue
        k = (r[1], r[2], r[3], "nan" if r[4] is not None and math.isnan(r[4]) else r[4])
        v = (r[6] is not None, r[6] or 0, r[0])
        if k not in latest or v > latest[k][0]:
            latest[k] = (v, r)
    groups = {}
    for _, r in latest.values():
        if r[5] is not None and math.isfinite(r[5]) and r[5] > 0:
            groups.setdefault(r[1], []).append(r)
    mz = lambda x: (2, 0) if x is None else (1, 0) if math.isnan(x) else (0, x)
    out = set()
    for g, rs in groups.items():
        rs.sort(key=lambda r: (-r[5], mz(r[4]), r[3] is None, r[3] or "", r[0]))
        out |= {(g, r[0]) for r in rs[:n]}
    return out


def test_against_brute_force(spark):
    import datetime

    rng = random.Random(5)
    rows = []
    for i in range(6000):
        g = 1 if rng.random() < 0.4 else rng.choice([None, *range(2, 200)])
        t = rng.choice([None, datetime.datetime(2025, 1, rng.randint(1, 3))])
        rows.append((i, g, rng.choice(["a", "b", None]), rng.choice(["y1", "b2", "é", None, "Z"]), rng.choice([1.5, 2.5, -0.5, None, float("nan"), 7.0]), rng.choice([0.5, 0.5, 1.0, 2.0, 0.0, -1.0, None, float("nan"), float("inf")]), t, 0, "x", 1))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for n in (1, 8, 50):
        got = [(r.grp, r.rid) for r in top_items(df, n).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, n)
    assert top_items(df.limit(0)).count() == 0
    # Many runs in each task and many blocks in each bucket.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        assert {(r.grp, r.rid) for r in top_items(df, 8, run_rows=100, block_rows=50).collect()} == brute(rows, 8)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 4)), max_size=12), max_size=6), st.integers(1, 4))
def test_merge_of_runs(runs, n):
    rows = [(g, 100 * k + i, float(s), 1.0, "a", k) for k, run in enumerate(runs) for i, (g, s) in enumerate(sorted(run, key=lambda x: (x[0], -x[1])))]
    t = pa.table({c: pa.array([r[i] for r in rows], ty) for i, (c, ty) in enumerate([("grp", pa.int64()), ("rid", pa.int64()), ("score", pa.float64()), ("tie_num", pa.float64()), ("k2", pa.string()), ("run", pa.int32())])})
    got, ranks = merge_runs(t, n)
    want = []
    for g in sorted({r[0] for r in rows}):
        want += sorted((i for i, r in enumerate(rows) if r[0] == g), key=lambda i: (-rows[i][2], rows[i][1]))[:n]
    assert got == want and (not ranks or max(ranks) < n)


def test_loser_tree_sorts():
    keys = [(x,) for x in (5, 3, 9, 1, 7)]
    t = LoserTree(list(keys))
    out = []
    while t.key[t.winner] != (math.inf,):
        out.append(t.key[t.winner])
        t.key[t.winner] = (math.inf,)
        t.replay(t.winner)
    assert out == sorted(keys)


def test_score_ties_by_row_id_and_equal_rows(spark):
    rows = [(i, 1, f"r{i}", "y1", 1.0, 0.5, None, 0, "", 0) for i in range(20)] + [(99, 1, "r0", "y1", 1.0, 0.5, None, 0, "", 0)]
    assert sorted(r.rid for r in top_items(spark.createDataFrame(rows, SCHEMA)).collect()) == list(range(1, 9))
