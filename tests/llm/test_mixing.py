from collections import defaultdict

from ionloom.llm.mixing import mixture, shares, source_name, token_counts, water_fill


def frames(spark, docs, targets):
    d = spark.createDataFrame([(*x, 5) for x in docs], "doc_id long, text string, source string, n_tokens int")
    return d, spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")


def test_water_fill():
    assert water_fill({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 2}) == {"a": 2.0, "b": 2.0}
    got = water_fill({"a": 10, "b": 100, "c": 100}, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 2, "b": 5, "c": 5}, total=220)
    assert got == {"a": 2.0, "b": 1.0, "c": 1.0}
    assert water_fill({"a": 10}, {"a": 1.0, "z": 1.0}, {"a": 3, "z": 3}, total=1000) == {"a": 3.0, "z": 0.0}
    assert water_fill({}, {"a": 1.0}, {"a": 3}) == {"a": 0.0}


def test_shares_and_caps(spark):
    docs = [(i, "word number %d and more text" % i * (1 + i % 3), "big") for i in range(3000)] + [(10_000 + i, "some text here", ["Small ", "SMALL", "small"][i % 3]) for i in range(300)]
    d, t = frames(spark, docs, [("m", "big", 0.8, 3), ("m", "small", 0.2, 4), ("m", "none", 0.0, 2)])
    sel, plan = mixture(d, t)
    rows = {r.source: r for r in shares(sel, plan).collect()}
    assert abs(rows["big"].reached_share - 0.8) < 0.01 and abs(rows["small"].reached_share - 0.2) < 0.01 and rows["none"].reached_share == 0
    copies = defaultdict(int)
    for r in sel.collect():
        copies[r.doc_id] += r.copies
    assert max(v for k, v in copies.items() if k >= 10_000) <= 4 and max(copies.values()) <= 4
    again = sorted(map(tuple, mixture(d.repartition(5), t)[0].collect()))
    assert again == sorted(map(tuple, sel.collect()))


def test_clamped_total(spark):
    docs = [(i, "text " * 50, "a") for i in range(100)] + [(1000 + i, "text " * 50, "b") for i in range(10)]
    d, t = frames(spark, docs, [("m", "a", 0.5, 2), ("m", "b", 0.5, 3)])
    total = 100 * 50
    rows = {r.source: r for r in shares(*mixture(d, t, total=float(total))).collect()}
    assert rows["b"].most_copies == 3 and rows["b"].n_docs == 10
    assert abs(sum(r.n_tokens for r in rows.values()) - total) < 0.05 * total


def test_dirt(spark):
    docs = [(None, "x", "a"), (1, None, "a"), (2, "", "a"), (3, "word", None), (4, "word", "a"), (4, "word word", "a"), (5, "w" * 300_000, "a")]
    d, t = frames(spark, docs, [("m", "A", 1.0, None), ("m", None, 0.5, 1), ("e", "zzz", 1.0, 2), ("n", "a", None, 2)])
    sel, plan = mixture(d, t)
    assert sorted((r.mix_name, r.doc_id, r.copies) for r in sel.collect()) == [("m", 4, 1), ("m", 5, 1)]
    assert mixture(d.limit(0), t)[0].count() == 0 and mixture(d, t.limit(0))[0].count() == 0


def test_source_names_and_tokens(spark):
    df = spark.createDataFrame([(1, " Wiki-Pages ", "Hello world"), (2, None, None)], "doc_id long, source string, text string")
    assert [r[0] for r in df.select(source_name(df.source)).collect()] == ["wiki_pages", None]
    assert [r.n_tokens for r in token_counts(df, "doc_id", "text", []).orderBy("doc_id").collect()] == [2, 0]


def test_a_tiny_source_bounds_or_is_clamped(spark):
    docs = [(i, "text " * 50, "big") for i in range(400)] + [(1000 + i, "text " * 50, "mid") for i in range(100)] + [(2000, "text " * 50, "tiny")]
    d, t = frames(spark, docs, [("m", "big", 0.5, 2), ("m", "mid", 0.3, 4), ("m", "tiny", 0.2, 3)])
    rows = {r.source: r for r in shares(*mixture(d, t)).collect()}
    assert [s for s, r in rows.items() if r.bounds_mix] == ["tiny"] and not any(r.clamped for r in rows.values())
    assert abs(rows["big"].reached_share - 0.5) < 0.05 and rows["big"].unused_share > 0.98
    rows = {r.source: r for r in shares(*mixture(d, t, total="once")).collect()}
    assert [s for s, r in rows.items() if r.clamped] == ["tiny"] and rows["tiny"].most_copies == 3 and not any(r.bounds_mix for r in rows.values())
    one = rows["tiny"].source_tokens
    assert abs(sum(r.n_tokens for r in rows.values()) - 501 * one) < 12 * one
    assert abs(rows["big"].n_tokens / rows["mid"].n_tokens - 5 / 3) < 0.1
