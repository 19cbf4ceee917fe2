from pyspark.sql import functions as F

from ionloom.operators.units import DEFAULTS, note_unit, to_milliseconds, unit_of


def times(spark, rows, sources=(), **kw):
    values = spark.createDataFrame([("sample_lib", i, s, f, v, "clash") for i, (s, f, v) in enumerate(rows)], "rec_table string, rec_id long, source_id int, field_name string, value string, unit string")
    src = spark.createDataFrame(list(sources), "source_id int, rt_unit string, note string")
    got = {r.rec_id: r.rt_ms for r in to_milliseconds(values, src, DEFAULTS, **kw).collect()}
    return [got.get(i) for i in range(len(rows))]


def test_written_units(spark):
    v = ["1.5", "1,5 min", "90s", "90 S", "1:30", "0:01:30", "83:11.22", "PT1M30S", "PT1H", "1 min 30 s", "RT 1.5 Min.", "1500 [ms]", "1.5 m", "−1.5 min", "-0:01:30", " 2 ", "1.0000000e+03 ms", "0.5 hr", "RT 2 hours", "nan", "n.d.", "NA", "-", "", None, "Infinity", "2msec", "7 apples", "-1:30"]
    want = [90000, 90000, 90000, 90000, 90000, 90000, 4991220, 90000, 3600000, 90000, 90000, 1500, 90000, -90000, -90000, 120000, 1000, 1800000, 7200000, None, None, None, None, None, None, None, 2, None, -90000]
    assert times(spark, [(None, "irt", x) for x in v]) == want


def test_chain_of_units(spark):
    sources = [(1, "hr", "gradient in seconds"), (2, None, "gradient 90 min; retention column exported in seconds"), (3, "n/a", "checked twice"), (4, "", "one unit equals 0.01 min, do not read as seconds"), (None, "s", None)]
    rows = [(1, "irt", "1"), (1, "irt", "1 s"), (2, "irt", "1"), (3, "irt", "1"), (3, "rt_seconds", "1"), (4, "irt", "1"), (99, "irt", "1"), (None, "rt_seconds", "1.0005")]
    assert times(spark, rows, sources) == [3600000, 1000, 1000, 60000, 1000, 600, 60000, 1001]
    assert times(spark, [], sources) == []


def test_notes(spark):
    notes = {
        "Zeitachse in Sekunden, Gradient 60 min": "s", "overnight runs, elution given in decimal hours": "h", "retention as decimal minutes (clock drift under 300 ms)": "min", "legacy export, retention in hundredths of a minute": "cmin",
        "RT axis holds ms since injection on a 120 min run": "ms", "values are minutes, the 44 s dead time is not subtracted": "min", "h-based axis: a 30 min gradient ends at 0.5": "h", "raw detector ticks, one tick per millisecond": "ms",
        "all elution times count seconds from injection, 2 min dead volume removed": "s", "column oven at 50 C": None, "": None, "checked twice": None, "first export of the pool": None,
    }
    df = spark.createDataFrame(list(notes.items()), "note string, want string")
    assert df.filter(~note_unit(F.col("note")).eqNullSafe(F.col("want"))).collect() == []
    assert [r[0] for r in spark.createDataFrame([("Sec.",), ("MIN",), ("milliseconds",), ("n/a",), (None,)], "u string").select(unit_of(F.col("u"))).collect()] == ["s", "min", "ms", None, None]


def test_mixture_assigns_missing_units(spark):
    known = [(1, "irt", str(10 + i * 0.1)) for i in range(900)]
    missing = [(2, "irt", str((10 + i * 0.3) * 60_000)) for i in range(300)]
    sources = [(1, "min", None), (2, None, None)]
    got = times(spark, known + missing, sources, fallback="posterior")
    assert got[900] == 600000 and got[-1] == round((10 + 299 * 0.3) * 60_000)
    assert times(spark, known + missing, sources)[900] == 600000 * 60000


def test_long_and_repeated_values(spark):
    v = ["1" * 50_000, "1." + "0" * 50_000 + " min", "a" * 50_000, "5 min", "5 min"]
    assert times(spark, [(None, "irt", x) for x in v]) == [None, 60000, None, 300000, 300000]
