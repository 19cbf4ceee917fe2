import datetime
import json

from ionloom.operators.drift import alias_table, catalogue, changes, fields_of, files_of, landed, lifespans

T = datetime.datetime(2025, 1, 1)
SCHEMA = "export_row_id long, file_id long, export_stream string, exported_at timestamp, received_at timestamp, record_no int, payload string"


def frame(spark, files):
    rows = [(k * 100 + i, fid, s, T + datetime.timedelta(days=day), T, i, p if isinstance(p, str) or p is None else json.dumps(p)) for k, (fid, s, day, recs) in enumerate(files) for i, p in enumerate(recs)]
    return spark.createDataFrame(rows, SCHEMA)


def got(df):
    return sorted(tuple(r) for r in changes(df).select("file_id", "change_kind", "old_name", "new_name").collect())


def test_changes(spark):
    files = [
        (9, "s", 0, [{"id": 1, "a": 1.5, "b": [1, 2.5], "c": "x", "flag": True}, {"id": 2, "a": 2.5, "b": [3], "c": None, "flag": False}]),
        (3, "s", 1, [{"id": 1, "A": "1.5", "b": [{"mz": 1}, {"mz": 2.5}], "flag": 1}, {"id": 5, "A": "7", "b": [{"mz": 1}], "flag": 0}]),
        (5, "s", 2, [{"id": 1, "A": {"value": 1.5, "unit": "Th"}, "p": "1;2.5", "d": 4, "flag": None}]),
        (7, "t", 0, [{"id": 1, "z": 1}]),
    ]
    assert got(frame(spark, files)) == [
        (3, "removed", "c", ""), (3, "renamed", "a", "A"), (3, "retyped", "a", "A"), (3, "retyped", "b", "b"), (3, "retyped", "flag", "flag"),
        (5, "added", "", "d"), (5, "removed", "flag", ""), (5, "renamed", "b", "p"), (5, "retyped", "A", "A"), (5, "retyped", "b", "p"),
    ]


def test_unlike_values_are_no_rename_and_stray_types_no_retype(spark):
    files = [(1, "s", 0, [{"id": i, "a": i} for i in range(5)]), (2, "s", 1, [{"id": i, "b": i + 1} for i in range(5)]), (3, "s", 2, [{"id": 1, "b": 2}, {"id": 2, "b": 3}, {"id": 3, "b": "4"}])]
    assert got(frame(spark, files)) == [(2, "added", "", "b"), (2, "removed", "a", "")]


def test_dirt(spark):
    files = [(1, "s", 0, [None, "", "{bad", "[1]", {"id": None, "a": 1}]), (2, "s", 1, [{"id": 1, "a": []}, {"id": 1, "a": []}]), (None, "s", 2, [{"id": 1}]), (4, None, 0, [{"id": 1, "q": 1}]), (5, None, 1, [{"id": 1, "q": "1"}])]
    assert got(frame(spark, files)) == [(2, "retyped", "a", "a")]
    assert got(frame(spark, []).limit(0)) == []


def test_lifespans_and_landed(spark):
    files = [(i, "s", i, [{"id": 1, "precMz": str(i + 0.5), **({"im": [1.25]} if i != 2 else {})}]) for i in range(4)]
    df = frame(spark, files)
    spans = sorted(tuple(r) for r in lifespans(catalogue(fields_of(df), files_of(df))).select("field", "first_file_no", "last_file_no", "n_files").collect())
    assert spans == [("im", 0, 1, 2), ("im", 3, 3, 1), ("precMz", 0, 3, 4)]
    rows = landed(df).orderBy("file_id").collect()
    assert [r.precursor_mono_mz for r in rows] == [0.5, 1.5, 2.5, 3.5] and [r.mobility_ook0 for r in rows] == [1.25, 1.25, None, 1.25]


def test_alias_table_follows_renames(spark):
    links = spark.createDataFrame([("renamed", "foo", "bar"), ("renamed", "precMz", "foo")], "change_kind string, old_name string, new_name string")
    assert {"foo", "bar"} <= set(alias_table(links)["precursor_mono_mz"][1])


def test_same_on_any_partitioning(spark, sf):
    df = spark.read.parquet(f"{sf}/eg_exports.parquet")
    assert got(df) == got(df.repartition(13))


def test_clashing_columns_and_long_values(spark):
    from pyspark.sql import functions as F

    long = "x" * 300_000
    df = frame(spark, [(1, "s", 0, [{"id": 1, "note": long}]), (2, "s", 1, [{"id": 1, "memo": long, "we ird.name'": 1}])])
    odd = df.withColumns({c: F.lit("clash") for c in ("field", "value", "jtype", "id", "file_no", "seq", "k", "old_name", "q", "key")})
    assert got(odd) == got(df) == [(2, "added", "", "we ird.name'"), (2, "renamed", "note", "memo")]
    assert landed(odd).count() == 2


def test_landed_finds_renames_and_keeps_the_rest(spark, tmp_path):
    from ionloom.queries.prep import QUERIES

    files = [
        (1, "s", 0, [{"id": 1, "rt": 10.5, "note": "x"}, {"id": 2, "rt": 20.5, "note": "y"}]),
        (2, "s", 1, [{"id": 1, "elu'ted": 10.5, "depth": {"a": [1, None]}}, {"id": 2, "elu'ted": "20.5", "note": None}]),
        (3, "s", 2, [{"id": "x9", "rt": 1, "rt_seconds": 2, "z": "two"}, "[1]"]),
    ]
    frame(spark, files).write.parquet(str(tmp_path / "eg_exports.parquet"))
    rows = QUERIES["p4_landed"](spark, str(tmp_path)).orderBy("export_row_id").collect()
    assert [r.rt_seconds for r in rows] == [10.5, 20.5, 10.5, 20.5, 2.0, None]
    assert [r.other for r in rows] == [{"note": '"x"'}, {"note": '"y"'}, {"depth": '{"a":[1,null]}'}, {"note": "null"}, {"id": '"x9"', "rt": "1", "z": '"two"'}, None]
