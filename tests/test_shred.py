import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ionloom.operators.shred import KEYS, _batch, all_fragments, shred, shred_payload, subtype_tables

EG = {"id": 1, "precursor_mz": 500.5, "fragment_mzs": [1.0, 2.0], "fragment_intensities": [0.5, 0.6], "fragment_labels": ["y1", "y2"]}


def frags(spark, payloads):
    df = spark.createDataFrame([(i, p, "x", 3) for i, p in enumerate(payloads)], "record_id long, payload string, kind string, element_pos int")
    return [tuple(r) for r in shred(df, ("fragment",)).select(*KEYS, "fragment_label").orderBy(*KEYS).collect()]


def test_shapes(spark):
    el = {"precursor": {"sequence": "A"}, "elution_group": EG}
    objects = EG | {"fragment_labels": [{"series": "b", "ordinal": 3}, {"series": "y", "ordinal": 4, "isotope": 1, "charge": 2}]}
    deep = EG | {"fragment_labels": [{"series": "a", "ordinal": 1, "isotope": 2, "charge": 1}, "b2"]}
    listed = {"id": 2, "fragments": [{"mz": 1.0, "label": "y3", "intensity": 1}, {"mz": 2.0, "label": {"series": "y", "ordinal": 9}, "intensity": 1}]}
    bare = {k: v for k, v in EG.items() if k != "fragment_labels"}
    got = frags(spark, [
        json.dumps(el),
        json.dumps([el, {"precursor": {}, "elution_group": [objects, deep]}]),
        json.dumps({"elements": [{"precursor": {}, "elution_group": json.dumps(listed)}, {"precursor": {}, "elution_group": bare}]}),
    ])
    assert got == [
        (0, 0, 0, 0, "y1"), (0, 0, 0, 1, "y2"),
        (1, 0, 0, 0, "y1"), (1, 0, 0, 1, "y2"), (1, 1, 0, 0, "b3"), (1, 1, 0, 1, "y4+i^2"), (1, 1, 1, 0, "a1+2i"), (1, 1, 1, 1, "b2"),
        (2, 0, 0, 0, "y3"), (2, 0, 0, 1, "y9"), (2, 1, 0, 0, "0"), (2, 1, 0, 1, "1"),
    ]


def test_dirt(spark):
    uneven = {"elution_group": EG | {"fragment_mzs": [1.0]}, "precursor": None}
    empty = {"elution_group": EG | {"fragment_mzs": [], "fragment_intensities": [], "fragment_labels": []}}
    nolabel = {"elution_group": EG | {"fragment_labels": None}}
    members = {"elements": [None, 5, {"elution_group": [None, EG]}]}
    text = json.dumps({"elution_group": EG})
    got = frags(spark, [None, "", "{", text[:-3], "[]", '{"a":NaN}', "null", json.dumps(uneven), json.dumps(empty), json.dumps(nolabel), json.dumps(members), json.dumps(text), "[" * 100_000])
    assert got == [(9, 0, 0, 0, "0"), (9, 0, 0, 1, "1"), (10, 2, 1, 0, "y1"), (10, 2, 1, 1, "y2"), (11, 0, 0, 0, "y1"), (11, 0, 0, 1, "y2")]


def test_subtypes_hold_all_fragments(spark, sf):
    records = spark.read.parquet(f"{sf}/speclib_elements.parquet")
    tables = subtype_tables(records)
    every = all_fragments(tables)
    want = sorted(tuple(r) for r in shred(records, ("fragment",)).select(*KEYS, "fragment_label", "fragment_mz").collect())
    assert sorted(tuple(r) for r in every.select(*KEYS, "fragment_label", "fragment_mz").collect()) == want
    assert sum(t.count() for k, t in tables.items() if k.startswith("fragments_")) == len(want) > 0
    orphans = every.join(tables["groups"], KEYS[:3], "left_anti").count() + tables["groups"].join(tables["elements"], KEYS[:2], "left_anti").count()
    assert orphans == 0
    assert tables["rejects"].join(tables["elements"], "record_id").count() == 0


def test_each_table_reads_its_own_files_and_columns(spark, sf):
    t = subtype_tables(spark.read.parquet(f"{sf}/speclib_elements.parquet"))["fragments_parallel_object"]
    files = [r[0] for r in t.select(F.input_file_name()).distinct().collect()]
    assert files and all("kind=fragment/shape=group_parallel_object" in f for f in files)
    assert "sequence" not in t._jdf.queryExecution().executedPlan().toString()


def test_empty_table_has_empty_tables(spark, sf):
    tables = subtype_tables(spark.read.parquet(f"{sf}/speclib_elements.parquet").limit(0))
    assert all(t.count() == 0 for t in tables.values()) and all_fragments(tables).count() == 0


def test_long_and_empty(spark):
    n = 50_000
    big = {"elution_group": {"id": 1, "fragment_mzs": [1.0] * n, "fragment_intensities": [1.0] * n}}
    df = spark.createDataFrame([(1, json.dumps(big))], "record_id long, payload string")
    assert shred(df, ("fragment",)).count() == n
    assert shred(df.limit(0)).count() == 0


leaf = st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=6) | st.sampled_from(["y4", "[1]", '{"series": "y", "ordinal": 1}', "\ud800"])
names = st.sampled_from(["elements", "elution_group", "precursor", "fragment_mzs", "fragment_mz", "fragment_labels", "fragment_intensities", "fragments", "series", "ordinal", "isotope", "charge", "mz", "label", "intensity", "id", "sequence", "decoy_group", "precursor_charge", "x"])
trees = st.recursive(leaf, lambda t: st.lists(t, max_size=4) | st.dictionaries(names, t, max_size=5), max_leaves=25)


@settings(max_examples=400, deadline=None)
@given(trees)
def test_any_json_is_read_or_rejected(tree):
    rows = list(shred_payload(1, json.dumps({"precursor": {}, "elution_group": tree}), frozenset({"element", "group", "fragment", "reject"})))
    rows += list(shred_payload(1, json.dumps(tree), frozenset({"element", "group", "fragment", "reject"})))
    assert rows and _batch(rows).num_rows == len(rows)


def test_odd_labels_and_huge_numbers(spark):
    labels = [{"series": "y", "ordinal": 1, "charge": "2", "isotope": None}, {"series": None, "ordinal": 3}, 7, "\ud83d"]
    eg = {"id": 10**30, "precursor_charge": 2**40, "fragment_mzs": [1, 2, 3, 4], "fragment_intensities": [1, "x", None, 1e308], "fragment_labels": labels}
    assert [r[4] for r in frags(spark, [json.dumps({"precursor": None, "elution_group": eg})])] == ["y1^2", "3", "7", "\ufffd"]
