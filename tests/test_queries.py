import random

import pytest

import ionloom.runtime as rt
from ionloom.operators import peptides
from ionloom.queries import interval, peptide, plans, readers, stats


def test_library_stats_count_large_groups(spark, tmp_path):
    rows = [(1, 100.0 + k) for k in range(101)] + [(2, 5.0), (2, 5.0), (2, None), (3, 7.0)]
    spark.createDataFrame(rows, "eg_id long, fragment_mz double").write.parquet(str(tmp_path / "fragment_ions.parquet"))
    assert [tuple(r) for r in peptide.a17_library_stats(spark, str(tmp_path)).collect()] == [(3, 103, 34.333333)]


def test_elution_group_json_keeps_large_groups(spark, tmp_path):
    ions = [(1, 100.0 + k) for k in range(1001)] + [(2, 5.0), (2, None)]
    spark.createDataFrame(ions, "eg_id long, fragment_mz double").write.parquet(str(tmp_path / "fragment_ions.parquet"))
    spark.createDataFrame([(1, 500.5, 2), (2, 600.5, 3)], "eg_id long, precursor_mono_mz double, precursor_charge int").write.parquet(str(tmp_path / "elution_groups.parquet"))
    assert sorted(tuple(r) for r in readers.s16_elution_group_json(spark, str(tmp_path)).collect()) == [(1, 2, 1001), (2, 3, 1)]


def test_texts_are_digested_with_missed_cuts_at_any_length(spark, tmp_path):
    docs = [(1, "AAGGLK SAMPLEVEYR"), (2, "xx aagglk samplevey" + "t" * 13 + "k")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.peptide: r.n_proteins for r in peptide.j11_containing_proteins(spark, str(tmp_path)).collect()}
    assert got == {"AAGGLK": 2, "SAMPLEVEYR": 1, "AAGGLKSAMPLEVEYR": 1, "XXAAGGLK": 1, "SAMPLEVEY" + "T" * 13 + "K": 1}
    lib = plans.s23_built_library(spark, str(tmp_path)).filter("not decoy").collect()
    assert {("AAGGLKSAMPLEVEYR", 3), ("AAGGLKSAM[UNIMOD:35]PLEVEYR", 2)} <= {(r.sequence, r.charge) for r in lib}


def test_nearest_point_of_all_rows(spark, tmp_path):
    spark.createDataFrame([(50, "1995-01-02"), (51, "1995-01-12")], "l_orderkey long, l_shipdate string").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "1995-01-03"), (2, "1995-01-11")], "o_orderkey long, o_orderdate string").write.parquet(str(tmp_path / "orders.parquet"))
    assert sorted(tuple(r) for r in interval.j06_nearest_cycle(spark, str(tmp_path)).collect()) == [(1, 0), (2, 10)]


def test_library_match_keeps_entries_without_source(spark, tmp_path):
    ions = [(g, 100.0 + k, 1.0) for g in (1, 2) for k in range(2001)]
    spark.createDataFrame(ions, "eg_id long, fragment_mz double, fragment_intensity double").write.parquet(str(tmp_path / "fragment_ions.parquet"))
    spark.createDataFrame([(1, 500.0, 2, 1.0, 4), (2, 500.0, 2, 1.0, None)], "eg_id long, precursor_mono_mz double, precursor_charge int, rt_seconds double, source_id long").write.parquet(str(tmp_path / "elution_groups.parquet"))
    assert peptide.j09_library_match(spark, str(tmp_path)).count() == 1


@pytest.mark.parametrize("name", ["h16_filter_funnel", "a14_ms1_errors", "j11_containing_proteins", "a08_match_counters", "a03_spectrum", "j01_range_join", "out04_transpose", "f19_skip_reasons"])
def test_sides_beyond_the_limit_are_never_broadcast(spark, sf, monkeypatch, name):
    """Spark's estimate of a side is that of the small file it is made of."""
    monkeypatch.setattr(rt, "BROADCAST_BYTES", 0)
    plan = (interval.QUERIES | stats.QUERIES | peptide.QUERIES)[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("name", ["a14_ms1_errors", "j01_range_join", "out04_transpose", "a03_spectrum", "a08_match_counters", "f19_skip_reasons"])
def test_shuffled_ions_give_what_sql_gives(spark, duck, sf, monkeypatch, name):
    """Else SQL is compared only where the ions are few enough to be broadcast."""
    monkeypatch.setattr(rt, "BROADCAST_BYTES", 0)
    got = (interval.QUERIES | stats.QUERIES)[name](spark, sf)
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()
    rows, want = sorted(map(tuple, got.collect())), sorted(duck.execute((interval.ORACLE | stats.ORACLE)[name]).fetchall())
    assert rows and rows == [pytest.approx(r) for r in want]


def test_peptides_are_found_over_spans_and_passes(spark, monkeypatch):
    monkeypatch.setattr(peptides, "BLOCK", 7)
    monkeypatch.setattr(peptides, "SPAN", 5)
    monkeypatch.setattr(peptides, "LETTERS", 20)
    rng = random.Random(3)
    proteins = [(i, "".join(rng.choices("AKé", k=rng.choice([0, 1, 5, 12, 40])))) for i in range(30)]
    wanted = sorted({"".join(rng.choices("AKé", k=rng.choice([2, 3, 4, 6, 9]))) for _ in range(80)})
    got = peptides.containing_proteins(spark.createDataFrame([(x,) for x in wanted], "peptide string"), spark.createDataFrame(proteins, "protein_id long, sequence string"), 3)
    assert sorted(map(tuple, got.collect())) == sorted((w, i) for w in wanted if len(w) >= 3 for i, s in proteins if w in s)
