import base64
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.sources import native, peaks, registry, simulator, sinks, speclib_binary, text_libraries


def write(p, text):
    p.write_text(text)
    return str(p)


DIANN = ["ModifiedPeptide", "StrippedPeptide", "PrecursorMz", "PrecursorCharge", "Tr_recalibrated", "IonMobility", "ProteinID", "Decoy", "FragmentMz", "RelativeIntensity", "FragmentType", "FragmentNumber", "FragmentCharge", "FragmentLossType"]


def diann_line(seq, mz, series, n, loss="noloss", decoy=0):
    return "\t".join(map(str, [f"_{seq}_", seq, mz, 2, 3.5, 0.78, "sp|Q1|X_Y", decoy, 100 + n, 0.5, series, n, 1, loss]))


def test_diann_groups_neighbours(spark, tmp_path):
    lines = ["\t".join(DIANN), diann_line("PEPK", 400.0, "y", 3), diann_line("PEPK", 400.0, "b", 2, "H2O"), diann_line("AAAK", 300.0, "y", 1), diann_line("PEPK", 400.0, "y", 2)]
    df = registry.read_library(spark, write(tmp_path / "lib.tsv", "\n".join(lines))).orderBy("group_id").collect()
    assert [(r.group_id, r.stripped, [f.label for f in r.fragments]) for r in df] == [(0, "PEPK", ["y3", "?1"]), (1, "AAAK", ["y1"]), (2, "PEPK", ["y2"])]
    assert df[0].rt_seconds == 210.0 and df[0].charge == 2
    bad = write(tmp_path / "bad.tsv", "\n".join([lines[0], diann_line("PEPK", 400.0, "y", 3, decoy=7)]))
    with pytest.raises(Exception, match="decoy flag"):
        text_libraries.read_diann(spark, bad).collect()


def test_diann_parquet(spark, tmp_path):
    names = [v[0] for v in text_libraries.DIANN_PARQUET.values()]
    spark.createDataFrame([("_A_", "A", 400.0, 2, 1.0, 0.9, "P", 0, 100.0, "y", 1, 1, "noloss", 0.5)] * 2, names).coalesce(1).write.parquet(str(tmp_path / "x.parquet"))
    r = registry.read_library(spark, str(tmp_path / "x.parquet")).collect()
    assert len(r) == 1 and len(r[0].fragments) == 2 and r[0].rt_seconds == 60.0


def test_spectronaut_and_skyline(spark, tmp_path):
    cols = [v[0] for v in text_libraries.SPECTRONAUT.values()]
    row = lambda seq, ex, n: "\t".join([f"_{seq}_", seq, "400.0", "2", "1.5", "0.9", "P1", str(200 + n), "y", str(n), "1", "noloss", "0.4", ex])
    sp = registry.read_library(spark, write(tmp_path / "s.tsv", "\n".join(["\t".join(cols), row("AK", "False", 1), row("AK", "True", 2), row("CK", "True", 1)]))).collect()
    assert [(r.stripped, [f.label for f in r.fragments], r.decoy, r.rt_seconds) for r in sp] == [("AK", ["y1"], 0, 90.0)]
    head = "Protein Name,Peptide Modified Sequence,Precursor Mz,Precursor Charge,Product Mz,Product Charge,Fragment Ion Type,Fragment Ion Ordinal,Transition Is Decoy,Library Intensity"
    sk = registry.read_library(spark, write(tmp_path / "k.csv", "\n".join([head, "P,AC[+57.02]K,400,2,400,2,precursor,0,False,#N/A", "P,AC[+57.02]K,400,2,300,1,y,2,False,#N/A", "P,AC[+57.02]K,400,2,310,1,b,2,False,0.25"]))).collect()
    assert sk[0].stripped == "ACK" and [(f.label, f.intensity) for f in sk[0].fragments] == [("y2", 1.0), ("b2", 0.25)]


def test_binary_round_trip(spark, tmp_path):
    frags = [(300.5, 0.5, 1, 2, 3, 0), (300.6, 0.9, 1, 2, 3, 0), (200.0, 0.4, 2, 1, 2, 0), (150.0, 0.3, 1, 1, 4, 1), (10.0, 0.1, 1, 9, 1, 0)]
    for version in (0, -1, -2, -3):
        data = speclib_binary.encode([("PEPTIDEK2", 0, 2, 8, 450.25, 33.5, 0.75, frags, True), ("AK1", 1, 1, 2, 218.1, -4.0, 0.0, [], False)], ["sp|A", "sp|B"], version)
        (tmp_path / f"v{-version}.speclib").write_bytes(data)
        r = registry.read_library(spark, str(tmp_path / f"v{-version}.speclib")).orderBy("group_id").collect()
        assert [(f.label, round(f.mz, 3)) for f in r[0].fragments] == [("y5", 300.6), ("b2^2", 200.0)]
        assert (r[0].modified, r[0].protein, r[0].charge, r[0].rt_seconds, len(r)) == ("PEPTIDEK2", "sp|A", 2, 33.5, 2)
        assert r[0].mobility == (0.75 if version <= -2 else 0.0)
    for broken in (data[:-4], data + b"\0\0\0\0", struct.pack("<i", -4) + data):
        with pytest.raises(ValueError):
            list(speclib_binary.decode(broken))


def test_native_forms(spark, tmp_path):
    el = {"precursor": {"sequence": "PEPK", "charge": 2, "decoy": False, "decoy_group": 3}, "elution_group": {"id": 3, "precursor_mz": 400.5, "fragment_mzs": [1.5, 2.5], "fragment_labels": ["y1", "y2"], "fragment_intensities": [0.5, 0.25], "rt_seconds": 9.5}}
    (tmp_path / "a.ndjson").write_text(json.dumps(el) + "\n\n" + json.dumps(el) + "\n")
    (tmp_path / "b.msgpack.zst").write_bytes(native.pack_elements([el, el]))
    (tmp_path / "c.msgpack").write_bytes(native.pack_elements([el, el], False))
    for name in ("a.ndjson", "b.msgpack.zst", "c.msgpack"):
        rows = native.check_native(registry.read_library(spark, str(tmp_path / name)))
        assert rows.filter("kind = 'fragment'").count() == 4 and rows.filter("kind = 'group'").first().precursor_mz == 400.5
    el["elution_group"]["fragment_mzs"] = [1.5]
    (tmp_path / "d.ndjson").write_text(json.dumps(el))
    with pytest.raises(Exception):
        native.check_native(native.read_native(spark, str(tmp_path / "d.ndjson"))).collect()


def test_elution_groups_and_templates(spark, tmp_path):
    assert "elution_groups.json" in text_libraries.write_elution_group_templates(str(tmp_path / "t"))
    r = registry.read_library(spark, str(tmp_path / "t" / "elution_groups.json")).orderBy("id").collect()
    assert len(r) == 2 and r[0].isotopes == [0] and [f.label for f in r[0].fragments] == ["y3", "y4"]
    g = registry.read_library(spark, write(tmp_path / "g.json", json.dumps([{"id": 5, "precursor": 300.0, "precursor_charge": 1, "fragments": [1.0, 2.0]}]))).first()
    assert g.precursor_mz == 300.0 and [f.label for f in g.fragments] == ["0", "1"]


def test_fasta_and_peptides(spark, tmp_path):
    f = native.read_fasta(spark, write(tmp_path / "p.fasta", ">sp|A one\nPEP\n\nTIDE\r\n>B two words\nAAK\n>C\n")).orderBy("protein_id").collect()
    assert [(r.protein_id, r.description, r.sequence) for r in f] == [("B", "B two words", "AAK"), ("C", "C", ""), ("sp|A", "sp|A one", "PEPTIDE")]
    assert [r.peptide for r in native.read_peptide_list(spark, write(tmp_path / "l.txt", " PEPK \n#no\n\nAAK\n")).collect()] == ["PEPK", "AAK"]


def spectrum(level, rt, mz, inten, extra=""):
    enc = lambda v: base64.b64encode(np.array(v, "<f8").tobytes()).decode()
    arr = lambda acc, v: f'<binaryDataArray><cvParam accession="{acc}"/><cvParam accession="MS:1000523"/><binary>{enc(v)}</binary></binaryDataArray>'
    return f'<spectrum><cvParam accession="MS:1000511" value="{level}"/><cvParam accession="MS:1000127"/><scan><cvParam accession="MS:1000016" value="{rt}" unitName="second"/></scan>{extra}<binaryDataArrayList>{arr("MS:1000514", mz)}{arr("MS:1000515", inten)}</binaryDataArrayList></spectrum>'


def test_mzml(spark, tmp_path):
    iso = '<isolationWindow><cvParam accession="MS:1000827" value="500"/><cvParam accession="MS:1000828" value="10"/><cvParam accession="MS:1000829" value="12"/></isolationWindow>'
    body = spectrum(2, 0.5, [1.0], [1.0], iso) + spectrum(1, 1.0, [100.0, float("nan"), 101.0], [5.0, 1.0, -2.0]) + spectrum(2, 1.5, [200.0], [7.0], iso) + spectrum(1, 2.0, [100.0], [6.0])
    (tmp_path / "r.mzML").write_text(f"<mzML><run>{body}</run></mzML>")
    r = registry.open_run(spark, str(tmp_path / "r.mzML")).orderBy("cycle_index", "ms_level", "mz").collect()
    assert [(x.run_id, x.ms_level, x.cycle_index, x.mz, x.intensity) for x in r] == [("r", 1, 0, 100.0, 5.0), ("r", 1, 0, 101.0, 0.0), ("r", 2, 0, 200.0, 7.0), ("r", 1, 1, 100.0, 6.0)]
    assert (r[2].mz_lo, r[2].mz_hi, r[2].window_id) == (490.0, 512.0, 0)
    from ionloom.api import GROUP, Run
    from ionloom.functions.ranges import Tolerance

    run = Run.open(spark, registry.index_run(spark, str(tmp_path / "r.mzML")))
    g = spark.createDataFrame([(1, 500.0, 1, 0.9, 1.5, [0], [("y1", 200.0)])], GROUP)
    assert not run.has_mobility and {x.ion: x.intensity for x in run.query_spectrum(g, Tolerance()).collect()} == {"p0": 0.0, "y1": 7.0}
    for bad in (body + spectrum(1, 0.1, [1.0], [1.0]), spectrum(1, 1, [1.0], [1.0]).replace("MS:1000127", "MS:1000128")):
        with pytest.raises(ValueError):
            list(peaks.parse_mzml("x", f"<m>{bad}</m>".encode()))
    assert peaks.window_bounds(None, 400.0, 500.0, True) == (400.0, 500.0) and peaks.window_bounds(1.0, float("nan"), 1.0) is None


def test_windows_and_mobility_kind(spark):
    w = spark.createDataFrame([("r", 0, 1.0, 2.0), ("r", 1, 2.0, 3.0), ("r", 2, 2.5, 4.0), ("s", 0, 1.0, 9.0)], "run_id string, window_id int, mz_lo double, mz_hi double")
    assert [tuple(x) for x in peaks.overlapping_windows(w).collect()] == [("r", 1, 2)]
    a = spark.createDataFrame([("r", 1, "MS:1002815"), ("r", 0, "other"), ("s", 0, "MS:1002476"), ("t", 0, "x")], "run_id string, spectrum int, accession string")
    assert {tuple(x) for x in peaks.mobility_kind(a).collect()} == {("r", "Ook0"), ("s", "Unsupported"), ("t", "Absent")}


def test_index_round_trip_and_api(spark, tmp_path):
    from ionloom.api import GROUP, Run
    from ionloom.functions.ranges import Tolerance, Width

    lib = simulator.library(5)
    p, c, w, there = simulator.run(lib, present=1.0, cycles=600, noise=500)
    pk = spark.createDataFrame(p).select("run_id", F.when(F.col("window_id") < 0, 1).otherwise(2).cast("byte").alias("ms_level"), F.col("window_id").cast("int"), F.col("mz").cast("float").alias("mz"), F.col("intensity").cast("float").alias("intensity"), F.col("mobility").cast("float").alias("mobility_ook0"), F.col("cycle").cast("int").alias("cycle_index"))
    path = str(tmp_path / "run.idx")
    peaks.write_index(pk, spark.createDataFrame(c), spark.createDataFrame(w), path, files=2)
    assert registry.open_run(spark, path).count() == len(p)
    run = Run.open(spark, path)
    assert run.num_cycles() == 600 and run.rt_range_ms() == (0, 599000) and run.rt_seconds_to_cycle_index(10.5) == 10 and run.rt_seconds_to_cycle_index(1e9) == 599 and run.cycle_index_to_rt_ms(3) == 3000 and run.is_lazy
    e = lib.iloc[0]
    g = {"id": 1, "precursor_mz": float(e.precursor_mz), "charge": 2, "mobility": float(e.mobility), "rt_seconds": float(e.rt_seconds * 1.02 + 8), "isotopes": [0, 1], "fragments": [{"label": f["label"], "mz": f["mz"]} for f in e.fragments]}
    t = Tolerance(rt=Width("minutes", 0.5, 0.5))
    got = next(run.query_chromatograms_iter([g], t))
    assert len(got) == 8 and all(len(r.chromatogram) == 61 for r in got) and all(abs(int(np.argmax(r.chromatogram)) - 30) <= 4 for r in got)
    gd = spark.createDataFrame([g], GROUP)
    spec = {r.ion: r.intensity for r in run.query_spectrum(gd, t).collect()}
    assert spec["p0"] > spec["p1"] > 0 and run.query_point(gd, t).first().intensity == pytest.approx(sum(spec.values()), rel=1e-6)
    st = {r.ion: r for r in run.query_mz_mobility(gd, t).collect()}
    assert st["y3"].mobility == pytest.approx(e.mobility, rel=0.01)
    into = run.query_chromatogram_into(gd, 0, 599, t).collect()
    assert {len(r.chromatogram) for r in into} == {600} and sum(into[0].chromatogram) == pytest.approx(sum(next(r for r in got if r.ion == into[0].ion).chromatogram))
    assert run.query_chromatogram_into(gd, 0, 1, t).count() == 0
    view = {r.ion: r for r in run.mobility_view(gd).collect()}
    assert view["y4"].mobility == pytest.approx(e.mobility, rel=0.02)
    each = run.query_chromatograms_batch(gd.unionByName(gd.withColumn("id", F.lit(2).cast("long"))), [(1, t), (2, Tolerance(rt=Width("minutes", 0.1, 0.1)))])
    assert {(r.query_id, len(r.chromatogram)) for r in each.collect()} == {(1, 61), (2, 13)}
    for bad in ("s3://b/x.mzML", "/x/y.unknown"):
        with pytest.raises(ValueError):
            registry.open_run(spark, bad)


def test_half_floats(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    t = pa.table({"mz": pa.array([400.0, 410.0], pa.float32()), "intensity": pa.array([1.0, 2.0], pa.float32()), "mobility_ook0": pa.array(np.array([0.75, 1.1], np.float16)), "cycle_index": pa.array([0, 1], pa.uint32())})
    pq.write_table(t, str(tmp_path / "h.parquet"), row_group_size=1)
    r = peaks.read_half_float_peaks(spark, [str(tmp_path / "h.parquet")], "r", 2, 1).orderBy("mz").collect()
    assert [x.mobility_ook0 for x in r] == [0.75, float(np.float16(1.1))]


def test_registry_refuses(spark, tmp_path):
    with pytest.raises(ValueError, match="no reader fits"):
        registry.read_library(spark, write(tmp_path / "x.tsv", "a\tb\n1\t2\n"))
    with pytest.raises(ValueError):
        registry.read_library(spark, str(tmp_path / "x.zip"))


def test_sinks(spark, tmp_path):
    from ionloom.operators.calibrate import Calibration, Curve, Ridge

    df = spark.createDataFrame([("A", 0.1), ("B", 0.6)], "sequence string, q_value double")
    sinks.write_results(df, str(tmp_path / "r"))
    assert [r.sequence for r in spark.read.parquet(str(tmp_path / "r")).collect()] == ["A"]
    assert sinks.write_json_array(df, str(tmp_path / "a.json"), True) == 2 and len(json.loads((tmp_path / "a.json").read_text())) == 2
    sinks.write_ndjson(df, str(tmp_path / "n"))
    sinks.write_tsv(df, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "n")).count() == 2 and spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).count() == 2
    sinks.write_calibration(Calibration(Curve([0, 1], [0, 2]), Ridge([0.0], [1.0], [1.0], [1.0])), str(tmp_path / "c.json"))
    assert sinks.read_calibration(str(tmp_path / "c.json")).curve.ys == [0.0, 2.0]
    rep = sinks.Report()
    with rep.phase("x"):
        pass
    rep.write(str(tmp_path / "rep" / "r.json"))
    assert os.path.exists(tmp_path / "rep" / "r.json")


def test_a_range_of_an_index_reads_few_row_groups(spark, tmp_path):
    from ionloom.sources import peaks as P

    ten = spark.createDataFrame([("r", 1, -1, 400.0 + 10 * i, 1.0, 0.9, i % 3) for i in range(10)], P.PEAK_SCHEMA.replace("ms_level byte", "ms_level int")).withColumn("ms_level", F.col("ms_level").cast("byte"))
    cycles, windows = spark.createDataFrame([("r", i) for i in range(3)], "run_id string, cycle int"), spark.createDataFrame([("r", -1)], "run_id string, window_id int")
    P.write_index(ten, cycles, windows, f"{tmp_path}/ten")
    assert P.read_index(spark, f"{tmp_path}/ten")[0].filter("mz between 420 and 460").count() == 5
    many = spark.range(400_000).select(F.lit("r").alias("run_id"), F.lit(1).cast("byte").alias("ms_level"), F.lit(-1).alias("window_id"), (200 + F.col("id") / 400).cast("float").alias("mz"), F.rand(1).cast("float").alias("intensity"), F.rand(2).cast("float").alias("mobility_ook0"), (F.col("id") % 100).cast("int").alias("cycle_index"))
    P.write_index(many, cycles, windows, f"{tmp_path}/many", files=2)
    P.rebucket(spark, f"{tmp_path}/many", f"{tmp_path}/small", files=2, row_group_bytes=64 << 10)
    read = {}
    for name in ("many", "small"):
        df = P.read_index(spark, f"{tmp_path}/{name}")[0].filter("mz between 500 and 501")
        assert len(df.collect()) == 401
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        read[name] = leaves.apply(0).metrics().apply("numOutputRows").value()
    assert read["small"] < read["many"] <= 210_000 and read["small"] < 60_000


def test_a_tolerance_per_group_is_one_plan(spark):
    from ionloom.api import GROUP, Run
    from ionloom.functions.ranges import Tolerance, Width

    peaks = spark.createDataFrame([(1, -1, 500.0 + d, 1.0, 0.9, c) for d in (0.0, 0.004, 0.04) for c in range(5)], "ms_level int, window_id int, mz double, intensity double, mobility double, cycle int")
    run = Run(peaks, spark.createDataFrame([(c, c * 1000) for c in range(5)], "cycle int, rt_ms long"))
    g = spark.createDataFrame([(i, 500.0, 1, 0.9, 2.0, [0], []) for i in range(4)], GROUP)
    tol = [(0, Tolerance()), (1, Tolerance(ms=Width("ppm", 1, 1))), (2, Tolerance(ms=Width("absolute", 0.1, 0.1))), (3, Tolerance(rt=Width("minutes", 1 / 60, 1 / 60)))]
    got = {r.query_id: r.chromatogram for r in run.query_chromatograms_batch(g, tol).collect()}
    assert {k: sum(v) for k, v in got.items()} == {0: 10.0, 1: 5.0, 2: 15.0, 3: 6.0} and len(got[3]) == 3


def test_first_bytes_settle_paths_without_a_known_suffix(spark, tmp_path):
    (tmp_path / "run.data").write_bytes(b"<?xml version='1.0'?><mzML/>")
    (tmp_path / "lib.bin").write_bytes(b"\x28\xb5\x2f\xfd0000")
    (tmp_path / "odd.bin").write_bytes(b"abc")
    assert registry.choose(spark, str(tmp_path / "run.data"), registry.RUNS).name == "mzml"
    assert registry.choose(spark, str(tmp_path / "lib.bin"), registry.LIBRARIES).name == "native"
    for name in ("odd.bin", "missing.bin", ""):
        with pytest.raises(ValueError, match="no reader fits"):
            registry.choose(spark, str(tmp_path / name), registry.LIBRARIES)
    assert registry.first_bytes(spark, str(tmp_path / "odd.bin")) == b"abc" and registry.first_bytes(spark, str(tmp_path)) == b""
