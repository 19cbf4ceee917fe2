import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.functions import arrays as A
from ionloom.functions import chemistry as C
from ionloom.functions import ranges as R


def one(spark, **cols):
    r = spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()
    return [r[n] for n in cols]


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_similarity(spark):
    cos, same, pear, flat, empty = one(spark, a=A.cosine(arr(1, 2, 3), arr(4, 5, 6)), b=A.cosine(arr(1, 2), arr(1, 2, 3)), c=A.pearson(arr(1, 2, 3), arr(2, 4, 7)), d=A.pearson(arr(1, 1), arr(1, 2)), e=A.cosine(arr(0, 0), arr(1, 2)))
    assert cos == pytest.approx(0.9746318, abs=1e-6) and same is None and empty is None
    assert pear == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1]) and flat == 0


def test_top_n_argmax_centred(spark):
    t, m, c, none = one(spark, a=A.top_n(arr(1, 2, 10, 4, 5, 9, 7, 8, 2, 1), 3), b=A.argmax(arr(1, 3, 3)), c=A.centred(arr(1, 2, 3)), d=A.centred(arr(2, 2)))
    assert [(x.value, x.place) for x in t] == [(10, 2), (9, 5), (8, 7)] and m == 1
    assert c == pytest.approx([-(0.5**0.5), 0, 0.5**0.5]) and none is None


def test_fwhm():
    x = np.exp(-((np.arange(41) - 20) ** 2) / (2 * 3.0**2))
    assert A.np_fwhm(x, 20) == pytest.approx(2.355 * 3, rel=0.02)
    assert A.np_fwhm(np.zeros(5), 2) == 2.0 and A.np_fwhm(np.array([]), 0) == 2.0 and A.np_fwhm(np.array([0.0, 1, 0]), 1) == 1.0


def test_isotopes_and_mobility(spark):
    env, k0 = one(spark, a=C.isotope_envelope(F.lit(60), F.lit(5)), b=C.one_over_k0(F.lit(1810.917 / 2 + C.PROTON) * 1.0, F.lit(2)))
    assert env == pytest.approx([1, 0.711, 0.471], abs=0.02)
    assert 0.5 < k0 < 2


def test_labels(spark):
    labels = ["y12", "b3^2", "y5+i", "a4+2i^3", "p", "p^2", "?7", "y", "y3^0", "", None]
    df = spark.createDataFrame([(x,) for x in labels], "label string").select("label", C.ion_parts(F.col("label")).alias("p"))
    got = [(r.p and tuple(r.p)) for r in df.collect()]
    assert got == [("y", 12, 0, 1), ("b", 3, 0, 2), ("y", 5, 1, 1), ("a", 4, 2, 3), ("p", None, 0, 1), ("p", None, 0, 2), None, None, None, None, None]
    back = [r[0] for r in df.filter("p is not null").select(C.ion_label(F.col("p.series"), F.col("p.ordinal"), F.col("p.isotope"), F.col("p.charge"))).collect()]
    assert back == labels[:6]
    assert one(spark, a=C.terminality(F.lit("b")), b=C.terminality(F.lit("y")), c=C.terminality(F.lit("p"))) == ["N", "C", None]


def test_decoys_and_mods(spark):
    got = one(spark, a=C.reverse_decoy(F.lit("PEPTIDEPINK")), b=C.reverse_decoy(F.lit("AC[UNIMOD:4]DK")), c=C.reverse_decoy(F.lit("AK")), d=C.mutate_decoy(F.lit("PEPTIDEK")), e=C.fixed_mod(F.lit("ACC[UNIMOD:4]C"), "C", "[UNIMOD:4]"))
    assert got == ["PNIPEDITPEK", "ADC[UNIMOD:4]K", "AK", "PDPTIDDK", "AC[UNIMOD:4]C[UNIMOD:4]C[UNIMOD:4]"]
    assert one(spark, a=C.shifted(F.lit(200.0), F.lit(1), F.lit(1), F.lit(1)), b=C.shifted(F.lit(896.5), F.lit(8), F.lit(1), F.lit(1)), c=C.shifted(F.lit(100.0), F.lit(None).cast("int"), F.lit(2), F.lit(2))) == [200.0, 910.5, 93.0]


def test_sequences(spark):
    pf, bare, mods, mass, unknown = one(spark, a=C.proforma(F.lit("_(UniMod:1)PEPC(UniMod:4)K_")), b=C.bare(F.lit("_[UNIMOD:1]-PEPC[+57.02]K_")), c=C.modifications(F.lit("A[UNIMOD:4]K[+15.99]")), d=C.peptide_mz(F.lit("PEPTIDE"), F.lit(1)), e=C.peptide_mass(F.lit("PEPX")))
    assert pf == "[UNIMOD:1]-PEPC[UNIMOD:4]K" and bare == "PEPCK" and mods == ["4", "+15.99"] and mass == pytest.approx(800.367, abs=1e-3) and unknown is None
    assert one(spark, a=C.peptide_mass(F.lit("C[UNIMOD:4]")) - C.peptide_mass(F.lit("C")))[0] == pytest.approx(57.021464)
    assert one(spark, a=C.ln_factorial(F.lit(10.0)), b=C.ln_factorial(F.lit(0.5)))[0] == pytest.approx(math.lgamma(11), abs=0.01)


def test_tolerance_json(spark):
    t = R.tolerance_from_json({"ms": {"ppm": [10, 20]}, "rt": "Unrestricted", "mobility": {"pct": [5, 5]}, "quad": {"da": [1.05, 1.05]}})
    assert t.ms == R.Width("ppm", 10, 20) and t.rt.kind == "unrestricted" and t.widened_mobility(2).mobility.hi == 10
    for bad in ({"zz": {}}, {"ms": {"ppm": [-1, 1]}}, {"ms": {"pct": [1, 1]}}):
        with pytest.raises(ValueError):
            R.tolerance_from_json(bad)
    lo, hi = t.ms.around(F.lit(1000.0))
    assert one(spark, a=lo, b=hi) == pytest.approx([999.99, 1000.02])
    assert one(spark, a=R.rt_range_ms(F.lit(10.0), R.Width("minutes", 0.5, 0.5))[0], b=R.rt_range_ms(F.lit(10.0), R.Width("minutes", 0.5, 0.5))[1]) == [0, 40000]


def test_window_shapes_against_sampling(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(300):
        a, b, c, d = rng.uniform(0, 10, 4)
        lo0, lo1, w0, w1 = a, b, abs(c) / 2 + 0.2, abs(d) / 2 + 0.2
        q0, i0 = rng.uniform(-2, 10), rng.uniform(0, 0.9)
        rows.append((float(q0), float(q0 + rng.uniform(0, 2)), float(i0), float(i0 + rng.uniform(0.05, 0.3)), 0.0, 1.0, float(lo0), float(lo1), float(lo0 + w0), float(lo1 + w1)))
    names = ["q_lo", "q_hi", "i_lo", "i_hi", "im0", "im1", "mz_lo0", "mz_lo1", "mz_hi0", "mz_hi1"]
    df = spark.createDataFrame(rows, names)
    hit, lo, hi = R.window_overlaps(*[F.col(c) for c in names[:4]], {c: F.col(c) for c in names[4:]})
    wrong = 0
    for r, g in zip(rows, df.select(hit.alias("h"), lo.alias("lo"), hi.alias("hi")).collect()):
        im = np.linspace(r[2], min(r[3], 1.0), 4001)
        inside = (r[6] + (r[7] - r[6]) * im <= r[1]) & (r[8] + (r[9] - r[8]) * im >= r[0]) if r[2] <= 1 else np.array([False])
        wrong += bool(g.h) != inside.any() or (inside.any() and (abs(g.lo - im[inside].min()) > 1e-3 or abs(g.hi - im[inside].max()) > 1e-3))
    assert wrong <= 1
