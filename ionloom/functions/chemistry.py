"""Scalar functions on peptides, masses and ion labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Monoisotopic residue masses, water, proton.
RESIDUES = {
    "G": 57.02146372, "A": 71.03711379, "S": 87.03202841, "P": 97.05276385, "V": 99.06841391, "T": 101.04767847, "C": 103.00918448, "L": 113.08406398, "I": 113.08406398, "N": 114.04292744,
    "D": 115.02694303, "Q": 128.05857751, "K": 128.09496302, "E": 129.04259309, "M": 131.04048461, "H": 137.05891186, "F": 147.06841391, "R": 156.10111103, "Y": 163.06332854, "W": 186.07931295,
}
WATER, PROTON = 18.010565, 1.007276
# Mass shifts of the modifications by their public accession.
UNIMOD = {
    1: 42.010565, 4: 57.021464, 5: 43.005814, 7: 0.984016, 21: 79.966331, 23: -18.010565, 27: -18.010565, 28: -17.026549, 34: 14.015650, 35: 15.994915, 36: 28.031300, 37: 42.046950, 39: 45.987721, 58: 56.026215,
    64: 100.016044, 121: 114.042927, 122: 27.994915, 188: 6.020129, 214: 144.102063, 259: 8.014199, 267: 10.008269, 299: 43.989829, 312: 119.004099, 385: -17.026549, 737: 229.162932, 747: 86.000394, 1289: 70.041865, 1363: 68.026215, 2016: 304.207146,
}
# Carbons per residue; C and M hold one sulphur.
CARBONS = {"A": 3, "C": 3, "D": 4, "E": 5, "F": 9, "G": 2, "H": 6, "I": 6, "K": 6, "L": 6, "M": 5, "N": 4, "P": 5, "Q": 5, "R": 6, "S": 3, "T": 4, "V": 5, "W": 11, "Y": 9}
CANONICAL = "ACDEFGHIKLMNPQRSTVWY"
SERIES_N, SERIES_C = "abcd", "vwxyz"


def count_of(seq: Column, residue: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(residue)))


def amino_acid_counts(seq: Column) -> list[Column]:
    return [count_of(seq, r).alias(f"n_{r.lower()}") for r in CANONICAL]


def carbons_sulphurs(seq: Column) -> tuple[Column, Column]:
    """Atoms of a bare sequence; null for an empty one or one with other letters."""
    ok = seq.rlike(f"^[{CANONICAL}]+$")
    c = sum((count_of(seq, r) * n for r, n in CARBONS.items()), F.lit(0))
    return F.when(ok, c), F.when(ok, count_of(seq, "C") + count_of(seq, "M"))


def averagine(mass: Column) -> tuple[Column, Column]:
    return F.round(mass * 4.9384 / 111.1054).cast("int"), F.round(mass * 0.0417 / 111.1054).cast("int")


def composition(seq: Column, mass: Column) -> tuple[Column, Column]:
    """Counted where the sequence allows it, else averagine."""
    (c, s), (ac, as_) = carbons_sulphurs(seq), averagine(mass)
    return F.coalesce(c, ac), F.coalesce(s, as_)


def isotope_envelope(carbons: Column, sulphurs: Column) -> Column:
    """Array of the first three isotope heights, the highest 1."""
    lam, l33, l34 = carbons * 0.011, sulphurs * 0.0076, sulphurs * 0.044
    poisson = lambda rate, k: F.pow(rate, F.lit(float(k))) * F.exp(-rate) / [1, 1, 2][k]
    c = [poisson(lam, k) for k in range(3)]
    s33 = [poisson(l33, k) for k in range(3)]
    e34 = F.exp(-l34)
    s = [s33[0] * e34, s33[1] * e34, s33[2] * e34 + s33[0] * l34 * e34]
    raw = [sum((c[i] * s[k - i] for i in range(k + 1)), F.lit(0.0)) for k in range(3)]
    top = F.greatest(*raw)
    return F.array(*[r / top for r in raw])


def one_over_k0(mz: Column, charge: Column) -> Column:
    """Predicted mobility of a precursor: a linear model in logarithms."""
    q = mz * mz / charge
    return -1.319388 - 0.2954677 * F.log(mz + 1) - 9.277763e-05 * mz + 0.3219103 * F.log(q + 1) + 4.005229e-07 * q + 0.1176651 * charge


def bare(seq: Column) -> Column:
    """A sequence without modifications, terminal dashes and underscores."""
    return F.regexp_replace(seq, r"\[[^\]]*\]|\([^)]*\)|[_\-]", "")


def proforma(seq: Column) -> Column:
    """Library notation to the public one: (UniMod:n) as [UNIMOD:n], with a dash after a terminal one."""
    s = F.regexp_replace(F.regexp_replace(seq, r"^_+|_+$", ""), r"(?i)\(unimod:(\d+)\)", "[UNIMOD:$1]")
    return F.regexp_replace(s, r"^(\[[^\]]*\])(?!-)", "$1-")


def modifications(seq: Column) -> Column:
    """Array of the accession numbers and mass shifts in brackets, as text."""
    return F.regexp_extract_all(seq, F.lit(r"\[(?:UNIMOD:)?([+\-]?[\d.]+)\]"), F.lit(1))


def peptide_mass(seq: Column) -> Column:
    """Neutral mass of a public-notation sequence; null if a residue or accession isn't known."""
    plain = bare(seq)
    mass = sum((count_of(plain, r) * m for r, m in RESIDUES.items()), F.lit(WATER))
    known = F.create_map(*[F.lit(x) for k, v in UNIMOD.items() for x in (str(k), v)])
    delta = F.aggregate(modifications(seq), F.lit(0.0), lambda acc, m: acc + F.when(m.rlike(r"^\d+$"), F.try_element_at(known, m)).otherwise(m.try_cast("double")))
    return F.when(plain.rlike(f"^[{CANONICAL}]+$"), mass + delta)


def peptide_mz(seq: Column, charge: Column) -> Column:
    return (peptide_mass(seq) + charge * PROTON) / charge


ION = r"^(?:(p)|([abcdvwxyz])(\d{1,3}))(?:\+(\d*)i)?(?:\^(\d+))?$"


def ion_parts(label: Column) -> Column:
    """Struct (series, ordinal, isotope, charge) of an ion label; null for what is none."""
    series = F.concat(F.regexp_extract(label, ION, 1), F.regexp_extract(label, ION, 2))
    n = F.regexp_extract(label, ION, 4)
    isotope = F.when(n != "", n.try_cast("int")).when(label.contains("i"), 1).otherwise(0)
    charge = F.coalesce(F.regexp_extract(label, ION, 5).try_cast("int"), F.lit(1))
    return F.when(label.rlike(ION) & (charge > 0), F.struct(series.alias("series"), F.regexp_extract(label, ION, 3).try_cast("int").alias("ordinal"), isotope.cast("int").alias("isotope"), charge.alias("charge")))


def ion_label(series: Column, ordinal: Column, isotope: Column, charge: Column) -> Column:
    iso = F.when(isotope == 0, "").when(isotope == 1, "+i").otherwise(F.concat(F.lit("+"), isotope.cast("string"), F.lit("i")))
    return F.concat(series, F.coalesce(ordinal.cast("string"), F.lit("")), iso, F.when(charge == 1, "").otherwise(F.concat(F.lit("^"), charge.cast("string"))))


def neutron_offset(isotope: Column, by: Column) -> Column:
    """The isotope of a label so many neutrons on; null where it leaves -128..127."""
    n = isotope.cast("long") + by.cast("long")
    return F.when(n.between(-128, 127), n.cast("int"))


def terminality(series: Column) -> Column:
    return F.when(series.isin(*SERIES_N), "N").when(series.isin(*SERIES_C), "C")


def fixed_mod(seq: Column, residue: str, notation: str) -> Column:
    """``notation`` after every unmodified ``residue``."""
    return F.regexp_replace(seq, rf"{residue}(?![\[(])", residue + notation.replace("$", r"\$"))


def reverse_decoy(seq: Column) -> Column:
    """Ends stay, the middle is reversed by residue; a modification moves with its residue."""
    tokens = F.regexp_extract_all(seq, F.lit(r"([A-Z](?:\[[^\]]*\]|\([^)]*\))*)"), F.lit(1))
    n = F.size(tokens)
    mid = F.reverse(F.slice(tokens, F.lit(2), F.greatest(n - 2, F.lit(0))))
    return F.when(n < 3, seq).otherwise(F.concat(F.get(tokens, F.lit(0)), F.array_join(mid, ""), F.get(tokens, n - 1)))


# Residues that stand in for each other in mutated decoys.
MUTATE_FROM, MUTATE_TO = "GAVLIFMPWSCTYHKRQEND", "LLLVVLLLLTSSSSLLNDQE"


def mutate_decoy(seq: Column) -> Column:
    """The second and the last but one residue are exchanged by a table."""
    n = F.length(seq)
    sub = lambda p: F.translate(F.substring(seq, p, F.lit(1)), MUTATE_FROM, MUTATE_TO)
    return F.when(n < 4, seq).otherwise(F.concat(F.substring(seq, F.lit(1), F.lit(1)), sub(F.lit(2)), F.substring(seq, F.lit(3), n - 4), sub(n - 1), F.substring(seq, n, F.lit(1))))


def shifted(mz: Column, ordinal: Column, charge: Column, variant: Column, shift: float = 14.0) -> Column:
    """Mass-shift decoys: variants 1 and 2 move ions beyond the second (or without ordinal) by +-shift/charge."""
    sign = F.when(variant == 1, 1.0).when(variant == 2, -1.0).otherwise(0.0)
    return F.when(ordinal.isNull() | (ordinal > 2), mz + sign * shift / charge).otherwise(mz)


def ln_factorial(n: Column) -> Column:
    """Stirling's ln n!; below 1 it is 0."""
    return F.when(n < 1, F.lit(0.0)).otherwise(n * F.log(n) - n + 0.5 * F.log(n) + 0.918938533204672742)


def lazyscore(values: Column) -> Column:
    """ln-factorial of the summed logarithms of an array, each at least 0."""
    return ln_factorial(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.log(F.greatest(x, F.lit(1.0)))))


def ppm_error(observed: Column, reference: Column) -> Column:
    return F.when(reference != 0, (observed - reference) / reference * 1e6)


def percent_error(observed: Column, reference: Column) -> Column:
    return F.when(reference != 0, (observed - reference) / reference * 100.0)
