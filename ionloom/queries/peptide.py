"""Peptides, masses, labels and libraries, over the library tables and texts read as sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions import chemistry as C
from ionloom.operators import matching, peptides
from ionloom.runtime import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "elution_groups").select("eg_id", F.col("precursor_sequence").alias("seq"), F.col("precursor_mono_mz").alias("mz"), F.col("precursor_charge").alias("z"))


def proteins(spark: SparkSession, sf: str) -> DataFrame:
    """Each text's letters as a sequence."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("protein_id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence")).filter("length(sequence) > 0")


PROT = "prot AS (SELECT doc_id AS protein_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents WHERE length(upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))) > 0)"
N = lambda r: f"(length(seq) - length(replace(seq, '{r}', '')))"
EG = "eg AS (SELECT eg_id, precursor_sequence AS seq, precursor_mono_mz AS mz, precursor_charge AS z FROM elution_groups)"
CARB = " + ".join(f"{n} * {N(r)}" for r, n in C.CARBONS.items())
MASS = f"({C.WATER} + " + " + ".join(f"{m} * {N(r)}" for r, m in C.RESIDUES.items()) + ")"
OKSEQ = f"regexp_full_match(seq, '[{C.CANONICAL}]+')"
COMP = f"""{EG}, comp AS (SELECT eg_id, CASE WHEN {OKSEQ} THEN {CARB} ELSE CAST(round(mz * z * 4.9384 / 111.1054) AS INTEGER) END AS carbons,
  CASE WHEN {OKSEQ} THEN {N('C')} + {N('M')} ELSE CAST(round(mz * z * 0.0417 / 111.1054) AS INTEGER) END AS sulphurs FROM eg)"""


@query(f"WITH {EG} SELECT eg_id, " + ", ".join(f"CAST({N(r)} AS INTEGER) AS n_{r.lower()}" for r in C.CANONICAL) + " FROM eg")
def a23_amino_acid_counts(spark: SparkSession, sf: str) -> DataFrame:
    return groups(spark, sf).select("eg_id", *C.amino_acid_counts(F.col("seq")))


@query(f"WITH {COMP} SELECT eg_id, CAST(carbons AS INTEGER) AS carbons, CAST(sulphurs AS INTEGER) AS sulphurs FROM comp")
def x13_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Atoms by sequence where it is standard, else averagine."""
    c, s = C.composition(F.col("seq"), F.col("mz") * F.col("z"))
    return groups(spark, sf).select("eg_id", c.cast("int").alias("carbons"), s.cast("int").alias("sulphurs"))


@query(f"""WITH {COMP}, p AS (SELECT eg_id, carbons * 0.011::DOUBLE AS l, sulphurs * 0.0076::DOUBLE AS a, sulphurs * 0.044::DOUBLE AS b FROM comp),
t AS (SELECT eg_id, exp(-l) AS c0, l * exp(-l) AS c1, l * l * exp(-l) / 2 AS c2, exp(-a) * exp(-b) AS s0, a * exp(-a) * exp(-b) AS s1, a * a * exp(-a) / 2 * exp(-b) + exp(-a) * b * exp(-b) AS s2 FROM p),
r AS (SELECT eg_id, c0 * s0 AS i0, c0 * s1 + c1 * s0 AS i1, c0 * s2 + c1 * s1 + c2 * s0 AS i2 FROM t)
SELECT eg_id, round(i0 / greatest(i0, i1, i2), 9) AS i0, round(i1 / greatest(i0, i1, i2), 9) AS i1, round(i2 / greatest(i0, i1, i2), 9) AS i2 FROM r""")
def x10_isotope_envelope(spark: SparkSession, sf: str) -> DataFrame:
    c, s = C.composition(F.col("seq"), F.col("mz") * F.col("z"))
    e = groups(spark, sf).select("eg_id", C.isotope_envelope(c, s).alias("e"))
    return e.select("eg_id", *[F.round(F.get("e", i), 9).alias(f"i{i}") for i in range(3)])


@query(f"WITH {EG} SELECT eg_id, round(-1.319388 - 0.2954677 * ln(mz + 1) - 9.277763e-05 * mz + 0.3219103 * ln(mz * mz / z + 1) + 4.005229e-07 * (mz * mz / z) + 0.1176651 * z, 6) AS mobility FROM eg WHERE mz IS NOT NULL")
def x14_mobility_model(spark: SparkSession, sf: str) -> DataFrame:
    return groups(spark, sf).filter("mz is not null").select("eg_id", F.round(C.one_over_k0(F.col("mz"), F.col("z")), 6).alias("mobility"))


@query(f"WITH {EG} SELECT eg_id, round(({MASS} + z * 1.007276) / z, 4) AS theoretical_mz FROM eg WHERE {OKSEQ}")
def x15_precursor_mz(spark: SparkSession, sf: str) -> DataFrame:
    m = C.peptide_mz(F.col("seq"), F.col("z"))
    return groups(spark, sf).select("eg_id", F.round(m, 4).alias("theoretical_mz")).filter("theoretical_mz is not null")


@query(f"WITH {EG} SELECT eg_id, round((mz - t) / t * 1e6, 2) AS ppm, round((mz - t) / t * 100, 4) AS percent FROM (SELECT eg_id, mz, ({MASS} + z * 1.007276) / z AS t FROM eg WHERE {OKSEQ})")
def x28_mass_errors(spark: SparkSession, sf: str) -> DataFrame:
    t = C.peptide_mz(F.col("seq"), F.col("z"))
    e = groups(spark, sf).select("eg_id", F.col("mz"), t.alias("t")).filter("t is not null")
    return e.select("eg_id", F.round(C.ppm_error(F.col("mz"), F.col("t")), 2).alias("ppm"), F.round(C.percent_error(F.col("mz"), F.col("t")), 4).alias("percent"))


LABEL = "'^(?:(p)|([abcdvwxyz])([0-9]{1,3}))(?:[+]([0-9]*)i)?(?:\\^([0-9]+))?$'"


@query(f"""SELECT fragment_label, series, ordinal, isotope, charge, CASE WHEN series IN ('a', 'b', 'c', 'd') THEN 'N' WHEN series IN ('v', 'w', 'x', 'y', 'z') THEN 'C' END AS terminus, count(*) AS n FROM (
SELECT fragment_label, regexp_extract(fragment_label, {LABEL}, 1) || regexp_extract(fragment_label, {LABEL}, 2) AS series, TRY_CAST(regexp_extract(fragment_label, {LABEL}, 3) AS INTEGER) AS ordinal,
CASE WHEN regexp_extract(fragment_label, {LABEL}, 4) <> '' THEN CAST(regexp_extract(fragment_label, {LABEL}, 4) AS INTEGER) WHEN contains(fragment_label, 'i') THEN 1 ELSE 0 END AS isotope, coalesce(TRY_CAST(regexp_extract(fragment_label, {LABEL}, 5) AS INTEGER), 1) AS charge
FROM fragment_ions WHERE regexp_matches(fragment_label, {LABEL})) GROUP BY 1, 2, 3, 4, 5, 6""")
def x16_ion_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Ion labels taken apart, with terminus and count."""
    f = table(spark, sf, "fragment_ions").groupBy("fragment_label").agg(F.count(F.lit(1)).alias("n"))
    p = f.withColumn("p", C.ion_parts(F.col("fragment_label"))).filter("p is not null")
    return p.select("fragment_label", "p.series", "p.ordinal", "p.isotope", "p.charge", C.terminality(F.col("p.series")).alias("terminus"), "n")


@query("SELECT DISTINCT fragment_label AS label, fragment_label AS again FROM fragment_ions WHERE fragment_label IS NOT NULL AND fragment_label NOT LIKE '?%'")
def x17_label_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "fragment_ions").select(F.col("fragment_label").alias("label")).distinct().withColumn("p", C.ion_parts(F.col("label"))).filter("p is not null")
    return f.select("label", C.ion_label(F.col("p.series"), F.col("p.ordinal"), F.col("p.isotope"), F.col("p.charge")).alias("again"))


@query("""SELECT lib_row_id, m AS proforma, regexp_replace(regexp_replace(m, '\\[[^\\]]*\\]', '', 'g'), '-', '', 'g') AS bare, len(regexp_extract_all(m, '\\[(?:UNIMOD:)?([+-]?[0-9.]+)\\]', 1)) AS n_mods FROM (
SELECT lib_row_id, regexp_replace(regexp_replace(regexp_replace(replace(x, '_', ''), '(?i)\\(unimod:([0-9]+)\\)', '[UNIMOD:\\1]', 'g'), '^(\\[[^\\]]*\\])', '\\1-'), '--', '-') AS m FROM (
SELECT lib_row_id, CASE WHEN lib_row_id % 2 = 0 THEN replace(modified_peptide, 'C', 'C(UniMod:4)') ELSE '_(UniMod:1)' || ltrim(modified_peptide, '_') END AS x FROM sample_lib WHERE modified_peptide IS NOT NULL))""")
def x19_proforma(spark: SparkSession, sf: str) -> DataFrame:
    """Library notation as the public one, stripped, with its modifications counted."""
    x = F.when(F.col("lib_row_id") % 2 == 0, F.replace("modified_peptide", F.lit("C"), F.lit("C(UniMod:4)"))).otherwise(F.concat(F.lit("_(UniMod:1)"), F.ltrim("modified_peptide", F.lit("_"))))
    s = table(spark, sf, "sample_lib").filter("modified_peptide is not null").select("lib_row_id", C.proforma(x).alias("proforma"))
    return s.select("lib_row_id", "proforma", C.bare(F.col("proforma")).alias("bare"), F.size(C.modifications(F.col("proforma"))).cast("long").alias("n_mods"))


@query(f"WITH {EG} SELECT eg_id, replace(seq, 'C', 'C[UNIMOD:4]') AS modified FROM eg")
def x22_fixed_mods(spark: SparkSession, sf: str) -> DataFrame:
    return groups(spark, sf).select("eg_id", C.fixed_mod(F.col("seq"), "C", "[UNIMOD:4]").alias("modified"))


@query(f"""WITH RECURSIVE {EG}, sets AS (SELECT eg_id, seq, 0 AS last, 0 AS n, '' AS done FROM eg WHERE length(seq) > 0
UNION ALL SELECT eg_id, seq, CAST(p AS INTEGER), n + 1, done || substr(seq, last + 1, CAST(p AS INTEGER) - last) || '[UNIMOD:35]' FROM sets, range(1, 60) r(p) WHERE p > last AND p <= length(seq) AND substr(seq, CAST(p AS INTEGER), 1) = 'M' AND n < 2)
SELECT eg_id, done || substr(seq, last + 1) AS modified, CAST(n AS INTEGER) AS n_mods FROM sets""")
def x23_variable_mods(spark: SparkSession, sf: str) -> DataFrame:
    """Every choice of up to two oxidised residues."""
    return peptides.variable_mods(groups(spark, sf), "M", "[UNIMOD:35]", 2, "seq").select("eg_id", "modified", "n_mods")


@query(f"WITH {EG} SELECT eg_id, CASE WHEN length(seq) < 3 THEN seq ELSE seq[1] || reverse(seq[2:-2]) || seq[-1] END AS decoy FROM eg")
def x24_reverse_decoy(spark: SparkSession, sf: str) -> DataFrame:
    return groups(spark, sf).select("eg_id", C.reverse_decoy(F.col("seq")).alias("decoy"))


@query(f"WITH {EG} SELECT eg_id, CASE WHEN length(seq) < 4 THEN seq ELSE seq[1] || translate(seq[2], '{C.MUTATE_FROM}', '{C.MUTATE_TO}') || seq[3:-3] || translate(seq[-2], '{C.MUTATE_FROM}', '{C.MUTATE_TO}') || seq[-1] END AS decoy FROM eg")
def x25_mutated_decoy(spark: SparkSession, sf: str) -> DataFrame:
    return groups(spark, sf).select("eg_id", C.mutate_decoy(F.col("seq")).alias("decoy"))


@query(f"""SELECT ion_row_id, v AS variant, round(CASE WHEN ordinal IS NULL OR ordinal > 2 THEN fragment_mz + CASE v WHEN 1 THEN 14.0 WHEN 2 THEN -14.0 ELSE 0 END / charge ELSE fragment_mz END, 5) AS mz FROM (
SELECT ion_row_id, fragment_mz, TRY_CAST(regexp_extract(fragment_label, {LABEL}, 3) AS INTEGER) AS ordinal, coalesce(TRY_CAST(regexp_extract(fragment_label, {LABEL}, 5) AS INTEGER), 1) AS charge FROM fragment_ions), (VALUES (0), (1), (2)) AS x(v)""")
def x26_decoy_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Target and two mass-shifted decoys of every ion, made row by row."""
    p = C.ion_parts(F.col("fragment_label"))
    f = table(spark, sf, "fragment_ions").select("ion_row_id", "fragment_mz", p.alias("p")).withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    return f.select("ion_row_id", "variant", F.round(C.shifted(F.col("fragment_mz"), F.col("p.ordinal"), F.coalesce("p.charge", F.lit(1)), F.col("variant")), 5).alias("mz"))


PIECES = """cut AS (SELECT protein_id, string_split(rtrim(regexp_replace(regexp_replace(sequence, '([KR])([^P,])', '\\1,\\2', 'g'), '([KR])([^P,])', '\\1,\\2', 'g'), ','), ',') AS p FROM prot),
piece AS (SELECT protein_id, unnest(p) AS piece, unnest(range(len(p))) AS i FROM cut),
run AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY protein_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, lead(piece) OVER (PARTITION BY protein_id ORDER BY i) AS nxt FROM piece),
pep AS (SELECT protein_id, piece AS peptide, start, 0 AS missed FROM run UNION ALL SELECT protein_id, piece || nxt, start, 1 FROM run WHERE nxt IS NOT NULL)"""


@query(f"WITH {PROT}, {PIECES} SELECT protein_id, peptide, CAST(start AS INTEGER) AS start, CAST(missed AS INTEGER) AS missed FROM pep WHERE length(peptide) BETWEEN 6 AND 30")
def x33_digestion(spark: SparkSession, sf: str) -> DataFrame:
    """Tryptic pieces with up to one missed cut."""
    return peptides.digest(proteins(spark, sf), 1, 6, 30)


@query(f"WITH {PROT}, {PIECES} SELECT peptide, count(DISTINCT protein_id) AS n_proteins FROM pep WHERE length(peptide) BETWEEN 6 AND 30 AND NOT regexp_matches(peptide, '[UBJZX]') GROUP BY 1")
def j15_distinct_peptides(spark: SparkSession, sf: str) -> DataFrame:
    """Each standard peptide once (F16 and the set operation of digests)."""
    return peptides.distinct_peptides(peptides.standard_only(peptides.digest(proteins(spark, sf), 1, 6, 30))).select("peptide", "n_proteins")


@query(f"""WITH {PROT}, {PIECES}, wanted AS (SELECT DISTINCT peptide FROM pep WHERE length(peptide) BETWEEN 6 AND 30),
six AS (SELECT protein_id, sequence, unnest(range(1, length(sequence) - 4)) AS p FROM prot), gram AS (SELECT protein_id, sequence, p, substr(sequence, p, 6) AS g FROM six),
hit AS (SELECT DISTINCT peptide, protein_id FROM wanted JOIN gram ON g = substr(peptide, 1, 6) AND substr(sequence, p, length(peptide)) = peptide)
SELECT peptide, count(*) AS n_proteins FROM hit GROUP BY 1""")
def j11_containing_proteins(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences that hold a peptide of the digested proteins."""
    p = proteins(spark, sf)
    return peptides.containing_proteins(peptides.digest(p, 1, 6, 30), p, 5).groupBy("peptide").agg(F.count(F.lit(1)).alias("n_proteins"))


@query(f"WITH {PROT} SELECT CAST(floor(sum(length(sequence)) / 10) * 2 AS BIGINT) AS n_estimate FROM prot")
def h13_peptide_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return peptides.unique_peptide_estimate(proteins(spark, sf), 1)


@query("""WITH f AS (SELECT eg_id, list_sort(list(CAST(round(fragment_mz) AS BIGINT))) AS keys, count(*) AS n FROM (SELECT DISTINCT eg_id, fragment_mz FROM fragment_ions WHERE fragment_mz IS NOT NULL) GROUP BY 1)
SELECT count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_fragments, round(avg(n), 6) AS mean_fragments FROM f""")
def a17_library_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Groups, fragments and mean fragments of a library."""
    d = table(spark, sf, "fragment_ions").filter("fragment_mz is not null").select("eg_id", "fragment_mz").distinct().groupBy("eg_id").agg(F.count(F.lit(1)).alias("n"))
    return d.agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_fragments"), F.round(F.avg("n"), 6).alias("mean_fragments"))


@query()
def j09_library_match(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of every other source matched to those of the rest, by precursor and shared fragments."""
    frag = table(spark, sf, "fragment_ions").filter("fragment_mz is not null and fragment_intensity > 0").select("eg_id", matching.mz_key(F.col("fragment_mz"), 0).alias("k")).distinct()
    keys = frag.groupBy("eg_id").agg(F.collect_list("k").alias("fragment_keys"), F.count(F.lit(1)).alias("n"))
    g = table(spark, sf, "elution_groups").select(F.col("eg_id").alias("id"), F.round(F.col("precursor_mono_mz") / 2).alias("mz"), F.col("precursor_charge").alias("charge"), F.coalesce("rt_seconds", F.lit(0.0)).alias("rt_seconds"), "eg_id", "source_id").filter("mz is not null")
    g = g.join(keys, "eg_id")
    return matching.match_libraries(g.filter("source_id % 2 <=> 0"), g.filter("not (source_id % 2 <=> 0)"), 3)


@query("""WITH r AS (SELECT min(rt_seconds) FILTER (decoy) AS a0, max(rt_seconds) FILTER (decoy) AS a1, min(rt_seconds) FILTER (NOT decoy) AS b0, max(rt_seconds) FILTER (NOT decoy) AS b1 FROM elution_groups WHERE rt_seconds IS NOT NULL AND NOT isnan(rt_seconds))
SELECT round(greatest(least(a1, b1) - greatest(a0, b0), 0) / (b1 - b0) * 100, 6) AS overlap_pct FROM r""")
def a18_rt_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """How much of one library's retention range the other covers; below 50 and 80 percent is worth a warning."""
    e = table(spark, sf, "elution_groups").filter("rt_seconds is not null and not isnan(rt_seconds)")
    m = lambda f, c, n: f(F.when(c, F.col("rt_seconds"))).alias(n)
    d, t = F.col("decoy"), ~F.col("decoy")
    r = e.agg(m(F.min, d, "a0"), m(F.max, d, "a1"), m(F.min, t, "b0"), m(F.max, t, "b1"))
    return r.select(F.round(F.greatest(F.least("a1", "b1") - F.greatest("a0", "b0"), F.lit(0.0)) / (F.col("b1") - F.col("b0")) * 100, 6).alias("overlap_pct"))


@query(f"""SELECT DISTINCT fragment_label AS label, b AS by_, CASE WHEN i + b BETWEEN -128 AND 127 THEN CAST(i + b AS INTEGER) END AS isotope FROM (SELECT fragment_label,
CASE WHEN regexp_extract(fragment_label, {LABEL}, 4) <> '' THEN CAST(regexp_extract(fragment_label, {LABEL}, 4) AS INTEGER) WHEN contains(fragment_label, 'i') THEN 1 ELSE 0 END AS i
FROM fragment_ions WHERE regexp_matches(fragment_label, {LABEL})), (VALUES (1), (-2), (127)) v(b)""")
def x18_neutron_offset(spark: SparkSession, sf: str) -> DataFrame:
    """Labels some neutrons on; null where the isotope has no room."""
    f = table(spark, sf, "fragment_ions").select(F.col("fragment_label").alias("label")).distinct().withColumn("p", C.ion_parts(F.col("label"))).filter("p is not null")
    f = f.withColumn("by_", F.explode(F.array(F.lit(1), F.lit(-2), F.lit(127))))
    return f.select("label", "by_", C.neutron_offset(F.col("p.isotope"), F.col("by_")).alias("isotope"))
