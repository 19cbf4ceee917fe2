"""Readers and writers, each fed a file made of the whole library tables and told against the tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions.chemistry import ion_parts
from ionloom.queries.peptide import LABEL, PROT, proteins
from ionloom.runtime import scratch, table
from ionloom.sources import native, sinks, speclib_binary, text_libraries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def ions(spark: SparkSession, sf: str) -> DataFrame:
    """Ions with a plain label, with their precursor; numbers in text-safe precision."""
    f = table(spark, sf, "fragment_ions").select("ion_row_id", "eg_id", "fragment_label", F.round("fragment_mz", 4).alias("mz"), ion_parts(F.col("fragment_label")).alias("p"))
    e = table(spark, sf, "elution_groups").select("eg_id", F.col("precursor_sequence").alias("seq"), F.round("precursor_mono_mz", 5).alias("pmz"), F.col("precursor_charge").alias("z"), F.col("decoy").cast("int").alias("decoy"))
    return f.filter("p is not null and p.series in ('a', 'b', 'y') and p.isotope = 0 and mz is not null").join(e, "eg_id")


IONS = f"""ions AS (SELECT f.ion_row_id, f.eg_id, fragment_label, round(fragment_mz, 4) AS mz, precursor_sequence AS seq, round(precursor_mono_mz, 5) AS pmz, precursor_charge AS z, CAST(decoy AS INTEGER) AS decoy
  FROM fragment_ions f JOIN elution_groups e ON f.eg_id = e.eg_id WHERE regexp_matches(fragment_label, {LABEL}) AND fragment_label[1] IN ('a', 'b', 'y') AND NOT contains(fragment_label, 'i') AND fragment_mz IS NOT NULL)"""
TOLD = f"WITH {IONS} SELECT '_' || seq || '_' AS modified, fragment_label AS label, count(*) AS n, CAST(sum(CAST(round(mz * 10000) AS BIGINT)) AS BIGINT) AS mz_sum FROM ions GROUP BY 1, 2"


def told(groups: DataFrame) -> DataFrame:
    """What a library holds, by sequence and label."""
    f = groups.select("modified", F.explode("fragments").alias("f"))
    return f.groupBy("modified", F.col("f.label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("f.mz") * 10000).cast("long")).alias("mz_sum"))


def _write_text(df: DataFrame, folder: str, sep: str) -> str:
    df.sortWithinPartitions("_g").drop("_g").write.csv(folder, sep=sep, header=True)
    return folder


def _named(df: DataFrame, names: dict, values: dict) -> DataFrame:
    return df.repartition("eg_id").select(F.col("eg_id").alias("_g"), *[v.cast("string").alias(names[k][0]) for k, v in values.items()])


def _values(**more) -> dict:
    c = F.col
    base = {
        "modified": F.concat(F.lit("_"), c("seq"), F.lit("_")), "stripped": c("seq"), "precursor_mz": c("pmz"), "charge": c("z"), "rt": F.lit(1.5), "mobility": F.lit(0.9), "protein": F.lit("P"),
        "mz": c("mz"), "series": c("p.series"), "ordinal": c("p.ordinal"), "fcharge": c("p.charge"), "loss": F.lit("noloss"), "intensity": F.lit(0.5),
    }
    return base | more


@query(TOLD)
def s11_diann_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = _named(ions(spark, sf), text_libraries.DIANN, _values(decoy=F.col("decoy")))
    return told(text_libraries.read_diann(spark, _write_text(rows, scratch(spark), "\t")))


@query(TOLD)
def s12_diann_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    rows = _named(ions(spark, sf), text_libraries.DIANN_PARQUET, _values(decoy=F.col("decoy")))
    typed = rows.select("_g", *[F.col(f"`{c}`").cast("double").alias(c) if c in ("Precursor.Mz", "Product.Mz", "RT", "IM", "Relative.Intensity") else F.col(f"`{c}`").cast("long").alias(c) if c in ("Precursor.Charge", "Fragment.Charge", "Fragment.Series.Number", "Decoy") else F.col(f"`{c}`") for c in rows.columns if c != "_g"])
    typed.sortWithinPartitions("_g").drop("_g").write.parquet(path)
    return told(text_libraries.read_diann_parquet(spark, path))


@query(TOLD.replace("FROM ions GROUP", "FROM ions WHERE eg_id % 5 <> 0 GROUP"))
def s14_spectronaut(spark: SparkSession, sf: str) -> DataFrame:
    """A fifth of the precursors is flagged for exclusion."""
    rows = _named(ions(spark, sf), text_libraries.SPECTRONAUT, _values(excluded=F.when(F.col("eg_id") % 5 == 0, "True").otherwise("False")))
    return told(text_libraries.read_spectronaut(spark, _write_text(rows, scratch(spark), "\t")))


@query(TOLD)
def s15_skyline(spark: SparkSession, sf: str) -> DataFrame:
    v = _values(decoy=F.when(F.col("decoy") == 1, "True").otherwise("False"), intensity=F.lit("#N/A"))
    rows = _named(ions(spark, sf), text_libraries.SKYLINE, {k: v[k] for k in text_libraries.SKYLINE})
    return told(text_libraries.read_skyline(spark, _write_text(rows, scratch(spark), ",")))


@query("WITH f AS (SELECT eg_id, count(*) AS n FROM fragment_ions WHERE fragment_mz IS NOT NULL GROUP BY 1) SELECT e.eg_id AS id, e.precursor_charge::SMALLINT AS charge, coalesce(n, 0) AS n FROM elution_groups e JOIN f ON e.eg_id = f.eg_id")
def s16_elution_group_json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    f = table(spark, sf, "fragment_ions").filter("fragment_mz is not null").groupBy("eg_id").agg(F.collect_list("fragment_mz").alias("fragments"))
    g = table(spark, sf, "elution_groups").join(f, "eg_id").select(F.col("eg_id").alias("id"), F.col("precursor_mono_mz").alias("precursor"), "precursor_charge", "fragments")
    sinks.write_ndjson(g, path)
    return text_libraries.read_elution_groups(spark, path, lines=True).select("id", "charge", F.size("fragments").cast("long").alias("n"))


@query("SELECT CAST(count(*) AS BIGINT) AS n_records FROM (SELECT payload FROM speclib_elements WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' AND NOT contains(payload, chr(10)))")
def s17_native_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as lines and read back as a native library."""
    path = scratch(spark) + ".ndjson"
    p = table(spark, sf, "speclib_elements").filter(F.try_parse_json("payload").isNotNull() & F.ltrim("payload").startswith("{") & ~F.col("payload").contains("\n")).select(F.col("payload").alias("value"))
    p.write.text(path)
    return native.read_native(spark, path).agg(F.countDistinct("record_id").alias("n_records"))


@query(f"WITH {PROT} SELECT CAST(protein_id AS VARCHAR) AS protein_id, length(sequence) AS n, md5(sequence) AS hash FROM prot")
def s19_fasta(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    p = proteins(spark, sf).select(F.concat(F.lit(">"), F.col("protein_id").cast("string"), F.lit(" made\n"), F.regexp_replace("sequence", "(.{60})", "$1\n")).alias("value"))
    p.write.text(path)
    return native.read_fasta(spark, path).select("protein_id", F.length("sequence").cast("long").alias("n"), F.md5("sequence").alias("hash"))


@query("SELECT DISTINCT precursor_sequence AS peptide FROM elution_groups")
def s20_peptide_list(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark)
    s = table(spark, sf, "elution_groups").select("precursor_sequence").distinct()
    s.select(F.concat(F.lit(" "), F.col("precursor_sequence"), F.lit("\n\n# note")).alias("value")).write.text(path)
    return native.read_peptide_list(spark, path)


CODES, LENGTH = {v: k for k, v in speclib_binary.SERIES.items()}, 100


@query(f"""WITH {IONS}, d AS (SELECT eg_id, seq, z, fragment_label, count(*) AS n FROM ions WHERE regexp_matches(fragment_label, '^[aby][0-9]+(\\^[0-9]+)?$') GROUP BY ALL)
SELECT seq || CAST(z AS VARCHAR) AS modified, CAST(z AS INTEGER) AS charge, fragment_label AS label, count(*) AS n_groups FROM d GROUP BY 1, 2, 3""")
def s13_binary_library(spark: SparkSession, sf: str) -> DataFrame:
    """Entries packed into binary libraries, a file per part of the groups, and read back; of repeated ions one stays."""
    path = scratch(spark)
    g = ions(spark, sf).groupBy("eg_id", "seq", "z", "pmz").agg(F.collect_list(F.struct("mz", "p")).alias("f"))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            entries = []
            for r in frame.itertuples():
                frags = [(x["mz"], 0.5, x["p"]["charge"], CODES[x["p"]["series"]], LENGTH - x["p"]["ordinal"] if x["p"]["series"] == "y" else x["p"]["ordinal"], 0) for x in r.f]
                entries.append((f"{r.seq}{r.z}", 0, int(r.z), LENGTH, float(r.pmz), 0.0, 0.9, frags, None))
            yield pd.DataFrame({"name": [uuid.uuid4().hex], "content": [speclib_binary.encode(entries, ["P"])]})

    files = g.mapInPandas(pack, "name string, content binary")
    files.write.parquet(path)
    lib = speclib_binary.read_packed(spark.read.parquet(path).select("name", "content"))
    f = lib.select("group_id", "file", "modified", "charge", F.explode("fragments").alias("f"))
    return f.groupBy("modified", "charge", F.col("f.label").alias("label")).agg(F.count(F.lit(1)).alias("n_groups"))
