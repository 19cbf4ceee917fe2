"""Spectral libraries in text and Parquet: two tab dialects, a dotted Parquet form, a tab form with an
exclusion flag, and a comma form without retention.

All give the same rows: (group_id, modified, stripped, precursor_mz, charge, rt_seconds, mobility, protein,
decoy, fragments array<struct<label, mz, intensity>>). A group is a run of neighbouring rows with equal
precursor columns; the same precursor further down is another group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.functions.chemistry import bare, ion_label
from ionloom.operators.sequence import neighbours, numbered, running_sums

# Column names of each form, by what they hold.
DIANN = {
    "modified": ("ModifiedPeptide",), "stripped": ("StrippedPeptide", "PeptideSequence"), "precursor_mz": ("PrecursorMz",), "charge": ("PrecursorCharge",), "rt": ("Tr_recalibrated",), "mobility": ("IonMobility",),
    "protein": ("ProteinID", "ProteinGroup"), "decoy": ("Decoy", "decoy"), "mz": ("FragmentMz", "ProductMz"), "series": ("FragmentType",), "ordinal": ("FragmentNumber", "FragmentSeriesNumber"),
    "fcharge": ("FragmentCharge",), "loss": ("FragmentLossType",), "intensity": ("RelativeIntensity", "LibraryIntensity"),
}
DIANN_PARQUET = {
    "modified": ("Modified.Sequence",), "stripped": ("Stripped.Sequence",), "precursor_mz": ("Precursor.Mz",), "charge": ("Precursor.Charge",), "rt": ("RT",), "mobility": ("IM",), "protein": ("Protein.Group",), "decoy": ("Decoy",),
    "mz": ("Product.Mz",), "series": ("Fragment.Type",), "ordinal": ("Fragment.Series.Number",), "fcharge": ("Fragment.Charge",), "loss": ("Fragment.Loss.Type",), "intensity": ("Relative.Intensity",),
}
SPECTRONAUT = {
    "modified": ("ModifiedPeptide",), "stripped": ("StrippedPeptide",), "precursor_mz": ("PrecursorMz",), "charge": ("PrecursorCharge",), "rt": ("iRT",), "mobility": ("IonMobility",), "protein": ("ProteinGroups",),
    "mz": ("FragmentMz",), "series": ("FragmentType",), "ordinal": ("FragmentNumber",), "fcharge": ("FragmentCharge",), "loss": ("FragmentLossType",), "intensity": ("RelativeIntensity",), "excluded": ("ExcludeFromAssay",),
}
SKYLINE = {
    "protein": ("Protein Name",), "modified": ("Peptide Modified Sequence",), "precursor_mz": ("Precursor Mz",), "charge": ("Precursor Charge",), "mz": ("Product Mz",), "fcharge": ("Product Charge",),
    "series": ("Fragment Ion Type",), "ordinal": ("Fragment Ion Ordinal",), "decoy": ("Transition Is Decoy",), "intensity": ("Library Intensity",),
}
OPTIONAL = {"intensity"}
PRECURSOR = ["modified", "stripped", "precursor_mz", "charge", "rt", "mobility", "protein", "decoy"]


def resolve(columns: list[str], names: dict[str, tuple[str, ...]]) -> dict[str, str] | None:
    """The columns of a form by what they hold; None if a required one is missing."""
    got = {k: next((a for a in alias if a in columns), None) for k, alias in names.items()}
    if any(v is None and not (k in OPTIONAL and names is SKYLINE) for k, v in got.items()):
        return None
    return {k: v for k, v in got.items() if v is not None}


def ordered_rows(df: DataFrame) -> DataFrame:
    """Adds the file, and the place of each row in it as ``seq``."""
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_row", F.monotonically_increasing_id())
    return numbered(placed, ["_file"], ["_block", "_row"]).drop("_block", "_row")


def _assemble(rows: DataFrame, keep: Column | None = None) -> DataFrame:
    """Groups of neighbouring rows; with ``keep``, rows beyond it go, and a group none of whose rows stay."""
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PRECURSOR])
    flagged = neighbours(rows.withColumn("_key", key), ["_file"], "seq", ["_key"])
    start = (F.col("prev__key").isNull() | (F.col("prev__key") != F.col("_key"))).cast("long")
    grouped = running_sums(flagged, [F.asc("seq")], {"group_id": start}, ["_file"])
    if keep is not None:
        grouped = grouped.filter(keep)
    frags = F.array_sort(F.collect_list(F.struct("seq", F.col("label"), F.col("mz").cast("double").alias("mz"), F.col("intensity").cast("float").alias("intensity"))))
    first = F.min_by(F.struct(*PRECURSOR), F.col("seq"))
    out = grouped.groupBy("_file", (F.col("group_id") - 1).alias("group_id")).agg(first.alias("_p"), frags.alias("_f"))
    return out.select("_file", "group_id", "_p.modified", "_p.stripped", F.col("_p.precursor_mz").cast("double").alias("precursor_mz"), F.col("_p.charge").cast("int").alias("charge"), F.col("_p.rt").cast("double").alias("rt_seconds"), F.col("_p.mobility").cast("double").alias("mobility"), "_p.protein", F.col("_p.decoy").cast("int").alias("decoy"), F.transform("_f", lambda s: F.struct(s.label.alias("label"), s.mz.alias("mz"), s.intensity.alias("intensity"))).alias("fragments")).withColumnRenamed("_file", "file")


def _label(place: Column) -> Column:
    """series, ordinal and charge; an ion with a loss or an unknown series is ``?place``."""
    known = F.col("series").rlike("^[abcxyz]$") & (F.coalesce(F.col("loss"), F.lit("noloss")) == "noloss")
    return F.when(known, ion_label(F.col("series"), F.col("ordinal").cast("int"), F.lit(0), F.col("fcharge").cast("int"))).otherwise(F.concat(F.lit("?"), place.cast("string")))


def _named(df: DataFrame, got: dict[str, str]) -> list[Column]:
    return [F.col(f"`{src}`").alias(k) for k, src in got.items()]


def _read(df: DataFrame, names: dict, **defaults: Column) -> DataFrame:
    got = resolve(df.columns, names)
    if got is None:
        raise ValueError(f"not this kind of library; columns are {df.columns}")
    rows = ordered_rows(df).select("_file", "seq", *_named(df, got))
    for k, c in defaults.items():
        if k not in got:
            rows = rows.withColumn(k, c)
    return rows


def read_diann(spark: SparkSession, path: str) -> DataFrame:
    """Retention minutes become seconds; a decoy flag other than 0 and 1 fails the load."""
    rows = _read(spark.read.csv(path, sep="\t", header=True, quote='"', escape='"'), DIANN)
    bad = F.when(F.col("decoy").isin("0", "1"), F.col("decoy")).otherwise(F.raise_error(F.concat(F.lit("decoy flag: "), F.coalesce("decoy", F.lit("null")))))
    return _assemble(rows.withColumn("decoy", bad).withColumn("rt", F.col("rt").cast("double") * 60).withColumn("label", _label(F.col("seq"))))


def read_diann_parquet(spark: SparkSession, path: str) -> DataFrame:
    rows = _read(spark.read.parquet(path), DIANN_PARQUET)
    return _assemble(rows.withColumn("rt", F.col("rt").cast("double") * 60).withColumn("label", _label(F.col("seq"))))


def read_spectronaut(spark: SparkSession, path: str) -> DataFrame:
    """Targets only; rows flagged for exclusion go, and precursors of which all do."""
    rows = _read(spark.read.csv(path, sep="\t", header=True), SPECTRONAUT, decoy=F.lit(0))
    rows = rows.withColumn("rt", F.col("rt").cast("double") * 60).withColumn("label", _label(F.col("seq")))
    return _assemble(rows, F.lower(F.coalesce("excluded", F.lit("false"))) != "true")


def read_skyline(spark: SparkSession, path: str) -> DataFrame:
    """Precursor rows go; #N/A is null, a missing intensity 1; no retention or mobility (0)."""
    df = spark.read.csv(path, header=True, nullValue="#N/A", quote='"', escape='"')
    rows = _read(df, SKYLINE, intensity=F.lit(1.0), rt=F.lit(0.0), mobility=F.lit(0.0), loss=F.lit("noloss"))
    rows = rows.withColumn("stripped", bare(F.col("modified"))).withColumn("decoy", F.lower(F.coalesce("decoy", F.lit("false"))).isin("true", "1").cast("int"))
    rows = rows.withColumn("intensity", F.coalesce(F.col("intensity").cast("double"), F.lit(1.0))).withColumn("label", _label(F.col("seq")))
    return _assemble(rows, F.lower(F.coalesce("series", F.lit(""))) != "precursor")


def read_elution_groups(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON elution groups (one array, or ``lines`` of objects), with the accepted other names; labels default to places."""
    names = {
        "precursor_mz": ("precursor", "precursor_mz", "precursor_mono_mz"), "mzs": ("fragments", "fragment_mzs", "fragment_mono_mzs"), "labels": ("fragment_labels",), "isotopes": ("precursor_isotopes",),
    }
    schema = "id long, mobility float, rt_seconds float, precursor double, precursor_mz double, precursor_mono_mz double, precursor_charge short, precursor_isotopes array<int>, fragments array<double>, fragment_mzs array<double>, fragment_mono_mzs array<double>, fragment_labels array<string>"
    df = spark.read.schema(schema).json(path, multiLine=not lines)
    first = lambda k: F.coalesce(*[F.col(c) for c in names[k]])
    mzs = first("mzs")
    labels = F.coalesce(first("labels"), F.transform(mzs, lambda x, i: i.cast("string")))
    return df.select("id", first("precursor_mz").alias("precursor_mz"), F.col("precursor_charge").alias("charge"), "mobility", "rt_seconds", F.coalesce(first("isotopes"), F.array(F.lit(0))).alias("isotopes"), F.zip_with(labels, mzs, lambda a, b: F.struct(a.alias("label"), b.alias("mz"))).alias("fragments"))


def write_elution_group_templates(folder: str) -> list[str]:
    """Example query files: a narrow and a wide tolerance, and two elution groups."""
    import json
    import os

    os.makedirs(folder, exist_ok=True)
    files = {
        "tolerance_narrow.json": {"ms": {"ppm": [10.0, 10.0]}, "rt": {"minutes": [0.5, 0.5]}, "mobility": {"pct": [5.0, 5.0]}, "quad": {"da": [1.05, 1.05]}},
        "tolerance_wide.json": {"ms": {"da": [0.04, 0.04]}, "rt": "Unrestricted", "mobility": {"pct": [20.0, 20.0]}, "quad": {"da": [0.2, 0.2]}},
        "elution_groups.json": [{"id": i, "mobility": 0.9, "rt_seconds": 60.0 * (i + 1), "precursor_mz": 500.0 + i, "precursor_charge": 2, "fragment_mzs": [300.1, 400.2 + i], "fragment_labels": ["y3", "y4"]} for i in range(2)],
    }
    for name, o in files.items():
        with open(os.path.join(folder, name), "w") as f:
            json.dump(o, f, indent=2)
    return sorted(files)
