"""Retention times in many units, all brought to milliseconds.

A unit written with the value goes first, then the source's unit column, then the unit its note gives.
Where none is given, values of the source are assigned by a mixture on the log scale: the density of all
known times, shifted by each unit's conversion factor, with weights fitted by expectation maximisation
over a histogram; the posterior of the chosen unit says how sure that is. Under ``fallback='default'`` the
documented unit of the column is what counts and the mixture only flags it; under ``'posterior'`` the
mixture decides wherever its posterior is at least ``SURE``.

Defined results: null, placeholder, NaN and infinite values give no row; a source that is null or not
listed counts as a source without a unit; a comma is a decimal mark; clock times and ISO durations carry
their own unit; half a millisecond rounds away from zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.runtime import sized_join, stored

# Milliseconds per unit, and the spellings of each.
FACTORS = {"ms": 1, "s": 1000, "cmin": 600, "min": 60_000, "h": 3_600_000}
SPELLINGS = {
    "ms": r"ms|msecs?|millisec(?:ond)?s?|millisekunden?",
    "s": r"s|secs?|seconds?|sekunden?|sek",
    "min": r"m|mins?|minutes?|minuten?",
    "h": r"h|hrs?|hours?|stunden?|std",
}
ANY = "|".join(SPELLINGS.values())
BINS_PER_DECADE = 20
SURE = 0.9
NUMBER = r"[+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:e[+-]?\d+)?"


def unit_of(text: Column) -> Column:
    """The unit that a text names and nothing else, or null."""
    t = F.regexp_replace(F.lower(F.trim(text)), r"^[\[(]?\s*|\s*[\])]?\.?$", "")
    out = F.when(t.rlike(r"^(?:0[.,]01 ?min|1/100 ?min|centimin(?:ute)?s?)$"), "cmin")
    for unit, names in SPELLINGS.items():
        out = out.when(t.rlike(rf"^(?:{names})$"), unit)
    return out


def note_unit(note: Column) -> Column:
    """The unit a note gives for retention: a unit word that isn't a quantity (``90 min``) and isn't denied."""
    t = F.lower(note)
    t = F.regexp_replace(t, r"(?:not|never)\s+(?:\w+\s+){0,3}?(?:as|in)\s+\w+", " ")
    hundredth = t.rlike(r"hundredths? of a min|0[.,]01 ?min|1/100 ?(?:of a )?min|centimin")
    # Quantities say nothing about the column's unit.
    t = F.regexp_replace(t, rf"\b\d+(?:[.,]\d+)?\s*(?:{ANY})\b", " ")
    first = F.regexp_extract(t, rf"(?<![\w'])({ANY})(?![\w'])", 1)
    return F.when(hundredth, "cmin").when(first != "", unit_of(first))


def source_units(sources: DataFrame) -> DataFrame:
    """(source_id, unit, unit_origin), one row per source."""
    s = sources.filter("source_id is not null").groupBy("source_id").agg(F.max("rt_unit").alias("rt_unit"), F.max("note").alias("note"))
    named, noted = unit_of(F.col("rt_unit")), note_unit(F.col("note"))
    return s.select("source_id", F.coalesce(named, noted).alias("source_unit"), F.when(named.isNotNull(), "source").when(noted.isNotNull(), "note").alias("source_origin"))


def with_parsed(df: DataFrame) -> DataFrame:
    """Adds number and text_unit: the number as written in ``value`` and the unit written with it, null if
    none is. Clock times and durations of several parts come as milliseconds. Rows that hold no time go.

    Each step is a column of its own and the result passes a generator, so that no step is computed twice
    and no filter pulls the whole chain below it."""
    num = lambda c: F.regexp_replace(c, ",", ".").try_cast("double")
    text = F.regexp_replace(F.lower(F.col("value")), "[\u00a0\u2007\u2009\u202f\\s]+", " ")
    text = F.regexp_replace(F.translate(text, "\u2212\u2013\u2012", "---"), r"^ ?(?:i?rt|tr)\b ?[:=]? ?", "")
    t, unit = F.col("_il_t"), F.col("_il_unit")
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)

    def part(pattern: str, g: int) -> Column:
        return F.coalesce(num(F.regexp_extract(t, pattern, g)), F.lit(0.0))

    hms, ms = r"^[+-]?(\d+):(\d{1,2}):(\d{1,2}(?:[.,]\d*)?)$", r"^[+-]?(\d+):(\d{1,2}(?:[.,]\d*)?)$"
    iso = r"^[+-]?pt(?:(\d+(?:[.,]\d+)?)h)?(?:(\d+(?:[.,]\d+)?)m)?(?:(\d+(?:[.,]\d+)?)s)?$"
    parts = rf"^[+-]?(?:(\d+(?:[.,]\d+)?) ?(?:{SPELLINGS['h']})\.? ?)?(?:(\d+(?:[.,]\d+)?) ?(?:{SPELLINGS['min']})\.? ?)?(?:(\d+(?:[.,]\d+)?) ?(?:{SPELLINGS['s']})\.?)?$"
    single = rf"^({NUMBER}) ?[\[(]? ?([a-z/][a-z/.,0-9 ]*?)\.?[\])]?$"
    several = lambda p, a, b, c: sign * (part(p, a) * 3_600_000 + part(p, b) * 60_000 + part(p, c) * 1000)
    clock = (
        F.when(t.rlike(hms), several(hms, 1, 2, 3))
        .when(t.rlike(ms), sign * (part(ms, 1) * 60_000 + part(ms, 2) * 1000))
        .when(t.rlike(iso) & t.rlike(r"pt\d"), several(iso, 1, 2, 3))
        .when(t.rlike(parts) & t.rlike(r"\d"), several(parts, 1, 2, 3))
    )
    out = df.withColumn("_il_t", F.trim(text)).withColumn("_il_plain", num(t))
    out = out.withColumn("_il_unit", F.when(F.col("_il_plain").isNull(), unit_of(F.regexp_extract(t, single, 2))))
    number = F.when(F.col("_il_plain").isNotNull(), F.col("_il_plain")).when(unit.isNotNull(), num(F.regexp_extract(t, single, 1))).otherwise(clock)
    got = F.array(F.struct(number.alias("number"), F.when(F.col("_il_plain").isNotNull(), F.lit(None).cast("string")).otherwise(F.coalesce(unit, F.lit("ms"))).alias("text_unit")))
    return out.select(*df.columns, F.inline(got)).filter("number is not null and not isnan(number) and abs(number) < 1e300")


def factor(unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for u, f in FACTORS.items():
        out = F.when(unit == u, float(f)).otherwise(out)
    return out


def _bin(x: Column) -> Column:
    return F.floor(F.log10(F.abs(x)) * BINS_PER_DECADE).cast("int")


def mixture(known: np.ndarray, origin: int, bins: np.ndarray, counts: np.ndarray, rounds: int = 20) -> dict[str, float]:
    """Weights of the units for one source and column: ``known`` is the density of log times from bin
    ``origin`` on; each component is that density moved by a unit's factor."""
    like = []
    for f in FACTORS.values():
        at = bins + int(round(np.log10(f) * BINS_PER_DECADE)) - origin
        like.append(np.where((at >= 0) & (at < len(known)), known[np.clip(at, 0, len(known) - 1)], 0.0) + 1e-6)
    like_ = np.array(like)
    weight = np.full(len(FACTORS), 1 / len(FACTORS))
    for _ in range(rounds):
        post = weight[:, None] * like_
        post /= post.sum(axis=0)
        weight = (post * counts).sum(axis=1) / counts.sum()
    return dict(zip(FACTORS, weight))


def unlabelled_units(values: DataFrame) -> DataFrame:
    """(source_id, field_name, mix_unit, mix_posterior) for sources without a unit.

    The histogram of known times has at most a few hundred bins; each source's is a group of that bound."""
    known = values.filter("unit is not null and number <> 0").select(_bin(F.col("number") * factor(F.col("unit"))).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).filter("bin between -200 and 400").toPandas()
    origin = -200
    density = np.zeros(601)
    if len(known):
        density[known["bin"] - origin] = known["n"]
    smooth = np.convolve(density, [0.25, 0.5, 0.25], "same")
    smooth = smooth / smooth.sum() if smooth.sum() else np.full(601, 1 / 601)
    hist = values.filter("unit is null and number <> 0").groupBy("source_id", "field_name", _bin(F.col("number")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        w = mixture(smooth, origin, g["bin"].to_numpy(), g["n"].to_numpy(dtype=float))
        unit = max(w, key=w.get)
        return pd.DataFrame({"source_id": g["source_id"].iloc[:1], "field_name": g["field_name"].iloc[:1], "mix_unit": [unit], "mix_posterior": [w[unit]]})

    return hist.groupBy("source_id", "field_name").applyInPandas(fit, "source_id int, field_name string, mix_unit string, mix_posterior double")


def to_milliseconds(values: DataFrame, sources: DataFrame, defaults: dict[str, str], fallback: str = "default") -> DataFrame:
    """``values`` has rec_table, rec_id, source_id, field_name and value (text), and is read once. Adds number, unit,
    unit_origin (text, source, note, default or mixture), rt_ms, mix_unit, mix_posterior and uncertain."""
    values = values.select("rec_table", "rec_id", F.col("source_id").cast("int"), "field_name", F.col("value").cast("string"))
    read = with_parsed(values)
    read = sized_join(read, source_units(sources), ["source_id"])
    read = read.withColumn("unit", F.coalesce("text_unit", "source_unit")).withColumn("unit_origin", F.when(F.col("text_unit").isNotNull(), "text").otherwise(F.col("source_origin")))
    # Texts are parsed once; the mixture and the result read the numbers.
    read = stored(read.drop("text_unit", "source_unit", "source_origin"))
    key = F.coalesce(F.col("source_id"), F.lit(-(2**31))).alias("source_id")
    mix = unlabelled_units(read.select(key, "field_name", "number", "unit")).withColumnRenamed("source_id", "_il_key")
    read = sized_join(read.withColumn("_il_key", key), mix, ["_il_key", "field_name"]).drop("_il_key")
    default = F.lit(None).cast("string")
    for name, u in defaults.items():
        default = F.when(F.col("field_name") == name, u).otherwise(default)
    sure = F.lit(fallback == "posterior") & (F.col("mix_posterior") >= SURE)
    chosen = F.when(sure, F.col("mix_unit")).otherwise(default)
    missing = F.col("unit").isNull()
    read = read.withColumn("uncertain", missing & ((F.col("mix_posterior") < SURE) | (F.col("mix_unit") != chosen) | F.col("mix_unit").isNull()))
    read = read.withColumn("unit_origin", F.coalesce("unit_origin", F.when(sure, "mixture").otherwise("default"))).withColumn("unit", F.coalesce("unit", chosen))
    # A billionth of a unit is kept before rounding, which removes what binary fractions add.
    exact = F.round(F.round(F.col("number") * factor(F.col("unit")), 4), 0).cast("long")
    return read.withColumn("rt_ms", exact).select("rec_table", "rec_id", "source_id", "field_name", "value", "number", "unit", "unit_origin", "rt_ms", "mix_unit", "mix_posterior", "uncertain")


def retention_values(sample_lib: DataFrame, elution_groups: DataFrame) -> DataFrame:
    """The three retention columns as (rec_table, rec_id, source_id, field_name, value)."""
    lib = F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("value")) for c in ("irt", "tr_recalibrated")])
    a = sample_lib.select(F.lit("sample_lib").alias("rec_table"), F.col("lib_row_id").cast("long").alias("rec_id"), "source_id", F.explode(lib).alias("f")).select("rec_table", "rec_id", "source_id", "f.field_name", "f.value")
    b = elution_groups.select(F.lit("elution_groups").alias("rec_table"), F.col("eg_id").cast("long").alias("rec_id"), "source_id", F.lit("rt_seconds").alias("field_name"), F.col("rt_seconds").cast("string").alias("value"))
    return a.unionByName(b)


#: The documented units of the three columns.
DEFAULTS = {"irt": "min", "tr_recalibrated": "min", "rt_seconds": "s"}
