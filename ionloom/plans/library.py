"""Building spectral libraries: digest, modify, charge, decoys, predict, filter."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.functions import chemistry as C
from ionloom.operators import peptides


@dataclass(frozen=True)
class Build:
    missed: int = 1
    shortest: int = 7
    longest: int = 30
    fixed: tuple[tuple[str, str], ...] = (("C", "[UNIMOD:4]"),)
    variable: tuple[tuple[str, str], ...] = ()
    most_variable: int = 1
    charges: tuple[int, int] = (2, 3)
    decoys: str = "reverse"  # none, reverse, mutate
    precursor_mz: tuple[float, float] = (300.0, 1500.0)
    fragment_mz: tuple[float, float] = (150.0, 2000.0)
    fragments: tuple[int, int] = (3, 12)

    def __post_init__(self):
        if self.decoys not in ("none", "reverse", "mutate"):
            raise ValueError(f"decoys: {self.decoys}")
        for lo, hi in ((self.shortest, self.longest), self.charges, self.precursor_mz, self.fragment_mz, self.fragments):
            if lo > hi:
                raise ValueError(f"an empty range: {lo} to {hi}")


Predictor = Callable[[pd.DataFrame], pd.DataFrame]
PREDICTED = "fragments array<struct<label:string,mz:double,intensity:double>>, irt double"


def ladder(frame: pd.DataFrame) -> pd.DataFrame:
    """An offline predictor: b and y ions of the bare sequence with smooth heights, and a retention time by
    composition. It stands in for a prediction service where there is none."""
    out = []
    for seq in frame["plain"]:
        masses = np.array([C.RESIDUES[r] for r in seq])
        b, y = np.cumsum(masses)[:-1] + C.PROTON, np.cumsum(masses[::-1])[:-1] + C.WATER + C.PROTON
        n = len(seq)
        out.append(([{"label": f"{s}{k + 1}", "mz": float(m[k]), "intensity": float(w * np.sin(np.pi * (k + 1) / n))} for s, m, w in (("b", b, 0.5), ("y", y, 1.0)) for k in range(n - 1)], float(sum(masses) / 20 + 3 * sum(seq.count(r) for r in "FILMVW"))))
    return pd.DataFrame(out, columns=["fragments", "irt"])


def request_tensors(frame: pd.DataFrame, energy: float = 30.0, intensities: bool = True) -> dict:
    """The body a prediction service expects for a batch of peptides."""
    n = len(frame)
    t = lambda name, kind, data: {"name": name, "shape": [n, 1], "datatype": kind, "data": data}
    inputs = [t("peptide_sequences", "BYTES", list(frame["sequence"]))]
    if intensities:
        inputs += [t("precursor_charges", "INT32", [int(z) for z in frame["charge"]]), t("collision_energies", "FP32", [energy] * n)]
    return {"id": "0", "inputs": inputs}


def response_fragments(response: dict) -> list[list[dict]]:
    """Fragments per peptide of a service's answer: zero heights go, ``y1+2`` is ``y1^2``."""
    got = {o["name"]: o for o in response["outputs"]}
    n, k = got["intensities"]["shape"]
    out = []
    for i in range(n):
        row = []
        for a, m, h in zip(*(got[name]["data"][i * k : (i + 1) * k] for name in ("annotation", "mz", "intensities"))):
            if h > 0:
                base, plus, z = a.rpartition("+")
                label = a if not plus else base if z == "1" else f"{base}^{z}"
                row.append({"label": label, "mz": float(m), "intensity": float(h)})
        out.append(row)
    return out


def service(url: str, rt_url: str, timeout: float = 60.0) -> Predictor:
    """A predictor that asks a service for fragments and retention, a batch at a time."""

    def ask(to: str, body: dict) -> dict:
        req = urllib.request.Request(to, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(req, timeout=timeout) as r:
            return json.load(r)

    def predict(frame: pd.DataFrame) -> pd.DataFrame:
        frags = response_fragments(ask(url, request_tensors(frame)))
        irt = ask(rt_url, request_tensors(frame, intensities=False))["outputs"][0]["data"]
        return pd.DataFrame({"fragments": frags, "irt": [float(x) for x in irt]})

    return predict


def candidates(proteins: DataFrame, settings: Build = Build()) -> DataFrame:
    """(plain, sequence, charge, decoy, decoy_group): every peptide form before prediction. A form's decoy
    group is its bare peptide's, shared by all its variants and charges."""
    p = peptides.standard_only(peptides.distinct_peptides(peptides.digest(proteins, settings.missed, settings.shortest, settings.longest)))
    return forms(p.select(F.col("peptide").alias("plain")), settings)


def forms(plain: DataFrame, settings: Build) -> DataFrame:
    f = plain.filter(F.col("plain").rlike(f"^[{C.CANONICAL}]+$")).dropDuplicates(["plain"]).withColumn("decoy_group", F.abs(F.xxhash64("plain")))
    if settings.decoys != "none":
        made = C.reverse_decoy(F.col("plain")) if settings.decoys == "reverse" else C.mutate_decoy(F.col("plain"))
        both = F.array(F.struct(F.col("plain").alias("s"), F.lit(False).alias("d")), F.struct(made.alias("s"), F.lit(True).alias("d")))
        f = f.withColumn("_b", F.explode(both)).filter("not _b.d or _b.s <> plain").select(F.col("_b.s").alias("plain"), "decoy_group", F.col("_b.d").alias("decoy"))
    else:
        f = f.withColumn("decoy", F.lit(False))
    f = f.withColumn("sequence", F.col("plain"))
    for residue, notation in settings.variable:
        f = peptides.variable_mods(f, residue, notation, settings.most_variable, "sequence").drop("sequence", "n_mods").withColumnRenamed("modified", "sequence")
    for residue, notation in settings.fixed:
        f = f.withColumn("sequence", C.fixed_mod(F.col("sequence"), residue, notation))
    return peptides.charge_states(f, *settings.charges)


def predicted(forms_: DataFrame, predictor: Predictor = ladder) -> DataFrame:
    """Adds fragments and irt, asked for in Arrow batches."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in forms_.schema.fields) + ", " + PREDICTED

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.concat([f.reset_index(drop=True), predictor(f.reset_index(drop=True))], axis=1)

    return forms_.mapInPandas(run, schema)


def entries(predicted_: DataFrame, settings: Build = Build()) -> DataFrame:
    """Library entries: precursor and fragments within limits, the highest fragments kept, too few of them drop the entry."""
    z = F.col("charge")
    mz = C.peptide_mz(F.col("sequence"), z)
    e = predicted_.withColumn("precursor_mz", mz).filter(F.col("precursor_mz").between(*settings.precursor_mz))
    ok = F.filter("fragments", lambda f: f.mz.between(*settings.fragment_mz) & (f.intensity > 0))
    top = F.slice(F.array_sort(F.transform(ok, lambda f, i: F.struct((-f.intensity).alias("k"), i.alias("i"), f.alias("f")))), 1, settings.fragments[1])
    e = e.withColumn("fragments", F.transform(top, lambda s: s.f)).filter(F.size("fragments") >= settings.fragments[0])
    cs = C.carbons_sulphurs(F.col("plain"))
    return e.select("sequence", "charge", "decoy", "decoy_group", "precursor_mz", C.isotope_envelope(*cs).alias("precursor_intensities"), C.one_over_k0(F.col("precursor_mz"), z).alias("mobility"), F.col("irt").alias("rt_seconds"), "fragments")


def build(proteins: DataFrame, settings: Build = Build(), predictor: Predictor = ladder) -> DataFrame:
    return entries(predicted(candidates(proteins, settings), predictor), settings)
