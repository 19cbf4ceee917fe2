"""Seeded runs with known contents: Gaussian elution of library ions, noise, and random bumps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Share of each isotope's height to the one before, and of the precursor to the fragments.
PRECURSOR_SHARE, ISOTOPE_STEP = 0.7, 0.6
WINDOWS = [(400.0, 600.0), (600.0, 800.0), (800.0, 1000.0)]
LABELS = ["y3", "y4", "y5", "b3", "b4", "y6"]


def library(n: int, seed: int = 42) -> pd.DataFrame:
    """Entries with sequences, precursors and six fragments each."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        seq = "".join(rng.choice(list("ACDEFGHILMNPQSTVWY"), rng.integers(7, 15))) + rng.choice(["K", "R"])
        frags = [{"label": lab, "mz": float(m), "intensity": float(h)} for lab, m, h in zip(LABELS, rng.uniform(200, 1500, len(LABELS)), rng.uniform(0.1, 1, len(LABELS)))]
        rows.append((i, seq, 2, i, True, float(rng.uniform(410, 990)), float(rng.uniform(60, 540)), float(rng.uniform(0.7, 1.3)), frags))
    return pd.DataFrame(rows, columns=["library_id", "sequence", "charge", "decoy_group", "is_target", "precursor_mz", "rt_seconds", "mobility", "fragments"])


LIBRARY_SCHEMA = "library_id long, sequence string, charge int, decoy_group long, is_target boolean, precursor_mz double, rt_seconds double, mobility double, fragments array<struct<label:string,mz:double,intensity:double>>"


def run(entries: pd.DataFrame, present: float = 0.8, cycles: int = 600, seed: int = 7, sigma: float = 2.0, height: float = 5000.0, slope: float = 1.02, offset: float = 8.0, noise: int = 20_000) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame, set[int]]:
    """(peaks, cycles, windows, ids of entries that are there). Times in the run are a line of the library's."""
    rng = np.random.default_rng(seed)
    there = set(entries.library_id[rng.random(len(entries)) < present])
    parts = []
    for e in entries.itertuples():
        if e.library_id not in there:
            continue
        apex = e.rt_seconds * slope + offset + rng.normal(0, 1)
        c = np.arange(max(0, int(apex - 4 * sigma)), min(cycles, int(apex + 4 * sigma) + 1))
        shape = np.exp(-0.5 * ((c - apex) / sigma) ** 2)
        ions = [(f["mz"], f["intensity"], next((k for k, w in enumerate(WINDOWS) if w[0] <= e.precursor_mz < w[1]), 0)) for f in e.fragments]
        ions += [(e.precursor_mz + k * 1.0033548378 / e.charge, PRECURSOR_SHARE * ISOTOPE_STEP**k, -1) for k in range(3)]
        for mz, h, w in ions:
            v = height * h * shape * rng.uniform(0.9, 1.1, len(c))
            parts.append(pd.DataFrame({"window_id": w, "mz": mz * (1 + rng.normal(0, 3e-6, len(c))), "intensity": v, "mobility": e.mobility * (1 + rng.normal(0, 0.004, len(c))), "cycle": c}))
    bumps = pd.DataFrame({"window_id": rng.integers(-1, len(WINDOWS), noise), "mz": rng.uniform(200, 1500, noise), "intensity": rng.uniform(1, 200, noise), "mobility": rng.uniform(0.6, 1.4, noise), "cycle": rng.integers(0, cycles, noise)})
    peaks = pd.concat([*parts, bumps], ignore_index=True)
    peaks = peaks[peaks.intensity > 1].copy()
    peaks.insert(0, "run_id", f"sim_{seed}")
    axis = pd.DataFrame({"run_id": f"sim_{seed}", "cycle": np.arange(cycles), "rt_ms": np.arange(cycles) * 1000})
    win = pd.DataFrame([(f"sim_{seed}", k, 0.0, 2.0, a, a, b, b) for k, (a, b) in enumerate(WINDOWS)], columns=["run_id", "window_id", "im0", "im1", "mz_lo0", "mz_lo1", "mz_hi0", "mz_hi1"])
    return peaks, axis, win, there


def frames(spark: SparkSession, n: int = 120, **kw) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, set[int]]:
    """(library, peaks, cycles, windows, ids that are there) as tables."""
    lib = library(n)
    peaks, cycles, windows, there = run(lib, **kw)
    return spark.createDataFrame(lib.to_dict("records"), LIBRARY_SCHEMA), spark.createDataFrame(peaks), spark.createDataFrame(cycles), spark.createDataFrame(windows), there


def recovered(results: DataFrame, there: set[int], thresholds: tuple[float, ...] = (0.01, 0.05, 0.1)) -> dict[float, dict[str, float]]:
    """Of a search of a run with known contents, at each q-value: targets, right ones, their share of what is there
    (sensitivity) and the share of wrong ones."""
    known = results.sparkSession.createDataFrame([(i,) for i in sorted(there)], "library_id long").withColumn("right", F.lit(True))
    t = results.filter("is_target").join(F.broadcast(known), "library_id", "left")
    out = {}
    for q in thresholds:
        n, right = t.filter(F.col("q_value") <= q).agg(F.count(F.lit(1)), F.count("right")).first()
        out[q] = {"targets": n, "right": right, "sensitivity": right / max(1, len(there)), "wrong_share": (n - right) / max(1, n)}
    return out


def auc(results: DataFrame, there: set[int], score: str = "discriminant_score") -> float:
    """How well a score tells entries that are there from all others."""
    from ionloom.operators.fdr import auc as area

    known = results.sparkSession.createDataFrame([(i,) for i in sorted(there)], "library_id long").withColumn("right", F.lit(True))
    t = results.join(F.broadcast(known), "library_id", "left").select(score, (F.coalesce("right", F.lit(False)) & F.col("is_target")).alias("positive"))
    return area(t, score).first()[0]
