"""Scores of a query's elution: the split product and the apex features, one Arrow pass over dense arrays.

A query is a row (query_id, apex, fragments array<array<double>>, expected array<double>, precursors
array<array<double>>, expected_precursors array<double>, cosine_profile, scribe_profile). Queries are
independent, so nothing is shuffled; pairwise correlations are what built-in functions can't express.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions.arrays import np_fwhm, np_pearson, np_unit_rows

# Offset and scale of each feature in the weighted score.
WEIGHTS = {
    "peak_shape": (1.0, 3.5), "ratio_cv": (1.0, 3.0), "centered_apex": (1.0, 4.5), "precursor_coelution": (1.0, 2.3), "fragment_coverage": (0.32, 1.0), "precursor_apex_match": (1.0, 8.0),
    "xic_quality": (1.0, 7.8), "fragment_apex_agreement": (0.43, 1.0), "isotope_correlation": (1.0, 2.6), "gaussian_correlation": (0.27, 1.0), "per_frag_gaussian_corr": (0.65, 1.0),
}


def around(n: int, apex: int, half: int) -> slice:
    return slice(max(0, apex - half), min(n, apex + half + 1))


def area_uniqueness(signal: np.ndarray, apex: int, half: int = 5) -> float:
    total = signal.sum()
    if total <= 0:
        return 0.0
    peak = signal[around(len(signal), apex, half)].sum()
    return float(peak * (1 + 200 * peak / total))


def _pair_mean(rows: np.ndarray, weights: np.ndarray) -> float:
    """Weighted mean of the correlations of all pairs of unit rows, from the square of their weighted sum."""
    if len(rows) < 2:
        return 0.0
    s = weights @ rows
    num, den = (s @ s - (weights**2) @ (rows**2).sum(axis=1)) / 2, (weights.sum() ** 2 - (weights**2).sum()) / 2
    return float(num / den) if den > 0 else 0.0


def coelution(fragments: np.ndarray, expected: np.ndarray, apex: int) -> tuple[float, float, float]:
    """(combined, weighted coelution, gradient consistency) around ``apex``."""
    live = expected > 0
    if not live.any() or not fragments.size:
        return 1.0, 0.0, 0.0
    n = fragments.shape[1]
    rows, ok = np_unit_rows(fragments[live][:, around(n, apex, 20)])
    if len(rows) < 2:
        return 1.0, 0.0, 0.0
    weighted = _pair_mean(rows, expected[live][ok] / expected.sum())
    diffs = np.diff(fragments[live][:, around(n, apex, 10)], axis=1)
    slopes = np_unit_rows(diffs)[0] if diffs.shape[1] else np.zeros((0, 0))
    gradient = _pair_mean(slopes, np.ones(len(slopes)))
    return (1 + 10 * max(weighted, 0.0)) * (1 + max(gradient, 0.0)), weighted, gradient


def split_product(cosine: np.ndarray, scribe: np.ndarray, fragments: np.ndarray, expected: np.ndarray) -> float:
    """Uniqueness times coelution, at the apex of the cosine and of the scribe profile."""
    out = 1.0
    for profile in (cosine, scribe):
        apex = int(np.argmax(profile)) if len(profile) else 0
        out *= area_uniqueness(profile, apex) * coelution(fragments, expected, apex)[0]
    return out


def _peak_shape(p: np.ndarray, apex: int) -> float:
    w = around(len(p), apex, 10)
    flank = min(apex - w.start, w.stop - 1 - apex)
    if flank < 2:
        return 0.5
    symmetry = np.clip(np_pearson(p[apex - flank : apex][::-1], p[apex + 1 : apex + 1 + flank]), 0, 1)
    sharp = max(1 - (p[w.start] + p[w.stop - 1]) / 2 / p[apex], 0.0) if p[apex] > 0 else 0.0
    return 0.5 * symmetry + 0.5 * sharp


def _gaussian(w: slice, apex: int, sigma: float) -> np.ndarray:
    return np.exp(-((np.arange(w.start, w.stop) - apex) ** 2) / (2 * sigma * sigma))


def apex_features(apex: int, fragments: np.ndarray, expected: np.ndarray, precursors: np.ndarray, expected_precursors: np.ndarray, cosine: np.ndarray) -> dict[str, float]:
    n_frag, n = fragments.shape
    at = fragments[:, apex] if n else np.zeros(n_frag)
    trace = np.maximum(precursors, 0).sum(axis=0) if precursors.size else np.zeros(n)
    f: dict[str, float] = {"peak_shape": _peak_shape(cosine, apex)}

    good = (expected > 0) & (at > 0)
    ratios = at[good] / expected[good]
    f["ratio_cv"] = 1 / (1 + ratios.std() / ratios.mean()) if len(ratios) >= 3 else 0.0
    f["centered_apex"] = max(1 - abs(apex - n / 2) / (n / 2), 0.0) if n else 0.0
    near = around(n, apex, 10)
    f["precursor_coelution"] = max(np_pearson(trace[near], fragments[:, near].sum(axis=0)), 0.0) if n else 0.0
    f["fragment_coverage"] = float((at > 0).mean()) if n_frag else 0.0
    close = max(1 - abs(int(np.argmax(trace)) - apex) / (n / 4), 0.0) if n else 0.0
    f["precursor_apex_match"] = 0.5 * close + 0.5 * (trace[apex] / trace.sum() if n and trace.sum() > 0 else 0.0)

    w = around(n, apex, 8)
    win = fragments[:, w]
    f["xic_quality"] = 0.0
    if n_frag and win.shape[1] >= 2:
        top, where = win.max(axis=1), win.argmax(axis=1)
        live = top > 0
        aligned = np.maximum(1 - np.abs(where - (apex - w.start)) / (win.shape[1] / 2), 0)
        sharp = np.maximum(1 - (win[:, 0] + win[:, -1]) / 2 / np.where(live, top, 1), 0)
        f["xic_quality"] = float((0.5 * aligned + 0.5 * sharp)[live].sum() / n_frag)
    tops = fragments.max(axis=1) if n else np.zeros(n_frag)
    f["fragment_apex_agreement"] = float(((np.abs(fragments.argmax(axis=1) - apex) <= 2) & (tops > 0)).mean()) if n_frag and n else 0.0

    obs, exp = np.zeros(3), np.zeros(3)
    k = min(3, len(precursors))
    obs[:k] = precursors[:k, apex] if k else 0
    k = min(3, len(expected_precursors))
    exp[:k] = expected_precursors[:k]
    norm = np.sqrt((obs @ obs) * (exp @ exp))
    f["isotope_correlation"] = float(np.clip(obs @ exp / norm, 0, 1)) if ((obs > 0) & (exp > 0)).sum() >= 2 and norm >= 1e-24 else 0.0

    w = around(len(cosine), apex, 15)
    f["gaussian_correlation"] = max(np_pearson(cosine[w], _gaussian(w, apex, max(np_fwhm(cosine, apex) / 2.355, 0.5))), 0.0) if w.stop - w.start >= 3 else 0.0
    f["per_frag_gaussian_corr"] = 0.0
    if near.stop - near.start >= 3 and (tops > 0).any():
        ref = _gaussian(near, apex, max((near.stop - near.start) / 6, 1.0))
        f["per_frag_gaussian_corr"] = float(np.mean([max(np_pearson(row[near], ref), 0.0) for row in fragments[tops > 0]]))
    return f


def weighted_score(base: float, features: dict[str, float]) -> float:
    return base * float(np.prod([offset + scale * features[k] for k, (offset, scale) in WEIGHTS.items()]))


SCHEMA = "query_id long, base_score double, " + ", ".join(f"{k} double" for k in WEIGHTS) + ", main_score double"
INPUT = ["query_id", "apex", "fragments", "expected", "precursors", "expected_precursors", "cosine_profile", "scribe_profile"]


def score_row(apex, fragments, expected, precursors, expected_precursors, cosine, scribe) -> list[float]:
    frag, cos = np.array(fragments, dtype=float), np.array(cosine, dtype=float)
    frag = frag.reshape(len(fragments), -1) if len(fragments) else np.zeros((0, len(cos)))
    prec = np.array(precursors, dtype=float).reshape(len(precursors), -1) if len(precursors) else np.zeros((0, len(cos)))
    exp = np.array(expected, dtype=float)
    base = split_product(cos, np.array(scribe, dtype=float), frag, exp)
    f = apex_features(int(apex), frag, exp, prec, np.array(expected_precursors, dtype=float), cos)
    return [base, *(float(f[k]) for k in WEIGHTS), weighted_score(base, f)]


def scores(queries: DataFrame) -> DataFrame:
    """Split product, the eleven features and their weighted product per query; rows with a null are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            rows = [[q, *score_row(*rest)] for q, *rest in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 0 else pa.float64()) for i in range(len(names))], names=names)

    return queries.select(*INPUT).na.drop().mapInArrow(run, SCHEMA)


# What a rescoring model sees of a scored table.


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))


def mz_bin(mz: Column, width: float = 5.0) -> Column:
    """A mass to charge as the bin it falls in, so that a model can't learn single precursors."""
    return (F.round(mz / width) * width).cast("double")


def transforms(value: Column, kind: str) -> Column:
    """raw, ln1p (of the value, at least 0) or round."""
    if kind == "raw":
        return value.cast("double")
    if kind == "ln1p":
        return F.log1p(F.greatest(value.cast("double"), F.lit(0.0)))
    if kind == "round":
        return F.round(value.cast("double"))
    raise ValueError(kind)


def mean_abs(errors: Column) -> Column:
    """Mean size of the finite errors of an array that aren't 0; null if there is none."""
    ok = F.filter(errors, lambda e: finite(e) & (e != 0))
    return F.when(F.size(ok) > 0, F.aggregate(ok, F.lit(0.0), lambda a, e: a + F.abs(e.cast("double"))) / F.size(ok))


def derived(rows: DataFrame) -> DataFrame:
    """Adds what depends on several scores: ratio and product of the main score and its lead, the split
    product times coverage, and the error in retention."""
    c = F.col
    return rows.withColumns({
        "main_over_delta_next": c("main_score") / F.when(c("delta_next") != 0, c("delta_next")),
        "main_times_delta_next": c("main_score") * c("delta_next"),
        "split_x_coverage": c("base_score") * c("fragment_coverage"),
        "rt_error": c("obs_rt_seconds") - c("rt_calibrated"),
    })


def neutralised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns that come from mobility as null, for runs whose mobility can't be searched."""
    return rows.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in columns if c in rows.columns})
