"""Centroids of raw frames: strong peaks gather the free peaks around them, frame by frame."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "frame_id long, mz double, mobility double, intensity double, n_peaks int, reason string"


def centroids(mz: np.ndarray, im: np.ndarray, intensity: np.ndarray, ppm: float, pct: float, max_peaks: int, early_stop: int) -> tuple[list[tuple], str]:
    """Clusters of one frame (mz, mobility, intensity, peaks) and why it stopped.

    Peaks are visited by the intensity around them, highest first. A free peak starts a cluster and takes
    the free peaks of its neighbourhood; a taken one gives those around it to its cluster. Positions are
    means weighted by whole intensities; a cluster of weights below 1 keeps its first peak's place. After
    ``early_stop`` new clusters in a row of fewer than 3 peaks the frame ends (0: never)."""
    order = np.argsort(mz, kind="stable")
    mz, im, intensity = mz[order], im[order], intensity[order]
    n = len(mz)
    lo, hi = np.searchsorted(mz, mz * (1 - ppm / 1e6), "left"), np.searchsorted(mz, mz * (1 + ppm / 1e6), "right")
    cum = np.r_[0.0, np.cumsum(intensity)]
    visit = np.argsort(-(cum[hi] - cum[lo]), kind="stable")
    owner = np.full(n, -1)
    heads: list[int] = []
    poor, included, reason = early_stop, 0, "all_taken"
    for i in visit:
        if len(heads) > max_peaks:
            reason = "max_peaks"
            break
        fresh = owner[i] < 0
        if fresh:
            owner[i] = len(heads)
            heads.append(int(i))
        near = np.arange(lo[i], hi[i])
        near = near[(owner[near] < 0) & (np.abs(im[near] - im[i]) <= im[i] * pct / 100)]
        owner[near] = owner[i]
        got = len(near) + fresh
        included += got
        if fresh and early_stop:
            poor = early_stop if got >= 3 else poor - 1
            if not poor:
                reason = "early_stop"
                break
        if included == n:
            break
    taken = owner >= 0
    k, w = len(heads), np.floor(intensity)
    at = owner[taken]
    total = np.bincount(at, w[taken], k)
    safe = np.where(total > 0, total, 1)
    cx = np.where(total > 0, np.bincount(at, (w * mz)[taken], k) / safe, mz[heads])
    cy = np.where(total > 0, np.bincount(at, (w * im)[taken], k) / safe, im[heads])
    return list(zip(cx, cy, np.bincount(at, intensity[taken], k), np.bincount(at, minlength=k))), reason


def centroid_frames(peaks: DataFrame, ppm: float = 10.0, pct: float = 3.0, max_peaks: int = 20_000, early_stop: int = 200, per_frame: Callable | None = None) -> DataFrame:
    """(frame_id, mz, mobility, intensity, n_peaks, reason). A frame is one scan of an instrument, so its
    size is bounded by the detector; frames are independent."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows, reason = centroids(g["mz"].to_numpy(float), g["mobility"].to_numpy(float), g["intensity"].to_numpy(float), ppm, pct, max_peaks, early_stop)
        return pd.DataFrame([(int(g["frame_id"].iloc[0]), *map(float, r[:3]), int(r[3]), reason) for r in rows], columns=["frame_id", "mz", "mobility", "intensity", "n_peaks", "reason"])

    ok = peaks.select("frame_id", "mz", "mobility", "intensity").na.drop().filter("intensity >= 0 and not isnan(mz) and not isnan(mobility)")
    return ok.groupBy("frame_id").applyInPandas(run, SCHEMA)


def summary(centroided: DataFrame) -> DataFrame:
    """Peaks in and out, per reason to stop."""
    return centroided.groupBy("reason").agg(F.countDistinct("frame_id").alias("n_frames"), F.sum("n_peaks").alias("peaks_in"), F.count(F.lit(1)).alias("peaks_out"))
