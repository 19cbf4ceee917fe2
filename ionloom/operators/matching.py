"""Matching two libraries by precursor and shared fragments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.runtime import sized_join

SHARED = 5


def mz_key(mz: Column, digits: int = 2) -> Column:
    """Whole-number key of an m/z at so many digits."""
    return F.round(mz * 10**digits).cast("long")


def shared_count(a: np.ndarray, b: np.ndarray, unit: int = 1) -> int:
    """Pairs of the two ascending lists at most ``unit`` apart, each value used once, smallest first."""
    i = j = n = 0
    while i < len(a) and j < len(b):
        d = a[i] - b[j]
        if abs(d) <= unit:
            n, i, j = n + 1, i + 1, j + 1
        elif d < 0:
            i += 1
        else:
            j += 1
    return n


def shared_fragments(a: Column, b: Column) -> Column:
    """``shared_count`` of two array columns, in Arrow batches."""
    return F.pandas_udf(_shared, "int")(a, b)


def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([shared_count(np.sort(x), np.sort(y)) if x is not None and y is not None else 0 for x, y in zip(a, b)], dtype="int32")


def match_libraries(calib: DataFrame, main: DataFrame, least: int = SHARED) -> DataFrame:
    """(calib_id, main_id, shared, d_rt): for each calibration entry the main entry of the same m/z key and
    charge that shares most fragments (at least ``least``), then is nearest in time, then has the least id.

    Both are (id, mz, charge, rt_seconds, fragment_keys array<long>). A key holds the few precursors of one
    m/z at two digits and one charge."""
    side = lambda d, p: d.select(F.col("id").alias(f"{p}_id"), mz_key(F.col("mz")).alias("key"), "charge", F.col("rt_seconds").alias(f"{p}_rt"), F.col("fragment_keys").alias(f"{p}_f"))
    j = sized_join(side(calib, "calib"), side(main, "main"), ["key", "charge"], "inner").withColumn("shared", shared_fragments(F.col("calib_f"), F.col("main_f"))).filter(F.col("shared") >= least)
    j = j.withColumn("d_rt", F.abs(F.col("calib_rt") - F.col("main_rt")))
    w = Window.partitionBy("calib_id").orderBy(F.desc("shared"), F.asc("d_rt"), F.asc("main_id"))
    return j.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("calib_id", "main_id", "shared", "d_rt")
