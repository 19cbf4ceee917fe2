"""Peak tables: the stored index of a run, and raw runs in mzML."""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PEAK_SCHEMA = "run_id string, ms_level byte, window_id int, mz float, intensity float, mobility_ook0 float, cycle_index int"


def to_half(x: np.ndarray) -> np.ndarray:
    """Values on the grid of 16-bit floats, as 32-bit ones."""
    return x.astype(np.float16).astype(np.float32)


def write_index(peaks: DataFrame, cycles: DataFrame, windows: DataFrame, path: str, files: int = 8, mobility_kind: str = "Ook0", row_group_bytes: int = 8 << 20) -> None:
    """A run's peaks in files clustered by m/z inside each level and window, so that a range of m/z reads
    few row groups; with its cycle axis, windows and a metadata file."""
    clustered = peaks.repartitionByRange(files, "ms_level", "window_id", "mz").sortWithinPartitions("ms_level", "window_id", "mz", "cycle_index")
    clustered.write.mode("overwrite").option("parquet.block.size", row_group_bytes).option("compression", "snappy").partitionBy("run_id", "ms_level").parquet(f"{path}/peaks")
    cycles.write.mode("overwrite").parquet(f"{path}/cycles")
    windows.write.mode("overwrite").parquet(f"{path}/windows")
    meta = json.dumps({"version": "2", "mobility_kind": mobility_kind})
    peaks.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """(peaks, cycles, windows, metadata), lazily: filters on level, window and m/z reach the files."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if meta.get("version") != "2":
        raise ValueError(f"index version {meta.get('version')} is not known")
    return spark.read.schema(PEAK_SCHEMA).parquet(f"{path}/peaks"), spark.read.parquet(f"{path}/cycles"), spark.read.parquet(f"{path}/windows"), meta


def rebucket(spark: SparkSession, path: str, to: str, files: int = 8, row_group_bytes: int = 1 << 20) -> None:
    """A stored index written anew with row groups of another size: small ones suit narrow ranges, large ones wide."""
    peaks, cycles, windows, meta = read_index(spark, path)
    write_index(peaks, cycles, windows, to, files, meta.get("mobility_kind", "Ook0"), row_group_bytes)


def read_half_float_peaks(spark: SparkSession, paths: list[str], run_id: str, ms_level: int, window_id: int) -> DataFrame:
    """Peak files whose mobility is a 16-bit float, which Spark's own reader refuses: read by Arrow, row
    group by row group, each a unit of work. Paths must be readable by the executors."""
    import pyarrow.parquet as pq

    units = [(p, g) for p in paths for g in range(pq.ParquetFile(p).num_row_groups)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = pq.ParquetFile(p).read_row_group(g)
                n = t.num_rows
                cols = [pa.array([run_id] * n), pa.array([ms_level] * n, pa.int8()), pa.array([window_id] * n, pa.int32()), *(pa.array(t[c].to_numpy().astype(k)) for c, k in (("mz", "f4"), ("intensity", "f4"), ("mobility_ook0", "f4"), ("cycle_index", "i4")))]
                yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in PEAK_SCHEMA.split(", ")])

    return spark.createDataFrame(units, "path string, row_group int").repartition(max(1, len(units))).mapInArrow(run, PEAK_SCHEMA)


# Accession numbers of the controlled vocabulary.
CENTROID, PROFILE, MS_LEVEL, SCAN_TIME = "MS:1000127", "MS:1000128", "MS:1000511", "MS:1000016"
MZ_ARRAY, INTENSITY_ARRAY, ZLIB, F32, F64 = "MS:1000514", "MS:1000515", "MS:1000574", "MS:1000521", "MS:1000523"
WINDOW_TARGET, WINDOW_LOWER, WINDOW_UPPER = "MS:1000827", "MS:1000828", "MS:1000829"
MOBILITY_OOK0, MOBILITY_MS = "MS:1002815", "MS:1002476"


def _params(node) -> dict[str, str]:
    return {p.get("accession"): (p.get("value"), p.get("unitName")) for p in node.iter() if p.tag.endswith("cvParam")}


def window_bounds(target: float | None, lower: float | None, upper: float | None, absolute: bool = False) -> tuple[float, float] | None:
    """Isolation bounds: offsets from a target, or absolute; None where they are unknown."""
    vals = (lower, upper) if absolute else (target, lower, upper)
    if any(v is None or math.isnan(v) for v in vals):
        return None
    return (lower, upper) if absolute else (target - lower, target + upper)


def overlapping_windows(windows: DataFrame) -> DataFrame:
    """Pairs of windows of a run whose insides overlap (touching is none). Windows of a run are tens."""
    a, b = windows.alias("a"), windows.alias("b")
    on = (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.window_id") < F.col("b.window_id")) & (F.col("a.mz_lo") < F.col("b.mz_hi")) & (F.col("b.mz_lo") < F.col("a.mz_hi"))
    return a.join(b, on).select(F.col("a.run_id").alias("run_id"), F.col("a.window_id").alias("window_a"), F.col("b.window_id").alias("window_b"))


def _array(node) -> tuple[str | None, np.ndarray]:
    p = _params(node)
    raw = base64.b64decode(next(x.text or "" for x in node if x.tag.endswith("}binary") or x.tag == "binary"))
    if ZLIB in p:
        raw = zlib.decompress(raw)
    kind = "mz" if MZ_ARRAY in p else "intensity" if INTENSITY_ARRAY in p else None
    return kind, np.frombuffer(raw, "<f4" if F32 in p else "<f8").astype(np.float64)


def parse_mzml(run_id: str, data: bytes) -> Iterator[tuple]:
    """(run_id, ms_level, window_id, window bounds, mz, intensity, mobility, cycle, rt_ms) per spectrum.

    A cycle starts with each survey spectrum; fragment spectra before the first go. Profile data and
    decreasing times are errors; bad m/z go, negative heights count 0."""
    import io

    cycle, last, windows = -1, -math.inf, {}
    for _, node in ElementTree.iterparse(io.BytesIO(data)):
        if not node.tag.endswith("spectrum"):
            continue
        p = _params(node)
        if PROFILE in p:
            raise ValueError(f"{run_id}: profile spectra are not supported")
        value, unit = p.get(SCAN_TIME, ("nan", None))
        rt = float(value) * (60_000 if unit == "minute" else 1000)
        if rt < last:
            raise ValueError(f"{run_id}: retention times decrease")
        last = rt
        level = int(p[MS_LEVEL][0])
        arrays = dict(_array(n) for n in node.iter() if n.tag.endswith("binaryDataArray"))
        node.clear()
        bounds, window = None, None
        if level == 1:
            cycle += 1
        else:
            num = lambda a: float(p[a][0]) if a in p else None  # noqa: B023, E731
            bounds = window_bounds(num(WINDOW_TARGET), num(WINDOW_LOWER), num(WINDOW_UPPER))
            if cycle < 0 or bounds is None:
                continue
            window = windows.setdefault(tuple(round(b * 1000) for b in bounds), len(windows))
        mz, height = arrays.get("mz", np.array([])), arrays.get("intensity", np.array([]))
        ok = np.isfinite(mz)
        mobility = float(p[MOBILITY_OOK0][0]) if MOBILITY_OOK0 in p else None
        yield run_id, level, window, bounds, mz[ok], np.maximum(np.nan_to_num(height[ok]), 0), mobility, cycle, int(rt)


MZML_SCHEMA = "run_id string, ms_level byte, window_id int, mz_lo double, mz_hi double, cycle_index int, rt_ms long, mobility_ook0 float, mz float, intensity float"


def read_mzml(spark: SparkSession, path: str) -> DataFrame:
    """Peaks of mzML runs, one task per file, spectrum by spectrum; windows are keyed to a thousandth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                run_id = re.sub(r"\.mzML(\.gz)?$", "", p.rsplit("/", 1)[-1])
                if data[:2] == b"\x1f\x8b":
                    data = zlib.decompress(data, 31)
                for r in parse_mzml(run_id, data):
                    n = len(r[4])
                    const = lambda v, t, n=n: pa.array([v] * n, t)
                    lo, hi = r[3] or (None, None)
                    yield pa.RecordBatch.from_arrays(
                        [const(r[0], pa.string()), const(r[1], pa.int8()), const(r[2], pa.int32()), const(lo, pa.float64()), const(hi, pa.float64()), const(r[7], pa.int32()), const(r[8], pa.int64()), const(r[6], pa.float32()), pa.array(r[4].astype("f4")), pa.array(r[5].astype("f4"))],
                        names=[f.split()[0] for f in MZML_SCHEMA.split(", ")],
                    )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, MZML_SCHEMA)


def mobility_kind(accessions: DataFrame) -> DataFrame:
    """(run_id, kind): Ook0, Absent or Unsupported, by the first spectrum (ordered) that says."""
    kind = F.when(F.col("accession") == MOBILITY_OOK0, "Ook0").when(F.col("accession") == MOBILITY_MS, "Unsupported")
    g = accessions.groupBy("run_id").agg(F.min(F.when(kind.isNotNull(), F.struct("spectrum", kind.alias("k")))).alias("f"))
    return g.select("run_id", F.coalesce("f.k", F.lit("Absent")).alias("kind"))
