"""Which reader a path needs: readers say yes, no or maybe, and a maybe is settled by the first bytes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ionloom.sources import native, peaks, speclib_binary, text_libraries


@dataclass(frozen=True)
class Reader:
    name: str
    suffixes: tuple[str, ...]
    read: Callable[[SparkSession, str], DataFrame]
    accepts: Callable[[list[str]], bool] | None = None
    magic: tuple[bytes, ...] = ()  # what its files begin with; settles paths that no suffix tells


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    """Column names of a delimited or Parquet file."""
    if path.endswith(".parquet") or first_bytes(spark, path, 4) == b"PAR1":
        return spark.read.parquet(path).columns
    got = spark.read.text(path).first()
    return [x.strip('"\r') for x in got[0].split(sep)] if got else []


def first_bytes(spark: SparkSession, path: str, n: int = 8) -> bytes:
    """The first bytes of a file in any store Spark can read; none of a folder or an empty or missing file."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or not fs.getFileStatus(p).isFile():
        return b""
    stream, out = fs.open(p), bytearray()
    try:
        while len(out) < n and (c := stream.read()) >= 0:
            out.append(c)
    finally:
        stream.close()
    return bytes(out)


def _form(names: dict) -> Callable[[list[str]], bool]:
    return lambda columns: text_libraries.resolve(columns, names) is not None


LIBRARIES: list[Reader] = [
    Reader("speclib", (".speclib",), speclib_binary.read_speclib),
    Reader("diann parquet", (".parquet",), text_libraries.read_diann_parquet, _form(text_libraries.DIANN_PARQUET), (b"PAR1",)),
    Reader("spectronaut", (".tsv", ".txt"), text_libraries.read_spectronaut, _form(text_libraries.SPECTRONAUT)),
    Reader("diann", (".tsv", ".txt"), text_libraries.read_diann, _form(text_libraries.DIANN)),
    Reader("skyline", (".csv",), text_libraries.read_skyline, _form(text_libraries.SKYLINE)),
    Reader("native", (".ndjson", ".jsonl", ".msgpack", ".msgpack.zst", ".ndjson.zst"), native.read_native, magic=(b"\x28\xb5\x2f\xfd",)),
    Reader("elution groups", (".json",), text_libraries.read_elution_groups),
]
RUNS: list[Reader] = [Reader("mzml", (".mzML", ".mzML.gz"), peaks.read_mzml, magic=(b"<?xml", b"<mzML", b"<indexed"))]


def register(reader: Reader, kind: list[Reader]) -> None:
    """Adds a reader, ahead of those there are."""
    kind.insert(0, reader)


def choose(spark: SparkSession, path: str, readers: list[Reader]) -> Reader:
    """The reader of a path. Two that are sure are an error; if none fits, the first refusal is told. A path whose
    suffix no reader knows may be any's: its first bytes settle it."""
    sure, refusal = [], None
    fits = [r for r in readers if path.endswith(r.suffixes)]
    if not fits:
        head = first_bytes(spark, path)
        fits = [r for r in readers if head and any(head.startswith(m) for m in r.magic)]
    for r in fits:
        if r.accepts is None:
            sure.append(r)
            continue
        columns = _header(spark, path, "," if path.endswith(".csv") else "\t")
        if r.accepts(columns):
            sure.append(r)
        else:
            refusal = refusal or f"{r.name}: columns are {columns}"
    if len(sure) > 1 and len({r.read for r in sure}) > 1:
        exact = [r for r in sure if r.accepts is not None]
        if len(exact) != 1:
            raise ValueError(f"{path}: several readers fit: {[r.name for r in sure]}")
        sure = exact
    if not sure:
        raise ValueError(f"{path}: no reader fits" + (f" ({refusal})" if refusal else ""))
    return sure[0]


def read_library(spark: SparkSession, path: str) -> DataFrame:
    return choose(spark, path, LIBRARIES).read(spark, path)


def source_kind(path: str) -> str:
    """stored index, raw run, or a raw run in an object store, which has to be indexed first."""
    remote = path.split("://", 1)[0] in ("s3", "s3a", "gs", "az", "abfs") and "://" in path
    if path.rstrip("/").endswith(".idx"):
        return "index"
    if any(path.endswith(s) for r in RUNS for s in r.suffixes):
        return "remote raw" if remote else "raw"
    raise ValueError(f"{path}: neither an index nor a known kind of run")


def open_run(spark: SparkSession, path: str) -> DataFrame:
    """Peaks of a run, from its stored index or its raw file."""
    kind = source_kind(path)
    if kind == "remote raw":
        raise ValueError(f"{path}: index the run next to its raw data and open the index")
    return peaks.read_index(spark, path)[0] if kind == "index" else choose(spark, path, RUNS).read(spark, path)


def index_run(spark: SparkSession, raw: str, to: str | None = None) -> str:
    """Reads a raw run and stores its index beside it (``<raw>.idx``) or at ``to``; gives the index's path."""
    from pyspark.sql import functions as F

    to = to or f"{raw}.idx"
    r = choose(spark, raw, RUNS).read(spark, raw)
    run = peaks_of(r)
    cycles = r.filter("ms_level = 1").select("run_id", F.col("cycle_index").alias("cycle"), "rt_ms").distinct()
    none = F.lit(None).cast("double")
    windows = r.filter("ms_level = 2").select("run_id", "window_id", none.alias("im0"), none.alias("im1"), F.col("mz_lo").alias("mz_lo0"), F.col("mz_lo").alias("mz_lo1"), F.col("mz_hi").alias("mz_hi0"), F.col("mz_hi").alias("mz_hi1")).distinct()
    windows = windows.fillna({"im0": 0.0, "im1": 1e9})
    has = "Absent" if run.filter("mobility_ook0 > 0").isEmpty() else "Ook0"
    peaks.write_index(run, cycles, windows, to, mobility_kind=has)
    return to


def peaks_of(raw: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return raw.select("run_id", "ms_level", F.coalesce("window_id", F.lit(-1)).alias("window_id"), "mz", "intensity", F.coalesce("mobility_ook0", F.lit(0.0)).cast("float").alias("mobility_ook0"), "cycle_index")
