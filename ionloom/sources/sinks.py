"""Writers: result tables, lines of JSON, text tables, calibration and run reports."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.operators.calibrate import Calibration


def write_results(results: DataFrame, path: str, max_q: float = 0.5) -> None:
    """Rows up to a q-value; that sequences can be parsed is told in the column's metadata."""
    kept = results.filter(F.col("q_value") <= max_q)
    if "sequence" in kept.columns:
        kept = kept.withMetadata("sequence", {"parsable_sequences": True})
    kept.write.mode("overwrite").parquet(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str, pretty: bool = False) -> int:
    """One JSON array in one file, row by row from the executors: for results a person looks at."""
    n = 0
    with open(path, "w") as f:
        f.write("[")
        for r in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
            f.write(("," if n else "") + ("\n" + json.dumps(json.loads(r.j), indent=2) if pretty else r.j))
            n += 1
        f.write("\n]" if pretty else "]")
    return n


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_calibration(c: Calibration, path: str) -> None:
    with open(path, "w") as f:
        json.dump(c.as_json(), f)


def read_calibration(path: str) -> Calibration:
    with open(path) as f:
        return Calibration.from_json(json.load(f))


class Report:
    """Milliseconds per phase and counts, written as one JSON object."""

    def __init__(self):
        self.values: dict = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        t = time.monotonic()
        yield
        self.values[f"{name}_ms"] = round((time.monotonic() - t) * 1000)

    def write(self, path: str) -> None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w") as f:
            json.dump(self.values, f, indent=2, sort_keys=True)


def read_peak_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
