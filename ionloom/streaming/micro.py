"""Streams: queries answered as they come, running statistics, and calibration in the background."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ionloom.operators import calibrate, extract, interval


def answer(queries: DataFrame, peaks: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch of ions (query_id, ion, mz_lo, mz_hi, cycle_lo, cycle_hi, ..) is joined to the stored
    peaks and its spectra given to ``sink``. Tolerances travel as the batch's own bounds."""
    residual = F.col("cycle").between(F.col("cycle_lo"), F.col("cycle_hi"))

    def batch(ions: DataFrame, batch_id: int) -> None:
        ions = ions.persist()
        try:
            sink(extract.spectrum(ions, interval.range_join(peaks, ions, "mz", "mz_lo", "mz_hi", residual=residual, log=True)), batch_id)
        finally:
            ions.unpersist()

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_stats(values: DataFrame, time: str, key: str, value: str, weight: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Weighted mean, least and largest value per key and time window; rows later than ``late`` are dropped,
    which bounds the state."""
    w, v = F.col(weight), F.col(value)
    g = values.filter(w > 0).withWatermark(time, late).groupBy(F.window(time, window), key)
    return g.agg(F.sum(w).alias("weight"), (F.sum(w * v) / F.sum(w)).alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi")).select(F.col("window.start").alias("window_start"), key, "weight", "mean", "lo", "hi")


def top_scores(candidates: DataFrame, n: int, state: dict, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the ``n`` best (score, id) over all batches in ``state['best']``: at most n rows a batch reach
    the driver, and merging is by score descending, id ascending."""

    def batch(df: DataFrame, batch_id: int) -> None:
        s = F.col("score").cast("double")
        got = df.filter((s > 0) & (s < float("inf")) & ~F.isnan(s)).orderBy(F.desc("score"), F.asc("id")).limit(n).select("score", "id").collect()
        state["best"] = sorted([*state.get("best", []), *map(tuple, got)], key=lambda t: (-t[0], t[1]))[:n]

    return candidates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def calibrating(points: DataFrame, state: calibrate.State, on_fit: Callable[[calibrate.Curve, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Points (library, observed, weight) add to ``state``; after each batch the curve is fitted anew."""

    def batch(df: DataFrame, batch_id: int) -> None:
        state.update(df)
        try:
            on_fit(state.fit(), batch_id)
        except ValueError:
            pass  # too few points so far

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
