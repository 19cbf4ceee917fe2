"""Target-decoy statistics: q-values, competition, deduplication, folds and reports.

Everything that runs over the whole table in score order uses range-partitioned running sums, so no
window holds all rows in one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.operators.sequence import neighbours, numbered, running_sums
from ionloom.runtime import sized_join, stored


def q_values(scored: DataFrame, score: str = "score", is_target: str = "is_target", tie: str = "id") -> DataFrame:
    """Adds q_value: (decoys + 1) / targets down the list, then the least from each place on (at most 1);
    equal scores share the first one's value. ``tie`` orders equal scores and must be unique.

    The running minimum from below is a running sum's counterpart: ranges are scanned in parallel and
    each takes the least of the ranges after it."""
    ok = scored.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    order = [F.desc(score), F.asc(tie)]
    target = F.col(is_target).cast("boolean")
    run = running_sums(ok, order, {"_t": target.cast("long"), "_d": (~target).cast("long")})
    run = run.withColumn("_raw", F.when(F.col("_t") > 0, (F.col("_d") + 1) / F.col("_t")).otherwise(F.lit(float("inf"))))
    ranged = stored(run.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    after = Window.orderBy(F.desc("_pid")).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    least = ranged.groupBy("_pid").agg(F.min("_raw").alias("_m")).select("_pid", F.coalesce(F.min("_m").over(after), F.lit(1.0)).alias("_after"))
    # From the end on: a frame that grows is linear, one that shrinks is not.
    below = Window.partitionBy("_pid").orderBy(F.asc(score), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
    q = sized_join(ranged, least, ["_pid"], "inner").withColumn("q_value", F.least(F.min("_raw").over(below), F.col("_after"), F.lit(1.0)))
    # Rows of one score lie in one or more ranges; the first one's value is the least of them.
    first = q.groupBy(score).agg(F.min("q_value").alias("q_value"))
    # A score that many rows share is a hot key.
    return sized_join(q.drop("q_value", "_t", "_d", "_raw", "_pid", "_after"), first, [score], "inner")


def threshold_report(q: DataFrame, thresholds: tuple[float, ...] = (0.01, 0.05, 0.1, 0.5, 1.0), is_target: str = "is_target") -> DataFrame:
    """Targets and decoys at each threshold, in one pass."""
    t = F.col(is_target).cast("boolean")
    aggs = [F.count(F.when((F.col("q_value") <= x) & c, 1)).alias(f"_{n}{i}") for i, x in enumerate(thresholds) for n, c in (("t", t), ("d", ~t))]
    one = q.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(float(x)).alias("threshold"), F.col(f"_t{i}").alias("n_targets"), F.col(f"_d{i}").alias("n_decoys")) for i, x in enumerate(thresholds)])
    return one.select(F.inline(rows))


def consecutive_dedup(rows: DataFrame, seq: str = "sequence", charge: str = "charge", mz: str = "mz", score: str = "score", is_target: str = "is_target") -> DataFrame:
    """Ordered by sequence, score, targets first and m/z, a row goes if it equals the one just before it
    in sequence, charge and m/z; interleaved charges survive."""
    beside = neighbours(numbered(rows, [seq], [F.desc(score), F.desc(is_target), F.asc(mz), F.asc(charge)], "_k"), [seq], "_k", [charge, mz])
    same = F.col(f"prev_{charge}").eqNullSafe(F.col(charge)) & F.col(f"prev_{mz}").eqNullSafe(F.col(mz)) & (F.col("_k") > 0)
    return beside.filter(~same).select(*rows.columns)


def best_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key; only the winner of each task's part is shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def competition(rows: DataFrame, group: str = "decoy_group", charge: str = "charge", score: str = "score", tie: str = "id") -> DataFrame:
    """One winner per (group, charge), with how far and by what ratio it beats the second; null if alone."""
    w = Window.partitionBy(group, charge).orderBy(F.desc(score), F.asc(tie))
    two = rows.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2")
    second = F.lead(score).over(Window.partitionBy(group, charge).orderBy("_rn"))
    out = two.withColumn("_second", second).filter("_rn = 1")
    return out.withColumn("delta_group", F.col(score) - F.col("_second")).withColumn("delta_group_ratio", F.col("_second") / F.when(F.col(score) != 0, F.col(score))).drop("_rn", "_second")


def fold(*cols: str, n: int = 3, seed: int = 42) -> Column:
    """A stable fold of a row by its key."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(n)).cast("int")


def feature_stats(rows: DataFrame, features: list[str], by: str = "fold") -> DataFrame:
    """Mean of the finite values and share of the others, per fold and feature."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    aggs = [x for c in features for x in (F.avg(F.when(ok(c), F.col(c))).alias(f"_m_{c}"), F.avg(F.when(ok(c), 0.0).otherwise(1.0)).alias(f"_r_{c}"))]
    g = rows.groupBy(by).agg(*aggs)
    return g.select(by, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_m_{c}").alias("mean"), F.col(f"_r_{c}").alias("non_finite")) for c in features])))


def auc(rows: DataFrame, score: str = "score", positive: str = "positive") -> DataFrame:
    """Area under the ROC curve by ranks; ties count half. Counts are summed per score first."""
    per = rows.filter(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive).cast("boolean")).cast("long")).alias("n"))
    run = running_sums(per, [F.asc(score)], {"below": F.col("n")})
    return run.agg(F.sum(F.col("p") * (F.col("below") - F.col("n") + F.col("n") / 2)).alias("_u"), F.sum("p").alias("_p"), F.sum("n").alias("_n")).select((F.col("_u") / F.when(F.col("_p") * F.col("_n") > 0, F.col("_p") * F.col("_n"))).alias("auc"))


def top_scores(rows: DataFrame, n: int = 2000, score: str = "score", tie: str = "id") -> DataFrame:
    """The ``n`` best finite positive scores: each task keeps ``n``, the rest never moves."""
    s = F.col(score).cast("double")
    return rows.filter((s > 0) & (s < float("inf")) & ~F.isnan(s)).orderBy(F.desc(score), F.asc(tie)).limit(n)
