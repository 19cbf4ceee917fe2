"""Running numbers and neighbours inside groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.runtime import sized_join, stored

#: Rows of a group that one window partition of ``neighbours`` holds.
BLOCK = 4096


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """``df`` with ``name`` counting from 0 in each ``group`` by ``order``.

    Rows are range-partitioned by group and order, numbered inside each range, and shifted by the counts
    of the ranges before; a group that holds a third of all rows spans a third of the ranges. ``order``
    should end in a unique column; nulls come first, as in Spark's ascending order."""
    ranged = stored(df.repartitionByRange(*group, *order).withColumn("_il_pid", F.spark_partition_id()))
    inside = Window.partitionBy("_il_pid", *group).orderBy(*order)
    counts = ranged.groupBy("_il_pid", *group).agg(F.count(F.lit(1)).alias("_il_n"))
    before = Window.partitionBy(*group).orderBy("_il_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("_il_pid", *group, F.coalesce(F.sum("_il_n").over(before), F.lit(0)).alias("_il_shift"))
    local = ranged.withColumn("_il_rn", F.row_number().over(inside) - 1)
    return sized_join(local, shifts, ["_il_pid", *group], "inner").withColumn(name, (F.col("_il_rn") + F.col("_il_shift")).cast("long")).drop("_il_pid", "_il_rn", "_il_shift")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], group: list[str] = ()) -> DataFrame:
    """Adds running sums by ``order`` over the whole table (or in each ``group``), ranges in parallel."""
    group = list(group)
    keyed = df.select("*", *[c.alias(f"_il_v_{k}") for k, c in sums.items()])
    ranged = stored(keyed.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_il_pid", F.spark_partition_id()))
    inside = Window.partitionBy("_il_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group, F.lit(1)).orderBy("_il_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_il_pid", *group).agg(*[F.sum(f"_il_v_{k}").alias(f"_il_t_{k}") for k in sums])
    shifts = totals.select("_il_pid", *group, *[F.coalesce(F.sum(f"_il_t_{k}").over(before), F.lit(0)).alias(f"_il_s_{k}") for k in sums])
    local = ranged.select("*", *[F.sum(f"_il_v_{k}").over(inside).alias(f"_il_l_{k}") for k in sums])
    joined = sized_join(local, shifts, ["_il_pid", *group], "inner")
    return joined.select(*df.columns, *[(F.col(f"_il_l_{k}") + F.col(f"_il_s_{k}")).alias(k) for k in sums])


def neighbours(df: DataFrame, group: list[str], seq: str, cols: list[str], block: int = BLOCK) -> DataFrame:
    """``df`` with prev_<c> and next_<c> for ``cols``: the rows beside each row of its group by ``seq``.

    Lag and lead run over blocks of the running number, each block with a copy of the rows just outside
    it, so that no window partition holds more than ``block`` + 2 rows. ``seq`` must count from 0 by 1."""
    own = F.floor(F.col(seq) / block).cast("long")
    tagged = df.select("*", F.explode(F.array_distinct(F.array(own, F.floor((F.col(seq) - 1) / block).cast("long"), F.floor((F.col(seq) + 1) / block).cast("long")))).alias("_il_block"))
    w = Window.partitionBy(*group, "_il_block").orderBy(seq)
    out = tagged.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in cols], *[F.lead(c).over(w).alias(f"next_{c}") for c in cols])
    return out.filter(F.col("_il_block") == own).drop("_il_block")
