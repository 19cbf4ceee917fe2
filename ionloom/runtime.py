"""Session settings, shared storage and size-checked joins used by every operator."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes of its rows, that is ever broadcast.
BROADCAST_BYTES = 16 << 20
#: Tasks over which a hot key of a join is spread.
SALTS = 32
#: A key is hot with more than this many rows and more than one in this many of all rows.
HOT_ROWS, HOT_SHARE = 200_000, 64


def session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators are tested with; a running session is reused."""
    b = (
        SparkSession.builder.master(master)
        .appName("ionloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a session on one machine may leave it
    unset and gets a temporary one; on a cluster a folder of one machine would lose what others wrote."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "ionloom-shared")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the driver's JVM ends, or by ``release``."""
    path = f"{shared_dir(spark)}/ionloom-{uuid.uuid4().hex}"
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    _scratch.append(path)
    return path


_scratch: list[str] = []


def release(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files behind stored ``frames``, or without any all scratch files of this driver. Only for what
    nothing reads any more: an operator drops what its result doesn't need, a caller all once results are written."""
    paths = [f._il_path for f in frames if hasattr(f, "_il_path")] if frames else list(_scratch)
    for path in paths:
        p, fs = _path(spark, path)
        fs.delete(p, True)
        if path in _scratch:
            _scratch.remove(path)


def stored(df: DataFrame, partition_by: tuple[str, ...] = (), **also: Column) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and a lost
    executor costs a re-read instead of a recomputation. The size of its rows is measured on the way, and
    what ``also`` names: aggregates that the result has in ``_il_seen``."""
    spark = df.sparkSession
    path, seen = scratch(spark), Observation()
    w = df.observe(seen, F.sum(row_bytes(df)).alias("b"), F.count(F.lit(1)).alias("n"), *[c.alias(f"also_{k}") for k, c in also.items()]).write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._il_path, out._il_bytes, out._il_rows = path, int(seen.get["b"] or 0), int(seen.get["n"])
    out._il_seen = {k: seen.get[f"also_{k}"] for k in also}
    return out


def row_bytes(df: DataFrame) -> Column:
    """A cheap estimate of a row's size: lengths of texts, binaries and arrays plus a constant for each other column."""
    size = F.lit(16 * max(1, len(df.columns)))
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.length(c), F.lit(0)) * 2
        elif kind == "array":
            inner = f.dataType.elementType.typeName()
            each = F.aggregate(c, F.lit(0), lambda a, x: a + 16 + F.coalesce(F.length(x), F.lit(0)) * 2) if inner in ("string", "binary") else F.size(c) * (8 if inner in ("integer", "long", "float", "double", "short", "byte", "boolean") else 64)
            size = size + F.greatest(F.coalesce(each, F.lit(0)), F.lit(0))
        elif kind == "map":
            size = size + F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) * 64
    return size.cast("long")


def measured(df: DataFrame) -> int:
    """Bytes of all rows: known of a stored table, else summed in one aggregate."""
    got = getattr(df, "_il_bytes", None)
    return got if got is not None else int(df.select(F.sum(row_bytes(df)).alias("b")).first()["b"] or 0)


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measured, not guessed."""
    return measured(df) <= limit


def hot_keys(big: DataFrame, on: list[str], least: int = HOT_ROWS, share: int = HOT_SHARE) -> DataFrame:
    """Keys that hold more than 1/``share`` of the rows (and ``least`` rows): fewer than ``share`` keys."""
    seen = Observation()
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_il_n")).observe(seen, F.sum("_il_n").alias("n"))
    top = counts.orderBy(F.desc("_il_n")).limit(share).collect()
    total = int(seen.get["n"] or 0)
    hot = [tuple(r)[:-1] for r in top if r["_il_n"] > max(least, total // share)]
    return big.sparkSession.createDataFrame(hot, big.select(*on).schema)


def shuffled_join(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of two sides of any size: both are shuffled and merged, and no estimate makes a broadcast of ``b``."""
    return a.join(b.hint("merge"), on, how)


def sized_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int | None = None, salts: int = SALTS, bytes_: int | None = None, least: int | None = None) -> DataFrame:
    """Equi-join whose ``small`` side is broadcast only after its size was measured (or given in ``bytes_``).

    A side that is more than a scan is stored first, so that it isn't worked out once to be measured and once
    more to be joined. Beyond the limit both sides are shuffled, whatever Spark's own estimate (of compressed files,
    before rows are copied to bins) would broadcast. Keys that hold a large share of ``big`` are then
    spread over ``salts`` tasks: only their rows of ``small`` are copied. ``how`` is inner, left (rows of ``big``
    stay) or left_semi."""
    limit = BROADCAST_BYTES if limit is None else limit
    if bytes_ is None:
        small = small if hasattr(small, "_il_bytes") else stored(small)
        bytes_ = small._il_bytes
    if bytes_ <= limit:
        return big.join(F.broadcast(small), on, how)
    hot = hot_keys(big, on, HOT_ROWS if least is None else least)
    if hot.isEmpty():
        return shuffled_join(big, small, on, how)
    salt, flag = "_il_salt", "_il_hot"
    marked = F.broadcast(hot.select(*[F.col(c).alias(f"_il_k_{c}") for c in on]).withColumn(flag, F.lit(True)))

    def mark(df: DataFrame) -> DataFrame:
        same = [F.col(c).eqNullSafe(F.col(f"_il_k_{c}")) for c in on]
        cond = same[0]
        for c in same[1:]:
            cond = cond & c
        return df.join(marked, cond, "left").drop(*[f"_il_k_{c}" for c in on])

    cols = [c for c in big.columns if big.schema[c].dataType.typeName() not in ("map", "variant")]
    spread = mark(big).withColumn(salt, F.when(F.col(flag), F.pmod(F.xxhash64(*cols), F.lit(salts))).otherwise(0).cast("int")).drop(flag)
    copies = mark(small).withColumn(salt, F.explode(F.when(F.col(flag), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(flag)
    return shuffled_join(spread, copies, [*on, salt], how).drop(salt)
