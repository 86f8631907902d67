"""Order statistics without a window over all rows: range-partition by value, totals per range, offsets back, local sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one process, as in tests, may use its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mirrorloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, so that lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a :func:`stored` table once nothing reads it any more."""
    jvm, base = df.sparkSession.sparkContext._jvm, shared_folder(df.sparkSession)
    at = jvm.org.apache.hadoop.fs.Path
    root = at(base).toUri().getPath().rstrip("/") + "/"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if at(folder).toUri().getPath().startswith(root):
            at(folder).getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at(folder), True)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], by: tuple[str, ...] = (), name: str = "running", how: Callable[[Column | str], Column] = F.sum) -> DataFrame:
    """``df`` with, for each of ``sums``, its sum (or ``how``) over the rows of the same ``by`` up to and with this one in ``order``; exact for whole numbers.

    Sorted rows are dealt out by ranges and stored with the number of their range; sums run within (by, range), and the totals
    of the ranges before, one row per range and group, are added.  No task sees more rows than a range has.
    """
    keys = [F.col(c).asc_nulls_first() for c in by]
    placed = stored(df.withColumns({f"_{k}": v for k, v in sums.items()}).orderBy(*keys, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)), name)
    totals = placed.groupBy(*by, "_range").agg(*[how(f"_{k}").alias(f"_{k}") for k in sums])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    if not by:
        # one row per range: the only window without a key, over as many rows as there are partitions
        before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_range", *[how(f"_{k}").over(before).alias(f"_{k}_before") for k in sums])
    within = Window.partitionBy(*by, "_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(offsets, [*by, "_range"])
    own = {k: how(f"_{k}").over(within) for k in sums}
    before_ = lambda k: F.col(f"_{k}_before")
    both = {k: v + F.coalesce(before_(k), F.lit(0)) if how is F.sum else (F.least if how is F.min else F.greatest)(v, before_(k)) for k, v in own.items()}
    return joined.select(*df.columns, *[v.alias(k) for k, v in both.items()])


def numbered(df: DataFrame, order: list[Column], by: tuple[str, ...] = (), out: str = "rank") -> DataFrame:
    """``df`` with its 1-based place in ``order`` among the rows of the same ``by``."""
    return running(df, order, {out: F.lit(1).cast("long")}, by, "numbered")
