"""Helpers that several operators share: reading documents, the shared folder, held-out folds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One run of ASCII white space, and one word, as Java and DuckDB regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only an in-process master without that setting gets a temporary folder, as in tests.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            own = tempfile.mkdtemp(prefix="mirrorloom-")
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of an Arrow batch in this session: texts differ in length a thousandfold, so the default of 10,000 rows can be gigabytes."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def positions(df: DataFrame, group: str, order: list[str], name: str = "positions") -> DataFrame:
    """``df`` with ``pos`` (0-based place within its ``group`` in the order of ``order``, nulls first) and ``n`` (rows of the group).

    No window holds a group's rows: the rows are range-partitioned and stored with their places in the partition; totals of each
    (group, partition), at most one row per partition and group more than there are groups, give the offsets.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    placed = stored(df.orderBy(*by).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), name)
    totals = placed.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__c"), F.min("__at").alias("__first"))
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "__part", "__first", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"), F.sum("__c").over(Window.partitionBy(group)).alias("n"))
    out = placed.join(offsets, [group, "__part"])
    return out.select(*df.columns, (F.col("__at") - F.col("__first") + F.col("__off")).alias("pos"), "n")


def keyed(docs: DataFrame, id_col: str, key: str = "__row") -> DataFrame:
    """``docs`` with a column ``key`` of unique longs in the order of the ids, nulls last.

    Ids that are unique are the key themselves.  Otherwise the rows are stored in order, ties by a hash of the row, with
    their numbers.
    """
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    ids = docs.select(F.col(id_col).alias("id"))
    if whole and ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or id is null").isEmpty():
        return docs.withColumn(key, F.col(id_col).cast("long"))
    ordered = docs.withColumn("__tie", F.xxhash64(*docs.columns)).orderBy(F.col(id_col).asc_nulls_last(), "__tie").drop("__tie")
    return stored(ordered.withColumn(key, F.monotonically_increasing_id()), "keyed")


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    base = shared_folder(spark).rstrip("/") + "/"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(base).toUri().getPath() + "/"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
