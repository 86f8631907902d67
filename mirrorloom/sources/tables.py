"""Tabular sources and sinks around the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import HIT_COLUMNS

_TYPES = {"start": "long", "end": "long", "arm_length": "int", "spacer_length": "int", "total_length": "int", "is_perfect": "boolean"}
_TYPES |= dict.fromkeys(["ga_pct", "ct_pct", "mirror_identity", "stacking_score", "pairing_score", "total_score"], "double")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Comma-separated table with header; a byte-order mark before the header is skipped."""
    table = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, encoding="UTF-8")
    return table.toDF(*[c.lstrip("﻿") for c in table.columns])


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """A hit table back from its tab-separated form; ``None`` and nothing are null."""
    raw = spark.read.csv(path, sep="\t", header=True, nullValue="")
    blank = lambda c: F.when(F.col(c).isin("", "None"), None).otherwise(F.col(c))
    return raw.select(*[blank(c).cast(_TYPES.get(c, "string")).alias(c) for c in HIT_COLUMNS])


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start0, end0, name) of a BED file, plain or gzip; track and browser lines and comments are skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(track|browser|#)") & (F.trim("value") != ""))
    f = F.split("value", "\t")
    return lines.select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("start0"), F.get(f, F.lit(2)).cast("long").alias("end0"), F.get(f, F.lit(3)).alias("name"))


def read_columns(spark: SparkSession, path: str, columns: dict[str, tuple[int, str]]) -> DataFrame:
    """Named and typed columns of a headerless tab-separated dump by position."""
    f = F.split("value", "\t")
    return spark.read.text(path).where("value <> ''").select(*[F.get(f, F.lit(i)).cast(t).alias(n) for n, (i, t) in columns.items()])


def read_wig(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, span, value) of variableStep WIG files: each header line holds for the lines below it."""
    from ..operators.intervals import carried

    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    header = F.when(F.col("value").startswith("variableStep"), F.struct("line", F.col("value").alias("text")))
    # a stretch is what one task read: its last header is carried to the tasks after it
    stretches = carried(lines, ("file",), "line", header, F.max, 1 << 33)
    above = Window.partitionBy("file", "_bin").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    lines = stretches.withColumn("header", F.coalesce(F.max(header).over(above), "_carry")["text"]).where(F.col("value").rlike(r"^\d") & F.col("header").isNotNull())
    f = F.split(F.trim("value"), r"\s+")
    span = F.coalesce(F.nullif(F.regexp_extract("header", r"span=(\d+)", 1), F.lit("")).try_cast("long"), F.lit(1))
    return lines.select(F.regexp_extract("header", r"chrom=(\S+)", 1).alias("chrom"), F.get(f, F.lit(0)).cast("long").alias("pos"), span.alias("span"), F.get(f, F.lit(1)).cast("double").alias("value"))


PIECE = 4096  # rows of a piece: texts of some kilobytes each


def spread(rows: DataFrame, streamed: bool = False) -> DataFrame:
    """``rows``, dealt out evenly if their source has fewer pieces than the session has cores, or pieces of too many rows.

    One row group or one gzip file is one task however large it is, and the scan after it costs far more than moving its
    rows.  The number of pieces follows the number of rows, so a task does not grow with the input.  What is ``streamed``, a row at a time
    and at little cost, is not moved for the rows of its pieces.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    sizes = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))  # by the footers
    pieces, total, most = sizes.agg(F.count(F.lit(1)), F.sum("n"), F.max("n")).first()
    if pieces >= cores and (streamed or most <= 2 * PIECE):
        return rows
    return rows.repartition(max(4 * cores, -(-(total or 0) // PIECE)))


def write_csv(tables: list[DataFrame], path: str) -> None:
    """Tables one below the other with the union of their columns; arrays, maps and structs as JSON."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    nested = (T.ArrayType, T.MapType, T.StructType)
    out.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in out.schema]).write.mode("overwrite").csv(path, header=True)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of input files, for run metadata."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
