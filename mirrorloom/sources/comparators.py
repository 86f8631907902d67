"""Outputs of other motif finders as hit tables: (record_id, start, end, score), coordinates 1-based and inclusive.

Tables and line formats are read by Spark in any number of tasks.  Where a line belongs to a block that an earlier line opens, the
last opening line is carried from task to task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import carried


def _hit(record: Column, start: Column, end: Column, score: Column) -> list[Column]:
    return [record.alias("record_id"), start.cast("long").alias("start"), end.cast("long").alias("end"), score.cast("double").alias("score")]


def read_triplex(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated table with the columns record_id, start, end and score, and any others."""
    c = F.col
    return spark.read.csv(path, header=True).select(*_hit(c("record_id"), c("start"), c("end"), c("score")))


def read_triplexator(spark: SparkSession, path: str, same_molecule: bool = False) -> DataFrame:
    """Tab-separated lines with 0-based starts; comments and empty lines are skipped.

    Sites have their record first; with ``same_molecule`` the lines are pairs of a third strand and a site, of which those within
    one record count, at the place of the site.
    """
    f = F.split("value", "\t")
    at = lambda i: F.get(f, F.lit(i))
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    if same_molecule:
        return lines.where(at(0) == at(3)).select(*_hit(at(3), at(4).cast("long") + 1, at(5), at(6)))
    return lines.select(*_hit(at(0), at(1).cast("long") + 1, at(2), at(3)))


def read_nessie(spark: SparkSession, path: str) -> DataFrame:
    """Also ``length``: blocks of ``>record``, ``$|length|...`` and ``@indexes:i|j|...`` lines.

    Each ``$`` line is a hit; the first index of the last line of indexes below it that has any is its 0-based start.  A hit without one has
    no coordinates.  Lines before the first record are skipped.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    opens = F.when(F.col("value").startswith(">"), F.struct("line", "value"))
    entry = F.when(F.col("value").startswith("$|"), F.struct("line", "value"))
    above = Window.partitionBy("file", "_bin").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    for name, of in (("record", opens), ("entry", entry)):
        lines = carried(lines, ("file",), "line", of, F.max, 1 << 33).withColumn(name, F.coalesce(F.max(of).over(above), "_carry")).drop("_bin", "_carry")
    inside = lines.where(F.col("record").isNotNull() & (F.col("entry.line") > F.col("record.line")))
    numbers = F.filter(F.split(F.substring_index("value", ":", -1), r"\|"), lambda x: F.trim(x) != "")
    first = F.when(F.col("value").startswith("@indexes:"), F.struct("line", F.trim(F.get(numbers, F.lit(0))).cast("long").alias("at")))
    per = inside.withColumn("first", first).groupBy("file", "record", "entry").agg(F.max(F.when(F.col("first.at").isNotNull(), F.col("first")))["at"].alias("at"))
    length = F.get(F.split("entry.value", r"\|"), F.lit(1)).cast("long")
    rid = F.regexp_extract("record.value", r"^>\s*(\S+)", 1)
    return per.select(*_hit(rid, F.col("at") + 1, F.col("at") + length, F.lit(None)), length.alias("length"))


def read_nbmst(spark: SparkSession, path: str, subset: bool = False) -> DataFrame:
    """A tab-separated table with Sequence_name, Start and Stop; with ``subset`` only the rows whose Subset is 1."""
    table = spark.read.csv(path, sep="\t", header=True)
    c = F.col
    return (table.where("Subset = '1'") if subset else table).select(*_hit(c("Sequence_name"), c("Start"), c("Stop"), F.lit(None)))
