"""FASTA source and the text sinks of hit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import HIT_COLUMNS

PARSERS = ("biopython", "inhouse")


def header_columns(header: Column) -> tuple[Column, Column]:
    """(seq_id, offset): the word that the header begins with or ``unknown``, and the start of a region that ends it, or 1."""
    name = F.regexp_extract(header, r"^(\S+)", 1)
    seq_id = F.when(name == "", "unknown").otherwise(name)
    region = F.regexp_extract(seq_id, r":(\d+)[-–]\d+$", 1)
    return seq_id, F.coalesce(F.nullif(region, F.lit("")).try_cast("long"), F.lit(1))


def read_fasta(spark: SparkSession, path: str, parser: str = "biopython") -> DataFrame:
    """Records (record_ix, seq_id, seq, seq_offset) with bases in upper case; empty records are left out.

    ``biopython`` starts a record at ``>`` at the beginning of a line, ``inhouse`` at every ``>``.  Gzip by suffix.
    """
    if parser not in PARSERS:
        raise ValueError(f"unknown parser {parser!r}")
    raw = spark.read.option("lineSep", ">" if parser == "inhouse" else "\n>").text(path)
    raw = raw.withColumn("record_ix", F.monotonically_increasing_id())
    # before the first record there may be text without a header
    value = F.regexp_replace("value", "^>", "") if parser == "biopython" else F.col("value")
    header = F.regexp_extract(value, r"^([^\r\n]*)", 1)
    body = F.substring(value, F.length(header) + 1, F.length(value))
    seq_id, offset = header_columns(header)
    out = raw.select("record_ix", seq_id.alias("seq_id"), F.upper(F.regexp_replace(body, r"[\n\r ]", "")).alias("seq"), offset.alias("seq_offset"))
    return out.where(F.length("seq") > 0)


#: Names up to which a list goes to every task.
NAMED = 100_000


def read_fasta_named(spark: SparkSession, path: str, names: list[str], parser: str = "biopython") -> DataFrame:
    wanted = spark.createDataFrame([(n,) for n in names], "seq_id string")
    return read_fasta(spark, path, parser).join(F.broadcast(wanted) if len(names) <= NAMED else wanted, "seq_id", "left_semi")


def write_hits(hits: DataFrame, path: str, single: bool = False) -> None:
    """Tab-separated hits with header, CRLF line ends and null as nothing, in order of (seq_id, start).

    A folder of files in order, each with the header, or with ``single`` one file: its parts are sorted and written by many
    tasks and then joined in order, by the file system where it can (``concat``), else by copying their streams.
    """
    out = hits.select(*HIT_COLUMNS).orderBy("seq_id", "start")
    text = {"sep": "\t", "lineSep": "\r\n", "nullValue": "", "emptyValue": ""}
    if not single:
        out.write.mode("overwrite").csv(path, header=True, **text)
        return
    folder = f"{path}.parts"
    out.write.mode("overwrite").csv(folder, header=False, **text)
    spark = hits.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    fs = at(folder).getFileSystem(conf)
    parts = sorted((f.getPath() for f in fs.listStatus(at(folder)) if f.getPath().getName().startswith("part-") and f.getLen()), key=lambda f: f.getName())
    fs.delete(at(path), True)
    stream = fs.create(at(path))
    stream.write(bytearray(("\t".join(HIT_COLUMNS) + "\r\n").encode()))
    joined = fs.getScheme() == "hdfs"
    if not joined:
        for part in parts:
            source = fs.open(part)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, conf, False)
            source.close()
    stream.close()
    if joined and parts:
        array = spark.sparkContext._gateway.new_array(at, len(parts))
        for i, part in enumerate(parts):
            array[i] = part
        fs.concat(at(path), array)
    fs.delete(at(folder), True)


def write_fasta(records: DataFrame, path: str, width: int = 80) -> None:
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    records.select(F.concat(F.lit(">"), F.col("seq_id"), F.lit("\n"), body).alias("value")).write.mode("overwrite").text(path)
