"""Structured Streaming front end: FASTA files that arrive in a folder are scanned record by record.

A record is one row, so detection, filters and scoring are stateless and need no watermark.  Overlap removal needs all
hits of a record together; it runs per micro-batch, in which a record arrives whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..params import ScanParams
from ..plans.scan import scan
from ..sources.fasta import header_columns


def read_fasta_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    raw = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", per_trigger).text(folder)
    value = F.regexp_replace("value", "^>", "")
    header = F.regexp_extract(value, r"^([^\r\n]*)", 1)
    seq_id, offset = header_columns(header)
    body = F.upper(F.regexp_replace(F.substring(value, F.length(header) + 1, F.length(value)), r"[\n\r ]", ""))
    return raw.select(F.xxhash64("value").alias("record_ix"), seq_id.alias("seq_id"), body.alias("seq"), offset.alias("seq_offset")).where(F.length("seq") > 0)


def scan_stream(records: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], p: ScanParams | None = None, once: bool = True) -> StreamingQuery:
    """Scan each micro-batch and hand its hits with the batch number to ``sink``, which should be idempotent."""
    p = p or ScanParams()
    writer = records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: sink(scan(batch, p), n))
    return (writer.trigger(availableNow=True) if once else writer).start()
