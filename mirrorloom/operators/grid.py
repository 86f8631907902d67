"""Scans of a parameter grid as DataFrame stages: one pass over the records whatever the size of the grid."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..grid import Grid, Sweep, detect_grid, scan_grid_many, with_filters
from ..kernel import Strand, together
from . import detect as D
from .overlap import _dealt
from .ranks import stored


def _whole(g: Grid):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [(s or "").lower().encode("latin-1", "replace") for s in batch.column(1).to_pylist()]
            for lo, hi in together([len(x) for x in seqs]):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(scan_grid_many(seqs[lo:hi], g), pa.list_(pa.int64()))], names=["record_ix", "words"])

    return run


HITS = "record_ix long, start long, end long, arm_length int, spacer_length int, full_sequence string, mask binary"


def _hits(g: Grid):
    names = [c.split()[0] for c in HITS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Strand([row["b"] or b""], [(row["own_from"], row["own_to"])])
                found = with_filters(s, detect_grid(s, g), g)
                # a row without configurations, so that every record has one
                none = (row["record_ix"], row["shift"], row["shift"], 0, 0, "", bytes(2 * 8 * g.detection_words))
                seq = s.d.tobytes().decode("latin-1")
                places = zip(*(found[k].tolist() for k in ("start", "end", "arm", "spacer")), found["mask"], strict=True)
                rows = itertools.chain([none], ((row["record_ix"], a + row["shift"], b + row["shift"], arm, sp, seq[a:b], mask.tobytes()) for a, b, arm, sp, mask in places))
                for part in itertools.batched(rows, 1 << 14):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)

    return run


def _sweeps(g: Grid):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, island, sweep = None, None, None
        close = lambda: pa.RecordBatch.from_arrays([pa.array([record], pa.int64()), pa.array([sweep.words()], pa.list_(pa.int64()))], names=["record_ix", "words"])
        for batch in batches:
            for r in batch.to_pylist():
                if sweep is None or r["record_ix"] != record:
                    if sweep is not None:
                        yield close()
                    record, island, sweep = r["record_ix"], r["_island"], Sweep(g)
                elif r["_island"] != island:
                    sweep.island()
                    island = r["_island"]
                sweep.hit(r["start"], r["end"], r["arm_length"], r["spacer_length"], r["full_sequence"], np.frombuffer(r["mask"], dtype=np.uint8))
        if sweep is not None:
            yield close()

    return run


def grid_calls(records: DataFrame, g: Grid, size: int = D.CHUNK) -> DataFrame:
    """(record_ix, words): bit ``config_id`` of the words tells whether that configuration calls the record.

    A record of up to ``size`` bases is detected, filtered and swept where it lies, without a shuffle.  A longer one is cut
    into chunks by midpoint; its hits, each once with the mask of its configurations, are dealt out by island.
    """
    short = records.where(F.length("seq") <= size).select("record_ix", "seq").mapInArrow(_whole(g), "record_ix long, words array<long>")
    long = records.where(F.length("seq") > size)
    # stored, as the islands read the hits several times
    hits = stored(D.chunked(long, g.base.but(maxspacer=g.maxspacer[-1], minrep=g.minrep[0]), size).mapInArrow(_hits(g), HITS), "grid-hits")
    parts = _dealt(hits, ("record_ix",), True).mapInArrow(_sweeps(g), "record_ix long, words array<long>")
    any_ = [F.bit_or(F.get("words", F.lit(i))).alias(f"w{i}") for i in range(g.words)]
    cut = parts.groupBy("record_ix").agg(*any_).select("record_ix", F.array(*[f"w{i}" for i in range(g.words)]).alias("words"))
    return short.unionByName(cut)


def grid_predictions(calls: DataFrame, g: Grid, id_col: str = "record_ix", only: list[int] | None = None) -> DataFrame:
    """(config_id, id, p) of every configuration and record of :func:`grid_calls`, or of the configurations ``only``."""
    ids = F.array(*map(F.lit, only)) if only is not None else F.sequence(F.lit(0), F.lit(g.size - 1))
    each = calls.select(id_col, "words", F.explode(ids).alias("config_id"))
    word = F.get("words", F.shiftright("config_id", 6))
    bit = F.call_function("shiftrightunsigned", word, F.col("config_id").bitwiseAND(63)).bitwiseAND(F.lit(1).cast("long"))
    return each.select("config_id", id_col, bit.cast("int").alias("p"))


def grid_counts(calls: DataFrame, g: Grid, by: Sequence[str] = ()) -> DataFrame:
    """(by, config_id, called, total): how many records of each group every configuration calls, and how many there are.

    Each task adds up the bits of its records, so what is shuffled is a row per group and task, not one per record and configuration.
    """
    by = list(by)
    kinds = [f for f in calls.schema.fields if f.name in by]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kinds] + ["counts array<long>", "total long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        totals: dict[tuple, int] = {}
        types = []
        for batch in batches:
            types = [batch.schema.field(f.name).type for f in kinds]
            keys = list(zip(*[batch.column(f.name).to_pylist() for f in kinds], strict=True)) if kinds else [()] * batch.num_rows
            words = batch.column("words").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, g.words)
            numbers = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            group = np.array([numbers[k] for k in keys], dtype=np.int64)
            for k, i in numbers.items():
                mine = np.ascontiguousarray(words[group == i])
                ones = np.unpackbits(mine.astype("<i8").view(np.uint8), axis=1, bitorder="little")[:, : g.size].sum(axis=0, dtype=np.int64)
                sums[k] = sums[k] + ones if k in sums else ones
                totals[k] = totals.get(k, 0) + len(mine)
        if sums:
            cols = [pa.array([k[i] for k in sums], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64())), pa.array(list(totals.values()), pa.int64())], names=[*[f.name for f in kinds], "counts", "total"])

    parts = calls.select(*[f.name for f in kinds], "words").mapInArrow(run, schema)
    each = parts.select(*by, "total", F.posexplode("counts").alias("config_id", "called"))
    return each.groupBy(*by, "config_id").agg(F.sum("called").alias("called"), F.sum("total").alias("total"))


def grid_confusion(calls: DataFrame, labels: DataFrame, g: Grid, id_col: str = "record_ix", by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, tn, fn of every configuration against (id, y, by)."""
    counts = grid_counts(calls.join(labels.select(id_col, "y", *by), id_col), g, [*by, "y"])
    of = lambda y, c: F.coalesce(F.sum(F.when(F.col("y") == y, c)), F.lit(0).cast("long"))
    called, left = F.col("called"), F.col("total") - F.col("called")
    return counts.groupBy(*by, "config_id").agg(of(1, called).alias("tp"), of(0, called).alias("fp"), of(0, left).alias("tn"), of(1, left).alias("fn"))
