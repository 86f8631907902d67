"""Detection as DataFrame stages: chunk records by midpoint, run the kernel on Arrow batches, build hit rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernel import detect_stretches, percentages, together
from ..params import ScanParams
from ..schema import NO_SPACER, RAW_HIT, SOURCE

CHUNK = 1 << 18
ROWS = 1 << 12  # hits of a batch that leaves a worker: spans of long repeats run to thousands of bases


def chunked(records: DataFrame, p: ScanParams, size: int = CHUNK, rebalance: bool = False) -> DataFrame:
    """Chunks of records: every midpoint belongs to one chunk, with all the context that its arms may reach.

    The result of a scan therefore does not depend on ``size``, and no candidate comes from two chunks.  ``rebalance`` deals the chunks out evenly, which a few
    long records (chromosomes) need and many short ones do not.
    """
    binary = records.select("record_ix", "seq_id", "seq_offset", F.col("seq").cast("binary").alias("b")).withColumn("n", F.octet_length("b").cast("long"))
    at = binary.withColumn("c0", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n") - 1, F.lit(0).cast("long")), F.lit(size).cast("long"))))
    lead, tail = context(p)
    first = F.greatest(F.col("c0") - lead, F.lit(0))
    last = F.least(F.col("c0") + size + tail, F.col("n"))
    out = at.select(
        "record_ix", "seq_id", "seq_offset", first.alias("shift"), (F.col("c0") - first).cast("int").alias("own_from"),
        (F.least(F.col("c0") + size, F.col("n")) - first).cast("int").alias("own_to"), F.substring("b", (first + 1).cast("int"), (last - first).cast("int")).alias("b"),
    )
    return out.repartition(4 * records.sparkSession.sparkContext.defaultParallelism) if rebalance else out


def _hits(p: ScanParams, extend: bool, kept: list[dict] | None = None, composed: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            column = lambda n: batch.column(names.index(n))  # noqa: E731, B023
            lengths = pc.fill_null(pc.binary_length(column("b")), 0).to_pylist()
            # hits leave by the sequences that go through the kernel together and by slices of these, so memory does not follow the batch
            for lo, hi in together(lengths):
                few = batch.slice(lo, hi - lo)
                cols = {n: few.column(names.index(n)).to_pylist() for n in ("b", "own_from", "own_to", "shift", "seq_offset")}
                seqs = [(b or b"").lower() for b in cols["b"]]
                owns = list(zip(cols["own_from"], cols["own_to"], strict=True))
                shifts = np.array([a + (o or 1) for a, o in zip(cols["shift"], cols["seq_offset"], strict=True)], dtype=np.int64)
                counters = None if kept is None else {}
                for got in detect_stretches(seqs, owns, p, extend, counters, composed):
                    for at in range(0, len(got["row"]), ROWS):
                        g = {k: v[at : at + ROWS] for k, v in got.items()}
                        spans = [seqs[i][a:b].decode("latin-1") for i, a, b in zip(g["row"].tolist(), g["start"].tolist(), g["end"].tolist(), strict=True)]
                        row = pa.array(g["row"])
                        ga, ct, mirror = percentages(g["ga"], g["ct"], g["mis"], g["arm"])
                        perfect = ((g["ga"] == g["arm"]) | (g["ct"] == g["arm"])) & (g["mis"] == 0)
                        start, end = g["start"] + shifts[g["row"]], g["end"] + shifts[g["row"]] - 1
                        i32 = lambda k: pa.array(g[k].astype(np.int32))  # noqa: E731, B023
                        yield pa.RecordBatch.from_arrays(
                            [few.column(names.index("record_ix")).take(row), few.column(names.index("seq_id")).take(row), pa.array(start), pa.array(end), i32("arm"), i32("spacer"), i32("ga"), i32("ct"), i32("mis"), pa.array(ga), pa.array(ct), pa.array(mirror), pa.array(perfect), pa.array(spans, pa.string())],
                            names=["record_ix", "seq_id", "start", "end", "arm_length", "spacer_length", "ga", "ct", "mismatches", "ga_pct", "ct_pct", "mirror_identity", "is_perfect", "full_sequence"],
                        )
                if kept is not None:
                    kept.extend(dict(zip(counters, c, strict=True)) for c in zip(*counters.values(), strict=True))

    return run


def raw_candidates(records: DataFrame, p: ScanParams, extend: bool = True, size: int = CHUNK, rebalance: bool = False, composed: bool = False) -> DataFrame:
    """Detector rows (one per centre and spacer), extended inwards; a geometry appears once."""
    return candidates_of(chunked(records, p, size, rebalance), p, extend, composed)


def context(p: ScanParams) -> tuple[int, int]:
    """Bases before and after a chunk's own that its arms may reach."""
    return p.maxrep + p.maxspacer + 1, p.maxspacer + p.maxrep + 2


COUNTERS = ("ctr_sp_pairs", "inner_iters")


def counted_candidates(chunks: DataFrame, p: ScanParams, extend: bool = True) -> DataFrame:
    """:func:`candidates_of` and, for every chunk, a row with null coordinates that carries its counters (``COUNTERS``)."""
    names = [c.split()[0].strip("`") for c in RAW_HIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept: list[dict] = []
            for hits in _hits(p, extend, kept)(iter([batch])):
                nulls = [pa.nulls(hits.num_rows, pa.int64())] * len(COUNTERS)
                yield pa.RecordBatch.from_arrays([*hits.select(names).columns, *nulls], names=[*names, *COUNTERS])
            ids = batch.column(batch.schema.names.index("record_ix"))
            types = {"record_ix": ids.type, "seq_id": pa.string(), "full_sequence": pa.string(), "is_perfect": pa.bool_(), "start": pa.int64(), "end": pa.int64()}
            types |= dict.fromkeys(["ga_pct", "ct_pct", "mirror_identity"], pa.float64())
            empty = [ids if c == "record_ix" else pa.nulls(batch.num_rows, types.get(c, pa.int32())) for c in names]
            yield pa.RecordBatch.from_arrays([*empty, *[pa.array([k[c] for k in kept], pa.int64()) for c in COUNTERS]], names=[*names, *COUNTERS])

    return chunks.mapInArrow(run, RAW_HIT + "".join(f", {c} long" for c in COUNTERS))


def candidates_of(chunks: DataFrame, p: ScanParams, extend: bool = True, composed: bool = False) -> DataFrame:
    """Detector rows of chunks; with ``composed`` only those that the composition filters of ``p`` keep, whose strings alone are cut and sent."""
    return chunks.mapInArrow(_hits(p, extend, composed=composed), RAW_HIT)


def deduplicate_geometry(raw: DataFrame) -> DataFrame:
    """Candidates from elsewhere once per geometry; those of :func:`raw_candidates` need no such shuffle."""
    return raw.dropDuplicates(["record_ix", "start", "end", "arm_length"])


def parts() -> dict[str, Column]:
    """What follows from a span and its lengths: columns that need not go along where hits are shuffled or sent to a worker."""
    arm, sp, s = F.col("arm_length"), F.col("spacer_length"), F.col("full_sequence")
    return {
        "source": F.lit(SOURCE), "total_length": arm * 2 + sp, "left_arm": F.substring(s, F.lit(1), arm),
        "spacer": F.when(sp == 0, NO_SPACER).otherwise(F.substring(s, arm + 1, sp)), "right_arm": F.substring(s, arm + sp + 1, arm),
    }


def materialise(raw: DataFrame) -> DataFrame:
    """Arm, spacer and total columns from the span."""
    more = {n: c.alias(n) for n, c in parts().items()}
    return raw.select(
        "record_ix", "seq_id", more["source"], "start", "end", "arm_length", "spacer_length", more["total_length"],
        "ga_pct", "ct_pct", "mirror_identity", "is_perfect", more["left_arm"], more["spacer"], more["right_arm"], "full_sequence", "ga", "ct", "mismatches",
    )
