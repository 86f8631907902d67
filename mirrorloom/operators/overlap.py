"""Non-overlapping selection of hits.

No decision reaches beyond an island of transitively overlapping hits, so hits may be dealt out by sequence or, where a
sequence holds most of all hits, by island.  Within a partition they are sorted by place, so one pass sees every island in
order.  ``greedy`` keeps a state of one hit, ``score`` one island, so memory follows the largest island.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import ceiling, score_hit
from ..params import STRATEGIES
from .intervals import carried


def islands(hits: DataFrame, key: str | tuple[str, ...] = "seq_id", out: str = "island", keep: bool = True) -> DataFrame:
    """``hits`` with ``island``: hits of a sequence that overlap, directly or through others, share it.  ``keep`` holds them in memory or on disk, which a stored table does not need."""
    keys = (key,) if isinstance(key, str) else tuple(key)
    hits = hits.persist() if keep else hits  # read for the ends per stretch, the flags per stretch, and both joins
    rows = carried(hits, keys, "start", F.col("end"), F.max)
    within = Window.partitionBy(*keys, "_bin").orderBy("start", "end")
    reach = F.greatest("_carry", F.max("end").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    marked = rows.withColumn("_new", F.coalesce(reach < F.col("start"), F.lit(True)).cast("long")).drop("_carry", "_bin")
    numbered = carried(marked, keys, "start", F.col("_new"), F.sum)
    # hits at the same place are peers, so they get the same number whichever of them opens the island
    upto = within.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return numbered.withColumn(out, F.coalesce("_carry", F.lit(0)) + F.sum("_new").over(upto)).drop("_new", "_carry", "_bin")


def _priority(h: dict) -> tuple:
    s = h["total_score"]
    scored = s is not None and s == s
    return (not scored, -s if scored else 0.0, -h["arm_length"], h["spacer_length"], h["start"], h["end"], h["full_sequence"])


def greedy_sweep(ordered: Iterator[tuple[tuple, dict]]) -> Iterator[int]:
    """Row numbers kept by the sweep over (key, hit) in order of (key, start, -arm, spacer)."""
    last = None
    for at, (key, h) in enumerate(ordered):
        if last is None or key != last[1] or h["start"] > last[2]["end"]:
            if last is not None:
                yield last[0]
        elif (h["arm_length"], -h["spacer_length"]) <= (last[2]["arm_length"], -last[2]["spacer_length"]):
            continue
        last = (at, key, h)
    if last is not None:
        yield last[0]


def best_first(island: list[tuple[int, dict]]) -> list[int]:
    """Row numbers of the hits of an island that are accepted when visited by priority."""
    taken: list[tuple[int, int, int]] = []
    for at, h in sorted(island, key=lambda x: _priority(x[1])):
        i = bisect_right(taken, (h["end"], 1 << 62, 0))
        if i and taken[i - 1][1] >= h["start"]:
            continue
        insort(taken, (h["start"], h["end"], at))
    return [at for *_, at in taken]


def _by_islands(ordered: Iterator[tuple[tuple, dict]]) -> Iterator[int]:
    island: list[tuple[int, dict]] = []
    key, upto = None, 0
    for at, (k, h) in enumerate(ordered):
        if island and (k != key or h["start"] > upto):
            yield from sorted(best_first(island))
            island = []
        upto = max(upto, h["end"]) if island else h["end"]
        key = k
        island.append((at, h))
    yield from sorted(best_first(island))


def remove_overlaps(hits: DataFrame, strategy: str = "greedy", key: tuple[str, ...] = ("seq_id",), by_island: bool = False) -> DataFrame:
    """Hits that stay under ``greedy`` or ``score`` (also ``stability``) selection; no two of a key overlap."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown overlap strategy {strategy!r}")
    if strategy != "greedy" and "total_score" not in hits.columns:
        raise ValueError("selection by score needs scored hits")
    needed = ["start", "end", "arm_length", "spacer_length", "full_sequence"] + ["total_score"] * (strategy != "greedy")
    choose = greedy_sweep if strategy == "greedy" else _by_islands
    keys, schema = [*key, "_island"], T.StructType([*hits.schema.fields, T.StructField("_island", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, pa.RecordBatch]] = []  # batches that may still give rows, with the number of their first row
        total = 0

        def rows() -> Iterator[tuple[tuple, dict]]:
            nonlocal total
            for batch in batches:
                held.append((total, batch))
                total += batch.num_rows
                cols = {n: batch.column(batch.schema.names.index(n)).to_pylist() for n in {*keys, *needed}}
                for i in range(batch.num_rows):
                    yield tuple(cols[k][i] for k in keys), {n: cols[n][i] for n in needed}

        picked: list[int] = []

        def flush(upto: int) -> Iterator[pa.RecordBatch]:
            nonlocal picked
            while held and held[0][0] + held[0][1].num_rows <= upto:
                first, batch = held.pop(0)
                mine = [x - first for x in picked if x < first + batch.num_rows]
                picked = picked[len(mine) :]
                if mine:
                    yield batch.take(pa.array(mine, pa.int64()))

        for at in choose(rows()):
            yield from flush(at)
            picked.append(at)
        yield from flush(total)

    return _dealt(hits, key, by_island).mapInArrow(run, schema).drop("_island")


def _dealt(hits: DataFrame, key: tuple[str, ...], by_island: bool) -> DataFrame:
    """``hits`` with ``_island``, dealt out and in the order of the sweep.

    By sequence they are shuffled once, which suits many short ones.  By island a sequence with most of all hits is
    spread over many tasks, for some passes more over the hits.
    """
    placed = islands(hits, key, "_island") if by_island else hits.withColumn("_island", F.lit(0).cast("long"))
    parts = [*key, "_island"] if by_island else list(key)
    n = int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*key, "_island", F.col("start"), F.col("arm_length").desc(), F.col("spacer_length")]
    return placed.select(*hits.columns, "_island").repartition(n, *parts).sortWithinPartitions(*order, "full_sequence")


def best_first_lazily(island: list[dict], drop_homopolymers: bool = False) -> list[dict]:
    """The hits that selection by score accepts, with their scores, scoring as few as possible.

    Hits wait under a score that they cannot exceed.  A hit that comes up and overlaps an accepted one goes unscored;
    otherwise it is scored and waits again under its score, behind any that might still equal it.
    """
    heap = [(-ceiling(h["left_arm"], h["spacer"], h["right_arm"]), 0, i) for i, h in enumerate(island)]
    heapq.heapify(heap)
    taken: list[tuple[int, int, int]] = []
    scored: dict[int, dict] = {}
    unscorable: list[tuple] = []

    def clashes(h: dict) -> bool:
        i = bisect_right(taken, (h["end"], 1 << 62, 0))
        return bool(i) and taken[i - 1][1] >= h["start"]

    while heap:
        _, known, *rest = heapq.heappop(heap)
        i = rest[-1]
        if clashes(island[i]):
            continue
        if known:
            insort(taken, (island[i]["start"], island[i]["end"], i))
            continue
        h = island[i]
        got = score_hit(h["left_arm"], h["spacer"], h["right_arm"])
        h = h | dict(zip(("stacking_score", "pairing_score", "total_score", "putative_triplex"), got or (None, None, None, ""), strict=True))
        bare = h["putative_triplex"].translate({91: None, 93: None})
        if drop_homopolymers and len(set(bare)) == 1:
            continue
        scored[i] = h
        if got is None:
            unscorable.append((_priority(h), i))
        else:
            heapq.heappush(heap, (-got[2], 1, _priority(h), i))
    for _, i in sorted(unscorable):
        if not clashes(island[i]):
            insort(taken, (island[i]["start"], island[i]["end"], i))
    return [scored[i] for *_, i in taken]
