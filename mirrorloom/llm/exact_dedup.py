"""Exact dedup by an extendible-hash index on shared files.

Plan.  Each text, white space normalised, gets a 64-bit key (XXH64).  The index is a directory of ``2^g`` slots over
the key's leading bits; a slot names a bucket, and several slots share a bucket whose local depth is below the global
depth ``g``.  Building starts with one bucket per initial slot; a bucket with more than ``capacity`` distinct keys
splits on its next bit, and when its local depth equals the global depth the directory doubles.  The pages are a
Parquet table in the shared folder, range-partitioned by (bucket, key), so one owner task writes each key range.

Collisions.  Entries of one key form a chain.  Chain members are told apart by their bytes: the aggregate that builds
the pages groups by (key, text) and Spark compares the whole text on every probe of its hash map.  Copies collapse on
the map side, so a group holding a third of all rows sends one row per task; the look-up that follows goes from the
directory to (bucket, key), a join that adaptive execution can split.

Everything is DataFrame code; only the directory (at most ``2^max_depth`` slots) comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, keyed, stored, text_or_empty

#: Bits by which the directory starts, and by which it may grow at most: 2^16 slots of 16 bytes are 1 MB.
INITIAL_DEPTH, MAX_DEPTH = 4, 16
#: Distinct keys that a bucket holds before it splits.  Beyond 2^16 full buckets (268 million keys) a bucket keeps its depth
#: and its pages overflow: they are written by key range, so their size bounds no task.
CAPACITY = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def _slot(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth)


def grow_directory(counts: list[tuple[int, int]], capacity: int, initial: int, deepest: int) -> tuple[int, list[tuple[int, int, int]]]:
    """(global depth, [(slot, bucket, local depth)]) from the number of keys under each prefix of ``deepest`` bits.

    A bucket is named by its first slot at ``deepest`` bits, so a split renames only its upper half.  A bucket that is
    still too full at ``deepest`` bits stays whole and its pages grow (overflow chaining).
    """
    sizes = dict(counts)
    level = {}
    for prefix, n in sizes.items():
        level[prefix >> (deepest - initial)] = level.get(prefix >> (deepest - initial), 0) + n
    buckets = {(p, initial) for p in range(1 << initial)}
    depth = initial
    full = {(p, initial) for p, n in level.items() if n > capacity}
    by_bit = {initial: level}
    while full:
        local = min(d for _, d in full)
        if local == deepest:
            break
        if local == depth:
            depth += 1  # the directory doubles
        if local + 1 not in by_bit:
            nxt: dict[int, int] = {}
            for prefix, n in sizes.items():
                nxt[prefix >> (deepest - local - 1)] = nxt.get(prefix >> (deepest - local - 1), 0) + n
            by_bit[local + 1] = nxt
        for p, d in [b for b in full if b[1] == local]:
            buckets.discard((p, d))
            full.discard((p, d))
            for half in (2 * p, 2 * p + 1):
                buckets.add((half, d + 1))
                if by_bit[d + 1].get(half, 0) > capacity:
                    full.add((half, d + 1))
    slots = []
    for p, d in buckets:
        first = p << (depth - d)
        slots += [(first + i, p << (deepest - d), d) for i in range(1 << (depth - d))]
    return depth, sorted(slots)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, initial: int = INITIAL_DEPTH, deepest: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(rows, pages, directory, depth) of documents with a unique ``__row`` in the order of their ids.

    rows: __row, id, key, text_sha256 of every document.  pages: bucket, local_depth, key, chain (place in the key's
    chain), chained (length of the chain), text_sha256, keep_row, keep_id, group_size.  directory: slot, bucket, local_depth.
    """
    base = _base(docs, id_col, text_col)
    rows = stored(base.select("__row", "id", "key", F.sha2("norm", 256).alias("text_sha256")), "dedup-rows")
    prefixes = rows.groupBy("key").count().groupBy(_slot(F.col("key"), deepest).alias("p")).count()
    counts = [(r[0], r[1]) for r in prefixes.collect()]  # 2^deepest rows at most
    depth, slots = grow_directory(counts, capacity, initial, deepest)
    directory = docs.sparkSession.createDataFrame(slots, "slot long, bucket long, local_depth int")
    entries = (
        base.groupBy("key", "norm")
        .agg(F.min(F.struct("__row", "id")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
        .select("key", F.sha2("norm", 256).alias("text_sha256"), F.col("keep.__row").alias("keep_row"), F.col("keep.id").alias("keep_id"), "group_size")
        .withColumn("slot", _slot(F.col("key"), depth))
        .join(F.broadcast(directory), "slot")  # 2^deepest slots at most
    )
    key = Window.partitionBy("bucket", "key")
    pages = entries.repartitionByRange("bucket", "key").withColumn("chain", F.row_number().over(key.orderBy("text_sha256"))).withColumn("chained", F.count(F.lit(1)).over(key))
    return rows, stored(pages.select("bucket", "local_depth", "key", "chain", "chained", "text_sha256", "keep_row", "keep_id", "group_size"), "dedup-pages"), directory, depth


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select("__row", F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("key", F.xxhash64("norm"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, bucket, chain, __row.

    Look-up.  A key's leading bits name a slot of the directory, the slot a bucket, and its page holds every text of the
    key.  Where that is one text, the row's text is equal to it; where keys collide, the rows' bytes are compared with
    those of the chain.

    Defined cases: a null text counts as empty, so all null and empty texts form one group; exactly one row of a group
    is kept, the one with the smallest id, a null id being the largest and rows of one id in the order of a hash of the
    row; a group of null ids has a null keep_id; an empty table gives no rows; other columns of ``docs`` are only read
    where ids repeat.
    """
    docs = keyed(docs, id_col)
    rows, pages, directory, depth = build_index(docs, id_col, text_col, **index)
    shown = ["bucket", "key", "chain", "keep_row", "keep_id", "group_size"]
    asked = rows.withColumn("slot", _slot(F.col("key"), depth)).join(F.broadcast(directory.select("slot", "bucket")), "slot")
    found = asked.join(pages.where("chained = 1").select(*shown), ["bucket", "key"]).select("__row", "id", "text_sha256", *shown)
    several = pages.where("chained > 1")
    if not several.isEmpty():
        texts = _base(docs, id_col, text_col).join(several.select("key").distinct(), "key", "left_semi")
        chains = texts.groupBy("key", "norm").agg(F.min("__row").alias("keep_row")).join(several.select(*shown), ["key", "keep_row"])
        met = texts.join(chains, ["key", "norm"])  # whole texts, byte by byte
        found = found.unionByName(met.select("__row", "id", F.sha2("norm", 256).alias("text_sha256"), *shown))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("__row") == F.col("keep_row")).alias("kept"), "text_sha256", "bucket", "chain", "__row")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **index) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all their columns."""
    rows = keyed(docs, id_col)
    _, pages, *_ = build_index(rows, id_col, text_col, **index)
    return rows.join(pages.select(F.col("keep_row").alias("__row")), "__row", "left_semi").select(*docs.columns)
