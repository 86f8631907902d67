"""SimHash near-dedup with pigeonring filtering.

A fingerprint is cut into ``BOXES`` boxes of 8 bits on a ring.  If two fingerprints differ in at most 3 bits, the
strong form of the pigeonhole principle on a ring says: from some box on, every chain of ``l`` consecutive boxes differs
in at most ``floor(3 l / 8)`` bits.  Chains of 1 and 2 boxes then have no difference and chains of up to 5 boxes one at
most.  So the first two boxes are equal, and of the next three at least two are: a join key of 32 bits, in 8 rotations
and 3 choices.  A candidate must also hold the chain budgets of every length before its full Hamming distance is taken.

Copies share a fingerprint, and only distinct fingerprints are joined, so large groups of copies cost one row.
Components are found on the fingerprint links alone by alternating large-star and small-star steps, cut after each
round with a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, keyed, small_batches, stored, text_or_empty

BITS, BOXES, WIDTH, DISTANCE, SHINGLE, SEED = 64, 8, 8, 3, 3, 42
_BLOCK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of the whole text as an unsigned integer; 0 if it has no word."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    total = np.zeros(BITS, dtype=np.int64)
    n = len(words) - shingle + 1
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):  # bounded memory for very long texts
        stop = min(n, at + _BLOCK)
        spans = zip(*(words[at + k : stop + k] for k in range(shingle)), strict=True)
        h = np.fromiter((hashed(b" ".join(s), SEED) for s in spans), dtype=np.uint64, count=stop - at)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64 bits as a signed long.  One narrow pass."""
    base = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    small_batches(docs.sparkSession)
    return base.mapInArrow(_fingerprint_batches, f"id {base.schema['id'].dataType.simpleString()}, fp long")


def _box(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % BOXES)).bitwiseAND(F.lit(255))


def ring_keys(fp: Column) -> Column:
    """The 24 keys of a fingerprint: rotation, choice, and the 32 bits of four boxes, packed into a long."""
    keys = []
    for start in range(BOXES):
        for k, pair in enumerate(combinations((2, 3, 4), 2)):
            key = F.lit(start * 3 + k).cast("long")
            for off in (0, 1, *pair):
                key = F.shiftleft(key, WIDTH).bitwiseOR(_box(fp, start + off))
            keys.append(key)
    return F.array(*keys)


def chain_ok(x: Column, start: Column) -> Column:
    """True if from ``start`` on every chain of boxes of the difference ``x`` keeps its proportional budget."""
    ok = F.lit(True)
    for length in range(1, BOXES + 1):
        if length * WIDTH < BITS:
            mask = F.lit((1 << (length * WIDTH)) - 1)
            ok = ok & (F.bit_count(_rotated(x, start).bitwiseAND(mask)) <= DISTANCE * length // BOXES)
        else:
            ok = ok & (F.bit_count(x) <= DISTANCE)
    return ok


def _rotated(x: Column, start: Column) -> Column:
    """``x`` turned right by ``start`` boxes."""
    by = (start * WIDTH).cast("int")
    return F.call_function("shiftrightunsigned", x, by).bitwiseOR(F.call_function("shiftleft", x, F.lit(BITS) - by))


def links(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of fingerprints in ``distinct`` (column fp) that differ in at most 3 bits, each once."""
    keyed = distinct.select("fp", F.explode(ring_keys(F.col("fp"))).alias("key"))
    left, right = keyed.withColumnRenamed("fp", "a"), keyed.withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    start = F.floor(F.shiftrightunsigned(F.col("key"), 32) / 3).cast("int")
    found = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.bit_count(x) <= DISTANCE) & chain_ok(x, start))
    return found.select("a", "b").distinct()


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node of its component.

    Large-star links each larger neighbour to the smallest node around, small-star the smaller ones; both keep the
    components and stop at stars.  Each round is written to the shared folder, so a lost executor costs one round.
    """
    now = stored(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), name)
    size = now.count()
    while True:
        both = now.unionByName(now.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        smallest = both.groupBy("lo").agg(F.min("hi").alias("m")).select(F.col("lo").alias("u"), F.least("lo", "m").alias("m"))
        large = both.join(smallest, F.col("lo") == F.col("u")).where("hi > lo").select(F.col("m").alias("lo"), "hi").where("lo < hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.col("m").alias("x"), F.explode(F.array("lo", "hi")).alias("y")).where("x < y").select(F.col("x").alias("lo"), F.col("y").alias("hi")).distinct()
        after = stored(small, name)
        n = after.count()
        # sets of as many edges of which one holds the other are equal
        still = n == size and now.join(after, ["lo", "hi"], "left_anti").isEmpty()
        drop_stored(now)
        now, size = after, n
        if still:
            break
    return after.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(after.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id that links reach).

    Defined cases: null, empty and wordless texts have fingerprint zero, which links like any other; a text of one or
    two words has the hash of the whole; a repeated id appears as often as it comes; a null id never is a
    component_id unless its component has no other id; an empty table gives no rows; other columns are not read.
    """
    marks = stored(fingerprints(docs, id_col, text_col), "simhash")
    distinct = stored(marks.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    tree = components(links(distinct), "simhash-stars")
    member = distinct.join(tree, distinct.fp == tree.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = stored(member, "simhash-member")
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one per component stays: one with the smallest id, a null id being the largest."""
    rows = keyed(docs, id_col)
    roots = simhash_groups(rows, "__row", text_col).select(F.col("component_id").alias("__row")).distinct()
    return rows.join(roots, "__row", "left_semi").select(*docs.columns)
