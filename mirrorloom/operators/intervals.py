"""Interval operators.  Hits are 1-based and inclusive, BED intervals 0-based and half-open.

Joins on overlap go through bins: both sides send a row per bin of ``width`` positions that they touch, join on (key,
bin), and a pair is kept only in the first bin that both touch, so nothing is joined twice and no deduplication is
needed.  Adaptive execution can split a bin that holds too many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import odds_ratio
from .evaluation import seeded, uniform
from .ranks import running

BIN = 1024
#: Positions of a bin within which running values are windowed; between bins they are carried.
STRETCH = 1 << 16


def carried(df: DataFrame, key: tuple[str, ...], at: str, of: Column, how: Callable[[Column], Column], width: int = STRETCH) -> DataFrame:
    """``df`` with ``_bin``, the stretch of ``at`` a row lies in, and ``_carry``: ``how`` of ``of`` over all earlier stretches of its key.

    What runs along a sequence is so split into windows within stretches and one over a row per stretch: a hot
    sequence is spread over tasks.
    """
    binned = df.withColumn("_bin", F.floor(F.col(at) / width).cast("long"))
    per = binned.groupBy(*key, "_bin").agg(how(of).alias("_own"))
    before = Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return binned.join(per.select(*key, "_bin", how(F.col("_own")).over(before).alias("_carry")), [*key, "_bin"])


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def to_bed(hits: DataFrame) -> DataFrame:
    return hits.select(F.col("seq_id").alias("chrom"), (F.col("start") - 1).alias("start0"), F.col("end").alias("end0"))


def overlap_pairs(left: DataFrame, right: DataFrame, key: str = "seq_id", width: int = BIN, pad: int = 0) -> DataFrame:
    """All pairs of overlapping intervals; the right's columns get the prefix ``r_``.  ``pad`` widens the right ones."""
    b = lambda c: F.floor(c / width).cast("long")
    lo, hi = F.col("start"), F.col("end")
    a = left.withColumn("_bin", F.explode(F.sequence(b(lo), b(F.greatest(hi, lo)))))
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    rs, re = F.col("r_start") - pad, F.col("r_end") + pad
    r = r.withColumn("_rbin", F.explode(F.sequence(b(rs), b(F.greatest(re, rs)))))
    on = (F.col(key) == F.col(f"r_{key}")) & (F.col("_bin") == F.col("_rbin"))
    pairs = a.join(r, on).where((lo <= re) & (hi >= rs) & (F.col("_bin") == F.greatest(b(lo), b(rs))))
    return pairs.drop("_bin", "_rbin")


def any_overlap(left: DataFrame, right: DataFrame, key: str = "seq_id", id_col: str = "id", keep: bool = True, width: int = BIN, pad: int = 0) -> DataFrame:
    """Rows of ``left`` that overlap some row of ``right``, or none of them with ``keep`` false."""
    met = overlap_pairs(left.select(id_col, key, "start", "end"), right.select(key, "start", "end"), key, width, pad).select(id_col).distinct()
    return left.join(met, id_col, "left_semi" if keep else "left_anti")


def matches(overlap: Column, length1: Column, length2: Column, fraction: Column | float) -> Column:
    """At least ``fraction`` of either interval is covered."""
    return (overlap / length1 >= fraction) | (overlap / length2 >= fraction)


def best_matches(inserts: DataFrame, hits: DataFrame, fraction: float, key: str = "seq_id", id_col: str = "id", width: int = BIN) -> DataFrame:
    """Per insert its best matching hit and the number of matches: score (NaN and null rank as -(-1)), overlap, start."""
    pairs = overlap_pairs(inserts, hits, key, width)
    o = overlap_length(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    pairs = pairs.withColumn("overlap", o).where(matches(F.col("overlap"), F.col("end") - F.col("start") + 1, F.col("r_end") - F.col("r_start") + 1, fraction))
    rank = F.when(F.col("r_total_score").isNull() | F.isnan("r_total_score"), -1.0).otherwise(-F.col("r_total_score"))
    best = pairs.groupBy(id_col).agg(F.min(F.struct(rank.alias("a"), (-F.col("overlap")).alias("b"), F.col("r_start").alias("s"), F.col("r_end").alias("e"), F.col("r_total_score").alias("t"))).alias("m"), F.count(F.lit(1)).alias("n_matches"))
    got = best.select(id_col, "n_matches", F.col("m.s").alias("best_start"), F.col("m.e").alias("best_end"), (-F.col("m.b")).alias("best_overlap"), F.col("m.t").alias("best_score"))
    return inserts.join(got, id_col, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def overlap_sweep(inserts: DataFrame, hits: DataFrame, fractions: list[float], key: str = "seq_id", id_col: str = "id") -> DataFrame:
    """Inserts matched at each fraction.  The pairs are joined once; only their best coverage is kept."""
    pairs = overlap_pairs(inserts, hits, key)
    o = overlap_length(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    cover = F.greatest(o / (F.col("end") - F.col("start") + 1), o / (F.col("r_end") - F.col("r_start") + 1))
    best = pairs.groupBy(id_col).agg(F.max(cover).alias("cover"))
    counts = [F.struct(F.lit(f).alias("fraction"), F.count_if(F.col("cover") >= f).alias("matched")) for f in fractions]
    return best.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def coverage(inserts: DataFrame, hits: DataFrame, key: str = "seq_id", id_col: str = "id") -> DataFrame:
    """Per insert the largest share of it that one hit covers, 0 without any."""
    pairs = overlap_pairs(inserts, hits, key)
    o = overlap_length(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end")) / (F.col("end") - F.col("start") + 1)
    return inserts.join(pairs.groupBy(id_col).agg(F.max(o).alias("c")), id_col, "left").select(id_col, F.coalesce("c", F.lit(0.0)).alias("max_coverage"))


def overlapping_neighbours(hits: DataFrame, key: str = "seq_id") -> DataFrame:
    """Per key, whether two of its intervals overlap."""
    # two overlap iff some interval starts no later than the greatest end before it
    rows = carried(hits.select(key, "start", "end"), (key,), "start", F.col("end"), F.max)
    before = Window.partitionBy(key, "_bin").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest("_carry", F.max("end").over(before))
    return rows.select(key, (F.col("start") <= reach).alias("o")).groupBy(key).agg(F.coalesce(F.bool_or("o"), F.lit(False)).alias("has_overlap"))


def as_of_region(points: DataFrame, regions: DataFrame, key: str = "seq_id") -> DataFrame:
    """For each interval the last of the non-overlapping regions that starts before its end, if it reaches its start.

    One union sorted by place instead of a join: the latest region is carried down to the intervals that follow it.
    """
    a = points.select(key, F.col("id"), F.col("start"), F.col("end"), F.lit(None).cast("long").alias("rs"), F.lit(None).cast("long").alias("re"), F.col("end").alias("at"), F.lit(1).alias("kind"))
    b = regions.select(key, F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.col("start").alias("rs"), F.col("end").alias("re"), F.col("start").alias("at"), F.lit(0).alias("kind"))
    region = F.when(F.col("kind") == 0, F.struct("rs", "re"))  # the last one is the greatest
    both = carried(a.unionByName(b), (key,), "at", region, F.max)
    w = Window.partitionBy(key, "_bin").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("last", F.coalesce(F.max(region).over(w), "_carry")).where("kind = 1")
    ok = F.col("last.re") >= F.col("start")
    return seen.select(key, "id", "start", "end", F.when(ok, F.col("last.rs")).alias("region_start"), F.when(ok, F.col("last.re")).alias("region_end"))


SIGNATURE = ["seq_id", "start", "end", "arm_length", "spacer_length", "ga_pct", "ct_pct", "mirror_identity"]


def same_hits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of :func:`compare_sets` over coordinates and percentages rounded to four places."""
    rounded = lambda df: df.select(*[F.round(c, 4).alias(c) if c in SIGNATURE[5:] else F.col(c) for c in SIGNATURE])
    return compare_sets(rounded(a), rounded(b), SIGNATURE)


def compare_sets(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in both, only in a, only in b (distinct), by one full aggregate over the union."""
    both = a.select(*columns, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*columns, F.lit(0).alias("a"), F.lit(1).alias("b")))
    each = both.groupBy(*columns).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return each.agg(F.count_if(F.expr("a = 1 and b = 1")).alias("shared"), F.count_if(F.expr("b = 0")).alias("only_a"), F.count_if(F.expr("a = 0")).alias("only_b"))


def coverage_of_sets(a: DataFrame, b: DataFrame, key: str = "seq_id") -> DataFrame:
    """One row: distinct intervals of each set, those in both, of ``a`` those that overlap ``b`` and their share, and of ``b`` those that overlap none of ``a``."""
    place = [key, "start", "end"]
    one = lambda df: df.select(*place).distinct().withColumn("_id", F.concat_ws(":", *[F.col(c).cast("string") for c in place]))
    x, y = one(a), one(b)
    sets = compare_sets(x, y, place)
    covered = any_overlap(x, y, key, "_id").agg(F.count(F.lit(1)).alias("a_covered"))
    alone = any_overlap(y, x, key, "_id", keep=False).agg(F.count(F.lit(1)).alias("b_alone"))
    both = sets.join(F.broadcast(covered)).join(F.broadcast(alone))  # one row each
    n = F.col("shared") + F.col("only_a")
    return both.select(n.alias("a_loci"), (F.col("shared") + F.col("only_b")).alias("b_loci"), "shared", "a_covered", F.try_divide(F.col("a_covered").cast("double"), n).alias("a_covered_fraction"), "b_alone")


def outside(points: DataFrame, hits: DataFrame, pad: int, key: str = "seq_id", id_col: str = "id") -> DataFrame:
    """Intervals that keep ``pad`` positions away from every hit."""
    return any_overlap(points, hits, key, id_col, keep=False, pad=pad)


def bin_counts(points: DataFrame, width: int = 200, key: str = "chrom", pos: str = "pos") -> DataFrame:
    return points.groupBy(key, F.floor((F.col(pos) - 1) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def poisson_tail(lam: Column, k: Column, steps: int = 400) -> Column:
    """P(X >= k): the regularised incomplete gamma function P(k, lam).

    Below ``k + 1`` by its power series, above by the complement's continued fraction, both from the leading term in logs; ``steps``
    terms suffice while either is far from its edge, and near it the number grows with the root of ``lam``, not with ``k``.
    """
    x, a = lam.cast("double"), k.cast("double")
    root = F.greatest(F.lit(float(steps)), F.ceil(12 * F.sqrt(F.greatest(x, a)))).cast("int")
    lead = F.exp(a * F.log(x) - x - _log_gamma(a))
    series = F.aggregate(
        F.sequence(F.lit(1), root), F.struct((1 / a).alias("t"), (1 / a).alias("s")),
        lambda v, i: F.struct((v["t"] * x / (a + i)).alias("t"), (v["s"] + v["t"] * x / (a + i)).alias("s")), lambda v: v["s"])
    # modified Lentz: b = x + 1 - a, then b + 2 i with partial numerators -i (i - a)
    tiny = 1e-300
    b0 = x + 1 - a
    start = F.struct((1 / b0).alias("d"), F.lit(1 / tiny).alias("c"), (1 / b0).alias("h"))

    def lentz(v: Column, i: Column) -> Column:
        an, b = -i * (i - a), b0 + 2 * i
        d = an * v["d"] + b
        c = b + an / v["c"]
        d = 1 / F.when(F.abs(d) < tiny, tiny).otherwise(d)
        c = F.when(F.abs(c) < tiny, tiny).otherwise(c)
        return F.struct(d.alias("d"), c.alias("c"), (v["h"] * d * c).alias("h"))

    fraction = F.aggregate(F.sequence(F.lit(1), root), start, lentz, lambda v: v["h"])
    tail = F.when(x < a + 1, lead * series).otherwise(1 - lead * fraction)
    return F.when(k <= 0, 1.0).when(lam <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def _log_gamma(a: Column) -> Column:
    """Stirling's series after moving the argument above 10; exact to the last bits for whole numbers."""
    up = F.greatest(F.lit(0), F.ceil(10 - a)).cast("int")
    moved = F.aggregate(F.sequence(F.lit(1), up), F.lit(0.0), lambda v, i: v + F.log(a + i - 1))
    below = F.when(up > 0, moved).otherwise(0.0)
    z = a + up
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, F.lit(5.0))) - 1 / (1680 * F.pow(z, F.lit(7.0))) - below


def benjamini_hochberg(df: DataFrame, p: str = "p", out: str = "q") -> DataFrame:
    """Adjusted p-values over all rows, from the counts per distinct p, with sums and minima by ranges."""
    per = df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(per, [F.col("_p")], {"_rank": F.col("_n")}, (), "adjusted-ranks")
    total = ranked.agg(F.max("_rank").alias("_all"))
    raw = ranked.join(F.broadcast(total)).select("_p", (F.col("_p") * F.col("_all") / F.col("_rank")).alias("_raw"))  # one row
    adjusted = running(raw, [F.col("_p").desc()], {"_least": F.col("_raw")}, (), "adjusted", F.min).select("_p", F.least(F.lit(1.0), F.col("_least")).alias(out))
    return df.join(adjusted, F.col(p) == F.col("_p"), "left").drop("_p")


def halo(df: DataFrame, key: str, at: str, before: int, after: int, width: int = STRETCH) -> DataFrame:
    """``df`` with ``_stretch`` and ``_own``: each row in its own stretch of ``at``, and copied to those whose border is within reach."""
    bin_ = lambda c: F.floor(c / width).cast("long")
    out = df.withColumn("_stretch", F.explode(F.sequence(bin_(F.col(at) - after), bin_(F.col(at) + before))))
    return out.withColumn("_own", F.col("_stretch") == bin_(F.col(at)))


def enriched_bins(counts: DataFrame, control: DataFrame, scale: float, genome_mean: float, key: str = "chrom", half: int = 25, fdr: float = 0.01) -> DataFrame:
    """Bins whose count beats scale * max(control, mean of 50 bins around, genome mean), among the bins of all keys; bins must be complete per key."""
    both = counts.join(control.withColumnRenamed("n", "c"), [key, "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    near = halo(both, key, "bin", half, half)
    around = F.sum("c").over(Window.partitionBy(key, "_stretch").orderBy("bin").rangeBetween(-half, half - 1)) / (2 * half)
    lam = F.lit(scale) * F.greatest(F.col("c").cast("double"), around, F.lit(genome_mean))
    tested = near.withColumn("lam", lam).where("_own").drop("_stretch", "_own").withColumn("p", poisson_tail(F.col("lam"), F.col("n")))
    return benjamini_hochberg(tested).where(F.col("q") <= fdr)


def merge_bins(bins: DataFrame, width: int = 200, key: str = "chrom") -> DataFrame:
    """Neighbouring bins as intervals (0-based, half-open)."""
    distinct = bins.select(key, "bin").distinct()
    numbered = carried(distinct, (key,), "bin", F.lit(1).cast("long"), F.sum)
    place = F.coalesce("_carry", F.lit(0)) + F.row_number().over(Window.partitionBy(key, "_bin").orderBy("bin"))
    return numbered.withColumn("g", F.col("bin") - place).groupBy(key, "g").agg((F.min("bin") * width).alias("start0"), ((F.max("bin") + 1) * width).alias("end0")).drop("g")


def rpkm(count: Column, length: Column, total: Column | int) -> Column:
    return count * 1e9 / (length * total)


def log2_enrichment(signal: Column, background: Column, pseudo: float = 0.5) -> Column:
    """Log ratio of two densities, ``pseudo`` added to both."""
    return F.log2((signal + pseudo) / (background + pseudo))


def prefix_sums(track: DataFrame, key: str = "chrom", pos: str = "bin", value: str = "v") -> DataFrame:
    rows = carried(track, (key,), pos, F.col(value), F.sum)
    within = Window.partitionBy(key, "_bin").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.coalesce("_carry", F.lit(0)) + F.sum(value).over(within)).drop("_bin", "_carry")


def signal_means(intervals: DataFrame, track: DataFrame, key: str = "chrom") -> DataFrame:
    """Mean of the track over bins [b0, b1) of each interval, from two look-ups in its prefix sums."""
    sums = prefix_sums(track, key).select(key, F.col("bin"), "upto")
    end = sums.select(key, (F.col("bin") + 1).alias("b1"), F.col("upto").alias("hi"))
    start = sums.select(key, (F.col("bin") + 1).alias("b0"), F.col("upto").alias("lo"))
    got = intervals.join(end, [key, "b1"], "left").join(start, [key, "b0"], "left")
    return got.withColumn("mean_signal", (F.coalesce("hi", F.lit(0)) - F.coalesce("lo", F.lit(0))) / (F.col("b1") - F.col("b0"))).drop("hi", "lo")


def windows_of(records: DataFrame, width: int, step: int) -> DataFrame:
    """(seq_id, pos, gc, asymmetry) of windows without other letters, by prefix counts: a record is read once however many windows it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seqs = batch.column("seq_id"), batch.column("b")
            for i in range(batch.num_rows):
                d = np.frombuffer(seqs[i].as_py() or b"", dtype=np.uint8)
                if len(d) < width:
                    continue
                upto = {}
                for letters in (b"GC", b"GA", b"CT", b"ACGT"):
                    mine = np.zeros(256, dtype=bool)
                    mine[list(letters + letters.lower())] = True
                    upto[letters] = np.concatenate([[0], np.cumsum(mine[d])])
                pos = np.arange(0, len(d) - width + 1, step)
                n = {k: v[pos + width] - v[pos] for k, v in upto.items()}
                pos, gc, skew = (x[n[b"ACGT"] == width] for x in (pos, n[b"GC"] / width, np.abs(n[b"GA"] - n[b"CT"]) / width))
                for at in range(0, len(pos), 1 << 14):
                    few = pos[at : at + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.full(len(few), i))), pa.array(few.astype(np.int32)), pa.array(gc[at : at + len(few)]), pa.array(skew[at : at + len(few)])], names=["seq_id", "pos", "gc", "asymmetry"])

    return records.select("seq_id", F.col("seq").cast("binary").alias("b")).mapInArrow(run, "seq_id string, pos int, gc double, asymmetry double")


def matched_controls(cases: DataFrame, pool: DataFrame, cells: list[str], per_cell: int = 200, draws: int = 10, widen: str | None = None, seed: int = 1, key: str = "seq_id") -> DataFrame:
    """``draws`` controls with replacement per case (id, cells) from the pool of its cell.

    A cell of the pool keeps ``per_cell`` windows of each sequence, in the order of a seeded digest (the feature's cap).
    If a cell is empty, the pool is that of all cells with ``widen`` within 1, then within 2.  A cell's pool is numbered,
    so the join is on (cell, number) and one row comes back per draw.
    """
    names = [c for c in pool.columns if c not in cells]
    order = Window.partitionBy(*cells, key).orderBy(seeded(seed, *names), *names)
    kept = pool.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_cell).drop("_r")
    if widen:
        kept = kept.withColumn("_far", F.explode(F.sequence(F.lit(-2), F.lit(2)))).withColumn(widen, (F.col(widen) + F.col("_far")).cast(pool.schema[widen].dataType)).withColumn("_far", F.abs("_far"))
    else:
        kept = kept.withColumn("_far", F.lit(0))
    cell = Window.partitionBy(*cells)
    within = kept.withColumn("_least", F.min("_far").over(cell)).where("_far <= _least")
    numbered = within.withColumn("_k", F.row_number().over(cell.orderBy(seeded(seed, *names), *names)) - 1)
    sizes = within.groupBy(*cells).agg(F.count(F.lit(1)).alias("_n"), F.first("_least").alias("widened"))
    each = cases.select("id", *cells).join(sizes, cells).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    each = each.withColumn("_k", F.floor(uniform(seeded(seed, "id", "draw")) * F.col("_n")).cast("int"))
    return each.join(numbered.select(*cells, "_k", *[F.col(c).alias(f"control_{c}") for c in names]), [*cells, "_k"]).select("id", *cells, "draw", "widened", *[f"control_{c}" for c in names])


def selectivity(motifs: DataFrame, hits: DataFrame, called: Column, key: str = "seq_id", id_col: str = "id") -> DataFrame:
    """One row: motifs with and without a hit by call, the odds ratio, and the mean best score of either kind of call."""
    best = overlap_pairs(motifs.select(id_col, key, "start", "end"), hits.select(key, "start", "end", "total_score"), key).groupBy(id_col).agg(F.max("r_total_score").alias("_best"), F.count(F.lit(1)).alias("_n"))
    rows = motifs.join(best, id_col, "left").select(called.alias("plus"), F.col("_n").isNotNull().alias("hit"), F.col("_best"))
    n = lambda h, p: F.count_if((F.col("hit") == h) & (F.col("plus") == p))
    got = rows.agg(n(True, True).alias("hit_plus"), n(True, False).alias("hit_minus"), n(False, True).alias("no_hit_plus"), n(False, False).alias("no_hit_minus"),
                   F.avg(F.when(F.col("plus"), F.col("_best"))).alias("score_plus"), F.avg(F.when(~F.col("plus"), F.col("_best"))).alias("score_minus"))
    return got.withColumn("odds_ratio", odds_ratio(F.col("hit_plus"), F.col("hit_minus"), F.col("no_hit_plus"), F.col("no_hit_minus"))[0])


def recall(called: DataFrame, hits: DataFrame, key: str = "seq_id", id_col: str = "id") -> DataFrame:
    """One row: called intervals, those that a hit overlaps, and their share."""
    met = any_overlap(called, hits, key, id_col).agg(F.count(F.lit(1)).alias("overlapped"))
    return called.agg(F.count(F.lit(1)).alias("called")).join(F.broadcast(met)).withColumn("fraction", F.try_divide(F.col("overlapped").cast("double"), F.col("called")))  # one row each


def analysed_universe(motifs: DataFrame, repeats: DataFrame, half: int = 250, key: str = "seq_id", id_col: str = "id") -> DataFrame:
    """Motifs with no repeat within ``half`` positions of their midpoint."""
    mid = F.floor((F.col("start") + F.col("end")) / 2).cast("long")
    around = motifs.select(id_col, key, (mid - half).alias("start"), (mid + half).alias("end"))
    return motifs.join(any_overlap(around, repeats, key, id_col, keep=False).select(id_col), id_col, "left_semi")


#: Classes of arm length, each from this length on.
ARM_CLASSES = (8, 10, 12, 15, 20)


def isolated(motifs: DataFrame, others: DataFrame, starts: DataFrame, mappability: str, least: float = 0.5, pad: int = 100, start_pad: int = 2000, key: str = "seq_id", id_col: str = "id") -> DataFrame:
    """Mappable motifs away from other motifs and from transcription starts, with the class of their arm length."""
    good = motifs.where(F.col(mappability) >= least)
    apart = outside(outside(good, others, pad, key, id_col), starts, start_pad, key, id_col)
    return apart.withColumn("arm_class", sum(((F.col("arm_length") >= c).cast("int") for c in ARM_CLASSES), F.lit(0)))


def local_controls(cases: DataFrame, pool: DataFrame, cells: list[str], reach: int = 50_000, most: int = 30, seed: int = 1, key: str = "seq_id") -> DataFrame:
    """Up to ``most`` windows of the case's own cell per case: ``local`` ones within ``reach``, and ones of the whole ``chromosome``.

    Both come from one numbering of the pool.  Local windows are joined by (sequence, cell, stretch of ``reach``); for the
    chromosome a case takes ``most`` numbers in a row from a seeded place on, so no case meets the whole pool.
    """
    b = lambda c: F.floor(F.col(c) / reach).cast("long")
    near = cases.select("id", key, *cells, F.col("start").alias("_s"), F.col("end").alias("_e"), F.explode(F.array(b("start") - 1, b("start"), b("start") + 1, b("end") + 1)).alias("_b")).distinct()
    own = pool.select(key, *cells, "pos", b("pos").alias("_b"))
    order = Window.partitionBy("id").orderBy(seeded(seed, "id", "pos"), "pos")
    local = near.join(own, [key, *cells, "_b"]).where((F.col("pos") >= F.col("_s") - reach) & (F.col("pos") < F.col("_e") + reach)).select("id", "pos").distinct()
    local = local.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("id", F.lit("local").alias("scope"), "pos")
    cell = Window.partitionBy(key, *cells)
    numbered = pool.select(key, *cells, "pos", (F.row_number().over(cell.orderBy(seeded(seed, "pos"), "pos")) - 1).alias("_k"))
    sizes = pool.groupBy(key, *cells).agg(F.count(F.lit(1)).alias("_n"))
    asked = cases.select("id", key, *cells).join(sizes, [key, *cells]).withColumn("_i", F.explode(F.sequence(F.lit(0), F.least(F.lit(most), F.col("_n")).cast("int") - 1)))
    asked = asked.withColumn("_k", F.pmod(F.floor(uniform(seeded(seed, "id")) * F.col("_n")) + F.col("_i"), F.col("_n")).cast("int"))
    whole = asked.join(numbered, [key, *cells, "_k"]).select("id", F.lit("chromosome").alias("scope"), "pos")
    return local.unionByName(whole)


def injected_places(inserts: DataFrame, key: str = "seq_id") -> DataFrame:
    """Places after insertion: each moves by the lengths of the inserts before it (columns pos, len)."""
    w = Window.partitionBy(key, "_bin").orderBy("pos", "id").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.col("pos") + F.coalesce("_carry", F.lit(0)) + F.coalesce(F.sum("len").over(w), F.lit(0))
    placed = carried(inserts, (key,), "pos", F.col("len"), F.sum).withColumn("start", moved).drop("_bin", "_carry")
    return placed.withColumn("end", F.col("start") + F.col("len") - 1)


def verify_manifest(manifest: DataFrame, records: DataFrame) -> DataFrame:
    """Per manifest row whether the record holds its sequence at its place (1-based), and whether it stands there only once in the manifest."""
    both = manifest.join(records.select("seq_id", "seq"), "seq_id", "left")
    both = both.withColumn("unique", F.count(F.lit(1)).over(Window.partitionBy("seq_id", "start")) == 1)
    return both.withColumn("found", F.coalesce(F.substring("seq", F.col("start").cast("int"), F.length("sequence")) == F.col("sequence"), F.lit(False))).drop("seq")


def motif_features(s: Column) -> dict[str, Column]:
    """Length, A/T share, purine skew, longest run share and the shortest period up to 4 with 90 % self-match."""
    u = F.upper(s)
    n = F.length(u)
    count = lambda x: n - F.length(F.translate(u, x, ""))
    chars = F.filter(F.split(u, ""), lambda c: c != "")
    run = F.aggregate(chars, F.struct(F.lit("").alias("c"), F.lit(0).alias("k"), F.lit(0).alias("m")), lambda a, c: F.struct(c.alias("c"), F.when(a["c"] == c, a["k"] + 1).otherwise(1).alias("k"), F.greatest(a["m"], F.when(a["c"] == c, a["k"] + 1).otherwise(1)).alias("m")), lambda a: a["m"])

    def self_match(k: int) -> Column:
        same = F.zip_with(F.slice(chars, F.lit(1), F.greatest(n - k, F.lit(0))), F.slice(chars, F.lit(k + 1), F.greatest(n - k, F.lit(0))), lambda a, b: (a == b).cast("int"))
        return (n > k) & (F.aggregate(same, F.lit(0), lambda a, x: a + x) >= 0.9 * (n - k))

    period = F.lit(0)
    for k in (4, 3, 2, 1):
        period = F.when(self_match(k), k).otherwise(period)
    return {"length": n, "at": count("AT") / n, "skew": (count("GA") - count("CT")) / n, "run": run / n, "period": period}
