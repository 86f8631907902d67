"""Summaries of hit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import seeded
from .ranks import running


def compute_stats(hits: DataFrame) -> DataFrame:
    """One row of totals; zeros for an empty table."""
    n = F.count(F.lit(1))
    mean = lambda c: F.coalesce(F.round(F.avg(c), 1), F.lit(0.0))
    perfect = F.count_if("is_perfect")
    return hits.agg(
        n.alias("total"), perfect.alias("perfect"), (n - perfect).alias("imperfect"), F.coalesce(F.round(F.try_divide(perfect * 100.0, n), 1), F.lit(0.0)).alias("perfect_pct"),
        F.countDistinct("seq_id").alias("sequences"), mean("arm_length").alias("mean_arm"), mean("spacer_length").alias("mean_spacer"), mean("mirror_identity").alias("mean_mirror"),
        F.coalesce(F.min("arm_length"), F.lit(0)).alias("min_arm"), F.coalesce(F.max("arm_length"), F.lit(0)).alias("max_arm"),
        F.coalesce(F.round(F.avg("total_score"), 1), F.lit(0.0)).alias("mean_score"), F.coalesce(F.max("total_score"), F.lit(0.0)).alias("max_score"), F.count("total_score").alias("scored"),
    )


def top_sequences(hits: DataFrame, n: int = 25) -> DataFrame:
    return hits.groupBy("seq_id").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.col("hits").desc(), "seq_id").limit(n)


def value_counts(hits: DataFrame, *cols: str) -> DataFrame:
    return hits.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def histogram(hits: DataFrame, col: str, bins: int = 50, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(bin, n) of equal bins over [lo, hi], the last one closed; without bounds over the column's range."""
    rows = hits.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).select(F.col(col).cast("double").alias("v"))
    if lo is None:
        ends = rows.agg(F.min("v").alias("a"), F.max("v").alias("b"))
        rows = rows.join(F.broadcast(ends))  # one row
        a, width = F.col("a"), (F.col("b") - F.col("a")) / bins
    else:
        a, width = F.lit(float(lo)), F.lit((hi - lo) / bins)
        rows = rows.where(F.col("v").between(lo, hi))
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("v") - a) / F.when(width == 0, 1.0).otherwise(width)), F.lit(bins - 1)))
    return rows.groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def seeded_sample(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash of ``key``: the same rows whatever the partitions."""
    return df.orderBy(seeded(seed, *key), *key).limit(n)


def locus_map(hits: DataFrame, sequences: int = 15, per: int = 600, seed: int = 42) -> DataFrame:
    """Sampled hits of the sequences with most of them: midpoint and a clipped size."""
    top = hits.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "seq_id").limit(sequences)
    mine = hits.join(F.broadcast(top), "seq_id")  # ``sequences`` rows
    order = Window.partitionBy("seq_id").orderBy(seeded(seed, "start", "end", "arm_length"), "start", "end")
    ranked = mine.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per)  # Spark limits each group before the shuffle too
    return ranked.select("seq_id", ((F.col("start") + F.col("end")) / 2).alias("mid"), (F.least(F.col("arm_length"), F.lit(30)) * 0.65).alias("size"))


def page(hits: DataFrame, number: int, size: int, order: list[str]) -> DataFrame:
    return hits.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(hits: DataFrame, size: int) -> DataFrame:
    n = F.count(F.lit(1))
    return hits.agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / size)).alias("pages"))


def score_range(df: DataFrame, col: str = "total_score") -> DataFrame:
    """Minimum, upper median (the element at n // 2) and maximum, from the value counts' running sum."""
    rows = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    sums = running(rows, [F.col(col)], {"upto": F.col("n")}, (), "score-range")
    upto = sums.join(F.broadcast(sums.agg(F.max("upto").alias("total"))))  # one row
    return upto.agg(F.min(col).alias("min_score"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col(col))).alias("median_score"), F.max(col).alias("max_score"))


def interval_strings(hits: DataFrame, key: str = "seq_id") -> DataFrame:
    """Per key its intervals in order, joined by semicolons."""
    spans = F.transform(F.array_sort(F.collect_list(F.struct("start", "end"))), lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return hits.groupBy(key).agg(F.array_join(spans, ";").alias("intervals"))


def record_calls(records: DataFrame, hits: DataFrame, id_col: str, threshold: float | None = None) -> DataFrame:
    """Per record its highest score, number of hits and call."""
    per = hits.groupBy(id_col).agg(F.max("total_score").alias("s"), F.count(F.lit(1)).alias("n"))
    out = records.join(per, id_col, "left").withColumn("max_score", F.coalesce("s", F.lit(0.0))).withColumn("n_hits", F.coalesce("n", F.lit(0)))
    return out.withColumn("called", F.col("n_hits") > 0 if threshold is None else F.col("max_score") >= threshold).drop("s", "n")


def best_hit(hits: DataFrame, id_col: str, order: list[Column], keep: list[str]) -> DataFrame:
    """Per record the columns ``keep`` of its hit that is last by ``order``."""
    top = hits.groupBy(id_col).agg(F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *keep)).alias("m"))
    return top.select(id_col, *[F.col(f"m.{k}").alias(k) for k in keep])
