"""Evaluation of calls and scores against labels.  Frames are long: one row per record, or per (config, record)."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Sequence
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.hamming import nearest
from ..functions.stats import binomial_two_sided
from .ranks import running, stored

COUNTS = ["tp", "fp", "tn", "fn"]


def confusion(df: DataFrame, y: str = "y", p: str = "p", by: Sequence[str] = ()) -> DataFrame:
    yes, call = F.col(y) == 1, F.col(p) == 1
    c = lambda cond: F.count_if(cond)
    return df.groupBy(*by).agg(c(yes & call).alias("tp"), c(~yes & call).alias("fp"), c(~yes & ~call).alias("tn"), c(yes & ~call).alias("fn"))


def with_metrics(counts: DataFrame) -> DataFrame:
    return counts.withColumns(stats.metrics(*(F.col(c) for c in COUNTS)))


def with_wilson(counts: DataFrame) -> DataFrame:
    sens = stats.wilson(F.col("tp"), F.col("tp") + F.col("fn"))
    spec = stats.wilson(F.col("tn"), F.col("tn") + F.col("fp"))
    return counts.withColumns({"sens_lo": sens[0], "sens_hi": sens[1], "spec_lo": spec[0], "spec_hi": spec[1]})


def _by_score(df: DataFrame, y: str, s: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score, which is all that rank statistics need."""
    valid = F.col(s).isNotNull() & ~F.isnan(F.col(s).cast("double"))
    return df.where(valid).groupBy(*by, s).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))


def auroc(df: DataFrame, y: str = "y", s: str = "s", by: Sequence[str] = ()) -> DataFrame:
    """Probability that a positive scores above a negative, ties one half; null without both."""
    upto = running(_by_score(df, y, s, by), [F.col(s)], {"upto": F.col("neg")}, tuple(by), "auroc")
    wins = upto.withColumn("w", F.col("pos") * (F.col("upto") - F.col("neg") / 2.0))
    return wins.groupBy(*by).agg(F.try_divide(F.sum("w"), F.sum("pos").cast("double") * F.sum("neg")).alias("auroc"))


def roc_points(df: DataFrame, y: str = "y", s: str = "s", by: Sequence[str] = ()) -> DataFrame:
    """Counts and metrics at each threshold (score >= t predicts 1), the distinct finite scores and both infinities.

    Rows without a score predict 0 at every finite threshold, and 1 at minus infinity like all others.
    """
    per = _by_score(df, y, s, by)
    totals = df.groupBy(*by).agg(F.count_if(F.col(y) == 1).alias("P"), F.count_if(F.col(y) != 1).alias("N"))
    sums = running(per, [F.col(s).desc()], {"tp": F.col("pos"), "fp": F.col("neg")}, tuple(by), "roc")
    mid = sums.select(*by, F.col(s).cast("double").alias("threshold"), "tp", "fp")
    ends = totals.select(*by, F.inline(F.array(
        F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp")),
        F.struct(F.lit(float("-inf")).alias("threshold"), F.col("P").alias("tp"), F.col("N").alias("fp")))))
    points = mid.unionByName(ends)
    both = points.join(F.broadcast(totals), list(by)) if by else points.join(F.broadcast(totals))  # a row per group
    return with_metrics(both.withColumn("tn", F.col("N") - F.col("fp")).withColumn("fn", F.col("P") - F.col("tp")).drop("P", "N"))


def best_youden(points: DataFrame, positive_only: bool = True) -> DataFrame:
    """Threshold with the highest J, the lowest one on ties."""
    j = F.round(F.col("sensitivity") + F.col("specificity") - 1, 12)
    ok = points.where((F.col("threshold") > 0) & (F.col("threshold") < float("inf"))) if positive_only else points
    return ok.withColumn("j", j).orderBy(F.col("j").desc(), "threshold").limit(1).select("threshold", "j", "sensitivity", "specificity")


def parameter_grid(spark: SparkSession, **values: Sequence) -> DataFrame:
    """Every combination, with ``config_id`` in the order of the lists; small by construction."""
    names = list(values)
    rows = [(i, *c) for i, c in enumerate(itertools.product(*values.values()))]
    return spark.createDataFrame(rows, ["config_id", *names])


def select_config(scored: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """First configuration per group by a composite order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def seeded(seed: int | Column, *cols: Column | str) -> Column:
    """A hexadecimal digest of a seed and values, which any engine can repeat: the order of seeded choices."""
    parts = [F.lit(seed) if isinstance(seed, int) else seed, *[F.col(c) if isinstance(c, str) else c for c in cols]]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))


def uniform(digest: Column) -> Column:
    """A number in (0, 1) from a digest."""
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)


#: Upper ends of the ranges of a uniform number in which a Poisson(1) weight is 0, 1, ..., 7.
POISSON = [math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def poisson_weight(u: Column) -> Column:
    return sum(((u > t).cast("int") for t in POISSON), F.lit(0))


def stratified_split(df: DataFrame, id_col: str, strata: Sequence[str], share: float, seed: int = 0) -> DataFrame:
    """``train`` marks round(share * n) records of each stratum, in the order of a seeded hash; the product is a decimal, so that halves go up."""
    w = Window.partitionBy(*strata)
    r = F.row_number().over(w.orderBy(seeded(seed, id_col), id_col))
    return df.withColumn("train", r <= F.round(F.count(F.lit(1)).over(w) * F.lit(Decimal(str(share)))))


def stratified_folds(df: DataFrame, id_col: str, strata: Sequence[str], k: int, seed: int | Column = 0, by: Sequence[str] = ()) -> DataFrame:
    """Round-robin folds within each stratum."""
    r = F.row_number().over(Window.partitionBy(*by, *strata).orderBy(seeded(seed, id_col), id_col))
    return df.withColumn("fold", (r - 1) % k)


def nested_cv(pred: DataFrame, folds: DataFrame, order: Sequence[Column], id_col: str = "record_id") -> DataFrame:
    """Out-of-fold confusion per repeat.

    pred: (config_id, id, y, p) and parameter columns used by ``order``; folds: (rep, id, fold).  Confusions per fold
    are summed once; a training confusion is the total less the fold, so predictions are joined with folds once.
    """
    extra = [c for c in pred.columns if c not in ("config_id", id_col, "y", "p")]
    return nested_cv_of(confusion(pred.join(folds, id_col), by=["rep", "fold", "config_id", *extra]), order)


def nested_cv_of(per: DataFrame, order: Sequence[Column]) -> DataFrame:
    """:func:`nested_cv` from the confusions per (rep, fold, config_id) and parameter columns."""
    extra = [c for c in per.columns if c not in ("rep", "fold", "config_id", *COUNTS)]
    w = Window.partitionBy("rep", "config_id")
    train = per.select("rep", "fold", "config_id", *extra, *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in COUNTS])
    chosen = select_config(with_metrics(train), order, ["rep", "fold"]).select("rep", "fold", "config_id")
    held = per.join(chosen, ["rep", "fold", "config_id"]).groupBy("rep").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return with_metrics(held)


def leave_one_group_out(pred: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """Per group the confusion of the configuration chosen on all others, by subtraction from the totals."""
    extra = [c for c in pred.columns if c not in ("config_id", "record_id", "y", "p", group)]
    per = confusion(pred, by=[group, "config_id", *extra])
    w = Window.partitionBy("config_id")
    train = per.select(group, "config_id", *extra, *[F.col(c).alias(f"own_{c}") for c in COUNTS], *[(F.sum(c).over(w) - F.col(c)).alias(c) for c in COUNTS])
    chosen = select_config(with_metrics(train), order, [group])
    return chosen.select(group, "config_id", *[F.col(f"own_{c}").alias(c) for c in COUNTS])


def assign_groups(df: DataFrame, id_col: str = "record_id", source: str = "source_record", group: str = "family_id") -> DataFrame:
    """A synthetic record belongs to the group of its source, else to its own, else to itself."""
    src = df.select(F.col(id_col).alias("_s"), F.nullif(group, F.lit("")).alias("_g"))
    return df.join(src, F.col(source) == F.col("_s"), "left").withColumn("group_id", F.coalesce("_g", F.nullif(group, F.lit("")), F.col(id_col).cast("string"))).drop("_s", "_g")


def collapse(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row of each group."""
    return select_config(df, [F.col(order)], keys)


def bootstrap_counts(df: DataFrame, n_boot: int, seed: int = 1, cluster: str = "record_id", cols: Sequence[str] = ("tp", "fp", "tn", "fn")) -> DataFrame:
    """Sums of ``cols`` over Poisson(1) resamples of clusters.

    Each cluster draws its own weight per replicate from a seeded hash, so no replicate is collected and replicates run
    in parallel; rows of a cluster are summed first.
    """
    per = df.groupBy(cluster).agg(*[F.sum(c).alias(c) for c in cols])
    weight = poisson_weight(uniform(seeded(seed, cluster, "b")))
    # rows of weight 0 add nothing; a filter on the weight would be pushed below it and digest every row once per end of its ranges
    each = per.repartition(per.sparkSession.sparkContext.defaultParallelism, cluster).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).select("b", *cols, weight.alias("w"))
    sums = each.groupBy("b").agg(F.max("w").alias("_most"), *[F.sum(F.col(c) * F.col("w")).alias(c) for c in cols])
    return sums.where("_most > 0").drop("_most")


def percentile_interval(df: DataFrame, col: str, n_boot: int) -> DataFrame:
    """2.5 % and 97.5 % by place among the replicates."""
    s = F.sort_array(F.collect_list(col))  # one number per replicate
    return df.agg(F.get(s, F.lit(int(0.025 * n_boot))).alias("lo"), F.get(s, F.least(F.size(s) - 1, F.lit(int(0.975 * n_boot)))).alias("hi"))


def indicator_counts(df: DataFrame, y: str = "y", p: str = "p", prefix: str = "") -> DataFrame:
    yes, call = F.col(y) == 1, F.col(p) == 1
    conds = {"tp": yes & call, "fp": ~yes & call, "tn": ~yes & ~call, "fn": yes & ~call}
    return df.withColumns({prefix + k: v.cast("long") for k, v in conds.items()})


def mcnemar(df: DataFrame, a: str, b: str, y: str = "y") -> tuple[int, int, float]:
    """(only a right, only b right, exact p); the driver sees two counts."""
    ra, rb = F.col(a) == F.col(y), F.col(b) == F.col(y)
    n10, n01 = df.agg(F.count_if(ra & ~rb), F.count_if(~ra & rb)).first()
    return n10, n01, binomial_two_sided(n10, n10 + n01)


def verdict(lo: Column, hi: Column, p: Column, alpha: float = 0.05) -> Column:
    return F.when((lo > 0) & (p < alpha), "better").when((hi < 0) & (p < alpha), "worse").when((lo > 0) | (hi < 0), "inconclusive").otherwise("equivalent")


def _in_blocks(test: DataFrame, train: DataFrame, block: int) -> DataFrame:
    """(a_id, m): the best of all training records of equal length.

    Each task holds up to ``block`` letters of either side of one length, so its memory does not follow the input; where one length has
    more, every block of one side meets every block of the other.
    """
    count = lambda df, c: df.groupBy("len").agg(F.ceil(F.count(F.lit(1)) * F.greatest(F.col("len"), F.lit(1)) / block).cast("int").alias(c))
    per = F.broadcast(count(test, "_as").join(count(train, "_bs"), "len"))  # one row per length: fewer than the root of twice the input's letters
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = test.join(per, "len").withColumn("_a", part("a_s", "_as")).withColumn("_b", every("_bs")).select("len", "_a", "_b", "a_id", "a_s")
    b = train.join(per, "len").withColumn("_b", part("b_s", "_bs")).withColumn("_a", every("_as")).select(F.col("len").alias("_len"), F.col("_a").alias("_c"), F.col("_b").alias("_d"), "b_id", "b_s")
    # a given number of partitions: by their few bytes they would be joined into too few tasks
    session, keys, same = test.sparkSession, ["len", "_a", "_b"], ["_len", "_c", "_d"]
    n = max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))

    def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right, [("b_id", "ascending")], null_placement="at_start"))
        # without one side there is no pair
        at, d = nearest(left["a_s"].to_pylist(), right["b_s"].to_pylist(), key[0].as_py()) if len(left) and len(right) else ([], [])
        return pa.Table.from_arrays([left["a_id"].slice(0, len(at)), pa.array(d, pa.int32()), right["b_id"].take(pa.array(at, pa.int64()))], names=["a_id", "d", "b_id"])

    kind = train.schema["b_id"].dataType.simpleString()
    found = a.repartition(n, *keys).groupBy(*keys).cogroup(b.repartition(n, *same).groupBy(*same)).applyInArrow(best, f"a_id long, d int, b_id {kind}")
    return found.groupBy("a_id").agg(F.min(F.struct("d", "b_id")).alias("m"))


def nearest_train(test: DataFrame, train: DataFrame, id_col: str = "record_id", seq: str = "seq", block: int = 1 << 23) -> DataFrame:
    """Per test record the training record of equal length with most equal bases, the smallest id on ties, exactly.

    One pass over all distinct sequences tells which test sequences have an equal training sequence, their nearest.  The others are held
    against all training sequences of their length, each sequence packed to a few bits a letter and 64 letters compared at once; what
    is shuffled for it is each sequence once, whatever its number of pairs, up to ``block`` letters of a length.
    A record without a partner of its length has null.
    """
    s, kind = F.upper(F.col(seq)).alias("s"), train.schema[id_col].dataType
    # copies share their nearest record: a search per distinct test sequence, and of equal training sequences the smallest id
    both = test.select(s, F.lit(None).cast(kind).alias("b_id"), F.lit(True).alias("asked")).unionByName(train.select(s, F.col(id_col).alias("b_id"), F.lit(False).alias("asked")))
    each = both.where("s is not null").groupBy("s").agg(F.min("b_id").alias("b_id"), F.bool_or("asked").alias("asked"), F.bool_or(~F.col("asked")).alias("known"))
    each = stored(each.select(F.monotonically_increasing_id().alias("a_id"), "s", F.length("s").alias("len"), "b_id", "asked", "known"), "nearest-each")
    searched = _in_blocks(each.where("asked and b_id is null").select("a_id", F.col("s").alias("a_s"), "len"), each.where("known").select("b_id", F.col("s").alias("b_s"), "len"), block)
    own = F.when(F.col("b_id").isNotNull(), F.struct(F.lit(0).alias("d"), "b_id")).otherwise(F.col("m"))
    best = each.where("asked").join(searched, "a_id", "left").select("s", F.when(own.isNotNull(), F.struct(own["d"].alias("d"), own["b_id"].alias("b_id"), "len")).alias("m"))
    best = test.select(F.col(id_col).alias("a_record"), s).join(best, "s").groupBy("a_record").agg(F.min("m").alias("m"))
    got = test.join(best, test[id_col] == best["a_record"], "left")
    return got.select(*[test[c] for c in test.columns], F.col("m.b_id").alias("nearest"), (1 - F.col("m.d") / F.col("m.len")).alias("identity"))


def leakage_flags(test: DataFrame, train: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Whether each test record's group also occurs in training, per grouping."""
    for g in groups:
        seen = train.select(F.col(g).alias(f"_{g}")).where(f"_{g} is not null").distinct().withColumn(f"{g}_in_train", F.lit(True))
        test = test.join(seen, F.col(g) == F.col(f"_{g}"), "left").withColumn(f"{g}_in_train", F.coalesce(f"{g}_in_train", F.lit(False))).drop(f"_{g}")
    return test


def selection_frequency(chosen: DataFrame, params: Sequence[str]) -> DataFrame:
    """How often each parameter value was selected."""
    long = chosen.select(F.inline(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("value")) for p in params])))
    n = F.count(F.lit(1))
    return long.groupBy("parameter", "value").agg(n.alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("parameter")))


def ratio_of_means(df: DataFrame, num: str, den: str, n_boot: int, seed: int = 1, cluster: str = "record_id") -> DataFrame:
    boots = bootstrap_counts(df, n_boot, seed, cluster, (num, den)).withColumn("r", F.try_divide(F.col(num).cast("double"), F.col(den)))
    return percentile_interval(boots, "r", n_boot)


def rank_sum(df: DataFrame, group: str, value: str) -> DataFrame:
    """(u, n1, n2, ties) of the Mann-Whitney test of rows with group 1 against the others."""
    per = running(_by_score(df.withColumn("_y", F.col(group)), "_y", value, ()), [F.col(value)], {"upto": F.col("neg")}, (), "rank-sum")
    t = F.col("pos") + F.col("neg")
    got = per.withColumn("u", F.col("pos") * (F.col("upto") - F.col("neg") / 2.0))
    return got.agg(F.sum("u").alias("u"), F.sum("pos").alias("n1"), F.sum("neg").alias("n2"), F.sum((t * t * t - t).cast("double")).alias("ties"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks, from the counts of distinct values of each column."""

    def ranked(c: str) -> DataFrame:
        per = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        upto = running(per, [F.col(c)], {"_upto": F.col("_n")}, (), "spearman")
        return upto.select(F.col(c).alias(f"_{c}"), (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(f"r_{c}"))

    both = df.join(ranked(a), F.col(a) == F.col(f"_{a}")).join(ranked(b), F.col(b) == F.col(f"_{b}"))
    return both.agg(F.corr(f"r_{a}", f"r_{b}").alias("rho"))


def quartile_means(df: DataFrame, score: str, value: str) -> DataFrame:
    q = df.agg(F.percentile(score, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    s = F.col(score)
    both = df.join(F.broadcast(q))  # one row
    bucket = (s > F.get("q", F.lit(0))).cast("int") + (s > F.get("q", F.lit(1))).cast("int") + (s > F.get("q", F.lit(2))).cast("int") + 1
    return both.where(s.isNotNull()).groupBy(bucket.alias("quartile")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def superiority(cases: DataFrame, controls: DataFrame, group: str, value: str) -> DataFrame:
    """Mean probability that a case exceeds a control of its group, ties one half; cases without controls do not count.

    Controls are counted per distinct value and cases look up how many lie below, so no pair of both is made.
    """
    both = cases.groupBy(group, value).agg(F.count(F.lit(1)).alias("_a"), F.lit(0).cast("long").alias("_b")).unionByName(
        controls.groupBy(group, value).agg(F.lit(0).cast("long").alias("_a"), F.count(F.lit(1)).alias("_b")))
    per = both.groupBy(group, value).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    w = Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    p = (F.coalesce(F.sum("_b").over(w), F.lit(0)) + F.col("_b") / 2) / F.sum("_b").over(Window.partitionBy(group))
    ranked = per.withColumn("_p", F.when(F.sum("_b").over(Window.partitionBy(group)) > 0, p))
    met = ranked.where((F.col("_a") > 0) & F.col("_p").isNotNull())
    return met.agg((F.sum(F.col("_p") * F.col("_a")) / F.sum("_a")).alias("superiority"), F.sum("_a").alias("cases"))


def placebo(controls: DataFrame, group: str, value: str, id_col: str, seed: int = 1) -> DataFrame:
    """Superiority of one seeded control of each group over the group's others; it should be near one half."""
    order = Window.partitionBy(group).orderBy(seeded(seed, id_col), id_col)
    marked = controls.withColumn("_r", F.row_number().over(order))
    return superiority(marked.where("_r = 1"), marked.where("_r > 1"), group, value)


def validate_cohort(records: DataFrame, expected: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Counts of what is wrong: repeated ids, missing, unexpected, changed sequences, labels outside 0/1."""
    ids = records.groupBy(id_col).agg(F.count(F.lit(1)).alias("k"), F.first("seq").alias("seq"), F.first("label").alias("label"))
    both = ids.join(expected.select(id_col, F.col("seq").alias("want")), id_col, "full")
    return both.agg(
        F.count_if(F.expr("k > 1")).alias("repeated"), F.count_if(F.expr("k is null")).alias("missing"), F.count_if(F.col("k").isNotNull() & F.col("want").isNull()).alias("unexpected"),
        F.count_if(F.upper("seq") != F.upper("want")).alias("changed"), F.count_if(F.col("k").isNotNull() & ~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("bad_label"),
    )


def prediction_matrix(records: DataFrame, configs: Sequence[dict], calls: Callable[[DataFrame, dict], DataFrame], id_col: str = "record_ix") -> DataFrame:
    """(config_id, record, p) of every configuration and record; ``calls`` gives the ids that a configuration calls.

    A plan of one branch per configuration over the same records; the grid is small by construction.
    """
    out = None
    for i, c in enumerate(configs):
        called = calls(records, c).select(id_col).distinct().withColumn("_p", F.lit(1))
        mine = records.select(id_col).join(called, id_col, "left").select(F.lit(i).alias("config_id"), id_col, F.coalesce("_p", F.lit(0)).alias("p"))
        out = mine if out is None else out.unionByName(mine)
    return out


def split_stability(pred: DataFrame, splits: DataFrame, order: Sequence[Column], default: int, id_col: str = "record_id") -> DataFrame:
    """Per split the configuration chosen on its training records, its MCC on the others and how far that is from the default's.

    pred: (config_id, id, y, p, ...); splits: (seed, id, train).  Predictions are joined with the splits once.
    """
    extra = [c for c in pred.columns if c not in ("config_id", id_col, "y", "p")]
    per = with_metrics(confusion(pred.join(splits, id_col), by=["seed", "train", "config_id", *extra]))
    chosen = select_config(per.where("train"), order, ["seed"]).select("seed", F.col("config_id").alias("chosen"))
    held = per.where(~F.col("train")).select("seed", "config_id", "mcc", "sensitivity", "specificity")
    base = held.where(F.col("config_id") == default).select("seed", F.col("mcc").alias("default_mcc"))
    got = held.join(chosen, "seed").where("config_id = chosen").join(base, "seed")
    return got.select("seed", "config_id", "mcc", "sensitivity", "specificity", "default_mcc", (F.col("mcc") - F.col("default_mcc")).alias("delta"))


def paired_difference(df: DataFrame, a: str, b: str, n_boot: int, seed: int = 1, cluster: str = "record_id", y: str = "y") -> DataFrame:
    """(b, d_mcc, d_sensitivity, d_specificity): call ``a`` minus call ``b`` on the same resamples of clusters."""
    cols = [f"{t}_{c}" for t in ("a", "b") for c in COUNTS]
    both = indicator_counts(indicator_counts(df, y, a, "a_"), y, b, "b_")
    boots = bootstrap_counts(both, n_boot, seed, cluster, cols)
    m = {t: stats.metrics(*(F.col(f"{t}_{c}") for c in COUNTS)) for t in ("a", "b")}
    usable = boots.where("a_tp + a_fn > 0 and a_tn + a_fp > 0")  # resamples with both labels
    return usable.select("b", *[(m["a"][k] - m["b"][k]).alias(f"d_{k}") for k in ("mcc", "sensitivity", "specificity")])


def false_positives_by_class(df: DataFrame, cls: str, tools: Sequence[str], y: str = "y") -> DataFrame:
    return df.where(F.col(y) == 0).groupBy(cls).agg(*[F.sum((F.col(t) == 1).cast("long")).alias(t) for t in tools])


def roc_band(df: DataFrame, n_boot: int, grid: Sequence[float], seed: int = 1, y: str = "y", s: str = "s", id_col: str = "record_id") -> DataFrame:
    """Sensitivity at given false-positive rates over Poisson resamples: 2.5 %, median and 97.5 %."""
    weight = poisson_weight(uniform(seeded(seed, id_col, "b")))
    each = df.where(F.col(s).isNotNull()).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(n_boot)))).withColumn("w", weight)
    per = each.groupBy("b", s).agg(F.sum(F.when(F.col(y) == 1, F.col("w")).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) != 1, F.col("w")).otherwise(0)).alias("neg"))
    w, all_ = Window.partitionBy("b").orderBy(F.col(s).desc()).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("b")
    pts = per.select("b", F.try_divide(F.sum("pos").over(w), F.sum("pos").over(all_)).alias("tpr"), F.try_divide(F.sum("neg").over(w), F.sum("neg").over(all_)).alias("fpr"))
    at = pts.withColumn("x", F.explode(F.array(*map(F.lit, grid)))).groupBy("b", "x").agg(F.coalesce(F.max(F.when(F.col("fpr") <= F.col("x"), F.col("tpr"))), F.lit(0.0)).alias("tpr"))
    return at.groupBy("x").agg(F.percentile("tpr", F.lit(0.025)).alias("lo"), F.percentile("tpr", F.lit(0.5)).alias("mid"), F.percentile("tpr", F.lit(0.975)).alias("hi"))
