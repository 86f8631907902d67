"""Mixing sources to target weights by entropy balancing.

Wanted: rates ``r_i`` in [0, cap] for the documents, as close as possible to 1 in relative entropy, with
``sum(r_i * size_i)`` over each source equal to its target.  The convex dual has one multiplier per source and gives
exponentially tilted rates ``r_i = min(cap, exp(lambda_s * size_i / mean_s))``.  Newton steps, kept inside a bracket,
solve it.  Each step is one distributed aggregate over the histogram (source, size, documents), which is a sufficient
statistic, so a hot source costs its distinct sizes, not its rows.  Sums are of fixed-point integers, so reruns agree.

Rounding into copies is exact to one small document per source.  Every document gets ``floor(r_i)`` copies.  Whether it
gets one more is decided by a cut on a hash of its id, relative to its fraction.  The cut is searched per source, radix
digit by radix digit, until the source's words meet its target: first over all documents, which settles those of more
than ``LARGE`` mean sizes, then over the small ones for what is left.  The driver holds a few numbers per source (a policy names its sources); no document reaches it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, drop_stored, keyed, stored, text_or_empty

#: Weights by place, repeated along the sources in code-point order (null last).
WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
STEPS, TOLERANCE = 60, 1e-7
LARGE = 1.0
#: The hash cut has 30 bits, searched in digits of 10.
DIGITS, DIGIT = 3, 10
_FIX = 1000


def sizes_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    words = F.regexp_count(text_or_empty(text_col), F.lit(WORD))
    source = F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))
    return docs.select(F.col(id_col).alias("id"), source.alias("src"), words.cast("long").alias("size"))


def targets(size_of: dict[str, int], weights=WEIGHTS, cap: float = CAP) -> dict[str, float]:
    """Words per source: weights share out 100 % of all words; no source above ``cap`` times its own.

    The excess of capped sources is shared again among the others by weight until none is above.  ``weights`` is a
    cycle over the sources in code-point order, null last, or a dict by source.
    """
    order = sorted((s for s in size_of if s != "n"), key=lambda s: s[1:]) + (["n"] if "n" in size_of else [])
    if isinstance(weights, dict):
        weight = {s: float(weights.get(s[1:] if s != "n" else None, 0.0)) for s in order}
    else:
        weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, fixed = float(sum(size_of.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, share = total - sum(fixed.values()), sum(weight[s] for s in free)
        goal = {s: left * weight[s] / share if share else 0.0 for s in free}
        over = [s for s in free if goal[s] > cap * size_of[s]]
        if not over:
            return {s: goal.get(s, fixed.get(s, 0.0)) for s in order}
        fixed |= {s: float(cap * size_of[s]) for s in over}


#: Sources up to which their numbers go to every task; beyond, rows meet them by a join that Spark picks.
MANY_SOURCES = 50_000


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    table = spark.createDataFrame(rows, schema)  # a row per source
    return F.broadcast(table) if len(rows) <= MANY_SOURCES else table


def _rate(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.exp(F.least(lam * size / mean, F.lit(math.log(cap))))


def solve(hist: DataFrame, goal: dict[str, float], mean: dict[str, float], total: dict[str, int], cap: float = CAP) -> dict[str, float]:
    """The multiplier of each source, by safeguarded Newton steps on the dual.  hist: src, size, n."""
    spark = hist.sparkSession
    lam, low, high = {}, {}, {}
    for s, t in goal.items():
        if total[s] == 0 or t >= cap * total[s] * (1 - 1e-12):
            lam[s] = math.inf  # every rate is at the cap
        elif t <= 0:
            lam[s] = -math.inf
        else:
            low[s], high[s] = -50.0 * (1 + mean[s]), 50.0 * (1 + mean[s])
    now = dict.fromkeys(low, 0.0)
    open_ = set(low)
    for _ in range(STEPS):
        if not open_:
            break
        state = _table(spark, [(s, now[s], max(mean[s], 1e-9)) for s in open_], "src string, lam double, mean double")
        size = F.col("size").cast("double")
        rate = _rate(F.col("lam"), size, F.col("mean"), cap)
        words = rate * size * F.col("n")
        slope = F.when(rate < cap, words * size / F.col("mean")).otherwise(F.lit(0.0))
        got = hist.join(state, "src").groupBy("src").agg(F.sum(F.round(words * _FIX).cast("long")).alias("w"), F.sum(F.round(slope * _FIX).cast("decimal(38,0)")).alias("d")).collect()
        for r in got:
            s, w, d = r.src, r.w / _FIX, float(r.d) / _FIX
            gap = w - goal[s]
            if abs(gap) <= TOLERANCE * goal[s] or high[s] - low[s] < 1e-12:
                open_.discard(s)
                continue
            if gap > 0:
                high[s] = min(high[s], now[s])
            else:
                low[s] = max(low[s], now[s])
            step = now[s] - gap / d if d > 0 else math.nan
            # Newton on the log of the words is flatter where the tilt is steep; a step out of the bracket bisects it.
            now[s] = round(step if low[s] < step < high[s] else (low[s] + high[s]) / 2, 12)
    return lam | now


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, copies, rate.

    Defined cases: a null text has size 0; a null source is a source of its own, the last; a document without words
    is taken once and counts nothing; repeated rows are documents of their own that are decided alike; ids may be null
    (all decided by one hash); an empty table gives no rows; other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    sized = stored(sizes_of(docs, id_col, text_col, source_col), "mix-sizes")
    hist = stored(sized.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    per = {r.src: (r.w, r.n) for r in hist.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("w"), F.sum("n").alias("n")).collect()}
    total = {s: w for s, (w, _) in per.items()}
    mean = {s: w / n for s, (w, n) in per.items()}
    goal = targets(total, weights, cap)
    lam = solve(hist, goal, mean, total, cap)
    drop_stored(hist)

    def clipped(x: float) -> float:
        return max(-1e300, min(1e300, x))

    state = _table(spark, [(s, clipped(lam[s]), max(mean[s], 1e-9), goal[s], total[s]) for s in goal], "src string, lam double, mean double, target double, source_size long")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("lam") >= 1e300, F.lit(float(cap))).otherwise(_rate(F.col("lam"), F.col("size").cast("double"), F.col("mean"), cap))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 11).cast("double") + 0.5) / float(1 << 53)
    whole = F.floor(F.col("rate") + 1e-9)
    frac = F.greatest(F.lit(0.0), F.col("rate") - whole)
    # the place of a small document: which cut on the hash, relative to its fraction, first takes it; 1/2 is unbiased
    place = F.least(F.lit((1 << DIGITS * DIGIT) - 1), F.floor(u / (u + frac) * (1 << DIGITS * DIGIT))).cast("long")
    rated = sized.join(state, "src").withColumn("rate", rate).withColumn("whole", whole.cast("long"))
    rated = rated.withColumn("place", F.when((frac > 1e-9) & (F.col("size") > 0), place)).withColumn("large", F.col("size") > LARGE * F.col("mean"))
    rated = stored(rated.select("id", "src", "size", "source_size", "target", "rate", "whole", "large", "place"), "mix-rates")
    drop_stored(sized)

    whole_words = {r.src: r.w for r in rated.groupBy("src").agg(F.sum(F.col("size") * F.col("whole")).alias("w")).collect()}
    need = {s: goal[s] - whole_words.get(s, 0) for s in goal}
    first = _cuts(rated, need)  # settles the large documents; the small ones then make up for what is missing or over
    settled = _table(spark, [(s, first[s]) for s in goal], "src string, first long")
    rated = rated.join(settled, "src").withColumn("extra", (F.col("large") & F.coalesce(F.col("place") <= F.col("first"), F.lit(False))).cast("long"))
    large_words = {r.src: r.w for r in rated.groupBy("src").agg(F.sum(F.col("size") * F.col("extra")).alias("w")).collect()}
    cut = _cuts(rated.where(~F.col("large")), {s: need[s] - large_words.get(s, 0) for s in goal})
    taken_to = _table(spark, [(s, cut[s]) for s in goal], "src string, cut long")
    copies = F.col("whole") + F.col("extra") + (~F.col("large") & F.coalesce(F.col("place") <= F.col("cut"), F.lit(False))).cast("long")
    out = rated.join(taken_to, "src").withColumn("copies", copies)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def _cuts(rated: DataFrame, need: dict[str, float]) -> dict[str, int]:
    """The cut per source so that the small documents whose place is up to it have about ``need`` words."""
    spark = rated.sparkSession
    small = rated.where("place is not null").select("src", "size", "place")
    prefix, done, spent = dict.fromkeys(need, 0), {}, dict.fromkeys(need, 0)
    for level in range(DIGITS):
        shift = DIGIT * (DIGITS - 1 - level)
        alive = [s for s in need if s not in done]
        if not alive:
            break
        at = _table(spark, [(s, prefix[s]) for s in alive], "src string, prefix long")
        digit = F.shiftright("place", shift).bitwiseAND((1 << DIGIT) - 1)
        here = small.join(at, "src").where(F.shiftright("place", shift + DIGIT) == F.col("prefix"))
        bins = here.groupBy("src", digit.alias("digit")).agg(F.sum("size").alias("w")).collect()  # 1024 rows a source at most
        by: dict[str, list[tuple[int, int]]] = {}
        for r in bins:
            by.setdefault(r.src, []).append((r.digit, r.w))
        for s in alive:
            chosen = None
            for d, w in sorted(by.get(s, [])):
                if spent[s] + w > need[s]:
                    chosen = (d, w)
                    break
                spent[s] += w
            if chosen is None:  # all of this range fits
                done[s] = ((prefix[s] + 1) << (shift + DIGIT)) - 1
            elif level == DIGITS - 1:
                key = prefix[s] << DIGIT | chosen[0]
                nearer = spent[s] + chosen[1] - need[s] < need[s] - spent[s]
                done[s] = key if nearer else key - 1
            else:
                prefix[s] = prefix[s] << DIGIT | chosen[0]
    return done


def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **policy) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, all columns kept."""
    rows = keyed(docs, id_col)
    plan = mix(rows, "__row", text_col, source_col, **policy).select("__row", F.col("copies").cast("int").alias("__n")).where("__n > 0")
    return rows.join(plan, "__row").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)
