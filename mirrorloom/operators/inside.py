"""Non-overlapping selection inside one island: the same hits as the sweeps of :mod:`overlap`, in many tasks and without a loop over rows.

Greedy.  The sweep holds one hit; the next one replaces it if it is longer (or as long with a shorter spacer), and ends
it if it starts after its end.  So every hit has one successor as the held hit, whatever came before: the first later hit that does
either.  Only the best hit of each start can ever be held.  Stretches of positions compute successors on their own, with as much
of what follows as a hit can reach, and each hit's exit: where the chain from it leaves the stretch.  Which exits the chain
passes is then found by pointer jumping between stretches, in as many rounds as the logarithm of the stretches of an island.

Both first set apart the hits that overlap no other, which stay under any selection; where hits are sparse, these are most.

By score.  In each round every open hit that outranks all open hits near it is accepted and strikes what it overlaps.  The best open hit
is always among them, so the rounds end, and each accepted hit would have been accepted in its turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import carried
from .ranks import drop_stored, numbered, stored

STRETCH = 512
APART = 1 << 16


def _apart(hits: DataFrame, key: tuple[str, ...], by_start: bool, width: int = APART) -> tuple[DataFrame, DataFrame]:
    """(hits that overlap no other, the rest); ``by_start`` leaves of each start only the hit that the greedy sweep can hold.

    Stretches of ``width`` positions are looked at on their own; at their edges, where a hit of another may reach, hits count as the rest.
    """
    first = Window.partitionBy(*key, "_wide").orderBy(F.col("start"), F.col("arm_length").desc(), F.col("spacer_length"), F.col("full_sequence"))
    placed = hits.where(F.col("start").isNotNull()).withColumn("_wide", F.floor(F.col("start") / width).cast("long"))
    if by_start:
        placed = placed.withColumn("_before", F.lag("start").over(first)).where("_before is null or _before < start").drop("_before")
    reach = F.max("end").over(first.rowsBetween(Window.unboundedPreceding, -1))
    marked = stored(placed.withColumns({"_reach": reach, "_next": F.lead("start").over(first)}), "selection-marked")
    longest = marked.agg(F.max(F.col("end") - F.col("start") + 1)).first()[0] or 1
    after, upto = F.col("_wide") * width, (F.col("_wide") + 1) * width
    alone = (F.col("start") - after >= longest) & F.coalesce(F.col("_reach") < F.col("start"), F.lit(True)) & F.coalesce(F.col("_next") > F.col("end"), F.col("end") < upto)
    return marked.where(alone).select(*hits.columns), marked.where(~alone).select(*hits.columns)


def _successors(hits: Column, starts: Column, border: Column) -> Column:
    """From the array of a stretch's and the following hits (s, e, a, m, apart), in order: (s, next, last, exit) of each, from the last to the first.

    ``a`` is the arm and ``m`` the negative spacer; ``apart`` the first start after ``e``.  ``last`` tells that nothing replaces
    the hit.  A stack holds the later hits that no hit in between outranks, the nearest first.
    """
    n = F.size(hits)
    empty = F.struct(F.array().cast("array<struct<s:bigint,a:int,m:int,x:bigint>>").alias("stack"), F.array().cast("array<struct<s:bigint,nxt:bigint,last:boolean,x:bigint>>").alias("out"))

    def step(state: Column, h: Column) -> Column:
        live = F.filter(state.stack, lambda t: (t.a > h.a) | ((t.a == h.a) & (t.m > h.m)))
        above = F.get(live, F.lit(0))
        replaced = F.coalesce(above.s <= h.e, F.lit(False))
        nxt = F.when(replaced, above.s).otherwise(h.apart)
        at = n - F.array_position(starts, nxt).cast("int")  # of the next hit in what is done, which runs backwards
        x = F.when(nxt >= border, nxt).when(nxt.isNotNull(), F.get(state.out, at).x)
        done = F.struct(h.s.alias("s"), nxt.alias("nxt"), (~replaced).alias("last"), x.alias("x"))
        top = F.struct(h.s.alias("s"), h.a.alias("a"), h.m.alias("m"), x.alias("x"))
        return F.struct(F.concat(F.array(top), live).alias("stack"), F.concat(state.out, F.array(done)).alias("out"))

    return F.aggregate(F.reverse(hits), empty, step).out


def greedy_inside(hits: DataFrame, key: tuple[str, ...] = ("seq_id",), stretch: int = STRETCH) -> DataFrame:
    """The hits that the greedy sweep keeps.  Stretches widen to twice the longest hit, so no array grows with the sequence."""
    # those that overlap no other stay where they were stored, and the rest is what follows is about
    alone, rest = _apart(hits, key, True)
    best = stored(rest, "greedy-best")
    reach = best.agg(F.max(F.col("end") - F.col("start") + 1)).first()[0] or 1
    width = max(stretch, 2 * reach)
    bare = best.select(*key, F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"), F.col("arm_length").cast("int").alias("a"), (-F.col("spacer_length")).cast("int").alias("m"))
    bin_ = lambda c: F.floor(c / width).cast("long")
    dealt = bare.withColumn("_st", F.explode(F.sequence(bin_(F.col("s") - 2 * reach), bin_(F.col("s")))))
    events = dealt.select("*", F.col("s").alias("pos"), F.lit(1).alias("kind")).unionByName(dealt.select("*", (F.col("e") + 1).alias("pos"), F.lit(0).alias("kind")))
    after = Window.partitionBy(*key, "_st").orderBy(F.col("pos").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    known = events.withColumn("apart", F.last(F.when(F.col("kind") == 1, F.col("s")), ignorenulls=True).over(after)).where("kind = 0")
    # stored, or every step of the fold would sort them again
    arrays = stored(known.groupBy(*key, "_st").agg(F.sort_array(F.collect_list(F.struct("s", "e", "a", "m", "apart"))).alias("hits"), F.sort_array(F.collect_list("s")).alias("starts")), "greedy-arrays")
    border = (F.col("_st") + 1) * width
    chained = stored(arrays.select(*key, "_st", F.reverse(F.filter(_successors(F.col("hits"), F.col("starts"), border), lambda o: o.s < border)).alias("out")).where(F.size("out") > 0), "greedy-chains")
    # a hit that starts after every earlier end is reached whatever is held before it
    ends = carried(bare, key, "s", F.col("e"), F.max)
    earlier = Window.partitionBy(*key, "_bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    roots = ends.withColumn("_reach", F.greatest("_carry", F.max("e").over(earlier))).where("_reach is null or _reach < s")
    roots = stored(roots.select(*key, "s"), "greedy-roots")
    links = chained.select(*key, F.inline("out")).where("x is not null").select(*key, "s", "x")
    targets = links.select(*key, F.col("x").alias("s")).distinct().unionByName(roots).distinct()
    jump = stored(links.join(targets, [*key, "s"], "left_semi"), "greedy-links")
    # of the roots, those with a link are followed
    front = stored(roots.join(jump, [*key, "s"], "left_semi"), "greedy-reached")
    scratch = [roots, jump, front]
    while not jump.isEmpty():
        to = jump.select(*key, F.col("s").alias("x"), F.col("x").alias("y"))
        front = stored(front.unionByName(front.join(jump, [*key, "s"]).select(*key, F.col("x").alias("s"))).distinct(), "greedy-reached")
        jump = stored(jump.join(to, [*key, "x"]).select(*key, "s", F.col("y").alias("x")), "greedy-links")
        scratch += [front, jump]
    reached = roots.unionByName(front)
    entries = reached.withColumn("_st", bin_(F.col("s"))).groupBy(*key, "_st").agg(F.collect_set("s").alias("entries"))  # at most a stretch's starts
    walk = F.struct(F.lit(None).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("kept"))

    def follow(state: Column, o: Column) -> Column:
        held = F.coalesce(o.s == state.at, F.lit(False)) | F.array_contains("entries", o.s)
        kept = F.when(held & o.last, F.concat(state.kept, F.array(o.s))).otherwise(state.kept)
        return F.struct(F.when(held, o.nxt).otherwise(state.at).alias("at"), kept.alias("kept"))

    kept = chained.join(entries, [*key, "_st"]).select(*key, F.explode(F.aggregate("out", walk, follow).kept).alias("start"))
    kept = stored(best.join(kept, [*key, "start"], "left_semi").select(*hits.columns), "greedy-kept")
    for df in (best, arrays, chained, *scratch):
        drop_stored(df)
    return alone.unionByName(kept)


def best_first_inside(hits: DataFrame, key: tuple[str, ...] = ("seq_id",), width: int = 64, rounds: int = 40) -> tuple[DataFrame, int]:
    """(the hits that selection by score keeps, rounds taken).

    A run of equal scores settles one hit a round, so after ``rounds`` what is still open, in islands that the accepted hits
    have cut, goes to the loop by island.
    """
    from .overlap import remove_overlaps

    score = F.col("total_score")
    unscored = score.isNull() | F.isnan(score)
    order = [unscored, F.when(unscored, 0.0).otherwise(-score), -F.col("arm_length"), F.col("spacer_length"), F.col("start"), F.col("end"), F.col("full_sequence")]
    alone, rest = _apart(hits, key, False)
    all_ = stored(numbered(rest, order, out="_rank"), "score-ranked")
    left, taken, done = all_.select(*key, "_rank", "start", "end"), None, 0
    bins = lambda df: df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long"))))
    scratch = [all_]
    while not left.isEmpty() and done < rounds:
        done += 1
        won = bins(left).groupBy(*key, "_bin").agg(F.min("_rank").alias("_rank")).groupBy("_rank").agg(F.count(F.lit(1)).alias("_won"))
        every = F.floor(F.col("end") / width) - F.floor(F.col("start") / width) + 1
        accepted = stored(left.join(won, "_rank").where(F.col("_won") == every).drop("_won"), "score-accepted")
        by = bins(accepted).select(*key, "_bin", F.col("start").alias("_s"), F.col("end").alias("_e"))
        struck = bins(left).join(by, [*key, "_bin"]).where("start <= _e and end >= _s").select("_rank").distinct()
        left = stored(left.join(struck, "_rank", "left_anti"), "score-open")
        taken = accepted if taken is None else taken.unionByName(accepted)
        scratch += [accepted, left]
    kept = all_.where("false") if taken is None else all_.join(taken.select("_rank"), "_rank", "left_semi")
    if not left.isEmpty():
        kept = kept.unionByName(remove_overlaps(all_.join(left.select("_rank"), "_rank", "left_semi").select(*all_.columns), "score", key, True).select(*kept.columns))
    kept = stored(kept.select(*hits.columns), "score-kept")
    for df in scratch:
        drop_stored(df)
    return alone.unionByName(kept), done
