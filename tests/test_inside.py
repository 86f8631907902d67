"""Selection inside islands against the loops, and ranks without a window over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from mirrorloom.operators import inside
from mirrorloom.operators.overlap import islands, remove_overlaps
from mirrorloom.operators.ranks import numbered, running

SCHEMA = "seq_id string, start long, end long, arm_length int, spacer_length int, total_score double, full_sequence string, n long"


def hits(spark, rng, n, length, longest=30, keys="ab"):
    rows = []
    for i in range(n):
        arm, sp, start = rng.randint(1, longest), rng.randint(0, 4), rng.randint(1, length)
        rows.append((rng.choice(keys), start, start + 2 * arm + sp - 1, arm, sp, rng.choice([None, float("nan"), 1.0, 2.0, round(rng.random() * 9, 1)]), f"s{rng.randint(0, 3)}", i))
    return spark.createDataFrame(rows, SCHEMA)


def geometry(df):
    return sorted((r.seq_id, r.start, r.end, r.arm_length, r.spacer_length, r.full_sequence) for r in df.collect())


@pytest.mark.parametrize(("n", "length", "longest", "stretch"), [(0, 5, 3, 8), (1, 5, 3, 8), (60, 100, 3, 8), (300, 400, 6, 16), (300, 200, 30, 16), (500, 3000, 9, 32), (400, 90_000, 30, 4096)])
def test_greedy_equals_the_loop(spark, n, length, longest, stretch):
    df = hits(spark, random.Random(n + length), n, length, longest)
    assert geometry(inside.greedy_inside(df, stretch=stretch)) == geometry(remove_overlaps(df, "greedy"))


@pytest.mark.parametrize(("n", "length", "rounds"), [(0, 5, 40), (200, 100, 40), (400, 2000, 40), (400, 2000, 1)])
def test_score_equals_the_loop(spark, n, length, rounds):
    df = hits(spark, random.Random(n + length), n, length)
    got, took = inside.best_first_inside(df, width=16, rounds=rounds)
    assert geometry(got) == geometry(remove_overlaps(df, "score")) and took <= rounds


def test_one_island_in_many_tasks(spark):
    """One sequence whose hits are one island: the plan has no Python worker and spreads the island over its stretches."""
    i = F.col("id")
    arm = (8 + F.pmod(F.xxhash64(i), F.lit(20))).cast("int")
    df = spark.range(1, 40_001).select(F.lit("chr").alias("seq_id"), i.alias("start"), (i + 2 * arm + 1).alias("end"), arm.alias("arm_length"), F.lit(2).alias("spacer_length"), F.pmod(F.xxhash64(i, F.lit(1)), F.lit(10_000)).cast("double").alias("total_score"), F.lit("s").alias("full_sequence"), i.alias("n"))
    got = inside.greedy_inside(df, stretch=1024)
    assert geometry(got) == geometry(remove_overlaps(df, "greedy"))
    best, rounds = inside.best_first_inside(df)
    assert geometry(best) == geometry(remove_overlaps(df, "score")) and rounds <= 12


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randint(0, 50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, w long").repartition(7)
    want = {r: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}
    got = numbered(df, [F.col("v"), F.col("w")])
    assert {(r.k, r.v, r.w): r["rank"] for r in got.collect()} == want
    sums, total = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        total[r[0]] = sums[r] = total.get(r[0], 0) + r[2]
    assert {(r.k, r.v, r.w): r.s for r in running(df, [F.col("v"), F.col("w")], {"s": F.col("w")}, ("k",)).collect()} == sums


def test_islands_of_a_stored_table_hold_nothing(spark):
    """What is read again from files need not be kept by the executors as well."""
    df = spark.createDataFrame([("s", 1, 5), ("s", 4, 9), ("s", 20, 30)], "seq_id string, start long, end long")
    islands(df, keep=False).collect()
    assert not df.is_cached
    assert sorted(r.island for r in islands(df, keep=False).collect()) == [1, 1, 2]


@pytest.mark.parametrize("width", [16, 64, 4096])
def test_hits_that_overlap_no_other_are_set_apart(spark, width):
    df = hits(spark, random.Random(width), 200, 3000, 9)
    rows = df.collect()
    alone, rest = inside._apart(df, ("seq_id",), False, width)
    meets = lambda r: any(o.n != r.n and o.seq_id == r.seq_id and o.start <= r.end and o.end >= r.start for o in rows)
    got = alone.collect()
    assert not any(meets(r) for r in got) and sorted(r.n for r in [*got, *rest.collect()]) == list(range(200))
    if width == 4096:
        assert {r.n for r in rows if not meets(r) and r.start > 20} <= {r.n for r in got}


@pytest.mark.parametrize("strategy", ["greedy", "score"])
def test_sparse_hits_do_not_go_through_the_rounds(spark, monkeypatch, strategy):
    """What is ranked or linked is only what overlaps."""
    df = hits(spark, random.Random(7), 600, 60_000, 6)
    seen, plain = {}, inside.stored

    def watched(rows, name):
        out = plain(rows, name)
        seen[name] = max(seen.get(name, 0), out.count())
        return out

    monkeypatch.setattr(inside, "stored", watched)
    got = inside.greedy_inside(df) if strategy == "greedy" else inside.best_first_inside(df)[0]
    assert geometry(got) == geometry(remove_overlaps(df, strategy))
    assert max(n for name, n in seen.items() if name != "selection-marked") < 200
