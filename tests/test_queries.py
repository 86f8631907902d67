"""Engine queries against their SQL on the smallest tables, and that they come without the training-data operators."""

import math
import random
import tempfile

import duckdb
import pytest

from mirrorloom import queries
from mirrorloom.functions import stats
from mirrorloom.operators import evaluation as E
from mirrorloom.operators import generators as N
from mirrorloom.operators import intervals as G

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect(config={"temp_directory": tempfile.mkdtemp()})
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rounded(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(repr([rounded(r[c]) for c in order]) for r in got.collect()) == sorted(repr([rounded(x) for x in r]) for r in want.select(*[f'"{c}"' for c in order]).fetchall())


def test_tails():
    assert stats.binomial_two_sided(0, 5) == pytest.approx(0.0625) and stats.binomial_two_sided(0, 0) == 1
    assert stats.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert stats.mann_whitney_p(50, 10, 10) == 1
    assert stats.welch_t(1, 1, 10, 0, 1, 10)[1] == pytest.approx(18)


def test_enriched_bins_equal_brute_force(spark):
    rng = random.Random(3)
    control = [(c, b, rng.randint(5_000, 12_000) if c == "a" else rng.randint(0, 40)) for c in "ab" for b in range(60)]
    counts = [(c, b, max(0, n // 10 + rng.choice([0, 0, 0, 60, 150, 300]) // (1 if c == "a" else 30))) for c, b, n in control]
    bins = {(c, b): n for c, b, n in control}
    p = {}
    for c, b, k in counts:
        around = sum(bins.get((c, x), 0) for x in range(b - 25, b + 25)) / 50
        lam = 0.1 * max(bins[c, b], around, 1.0)
        p[c, b] = max(0.0, 1 - math.fsum(math.exp(i * math.log(lam) - lam - math.lgamma(i + 1)) for i in range(k)))
    order, q, least = sorted(p, key=p.get), {}, 1.0
    for i in range(len(order), 0, -1):
        q[order[i - 1]] = least = min(least, p[order[i - 1]] * len(p) / i)
    table = lambda rows: spark.createDataFrame(rows, "chrom string, bin long, n long")
    got = {(r.chrom, r.bin): (r.lam, r.q) for r in G.enriched_bins(table(counts), table(control), 0.1, 1.0).collect()}
    assert {k: v for k, (_, v) in got.items()} == pytest.approx({k: v for k, v in q.items() if v <= 0.01}, abs=1e-9)
    assert any(lam > 745 for lam, _ in got.values())


def test_split_rounds_halves_up(spark, con):
    """45 * 0.7 is 31.5, as a double less."""
    sizes = [5, 15, 35, 45, 90]
    rows = spark.createDataFrame([(1000 * n + i, n) for n in sizes for i in range(n)], "record_id long, y int")
    got = {r.y: r.n for r in E.stratified_split(rows, "record_id", ["y"], 0.7).where("train").groupBy("y").count().withColumnRenamed("count", "n").collect()}
    assert got == {n: int(con.sql(f"SELECT round({n}::BIGINT * 0.7)").fetchall()[0][0]) for n in sizes} == {5: 4, 15: 11, 35: 25, 45: 32, 90: 63}


def test_nearest_of_many_copies(spark):
    """A thousand copies on either side are one comparison each; equal ids of different sequences take the best of both."""
    rng = random.Random(8)
    base = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(6)]
    near = [s[:7] + ("A" if s[7] != "A" else "C") + s[8:] for s in base]
    test = [(i, base[i % 6]) for i in range(600)] + [(0, "ACGTACGT"), (900, "ACG"), (901, None)]
    train = [(10_000 + i, near[i % 5]) for i in range(1000)] + [(5, "ACGTACGT"), (7, base[3])]
    table = lambda rows: spark.createDataFrame(rows, "record_id long, seq string")
    pairs = {}
    for i, a in test:
        for j, b in set(train):
            if a and len(a) == len(b):
                d = sum(x != y for x, y in zip(a, b, strict=True))
                pairs[i] = min(pairs.get(i, (99, 0, 0)), (d, j, len(a)))
    got = E.nearest_train(table(test), table(train)).collect()
    assert len(got) == len(test)
    for r in got:
        want = pairs.get(r.record_id)
        assert (r.nearest, r.identity) == ((want[1], 1 - want[0] / want[2]) if want else (None, None))


def test_copies_are_compared_once(spark, monkeypatch):
    """What is searched are distinct sequences without an equal one."""
    seen = []
    whole = E._in_blocks
    monkeypatch.setattr(E, "_in_blocks", lambda test, train, block: (seen.append((test.count(), train.count())), whole(test, train, block))[1])
    table = lambda rows: spark.createDataFrame(rows, "record_id long, seq string")
    E.nearest_train(table([(i, "ACGTACG") for i in range(50)] + [(99, "GGGTACG")]), table([(1000 + i, "ACGTACG") for i in range(50)])).collect()
    assert seen == [(1, 1)]


def test_nearest_in_blocks_of_both_sides(spark):
    """Blocks of a few letters, letters beyond ASCII, ids that are texts, ties across blocks."""
    rng = random.Random(3)
    of = lambda n: "".join(rng.choice("ACGTN\u03a9\U0001f600") for _ in range(n))
    test, train = ([(f"{side}{i}", of(rng.choice([1, 5, 66]))) for i in range(40)] for side in "ab")
    want = {}
    for i, a in test:
        fits = [(sum(x != y for x, y in zip(a, b, strict=True)), j, len(a)) for j, b in train if len(a) == len(b)]
        want[i] = min(fits) if fits else None
    table = lambda rows: spark.createDataFrame(rows, "record_id string, seq string")
    for block in (1, 150, 1 << 23):
        got = {r.record_id: (r.nearest, r.identity) for r in E.nearest_train(table(test), table(train), block=block).collect()}
        assert got == {i: (m[1], 1 - m[0] / m[2]) for i, m in want.items()}


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_nearest_shuffles_a_sequence_a_few_times(spark):
    """No copy of a sequence for each of its slices, or for each block that it meets."""
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("ACGT") for _ in range(400))) for i in range(1500)]
    table = spark.createDataFrame(rows, "record_id long, seq string")
    before, limit = shuffled_bytes(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables that are too large for it
    try:
        assert E.nearest_train(table.where("record_id % 50 = 0"), table.where("record_id % 50 <> 0")).where("nearest is not null").count() == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert 0 < shuffled_bytes(spark) - before < 4 * 400 * 1500


def test_windows_read_a_record_once(spark):
    """No copy of the record for each of its windows."""
    records = spark.createDataFrame([("a", "acgtNNgaga" * 3 + "ggcc" * 5), ("b", "acg"), ("c", None)], "seq_id string, seq string")
    got = G.windows_of(records, 4, 1)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    s = ("acgtNNgaga" * 3 + "ggcc" * 5).upper()
    n = lambda w, x: sum(w.count(c) for c in x)
    want = [("a", i, n(s[i : i + 4], "GC") / 4, abs(n(s[i : i + 4], "GA") - n(s[i : i + 4], "CT")) / 4) for i in range(len(s) - 3) if "N" not in s[i : i + 4]]
    assert sorted(map(tuple, got.collect())) == want


def test_auroc_is_pairs(spark):
    rows = [(y, s) for y, s in [(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1), (1, 0.1)]]
    wins = sum(1 if a > b else 0.5 if a == b else 0 for y, a in rows if y for z, b in rows if not z) / 6
    assert E.auroc(spark.createDataFrame(rows, "y int, s double")).first()[0] == pytest.approx(wins)


def every_mirror(s, least, loop):
    """(identity, arm, start, spacer) by arm, start and spacer, all of them."""
    best = (0.0, 0, 0, 0)
    for arm in range(least, len(s) // 2 + 1):
        for i in range(len(s) - 2 * arm + 1):
            for sp in range(min(loop, len(s) - 2 * arm - i) + 1):
                same = sum(a == b for a, b in zip(s[i : i + arm], s[i + arm + sp : i + 2 * arm + sp][::-1], strict=True)) / arm
                if (same, arm) > best[:2]:
                    best = (same, arm, i, sp)
    return best


def test_best_mirror_is_the_best_of_all():
    rng = random.Random(2)
    for _ in range(400):
        letters, least = rng.choice(["ACGT", "AG", "ACGTN", "ABCDEFGHIJKLMNOP"]), rng.choice([3, 5, 8])
        s = "".join(rng.choice(letters) for _ in range(rng.choice([0, 5, 16, 30, 45])))
        assert N.best_mirror(s, least) == every_mirror(s, least, 12)


def test_generators():
    s = "GATTACAGATTACCAGGAATTCCGGTTAACC"
    t = N.dinucleotide_shuffle(s, 5)
    pairs = lambda x: sorted(zip(x, x[1:], strict=False))
    assert pairs(s) == pairs(t) and s[0] == t[0] and s[-1] == t[-1]
    m = N.perfect_mirror(12, 3, 1)
    assert m[:12] == m[15:][::-1] and N.has_strong_mirror(m)
    assert N.BALANCED[0] <= N.purine_fraction(m[:12]) <= N.BALANCED[1]
    d = N.disrupt_mirror(m, 2)
    kinds = str.maketrans("AGCT", "RRYY")
    assert d.translate(kinds) == m.translate(kinds) and not N.has_strong_mirror(d)
    r = N.random_like(s, 3)
    assert sum(map(r.count, "GC")) == sum(map(s.count, "GC"))
    b = N.random_b_dna(24, 4)
    assert 0.4 <= N.purine_fraction(b) <= 0.6 and not N.has_strong_mirror(b)
    assert N.perfect_mirror(5, 2, 1, "GA")[:5] == N.perfect_mirror(5, 2, 1, "GA")[7:][::-1]
    with pytest.raises(ValueError):
        N.random_b_dna(1, 1, tries=50)
    assert sum(N.class_quotas(10, {"a": 1, "b": 1, "c": 1}).values()) == 10
    assert len(N.random_like(s, 1)) == len(s)


def test_bootstrap_runs_in_many_tasks_and_digests_a_row_once(spark):
    from mirrorloom.operators import evaluation as E

    df = spark.range(50).selectExpr("id AS record_id", "id % 2 AS tp", "1L AS fp")
    got = E.bootstrap_counts(df, 20, cols=("tp", "fp"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == len(E.POISSON)  # a filter on the weight would repeat them all
    assert "RepartitionByExpression" in plan  # small groups of clusters have 200 times the rows: they must not be joined into one task
    assert got.count() == 20
