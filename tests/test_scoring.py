"""The linear window search against every window, from the definition."""

import random

import pytest

from mirrorloom.functions import scoring as S


def every_window(first: str, second: str, loop: int) -> tuple[int, int]:
    arm, best, window = len(first), None, (0, len(first))
    least = min(S.MIN_WINDOW, arm)
    for lo in range(arm):
        for hi in range(lo + least, arm + 1):
            if 2 * (arm - hi) + loop > hi - lo:
                continue
            good = [x == y and x in "GA" for x, y in zip(first[lo:hi], second[lo:hi], strict=True)]
            pairing = sum((S.PAIRING_GG if x == "G" else S.PAIRING_AA) if ok else S.PAIRING_OTHER for x, ok in zip(first[lo:hi], good, strict=True))
            value = round(pairing + sum(S.stacking_steps(good)), 3)
            if best is None or value > best:
                best, window = value, (lo, hi)
    return window


@pytest.mark.parametrize("letters", ["GA", "GGA", "GACT", "ACGT", "G"])
def test_window_is_the_best_of_all(letters):
    rng = random.Random(letters)
    for _ in range(250):
        first = "".join(rng.choice(letters) for _ in range(rng.choice([1, 5, 8, 9, 13, 24, 40])))
        share = rng.choice([0.3, 0.7, 0.9, 1.0])
        second = "".join(c if rng.random() < share else rng.choice("ACGT") for c in first)
        loop = rng.randint(0, 12)
        assert S.best_window(first, second, loop) == every_window(first, second, loop)
    assert S.best_window("", "", 3) == (0, 0) and S.best_window("GA" * 5, "GA" * 5, 0, search=False) == (0, 10)


def test_many_hits_score_as_one_by_one():
    rng, left, spacer, right = random.Random(3), [], [], []
    for _ in range(600):
        arm, letters = rng.choice([1, 2, 7, 8, 9, 12, 30, 200]), rng.choice(["ACGT", "GA", "GAGAGAC", "CT", "ga", "acgtN", "GGGGGGA"])
        x = "".join(rng.choice(letters) for _ in range(arm))
        y = list(x[::-1])
        for _ in range(rng.randrange(1 + arm // 5)):
            y[rng.randrange(arm)] = rng.choice("ACGT")
        left.append(x)
        right.append("".join(y))
        spacer.append(rng.choice(["", S.NO_SPACER, "A", "cgt", "N" * 8]))
    left, spacer, right = [*left, "ACGÜ", ""], [*spacer, "", "a"], [*right, "ACGT", ""]
    for stacking in (True, False):
        for search in (True, False):
            for one, got in zip(map(lambda a, b, c: S.score_hit(a, b, c, stacking, search), left, spacer, right), S.score_many(left, spacer, right, stacking, search), strict=True):
                assert (one is None) == (got is None)
                if one:
                    assert got[:2] == pytest.approx(one[:2]) and got[2:] == one[2:]


def test_a_filter_on_scores_does_not_score_again(spark):
    hits = spark.range(20).selectExpr("repeat('GA', 5) AS left_arm", "'c' AS spacer", "repeat('AG', 5) AS right_arm")
    got = S.with_scores(hits).where("total_score > 1 and putative_triplex <> ''")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and got.count() == 20
