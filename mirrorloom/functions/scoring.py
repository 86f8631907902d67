"""Triplex scoring: pairing and stacking over the best window of an arm pair."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NO_SPACER, SCORES

#: Weights of the scoring model.
PAIRING_GG, PAIRING_AA, PAIRING_OTHER = 7.6, 3.83, -5.715
STACK_BONUS, STACK_FIRST, MIN_WINDOW, SPACER_PER_ARM = 5.0, 5.0, 8, 1.0
MODELS = ("pairing", "pairing_stacking", "complete")


def discount(run: int) -> float:
    """Penalty for the ``run``-th step in a row without stacking."""
    return STACK_FIRST if run <= 2 else round(5.0 ** (min(run - 2, 12) + 1) / 2, 2)


_DISCOUNTS = np.array([0.0] + [discount(i) for i in range(1, 16)])
_COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")


def reverse_complement(s: str) -> str:
    return s[::-1].translate(_COMPLEMENT)


def reverse_complement_column(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTacgt", "TGCAtgca"))


def stacking_steps(matches: list[bool]) -> list[float]:
    """What each step from one pair to the next adds to the stacking score."""
    out, run = [], 0
    for a, b in zip(matches, matches[1:], strict=False):
        run = 0 if a and b else run + 1
        out.append(STACK_BONUS if run == 0 else -float(_DISCOUNTS[min(run, 15)]))
    return out


def orient(left: str, spacer: str, right: str) -> tuple[str, str, str]:
    """(first arm, spacer, second arm read backwards) on the purine strand."""
    s = (left + ("" if spacer == NO_SPACER else spacer) + right).upper()
    arm = len(left)
    pyrimidines = sum(left.upper().count(b) for b in "CT")
    if pyrimidines > sum(left.upper().count(b) for b in "GA"):
        s = reverse_complement(s)
    return s[:arm], s[arm : len(s) - arm], s[len(s) - arm :][::-1]


#: All weights are multiples of 1 / UNITS, so that windows are compared in whole numbers.
UNITS = 200
_WHOLE_DISCOUNTS = np.rint(_DISCOUNTS * UNITS).astype(np.int64)


def best_window(first: str, second: str, loop: int, search: bool = True, stacking: bool = True) -> tuple[int, int]:
    """The window (L, R) of the arms with the highest score; earliest L, then R, on ties; whole arms if none fits.

    Linear in the arm.  From the first stacked step after its start on, a window sees the same runs as the whole arm does, so its
    score is a part that depends on R plus a part that depends on L, and the best L for an R is a prefix maximum.  A window
    without a stacked step loses more by its last unstacked step than any pair adds, so for an R only the latest L counts.
    """
    arm = len(first)
    if not search or not arm:
        return 0, arm
    a, b = np.frombuffer(first.encode(), np.uint8), np.frombuffer(second.encode(), np.uint8)
    good = (a == b) & ((a == 71) | (a == 65))
    weights = np.where(good, np.where(a == 71, round(PAIRING_GG * UNITS), round(PAIRING_AA * UNITS)), round(PAIRING_OTHER * UNITS)).astype(np.int64)
    least = min(MIN_WINDOW, arm)
    tops = np.concatenate([[0], np.cumsum(weights)])
    ends = np.arange(least, arm + 1)
    latest = np.minimum(ends - least, 3 * ends - 2 * arm - loop)  # what lies outside of the window must fit its length
    ends, latest = ends[latest >= 0], latest[latest >= 0]
    if not len(ends):
        return 0, arm
    i = np.arange(arm)
    if not stacking:
        before, by_start, by_end, open_ = latest, -tops[:-1], tops[ends], np.zeros(len(ends), dtype=bool)
    else:
        both = np.concatenate([[False], good[1:] & good[:-1]])
        seen = np.maximum.accumulate(np.where(both, i, 0))  # last stacked step so far; 0 for none
        steps = np.where(both, round(STACK_BONUS * UNITS), -_WHOLE_DISCOUNTS[np.minimum(i - seen, 15)])
        steps[0] = 0
        upto = np.cumsum(steps)
        alone = np.cumsum(_WHOLE_DISCOUNTS[np.minimum(i, 15)])
        nxt = np.minimum.accumulate(np.where(both, i, arm)[::-1])[::-1]
        nxt = np.concatenate([nxt[1:], [arm]])  # first stacked step after each start
        by_start = np.where(nxt < arm, -tops[:-1] - alone[np.maximum(nxt - 1 - i, 0)] - upto[np.maximum(nxt - 1, 0)], np.iinfo(np.int64).min // 2)
        by_end = tops[ends] + upto[ends - 1]
        before = np.minimum(latest, seen[ends - 1] - 1)  # starts from which the window has a stacked step
        open_ = latest >= seen[ends - 1]
    highest = np.maximum.accumulate(by_start)
    earliest = np.maximum.accumulate(np.where(np.concatenate([[True], by_start[1:] > highest[:-1]]), i, 0))
    some = before >= 0
    starts, values, upper = [earliest[before[some]]], [by_end[some] + highest[before[some]]], [ends[some]]
    if open_.any():
        lo, hi = latest[open_], ends[open_]
        starts.append(lo)
        values.append(tops[hi] - tops[lo] - alone[hi - 1 - lo])
        upper.append(hi)
    lo, value, hi = (np.concatenate(x) for x in (starts, values, upper))
    best = np.lexsort((hi, lo, -value))[0]
    return int(lo[best]), int(hi[best])


def ceiling(left: str, spacer: str, right: str) -> float:
    """No window scores more: all matched purine pairs and all stacked steps, without a penalty; infinite if unknown."""
    first, _, second = orient(left, spacer, right)
    a, b = np.frombuffer(first.encode(), np.uint8), np.frombuffer(second.encode(), np.uint8)
    good = (a == b) & ((a == 71) | (a == 65))
    return float(PAIRING_GG * (good & (a == 71)).sum() + PAIRING_AA * (good & (a == 65)).sum() + STACK_BONUS * (good[1:] & good[:-1]).sum()) + 0.001


@lru_cache(maxsize=50_000)
def score_hit(left: str, spacer: str, right: str, stacking: bool = True, search: bool = True) -> tuple[float, float, float, str] | None:
    """(stacking, pairing, total, putative triplex) or None if a base is not A, C, G or T."""
    first, loop, second = orient(left, spacer, right)
    if set(first + second) - set("ACGT"):
        return None
    lo, hi = best_window(first, second, len(loop), search, stacking)
    good = [x == y and x in "GA" for x, y in zip(first[lo:hi], second[lo:hi], strict=True)]
    pairing = sum((PAIRING_GG if x == "G" else PAIRING_AA) if ok else PAIRING_OTHER for x, ok in zip(first[lo:hi], good, strict=True))
    stacked = sum(stacking_steps(good)) if stacking else 0.0
    triplex = f"{first[lo:hi]}[{first[hi:]}{loop}{second[hi:][::-1]}]{second[lo:hi][::-1]}".lower()
    return float(stacked), float(pairing), max(round(stacked + pairing, 3), 0.0), triplex


_CELLS = 1 << 14  # bases of equally long arms that are scored at once
_COMPLEMENTS = np.arange(256, dtype=np.uint8)
_COMPLEMENTS[list(b"ACGT")] = list(b"TGCA")
_KNOWN = np.isin(np.arange(256), list(b"ACGT"))
_NEVER = np.iinfo(np.int64).min // 4


def _windows(a: np.ndarray, b: np.ndarray, loop: np.ndarray, search: bool, stacking: bool) -> tuple[np.ndarray, ...]:
    """(L, R, stacking, pairing) of the best windows of many arm pairs of one length, a row each, in units: :func:`best_window` by rows."""
    n, arm = a.shape
    good = (a == b) & ((a == 71) | (a == 65))
    weights = np.where(good, np.where(a == 71, round(PAIRING_GG * UNITS), round(PAIRING_AA * UNITS)), round(PAIRING_OTHER * UNITS)).astype(np.int64)
    tops = np.zeros((n, arm + 1), np.int64)
    np.cumsum(weights, axis=1, out=tops[:, 1:])
    i = np.arange(arm)
    along = lambda x, at: np.take_along_axis(x, at, 1)
    lo, hi = np.zeros(n, np.int64), np.full(n, arm)
    if stacking:
        both = np.zeros((n, arm), bool)
        both[:, 1:] = good[:, 1:] & good[:, :-1]
        seen = np.maximum.accumulate(np.where(both, i, 0), axis=1)
        steps = np.where(both, round(STACK_BONUS * UNITS), -_WHOLE_DISCOUNTS[np.minimum(i - seen, 15)])
        steps[:, 0] = 0
        upto = np.cumsum(steps, axis=1)
        stacked = upto[:, -1].copy()
    else:
        stacked = np.zeros(n, np.int64)
    if search:
        least = min(MIN_WINDOW, arm)
        ends = np.arange(least, arm + 1)
        latest = np.minimum(ends - least, (3 * ends - 2 * arm) - loop[:, None])
        fits = latest >= 0
        if not stacking:
            before, by_start, by_end = latest, -tops[:, :-1], tops[:, ends]
        else:
            alone = np.cumsum(_WHOLE_DISCOUNTS[np.minimum(i, 15)])
            nxt = np.full((n, arm), arm)
            nxt[:, :-1] = np.minimum.accumulate(np.where(both, i, arm)[:, ::-1], axis=1)[:, ::-1][:, 1:]
            by_start = np.where(nxt < arm, -tops[:, :-1] - alone[np.maximum(nxt - 1 - i, 0)] - along(upto, np.maximum(nxt - 1, 0)), _NEVER)
            by_end = tops[:, ends] + upto[:, ends - 1]
            before = np.minimum(latest, seen[:, ends - 1] - 1)
        highest = np.maximum.accumulate(by_start, axis=1)
        newest = np.ones((n, arm), bool)
        newest[:, 1:] = by_start[:, 1:] > highest[:, :-1]
        earliest = np.maximum.accumulate(np.where(newest, i, 0), axis=1)
        at = np.maximum(before, 0)
        starts, values = [along(earliest, at)], [np.where(fits & (before >= 0), by_end + along(highest, at), 2 * _NEVER)]
        if stacking:
            at = np.maximum(latest, 0)
            starts.append(at)
            values.append(np.where(fits & (latest >= seen[:, ends - 1]), tops[:, ends] - along(tops, at) - alone[np.maximum(ends - 1 - at, 0)], 2 * _NEVER))
        start, value = np.concatenate(starts, axis=1), np.concatenate(values, axis=1)
        best = value.max(axis=1)
        tied = value == best[:, None]
        first = np.where(tied, start, arm + 1).min(axis=1)
        last = np.where(tied & (start == first[:, None]), np.tile(ends, len(starts)), arm + 1).min(axis=1)
        some = fits.any(axis=1)
        lo, hi = np.where(some, first, lo), np.where(some, last, hi)
        if stacking:
            stacked = np.where(some, best - (tops[np.arange(n), hi] - tops[np.arange(n), lo]), stacked)
    return lo, hi, stacked, tops[np.arange(n), hi] - tops[np.arange(n), lo]


def score_many(left: list[str], spacer: list[str], right: list[str], stacking: bool = True, search: bool = True) -> list[tuple[float, float, float, str] | None]:
    """:func:`score_hit` of many hits: those with arms of one length together, so that short arms share the cost of array operations."""
    out: list = [None] * len(left)
    by_arm: dict[int, list[int]] = {}
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x and len(x) == len(y) and x.isascii() and y.isascii():
            by_arm.setdefault(len(x), []).append(i)
        else:
            out[i] = score_hit(x, spacer[i], y, stacking, search)
    for arm, all_ in by_arm.items():
        for at in range(0, len(all_), max(1, _CELLS // arm)):
            few = all_[at : at + max(1, _CELLS // arm)]
            bases = lambda of: np.frombuffer("".join([of[i] for i in few]).upper().encode(), np.uint8).reshape(-1, arm)  # noqa: E731, B023
            one, two = bases(left), bases(right)[:, ::-1]
            loops = ["" if spacer[i] == NO_SPACER else spacer[i].upper() for i in few]
            turned = ((one == 67) | (one == 84)).sum(axis=1) > ((one == 71) | (one == 65)).sum(axis=1)
            known = (_KNOWN[one] & _KNOWN[two]).all(axis=1)
            a, b = (np.where(turned[:, None], y, x) for x, y in ((one, _COMPLEMENTS[two]), (two, _COMPLEMENTS[one])))
            parts = [x.tolist() for x in _windows(a, b, np.array([len(x) for x in loops]), search, stacking)]
            first, second = a.tobytes().decode("ascii"), b.tobytes().decode("ascii")
            for j, (i, ok, turn, lo, hi, stacked, pairing) in enumerate(zip(few, known.tolist(), turned.tolist(), *parts, strict=True)):
                if not ok:
                    continue
                x, y, loop = first[j * arm : (j + 1) * arm], second[j * arm : (j + 1) * arm], reverse_complement(loops[j]) if turn else loops[j]
                triplex = f"{x[lo:hi]}[{x[hi:]}{loop}{y[hi:][::-1]}]{y[lo:hi][::-1]}".lower()
                out[i] = (stacked / UNITS, pairing / UNITS, max((stacked + pairing) / UNITS, 0.0), triplex)
    return out


def upper_bound(left: Column) -> Column:
    """A score that no window of the arm can exceed: every purine paired, every step stacked."""
    s = F.upper(left)
    gs, as_ = F.length(s) - F.length(F.replace(s, F.lit("G"), F.lit(""))), F.length(s) - F.length(F.replace(s, F.lit("A"), F.lit("")))
    cs, ts = F.length(s) - F.length(F.replace(s, F.lit("C"), F.lit(""))), F.length(s) - F.length(F.replace(s, F.lit("T"), F.lit("")))
    purine = (cs + ts) <= (gs + as_)
    return F.when(purine, PAIRING_GG * gs + PAIRING_AA * as_).otherwise(PAIRING_GG * cs + PAIRING_AA * ts) + STACK_BONUS * F.greatest(F.length(s) - 1, F.lit(0))


def with_model_scores(hits: DataFrame, models: tuple[str, ...] = MODELS) -> DataFrame:
    """``hits`` with a struct of the four score columns for each model, named ``_`` and the model; one pass for all of them."""
    for model in models:
        if model not in MODELS:
            raise ValueError(f"unknown scoring model {model!r}")
    names = [c.split()[0] for c in SCORES.split(", ")]

    @F.pandas_udf(", ".join(f"{m}_{c}" for m in models for c in SCORES.split(", ")))
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for arms in parts:
            cols = [x.tolist() for x in arms]
            out = [pd.DataFrame([got or (None, None, None, "") for got in score_many(*cols, m != "pairing", m == "complete")], columns=[f"{m}_{c}" for c in names]) for m in models]
            yield pd.concat(out, axis=1)

    # not deterministic to the optimiser, or a filter on a score would run it once more
    scored = hits.withColumn("_s", run.asNondeterministic()("left_arm", "spacer", "right_arm"))
    return scored.select(*hits.columns, *[F.struct(*[F.col(f"_s.{m}_{c}").alias(c) for c in names]).alias(f"_{m}") for m in models])


def with_scores(hits: DataFrame, model: str = "complete") -> DataFrame:
    """``hits`` with the four score columns; scores are null and the triplex empty where a hit cannot be scored."""
    bare = hits.drop("stacking_score", "pairing_score", "total_score", "putative_triplex")
    return with_model_scores(bare, (model,)).select("*", f"_{model}.*").drop(f"_{model}")
