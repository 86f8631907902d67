"""Small statistics: column formulas, and tail probabilities for a handful of numbers on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963985


def mcc(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    a, b, c, d = (x.cast("double") for x in (tp, fp, tn, fn))
    under = F.sqrt((a + b) * (a + d) * (c + b) * (c + d))
    return F.when(under == 0, 0.0).otherwise((a * c - b * d) / under)


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Rates of a confusion matrix, 0 where the denominator is."""
    return {
        "sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "precision": ratio(tp, tp + fp), "npv": ratio(tn, tn + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + tn + fn), "mcc": mcc(tp, fp, tn, fn),
    }


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Score interval of a share, within [0, 1]; null without trials."""
    m = n.cast("double")
    p = F.try_divide(k.cast("double"), m)
    mid, half, under = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)), 1 + z * z / m
    ok = lambda c: F.when(n > 0, c)
    return ok(F.greatest(F.lit(0.0), (mid - half) / under)), ok(F.least(F.lit(1.0), (mid + half) / under))


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """(odds ratio, standard error of its logarithm), half a count added to each cell."""
    a, b, c, d = (x + 0.5 for x in (a, b, c, d))
    return (a * d) / (b * c), F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided binomial test at one half (McNemar on discordant pairs)."""
    if not n:
        return 1.0
    low = min(k, n - k)
    return min(1.0, 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(low + 1)))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p: tables with the same margins that are no likelier."""
    r, s, n = a + b, a + c, a + b + c + d

    def logp(x: int) -> float:
        lf = math.lgamma
        return lf(r + 1) + lf(n - r + 1) + lf(s + 1) + lf(n - s + 1) - lf(n + 1) - lf(x + 1) - lf(r - x + 1) - lf(s - x + 1) - lf(n - r - s + x + 1)

    own = logp(a)
    return min(1.0, sum(math.exp(p) for p in (logp(x) for x in range(max(0, r + s - n), min(r, s) + 1)) if p <= own + 1e-7))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def mann_whitney_p(u: float, n1: int, n2: int, ties: float = 0.0) -> float:
    """Two-sided p by the normal approximation; ``ties`` is the sum of t^3 - t over tied groups."""
    n = n1 + n2
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))) if n > 1 else 0.0
    return 1.0 if var <= 0 else normal_two_sided(max(0.0, abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(var))


def welch_t(m1: float, v1: float, n1: int, m2: float, v2: float, n2: int) -> tuple[float, float]:
    """(t, degrees of freedom) of two samples by mean, variance and size."""
    a, b = v1 / n1, v2 / n2
    return (m1 - m2) / math.sqrt(a + b), (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
