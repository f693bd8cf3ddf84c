"""Statistics on small driver-side arrays: bootstrap, Wilcoxon, effect sizes, tests from intervals, longitudinal
measures. Inputs are metric series or collected samples, never tables."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from tracelens.schema import SEED


def mcc(y: np.ndarray, p: np.ndarray) -> float:
    tn, fp, fn, tp = (float(np.sum(2 * np.asarray(y) + np.asarray(p) == v)) for v in range(4))
    below = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return (tp * tn - fp * fn) / below if below else 0.0


def stratified_bootstrap(metric: Callable, y: np.ndarray, other: np.ndarray, n: int = 1000, seed: int = SEED) -> np.ndarray:
    """Replicates of metric(y, other), resampled within each class; NaN with one class."""
    y, other = np.asarray(y), np.asarray(other)
    if len(np.unique(y)) < 2:
        return np.full(n, np.nan)
    rng = np.random.default_rng(seed)
    groups = [np.flatnonzero(y == v) for v in np.unique(y)]
    out = np.empty(n)
    for i in range(n):
        at = np.concatenate([rng.choice(g, len(g)) for g in groups])
        out[i] = metric(y[at], other[at])
    return out


def interval(replicates: np.ndarray, alpha: float = 0.05) -> tuple[float, float]:
    return tuple(np.nanquantile(replicates, [alpha / 2, 1 - alpha / 2]))


def threshold_p(replicates: np.ndarray, threshold: float, greater: bool = True) -> float:
    """Share of the defined replicates that fail to beat the threshold; NaN if none is defined."""
    r = np.asarray(replicates, float)
    r = r[np.isfinite(r)]
    if not len(r):
        return math.nan
    return float(np.mean(r <= threshold if greater else r >= threshold))


def f1(y: np.ndarray, p: np.ndarray) -> float:
    _, fp, fn, tp = (float(np.sum(2 * np.asarray(y) + np.asarray(p) == v)) for v in range(4))
    return 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0


def average_precision(y: np.ndarray, score: np.ndarray) -> float:
    """Mean precision over the positives, rows of one score together; NaN without positives."""
    y, score = np.asarray(y, float), np.asarray(score, float)
    order = np.argsort(-score, kind="stable")
    tp, n = np.cumsum(y[order]), np.arange(1, len(y) + 1)
    last = np.append(score[order][1:] != score[order][:-1], True)
    gained = np.diff(np.concatenate([[0], tp[last]]))
    return float((gained * tp[last] / n[last]).sum() / y.sum()) if y.sum() else math.nan


def roc_auc(y: np.ndarray, score: np.ndarray) -> float:
    """Share of (positive, negative) pairs in the right order, ties count half; NaN with one class."""
    y, score = np.asarray(y, float), np.asarray(score, float)
    pos, neg = y.sum(), (1 - y).sum()
    if not pos or not neg:
        return math.nan
    _, inverse, n = np.unique(score, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(n) - (n - 1) / 2)[inverse]
    return float((ranks[y > 0].sum() - pos * (pos + 1) / 2) / (pos * neg))


def brier(y: np.ndarray, score: np.ndarray) -> float:
    return float(np.mean((np.asarray(score, float) - np.asarray(y, float)) ** 2))


#: name -> (metric, whether it takes scores instead of labels)
METRICS = {"mcc": (mcc, False), "f1": (f1, False), "pr_auc": (average_precision, True), "roc_auc": (roc_auc, True), "brier": (brier, True)}


def metric_interval(name: str, y: np.ndarray, score: np.ndarray, threshold: float = 0.5, n: int = 1000, seed: int = SEED, alpha: float = 0.05) -> dict:
    """point, low, high and replicates of a metric by a stratified bootstrap. Unknown names raise KeyError; with one
    class all but the point are NaN."""
    metric, takes_scores = METRICS[name]
    other = np.asarray(score, float)
    if not takes_scores:
        other = (other >= threshold).astype(int)
    replicates = stratified_bootstrap(metric, y, other, n, seed)
    defined = np.isfinite(replicates).any()
    low, high = interval(replicates, alpha) if defined else (math.nan, math.nan)
    return {"point": metric(np.asarray(y), other), "low": float(low), "high": float(high), "replicates": replicates}


def paired_difference(metric: Callable, y: np.ndarray, a: np.ndarray, b: np.ndarray, n: int = 1000, seed: int = SEED) -> dict:
    """Interval of metric(a) - metric(b) on common resamples within each class, and whether it straddles zero."""
    y, a, b = map(np.asarray, (y, a, b))
    rng = np.random.default_rng(seed)
    groups = [np.flatnonzero(y == v) for v in np.unique(y)]
    d = []
    for _ in range(n):
        at = np.concatenate([rng.choice(g, len(g)) for g in groups])
        d.append(metric(y[at], a[at]) - metric(y[at], b[at]))
    lo, hi = interval(np.array(d))
    return {"low": float(lo), "high": float(hi), "straddles_zero": bool(lo <= 0 <= hi)}


def median_interval(values: np.ndarray, n: int = 1000, seed: int = SEED) -> tuple[float, float, float]:
    v = np.asarray(values, float)
    rng = np.random.default_rng(seed)
    r = np.array([np.median(rng.choice(v, len(v))) for _ in range(n)])
    return (float(np.median(v)), *map(float, interval(r)))


def wilcoxon(a: np.ndarray, b: np.ndarray, alternative: str = "two-sided") -> tuple[float, float]:
    """Paired signed-rank statistic and p: exact up to 50 pairs without ties (sums counted by recursion), else normal
    with continuity and tie corrections. The statistic is the lesser rank sum, or for "greater" and "less" (of a over b)
    that of the positive differences. Equal lists give p = 1."""
    if alternative not in ("two-sided", "greater", "less"):
        raise ValueError(f"unknown alternative {alternative!r}")
    a, b = np.asarray(a, float), np.asarray(b, float)
    if a.shape != b.shape:
        raise ValueError("lists of different length")
    if not len(a):
        raise ValueError("empty lists")
    d = (a - b)[a != b]
    n = len(d)
    if n == 0:
        return 0.0, 1.0
    size, inverse, ties = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    ranks = (np.cumsum(ties) - (ties - 1) / 2)[inverse]
    plus, minus = float(ranks[d > 0].sum()), float(ranks[d < 0].sum())
    w = min(plus, minus) if alternative == "two-sided" else plus
    low = min(plus, minus) if alternative == "two-sided" else minus if alternative == "greater" else plus
    if n <= 50 and (ties == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        below = ways[: int(low) + 1].sum() / 2.0**n
    else:
        var = n * (n + 1) * (2 * n + 1) / 24 - float((ties**3 - ties).sum()) / 48
        z = (low - n * (n + 1) / 4 + 0.5) / math.sqrt(var)
        below = 0.5 * math.erfc(-z / math.sqrt(2))
    return w, float(min(1.0, 2 * below if alternative == "two-sided" else below))


def paired_test(a: np.ndarray, b: np.ndarray, alternative: str = "two-sided", alpha: float = 0.05) -> dict:
    """Signed-rank test with the medians of both lists and the decision."""
    w, p = wilcoxon(a, b, alternative)
    return {"statistic": w, "p": p, "median_a": float(np.median(a)), "median_b": float(np.median(b)), "reject": p < alpha}


def cohens_d(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.asarray(a, float), np.asarray(b, float)
    n, m = len(a), len(b)
    if n < 2 or m < 2:
        raise ValueError("an effect size needs two values in each list")
    s = math.sqrt(((n - 1) * a.var(ddof=1) + (m - 1) * b.var(ddof=1)) / (n + m - 2))
    return float((a.mean() - b.mean()) / s) if s else 0.0


def interval_test(low: float, high: float, threshold: float, greater: bool = True) -> bool:
    """Reject the null when the whole interval is strictly beyond the threshold."""
    return low > threshold if greater else high < threshold


def tail_p(value: float, low: float, high: float, threshold: float, greater: bool = True) -> float:
    """One-sided normal p-value from a value and its 95 % interval."""
    se = (high - low) / (2 * 1.959963984540054)
    z = (value - threshold) / se if se else math.copysign(math.inf, value - threshold)
    return 0.5 * math.erfc((z if greater else -z) / math.sqrt(2))


def reconcile(value: float, low: float, high: float, threshold: float, stored: bool, greater: bool = True, alpha: float = 0.05) -> dict:
    """The decision by the interval and by the tail's p-value, and whether a stored decision agrees with the interval's."""
    by_interval = interval_test(low, high, threshold, greater)
    p = tail_p(value, low, high, threshold, greater)
    return {"p": p, "by_interval": by_interval, "by_p": p < alpha / 2, "agrees": stored == by_interval}


def overlaps(a: tuple[float, float], b: tuple[float, float]) -> bool:
    return a[0] <= b[1] and b[0] <= a[1]


def degradation_slope(values: list[float]) -> float:
    """OLS slope over the index; NaN under two points."""
    y = np.asarray(values, float)
    return float(np.polyfit(np.arange(len(y)), y, 1)[0]) if len(y) > 1 else math.nan


def retraining_effectiveness(before: float, dip: float, after: float) -> float:
    """Share of what was lost that came back; NaN if nothing was lost."""
    lost = before - dip
    return (after - dip) / lost if lost > 0 else math.nan


def sustainment(values: list[float], reference: float, drop: float) -> int:
    """Periods before the first dip below reference - drop."""
    return next((i for i, v in enumerate(values) if v < reference - drop), len(values))


def mcc_at_prevalence(y: np.ndarray, p: np.ndarray, prevalence: float) -> float:
    """MCC with the larger class's counts scaled down to a prevalence of positives."""
    tn, fp, fn, tp = (float(np.sum(2 * np.asarray(y) + np.asarray(p) == v)) for v in range(4))
    pos, neg = tp + fn, tn + fp
    if not pos or not neg:
        return 0.0
    if pos / (pos + neg) > prevalence:
        k = prevalence * neg / (1 - prevalence) / pos
        tp, fn = tp * k, fn * k
    else:
        k = pos * (1 - prevalence) / prevalence / neg
        tn, fp = tn * k, fp * k
    below = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return (tp * tn - fp * fn) / below if below else 0.0


def converged(curve: list[float], straddles: list[bool], delta: float) -> int | None:
    """First step of a learning curve whose gain is below delta and whose difference straddles zero."""
    return next((i for i in range(1, len(curve)) if abs(curve[i] - curve[i - 1]) < delta and straddles[i]), None)
