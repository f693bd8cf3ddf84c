"""Drift detectors with picklable state: update(), drift_detected, warning_detected, drift_indices, n_updates, reset().
Non-finite observations are counted and skipped. reset() takes a detector back to its start; what a detector forgets
after a drift of its own accord is its own affair."""

from __future__ import annotations

import bisect
import math
from collections import deque

import numpy as np


class Detector:
    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        """Forget the data, the counts and the indices."""
        self.n_updates = 0
        self.drift_indices: list[int] = []
        self.drift_detected = self.warning_detected = False
        self._start()

    def _start(self) -> None:
        """Forget the data."""

    def update(self, x: float) -> bool:
        i, self.n_updates = self.n_updates, self.n_updates + 1
        self.drift_detected = self.warning_detected = False
        if not math.isfinite(x):
            return False
        self.drift_detected, self.warning_detected = self._step(float(x))
        if self.drift_detected:
            self.drift_indices.append(i)
        return self.drift_detected

    def update_many(self, values: np.ndarray) -> list[int]:
        """update() for each of the values; the places of those that gave a drift."""
        return [i for i, x in enumerate(values.tolist()) if self.update(x)]

    def _step(self, x: float) -> tuple[bool, bool]:
        raise NotImplementedError


class PageHinkley(Detector):
    """Cumulative deviation above a fading mean, against its minimum."""

    def __init__(self, min_instances: int = 30, delta: float = 0.01, threshold: float = 15.0, alpha: float = 1 - 1e-4):
        if min_instances < 1 or threshold <= 0 or not 0 < alpha <= 1:
            raise ValueError("min_instances from 1, threshold above 0, alpha in (0, 1]")
        self.min_instances, self.delta, self.threshold, self.alpha = min_instances, delta, threshold, alpha
        super().__init__()

    def _start(self) -> None:
        self.n, self.mean, self.total, self.low = 0, 0.0, 0.0, math.inf

    def _step(self, x: float) -> tuple[bool, bool]:
        self.n += 1
        self.mean += (x - self.mean) / self.n
        self.total = self.alpha * self.total + x - self.mean - self.delta
        self.low = min(self.low, self.total)
        gap = self.total - self.low
        if self.n >= self.min_instances and gap > self.threshold:
            self._start()
            return True, True
        return False, self.n >= self.min_instances and gap > self.threshold / 2


class Adwin(Detector):
    """Adaptive window: exponential histogram buckets; old ones go while two sides of a cut differ by more than the
    Hoeffding-style bound at confidence delta."""

    def __init__(self, delta: float = 0.002, per_size: int = 5, every: int = 32, least: int = 10):
        if not 0 < delta < 1:
            raise ValueError("delta in (0, 1)")
        self.delta, self.per_size, self.every, self.least = delta, per_size, every, least
        super().__init__()

    def _start(self) -> None:
        self.rows: list[deque] = [deque()]  # row k: (sum, variance sum) of buckets of 2^k values, oldest first
        self.width, self.total, self.spread, self.ticks = 0, 0.0, 0.0, 0

    def _step(self, x: float) -> tuple[bool, bool]:
        if self.width:
            d = x - self.total / self.width
            self.spread += self.width * d * d / (self.width + 1)
        self.width += 1
        self.total += x
        self.rows[0].append((x, 0.0))
        k = 0
        while len(self.rows[k]) > self.per_size:
            (s1, v1), (s2, v2) = self.rows[k].popleft(), self.rows[k].popleft()
            if k + 1 == len(self.rows):
                self.rows.append(deque())
            n = 2**k
            self.rows[k + 1].append((s1 + s2, v1 + v2 + (s1 - s2) ** 2 / (2 * n)))
            k += 1
        self.ticks += 1
        return (self._shrink() if self.ticks % self.every == 0 and self.width > self.least else False), False

    def _shrink(self) -> bool:
        found = again = False
        while again or not found:
            again = False
            n0, s0 = 0, 0.0
            for k in range(len(self.rows) - 1, -1, -1):
                for s, _ in self.rows[k]:
                    n0, s0 = n0 + 2**k, s0 + s
                    n1 = self.width - n0
                    if n0 < 5 or n1 < 5:
                        continue
                    gap = abs(s0 / n0 - (self.total - s0) / n1)
                    m = 1 / (1 / n0 + 1 / n1)
                    log = math.log(2 * math.log(self.width) / self.delta)
                    if gap > math.sqrt(2 / m * self.spread / self.width * log) + 2 / (3 * m) * log:
                        again = found = True
                        break
                if again:
                    break
            if not again:
                break
            k = len(self.rows) - 1
            s, v = self.rows[k].popleft()
            n = 2**k
            mean = s / n
            self.width -= n
            self.total -= s
            if self.width:
                d = mean - self.total / self.width
                self.spread = max(0.0, self.spread - v - n * self.width * d * d / (n + self.width))
            while len(self.rows) > 1 and not self.rows[-1]:
                self.rows.pop()
        return found


class Windowed(Detector):
    """A reference, of the first values or set, against a sliding window of the latest, tested every few updates."""

    def __init__(self, reference_size: int = 500, window_size: int = 500, test_every: int = 1):
        if reference_size < 2 or window_size < 2 or test_every < 1:
            raise ValueError("reference and window need two values, a test every update at most")
        self.reference_size, self.window_size, self.test_every = reference_size, window_size, test_every
        super().__init__()

    def _start(self) -> None:
        self.reference: list[float] = []  # in order
        self.has_reference = False
        self.window: deque = deque(maxlen=self.window_size)
        self.statistic = math.nan

    def set_reference(self, values, counts=None) -> None:
        """Fix the reference: the finite ones of these values, two at least. counts: how often each of them occurs."""
        a = np.asarray(values, float)
        n = np.ones(len(a), int) if counts is None else np.asarray(counts)
        a, n = a[np.isfinite(a)], n[np.isfinite(a)]
        if n.sum() < 2:
            raise ValueError("a reference needs two finite values")
        self._fix(a, n)
        self.has_reference = True

    def _fix(self, values: np.ndarray, counts: np.ndarray) -> None:
        self.reference = np.sort(np.repeat(values, counts))

    def _step(self, x: float) -> tuple[bool, bool]:
        if not self.has_reference:
            bisect.insort(self.reference, x)
            self.has_reference = len(self.reference) == self.reference_size
            return False, False
        self.window.append(x)
        if len(self.window) < self.window_size or (self.n_updates - 1) % self.test_every:
            return False, False
        return self._test()

    def _test(self) -> tuple[bool, bool]:
        raise NotImplementedError


class Ks(Windowed):
    def __init__(self, alpha: float = 0.001, **sizes: int):
        if not 0 < alpha < 1:
            raise ValueError("alpha in (0, 1)")
        self.alpha = alpha
        super().__init__(**sizes)

    def _start(self) -> None:
        super()._start()
        self.p_value = math.nan
        self.shares, self.size = None, 0  # of the distinct values of a fixed reference: shares below, and all its values

    def _fix(self, values: np.ndarray, counts: np.ndarray) -> None:
        """The reference is kept as its distinct values: it may be a long history."""
        self.reference, at = np.unique(values, return_inverse=True)
        below = np.concatenate([[0], np.cumsum(np.bincount(at, counts).astype(np.int64))])
        self.size = int(below[-1])
        self.shares = below / self.size

    def update_many(self, values: np.ndarray) -> list[int]:
        if not self.has_reference or len(values) < 2:
            return super().update_many(values)
        # only the tests look at the window; the last value goes the usual way and leaves the usual state
        places = np.flatnonzero(np.isfinite(values[:-1]))
        kept = np.concatenate([np.array(self.window, float), values[places]])
        before, start, found = len(self.window), self.n_updates, []
        due = np.flatnonzero(((start + places) % self.test_every == 0) & (before + np.arange(1, len(places) + 1) >= self.window_size))
        for i in due.tolist():
            end = before + i + 1
            if self._compare(kept[end - self.window_size : end])[0]:
                found.append(int(places[i]))
        self.n_updates += len(values) - 1
        self.drift_indices += [start + i for i in found]
        self.window = deque(kept[-self.window_size :].tolist(), maxlen=self.window_size)
        return found + ([len(values) - 1] if self.update(float(values[-1])) else [])

    def _test(self) -> tuple[bool, bool]:
        return self._compare(np.array(self.window))

    def _compare(self, window: np.ndarray) -> tuple[bool, bool]:
        if self.shares is None:
            self._fix(np.array(self.reference), np.ones(len(self.reference), int))
        # between two values of the window its share is constant, so the greatest gap is at one of them or just below it
        a, b = self.reference, np.sort(window)
        at = np.abs(self.shares[np.searchsorted(a, b, "right")] - np.searchsorted(b, b, "right") / len(b))
        below = np.abs(self.shares[np.searchsorted(a, b, "left")] - np.searchsorted(b, b, "left") / len(b))
        self.statistic = float(max(at.max(), below.max()))
        self.p_value = kolmogorov_p(self.statistic, self.size, len(b))
        return self.p_value < self.alpha, self.p_value < min(1.0, 10 * self.alpha)


def kolmogorov_p(d: float, n: int, m: int) -> float:
    """Asymptotic two-sample p-value."""
    e = math.sqrt(n * m / (n + m))
    x = (e + 0.12 + 0.11 / e) * d
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def expected_null_psi(bins: int, reference: int, window: int) -> float:
    """What the index amounts to by chance alone, without any drift."""
    if bins < 2 or reference < 1 or window < 1:
        raise ValueError("two bins and values on both sides are needed")
    return (bins - 1) * (1 / reference + 1 / window)


def stability_index(reference, window, bins: int = 10, eps: float = 1e-6) -> float:
    """Population stability index over the distinct quantiles of the reference, the outer bins open. A reference of one
    value: by the share of the window that has it. NaN without values."""
    a, b = (np.asarray(x, float) for x in (reference, window))
    a, b = a[np.isfinite(a)], b[np.isfinite(b)]
    if not len(a) or not len(b):
        return math.nan
    edges = np.unique(np.quantile(a, np.linspace(0, 1, bins + 1)))
    if len(edges) == 1:
        share = max(float(np.mean(b == edges[0])), eps)
        return (share - 1) * math.log(share)
    inner = edges[1:-1]  # a value on an edge belongs to the bin above it
    share = lambda x: np.maximum(np.bincount(np.searchsorted(inner, x, "right"), minlength=len(inner) + 1) / len(x), eps)
    p, q = share(a), share(b)
    return float(((q - p) * np.log(q / p)).sum())


class Psi(Windowed):
    """Refuses sizes at which chance alone comes near the drift threshold (by more than `noise` of it)."""

    def __init__(self, bins: int = 10, drift: float = 0.25, warning: float = 0.1, noise: float = 0.25, **sizes: int):
        self.bins, self.drift, self.warn = bins, drift, warning
        super().__init__(**sizes)
        self.null = expected_null_psi(bins, self.reference_size, self.window_size)
        if self.null > noise * drift:
            raise ValueError(f"unreliable sizes: {self.null:.3f} is expected by chance against a threshold of {drift}")

    def _test(self) -> tuple[bool, bool]:
        self.statistic = stability_index(self.reference, self.window, self.bins)
        return self.statistic > self.drift, self.statistic > self.warn


DETECTORS = {"adwin": Adwin, "page_hinkley": PageHinkley, "ks": Ks, "psi": Psi}


def make_detector(name: str, **kw) -> Detector:
    if name not in DETECTORS:
        raise ValueError(f"unknown detector {name!r}")
    return DETECTORS[name](**kw)
