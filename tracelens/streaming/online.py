"""Online learners: logistic regression by stochastic gradients, Hoeffding trees, one that adapts to drift, a forest of
those, boosting, and a soft vote. All learn row by row and pickle, so a saved learner goes on exactly where it was.

A learner has features (names) or a number of them; rows are arrays or dictionaries by name (absent ones are NaN, which
counts as 0). learn_one() returns the learner, never a prediction."""

from __future__ import annotations

import math
import pickle
import sys
from collections import Counter

import numpy as np

from tracelens.schema import SEED
from tracelens.streaming.detectors import Adwin


def rows_of(data, features: list[str], drop_nulls: bool = False) -> list[dict]:
    """Rows of a pandas frame or a list of dictionaries as dictionaries with these features."""
    if hasattr(data, "to_dict") and hasattr(data, "columns"):
        data = data[features].to_dict("records")
    elif not isinstance(data, list):
        raise TypeError(f"no rows in a {type(data).__name__}")
    null = lambda v: v is None or v != v
    return [{f: math.nan if null(r.get(f)) else float(r[f]) for f in features if not (drop_nulls and null(r.get(f)))} for r in data]


_MOST = sys.float_info.max


class Learner:
    #: Whether class weights reach the learner.
    supports_weights = False

    def __init__(self, n: int | None = None, features: list[str] | None = None, class_weights: dict[int, float] | None = None):
        if n is None and features is None:
            raise ValueError("features or their number")
        self.features, self.class_weights = features, class_weights or {}
        self.n = len(features) if features is not None else n
        self.reset()

    def reset(self) -> None:
        self.n_learned = 0
        self._build()

    def _array(self, x) -> list[float]:
        """The row as floats, NaN as 0 and infinite ones as the greatest float. Rows are short, so lists are faster."""
        if isinstance(x, dict):
            x = [x.get(f, math.nan) for f in self.features] if self.features else list(x.values())
        return [v if -_MOST <= v <= _MOST else 0.0 if v != v else math.copysign(_MOST, v) for v in [0.0 if v is None else float(v) for v in x]]

    def predict_one(self, x) -> float:
        return self._predict(self._array(x))

    predict_proba_one = predict_one

    def predict_proba(self, xs) -> np.ndarray:
        return np.array([self.predict_one(x) for x in (rows_of(xs, self.features) if hasattr(xs, "columns") else xs)], float)

    def learn_one(self, x, y: int, w: float = 1.0) -> Learner:
        self._take(self._array(x), int(y), w)
        return self

    def _take(self, x: list[float], y: int, w: float) -> None:
        if not self.supports_weights:
            w = 1.0
        elif self.class_weights:
            w *= self.class_weights.get(y, 1.0)
        self._learn(x, y, w)
        self.n_learned += 1

    def score_and_learn(self, x, y: int) -> float:
        """predict_one(), then learn_one(): the score from before the label was seen."""
        p = self.predict_one(x)
        self.learn_one(x, y)
        return p

    def learn_many(self, xs, ys) -> Learner:
        xs = rows_of(xs, self.features) if hasattr(xs, "columns") else xs
        if len(xs) != len(ys):
            raise ValueError("rows and labels of different lengths")
        for x, y in zip(xs, ys, strict=True):
            self.learn_one(x, y)
        return self

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            pickle.dump(self, f, protocol=pickle.HIGHEST_PROTOCOL)

    @staticmethod
    def load(path: str) -> Learner:
        with open(path, "rb") as f:
            return pickle.load(f)


class LogisticSgd(Learner):
    supports_weights = True

    def __init__(self, n: int | None = None, rate: float = 0.05, decay: float = 1e-4, positive_weight: float = 1.0, **kw):
        self.rate, self.decay, self.positive_weight = rate, decay, positive_weight
        super().__init__(n, **kw)

    def _build(self) -> None:
        self.w, self.b, self.seen = [0.0] * self.n, 0.0, 0
        self.mean, self.m2, self.sd = [0.0] * self.n, [0.0] * self.n, [1.0] * self.n

    def _scaled(self, x: list[float]) -> list[float]:
        return [(a - m) / d for a, m, d in zip(x, self.mean, self.sd)] if self.seen > 1 else [0.0] * self.n  # noqa: B905

    def _sigmoid(self, scaled: list[float]) -> float:
        z = self.b + sum([a * b for a, b in zip(scaled, self.w)])  # noqa: B905
        return 1 / (1 + math.exp(-z)) if -30.0 < z < 30.0 else 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def _predict(self, x: list[float]) -> float:
        return self._sigmoid(self._scaled(x))

    def _learn(self, x: list[float], y: int, w: float) -> None:
        self.seen += 1
        n, mean, m2, sd = self.seen, self.mean, self.m2, self.sd
        for i, a in enumerate(x):
            d = a - mean[i]
            mean[i] += d / n
            m2[i] += d * (a - mean[i])
            sd[i] = math.sqrt(max(m2[i], 0.0) / n) + 1e-9
        scaled = self._scaled(x)
        g = (self._sigmoid(scaled) - y) * w * (self.positive_weight if y else 1.0)
        rate, decay = self.rate, self.decay
        self.w = [b - rate * (g * a + decay * b) for a, b in zip(scaled, self.w)]  # noqa: B905
        self.b -= self.rate * g


class HoeffdingTree(Learner):
    """Binary splits on Gaussian class summaries, made when the best gain beats the next by the Hoeffding bound.

    leaves: most leaves; None for no bound. subset: features that a leaf looks at; None for all."""

    supports_weights = True

    def __init__(self, n: int | None = None, grace: int = 100, confidence: float = 1e-4, tie: float = 0.1, leaves: int | None = None, subset: int | None = None, seed: int = SEED, **kw):
        self.grace, self.confidence, self.tie, self.leaves, self.subset, self.seed = grace, confidence, tie, leaves, subset, seed
        super().__init__(n, **kw)

    def _build(self) -> None:
        self.rng = np.random.default_rng(self.seed)
        self.root, self.size = self._leaf(), 1
        self.last: tuple = (None, None)  # the last row and its leaf: it is scored, then learned

    def _leaf(self) -> dict:
        seen = np.arange(self.n) if self.subset is None or self.subset >= self.n else np.sort(self.rng.choice(self.n, self.subset, replace=False))
        none = lambda: [[0.0] * self.n, [0.0] * self.n]
        return {"n": [0.0, 0.0], "mean": none(), "m2": none(), "lo": [math.inf] * self.n, "hi": [-math.inf] * self.n, "since": 0.0, "seen": seen.tolist()}

    def _find(self, x: list[float]) -> dict:
        node = self.last[1] if x is self.last[0] else self.root
        while "at" in node:
            node = node["left"] if x[node["at"]] <= node["cut"] else node["right"]
        self.last = (x, node)
        return node

    def _predict(self, x: list[float]) -> float:
        a, b = self._find(x)["n"]
        return (b + 1) / (a + b + 2)

    def _learn(self, x: list[float], y: int, w: float) -> None:
        if w <= 0:
            return
        leaf = self._find(x)
        leaf["n"][y] += w
        n, mean, m2, lo, hi = leaf["n"][y], leaf["mean"][y], leaf["m2"][y], leaf["lo"], leaf["hi"]
        for i, a in enumerate(x):
            d = a - mean[i]
            mean[i] += w * d / n
            m2[i] += w * d * (a - mean[i])
            if a < lo[i]:
                lo[i] = a
            if a > hi[i]:
                hi[i] = a
        leaf["since"] += w
        if leaf["since"] >= self.grace and min(leaf["n"]) > 0 and (self.leaves is None or self.size < self.leaves):
            leaf["since"] = 0.0
            self._split(leaf)

    @staticmethod
    def _spread(leaf: dict, c: int, i: int) -> float:
        return (math.sqrt(max(leaf["m2"][c][i], 0.0) / max(leaf["n"][c], 1e-9)) + 1e-9) * math.sqrt(2)

    def _below(self, leaf: dict, c: int, i: int, cut: float) -> float:
        """Share of a class below a cut."""
        return 0.5 * math.erfc((leaf["mean"][c][i] - cut) / self._spread(leaf, c, i))

    def _split(self, leaf: dict) -> None:
        total = sum(leaf["n"])
        entropy = lambda c: -sum(v / sum(c) * math.log2(v / sum(c)) for v in c if v > 1e-12 * sum(c)) if sum(c) > 0 else 0.0
        gains, whole = [], entropy(leaf["n"])
        for i in leaf["seen"]:
            best, spread = (0.0, 0.0), [self._spread(leaf, c, i) for c in (0, 1)]
            for cut in np.linspace(leaf["lo"][i], leaf["hi"][i], 12)[1:-1].tolist():
                below = [leaf["n"][c] * (0.5 * math.erfc((leaf["mean"][c][i] - cut) / spread[c])) for c in (0, 1)]
                above = [leaf["n"][c] - below[c] for c in (0, 1)]
                gain = whole - sum(below) / total * entropy(below) - sum(above) / total * entropy(above)
                best = max(best, (gain, cut))
            gains.append((*best, i))
        gains.sort(reverse=True)
        bound = math.sqrt(math.log(1 / self.confidence) / (2 * total))
        second = gains[1][0] if len(gains) > 1 else 0.0
        if gains[0][0] > 0 and (gains[0][0] - second > bound or bound < self.tie):
            _, cut, i = gains[0]
            left, right = self._leaf(), self._leaf()
            for c in (0, 1):
                share = self._below(leaf, c, i, cut)
                left["n"][c], right["n"][c] = leaf["n"][c] * share, leaf["n"][c] * (1 - share)
                left["mean"][c], right["mean"][c] = leaf["mean"][c].copy(), leaf["mean"][c].copy()
                left["m2"][c], right["m2"][c] = [v * share for v in leaf["m2"][c]], [v * (1 - share) for v in leaf["m2"][c]]
            leaf.clear()
            leaf.update({"at": i, "cut": cut, "left": left, "right": right})
            self.size += 1


class AdaptiveTree(Learner):
    """A Hoeffding tree watched by ADWIN: when its error rises, a new tree grows beside it and takes over once it errs
    less."""

    supports_weights = True

    def __init__(self, n: int | None = None, delta: float = 0.002, patience: int = 300, **kw):
        self.delta, self.patience = delta, patience
        self.tree = {k: kw.pop(k) for k in ("grace", "confidence", "tie", "leaves", "subset", "seed") if k in kw}
        super().__init__(n, **kw)

    def _build(self) -> None:
        self.main, self.spare = HoeffdingTree(self.n, **self.tree), None
        self.watch, self.errors, self.level = Adwin(self.delta), [0.0, 0.0, 0], 0.0

    def _predict(self, x: list[float]) -> float:
        return self.main._predict(x)

    def _learn(self, x: list[float], y: int, w: float) -> None:
        wrong = float((self.main._predict(x) >= 0.5) != y)
        before = self.watch.total / self.watch.width if self.watch.width else 0.0
        if self.watch.update(wrong) and self.spare is None and self.watch.total / max(self.watch.width, 1) > before:
            self.spare, self.errors = HoeffdingTree(self.n, **self.tree), [0.0, 0.0, 0]
        self.main._learn(x, y, w)
        if self.spare is not None:
            self.errors = [self.errors[0] + wrong, self.errors[1] + float((self.spare._predict(x) >= 0.5) != y), self.errors[2] + 1]
            self.spare._learn(x, y, w)
            if self.errors[2] >= self.patience:
                if self.errors[1] <= self.errors[0]:
                    self.main, self.watch = self.spare, Adwin(self.delta)
                self.spare = None


class AdaptiveForest(Learner):
    """Trees on random features and Poisson(rate) copies of each row; a tree whose error drifts upwards starts anew."""

    supports_weights = True

    def __init__(self, n: int | None = None, n_models: int = 10, rate: float = 6.0, delta: float = 0.001, seed: int = SEED, **kw):
        self.n_models, self.poisson, self.delta, self.seed = n_models, rate, delta, seed
        super().__init__(n, **kw)

    def _tree(self, i: int) -> HoeffdingTree:
        return HoeffdingTree(self.n, grace=50, confidence=0.01, subset=max(1, round(math.sqrt(self.n)) if self.n > 3 else self.n), seed=self.seed + i)

    def _build(self) -> None:
        self.rng, self.made = np.random.default_rng(self.seed), self.n_models
        self.trees = [self._tree(i) for i in range(self.n_models)]
        self.watch = [Adwin(self.delta) for _ in self.trees]

    def _predict(self, x: list[float]) -> float:
        return float(np.mean([t._predict(x) for t in self.trees]))

    def _learn(self, x: list[float], y: int, w: float) -> None:
        for i, (tree, copies) in enumerate(zip(self.trees, self.rng.poisson(self.poisson, self.n_models), strict=True)):
            d = self.watch[i]
            before = d.total / d.width if d.width else 0.0
            if d.update(float((tree._predict(x) >= 0.5) != y)) and d.total / max(d.width, 1) > before:
                tree = self.trees[i] = self._tree(self.made)
                self.watch[i], self.made = Adwin(self.delta), self.made + 1
            if copies:
                tree._learn(x, y, w * copies)


class OnlineBoosting(Learner):
    """Members in a row; each sees a row as often as the members before it have got such rows wrong, and votes by its
    own error."""

    supports_weights = True

    def __init__(self, n: int | None = None, n_models: int = 10, seed: int = SEED, **kw):
        self.n_models, self.seed = n_models, seed
        super().__init__(n, **kw)

    def _build(self) -> None:
        self.rng = np.random.default_rng(self.seed)
        self.trees = [HoeffdingTree(self.n, grace=50, seed=self.seed + i) for i in range(self.n_models)]
        self.right, self.wrong = np.full(self.n_models, 1e-9), np.full(self.n_models, 1e-9)

    def _predict(self, x: list[float]) -> float:
        error = np.clip(self.wrong / (self.right + self.wrong), 1e-3, 1 - 1e-3)
        votes = np.maximum(np.log((1 - error) / error), 0.0) * (self.right + self.wrong > 1e-6)
        p = np.array([t._predict(x) for t in self.trees])
        return float((votes * p).sum() / votes.sum()) if votes.sum() > 0 else 0.5

    def _learn(self, x: list[float], y: int, w: float) -> None:
        weight = w
        for i, tree in enumerate(self.trees):
            copies = self.rng.poisson(min(weight, 50.0))
            if copies:
                tree._learn(x, y, float(copies))
            if (tree._predict(x) >= 0.5) == y:
                self.right[i] += weight
                weight *= (self.right[i] + self.wrong[i]) / (2 * self.right[i])
            else:
                self.wrong[i] += weight
                weight *= (self.right[i] + self.wrong[i]) / (2 * self.wrong[i])


class SoftVote(Learner):
    """Mean of the members' scores: equal weights, or with dynamic ones the greater of 1 - fading loss and `floor`. A
    member's loss is |label - score| before it sees the label."""

    supports_weights = True

    def __init__(self, n: int | None = None, members=("logistic", "tree"), decay: float = 0.99, floor: float = 0.01, dynamic: bool = True, **kw):
        if not members:
            raise ValueError("a vote needs a member")
        if not 0 < decay < 1:
            raise ValueError("decay in (0, 1)")
        self.given, self.decay, self.floor, self.dynamic = members, decay, floor, dynamic
        super().__init__(n, **kw)

    def _build(self) -> None:
        self.members = [make_learner(m, self.n, features=self.features, class_weights=self.class_weights) if isinstance(m, str) else m for m in self.given]
        for m in self.members:
            m.reset()
        self.loss = [0.0] * len(self.members)

    @property
    def weights(self) -> np.ndarray:
        return np.array(self._shares())

    def _shares(self) -> list[float]:
        w = [max(1 - v, self.floor) for v in self.loss] if self.dynamic and self.n_learned else [1.0] * len(self.members)
        total = sum(w)
        return [v / total for v in w]

    def _vote(self, scores: list[float]) -> float:
        return float(sum([a * p for a, p in zip(self._shares(), scores, strict=True)]))

    def _predict(self, x: list[float]) -> float:
        return self._vote([m._predict(x) for m in self.members])

    def _take(self, x: list[float], y: int, w: float, scores: list[float] | None = None) -> None:
        if scores is None:
            scores = [m._predict(x) for m in self.members]
        old, new = self.decay, 1 - self.decay
        self.loss = [old * v + new * abs(y - p) for v, p in zip(self.loss, scores, strict=True)]
        for m in self.members:
            m._take(x, y, w)
        self.n_learned += 1

    def score_and_learn(self, x, y: int) -> float:
        a = self._array(x)
        scores = [m._predict(a) for m in self.members]
        p = self._vote(scores)
        self._take(a, int(y), 1.0, scores)
        return p


LEARNERS = {"logistic": LogisticSgd, "tree": HoeffdingTree, "adaptive_tree": AdaptiveTree, "adaptive_forest": AdaptiveForest, "boosting": OnlineBoosting, "vote": SoftVote}


def make_learner(name: str, n: int | None = None, **kw):
    if name not in LEARNERS:
        raise ValueError(f"unknown online learner {name!r}")
    return LEARNERS[name](n, **kw)


def balanced_weights(labels) -> dict[int, float]:
    """n / (classes x n of the class); with one class both count 1."""
    c = Counter(int(y) for y in labels)
    if len(c) < 2:
        return {0: 1.0, 1: 1.0}
    return {k: sum(c.values()) / (len(c) * v) for k, v in c.items()}
