import math
import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.streaming.detectors import DETECTORS, expected_null_psi, make_detector, stability_index
from tracelens.streaming.online import LEARNERS, balanced_weights, make_learner, rows_of
from tracelens.streaming.stream import prequential, replay_detector, stream_detector


def jump(n=600, seed=1):
    r = random.Random(seed)
    return [float(r.random() < 0.1) for _ in range(n)] + [float(r.random() < 0.8) for _ in range(n)]


SIZES = {"ks": {"reference_size": 200, "window_size": 100}, "psi": {"reference_size": 200, "window_size": 100, "bins": 2}, "adwin": {}, "page_hinkley": {}}


@pytest.mark.parametrize("name", sorted(DETECTORS))
def test_finds_a_jump_and_resumes(name):
    a, b = make_detector(name, **SIZES[name]), make_detector(name, **SIZES[name])
    # the bins of the stability index are quantiles of a reference, so it needs values and not only hits
    for i, x in enumerate(normal(3.0, 1200, 600) if name == "psi" else jump()):
        a.update(x)
        if i == 700:
            b = pickle.loads(pickle.dumps(b))
        b.update(x)
    assert a.drift_indices and min(a.drift_indices) >= 600 - 1
    assert a.drift_indices == b.drift_indices


@pytest.mark.parametrize("name", ["adwin", "page_hinkley"])
def test_quiet_without_drift(name):
    d = make_detector(name)
    r = random.Random(3)
    for _ in range(1000):
        d.update(float(r.random() < 0.1))
    assert not d.drift_indices


def test_non_finite_values_count_only():
    d = make_detector("page_hinkley")
    for x in (float("nan"), float("inf"), 1.0):
        d.update(x)
    assert d.n_updates == 3 and d.n == 1
    with pytest.raises(ValueError):
        make_detector("none")


@pytest.mark.parametrize("name", sorted(LEARNERS))
def test_learners_learn(name):
    rng = np.random.default_rng(42)
    m, hits = make_learner(name, 2), 0
    for i in range(1500):
        y = int(rng.random() < 0.5)
        x = rng.normal(2.0 * y, 0.7, 2)
        if i >= 1000:
            hits += (m.predict_one(x) >= 0.5) == y
        m.learn_one(x, y)
    assert hits > 400
    assert balanced_weights([0, 0, 0, 1]) == {0: 4 / 6, 1: 2.0}


def test_stream_equals_replay(spark, tmp_path):
    rows = [(k, i, x) for k in ("a", "b") for i, x in enumerate(jump(seed=ord(k)))]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    want = sorted(map(tuple, replay_detector(df, "k", "i", "v", "page_hinkley").collect()))
    for lo in (0, 400, 800):
        df.where(F.col("i").between(lo, lo + 399)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = stream_detector(s, "k", "i", "v", "page_hinkley").writeStream.format("memory").queryName("drifts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("drifts").collect())) == want and want


def normal(shift, n=2000, at=1200, seed=42):
    rng = np.random.default_rng(seed)
    return rng.normal(np.where(np.arange(n) < at, 0.0, shift), 1.0)


@pytest.mark.parametrize("name,sizes", [("ks", {"reference_size": 100, "window_size": 50, "test_every": 10}), ("psi", {"test_every": 50}), ("adwin", {}), ("page_hinkley", {})])
def test_stationary_streams_are_quiet(name, sizes):
    noisy = 0
    for seed in range(100):
        d = make_detector(name, **sizes)
        rng = np.random.default_rng(seed)
        for x in rng.normal(0, 1, 1500) if name in ("ks", "psi") else (rng.random(1500) < 0.05).astype(float):
            d.update(x)
        noisy += bool(d.drift_indices)
    assert noisy <= (40 if name == "ks" else 5)  # KS tests 140 times at a level of 0.001


def test_psi_guard_and_analytic_cases():
    assert expected_null_psi(10, 500, 500) == pytest.approx(9 * 2 / 500) and expected_null_psi(10, 100, 50) > 0.25
    with pytest.raises(ValueError, match="unreliable"):
        make_detector("psi", reference_size=100, window_size=50)
    make_detector("psi", reference_size=100, window_size=50, bins=2)
    x = np.random.default_rng(1).normal(size=5000)
    assert stability_index(x, x) == pytest.approx(0.0, abs=1e-9)
    assert stability_index(x, x + 0.1) < 0.1 < 0.25 < stability_index(x, x + 2)
    zeros = np.zeros(500)
    assert stability_index(zeros, zeros[:200]) == pytest.approx(0.0, abs=1e-9)
    assert 0.25 < stability_index(zeros, np.r_[np.zeros(100), np.ones(100)]) < 100
    for bad in ({"reference_size": 1}, {"test_every": 0}, {"alpha": 2.0}):
        with pytest.raises(ValueError):
            make_detector("ks", **bad)


def test_reference_reset_and_latency():
    d = make_detector("ks", reference_size=100, window_size=50, test_every=10)
    for x in normal(3.0):
        d.update(x)
    assert 1200 <= d.drift_indices[0] <= 1300 and d.has_reference
    d.reset()
    assert (d.n_updates, d.drift_indices, d.has_reference, d.drift_detected) == (0, [], False, False)
    d.set_reference(np.random.default_rng(2).normal(0, 1, 500))
    for x in np.random.default_rng(3).normal(3, 1, 200):
        d.update(x)
    assert d.drift_indices[0] <= 100
    with pytest.raises(ValueError):
        d.set_reference([1.0, float("nan")])


@pytest.mark.parametrize("name", sorted(LEARNERS))
def test_learner_protocol_and_exact_resume(name, tmp_path):
    rng = np.random.default_rng(42)
    y = rng.binomial(1, 0.3, 500)
    x = np.stack([rng.normal(0, 1, 500) + 3 * y, rng.normal(0, 1, 500), rng.normal(0, 1, 500)], axis=1)
    m = make_learner(name, features=["a", "b", "c"], class_weights={1: 2.0})
    assert m.n_learned == 0 and 0 <= m.predict_proba_one({"a": 0.0}) <= 1 and isinstance(m.supports_weights, bool)
    rows = [dict(zip("abc", r)) for r in x]
    assert m.learn_one(rows[0], y[0]) is m and m.n_learned == 1
    m.reset()
    m.learn_many(rows[:250], y[:250])
    m.save(str(tmp_path / "m"))
    again = type(m).load(str(tmp_path / "m"))
    m.learn_many(rows[250:], y[250:])
    again.learn_many(rows[250:], y[250:])
    assert m.n_learned == again.n_learned == 500
    assert np.array_equal(m.predict_proba(rows[:50]), again.predict_proba(rows[:50]))
    p = m.predict_proba(rows)
    assert p[y == 1].mean() > p[y == 0].mean() + 0.2
    with pytest.raises(ValueError):
        m.learn_many(rows, y[:3])


def test_soft_vote_weights():
    m = make_learner("vote", 1, members=("logistic", "tree"), dynamic=False)
    assert m.weights.tolist() == [0.5, 0.5]
    m = make_learner("vote", 1, members=("logistic", "tree"), floor=0.3)
    m.learn_one([0.0], 1)
    m.loss = np.array([0.9, 0.2])
    assert m.weights == pytest.approx(np.array([0.3, 0.8]) / 1.1)
    with pytest.raises(ValueError):
        make_learner("vote", 1, members=())
    assert rows_of([{"a": 1, "b": None}], ["a", "b"], drop_nulls=True) == [{"a": 1.0}]
    with pytest.raises(TypeError):
        rows_of("x", ["a"])
    assert balanced_weights([0, 0]) == {0: 1.0, 1: 1.0}


def test_adaptive_tree_follows_a_reversal():
    rng = np.random.default_rng(7)
    m, plain = make_learner("adaptive_tree", 1, grace=50), make_learner("tree", 1, grace=50)
    hits = [0, 0]
    for i in range(6000):
        y = int(rng.random() < 0.5)
        x = [rng.normal(2.0 * (y if i < 3000 else 1 - y), 0.5)]
        if i >= 5000:
            hits = [hits[0] + ((m.predict_one(x) >= 0.5) == y), hits[1] + ((plain.predict_one(x) >= 0.5) == y)]
        m.learn_one(x, y)
        plain.learn_one(x, y)
    assert hits[0] > 900


def test_replay_against_a_loop(spark):
    rows = [(k, i, i % 3, x) for k in ("a", "b", None) for i, x in enumerate(jump(300, seed=len(k or "")))]
    random.Random(1).shuffle(rows)
    got = sorted((r["key"] or "", r["idx"]) for r in replay_detector(spark.createDataFrame(rows, "k string, i long, j long, v double"), "k", ["i", "j"], "v", "page_hinkley").collect())
    want = []
    for k in ("a", "b", None):
        d = make_detector("page_hinkley")
        for x in jump(300, seed=len(k or "")):
            d.update(x)
        want += [(k or "", i) for i in d.drift_indices]
    assert got == sorted(want) and want
    plain = prequential(spark.createDataFrame([(1, i // 100, i, float(x > 0.5), int(x > 0.5)) for i, x in enumerate(normal(0.0, 300))], "k int, p int, i int, x double, y int"), "k", "p", "i", ["x"], "y", "tree")
    assert [(r["period"], r["tn"] + r["fp"] + r["fn"] + r["tp"]) for r in plain.orderBy("period").collect()] == [("0", 100), ("1", 100), ("2", 100)]


@pytest.mark.parametrize("fixed", [True, False])
def test_ks_of_many_values_is_that_of_each(fixed):
    """A reference is held by its distinct values, and only tests look at the window (F5)."""
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.integers(0, 20, 900), rng.integers(4, 24, 900)]).astype(float)
    values[[3, 700, 1799]] = math.nan
    one, many = (make_detector("ks", reference_size=100, window_size=60, test_every=7) for _ in range(2))
    reference = rng.integers(0, 20, 5000).astype(float)
    if fixed:
        one.set_reference(reference)
        many.set_reference(*np.unique(reference, return_counts=True))
        assert len(many.reference) == 20
    hits = [i for i, x in enumerate(values) if one.update(x)]
    found = [a + i for a in range(0, 1800, 250) for i in many.update_many(values[a : a + 250])]
    assert found == hits and hits and many.drift_indices == one.drift_indices
    assert (many.n_updates, list(many.window), many.p_value, many.drift_detected) == (one.n_updates, list(one.window), one.p_value, one.drift_detected)
    points = np.concatenate([np.sort(reference), many.window])
    share = lambda a: np.searchsorted(np.sort(a), points, "right") / len(a)
    many.set_reference(reference)
    many._test()
    assert many.statistic == np.abs(share(reference) - share(np.array(many.window))).max()


@pytest.mark.parametrize("name", ["vote", "logistic", "tree", "boosting"])
def test_score_and_learn(name):
    """One pass over a row gives what scoring and learning it give (F2)."""
    rng = np.random.default_rng(6)
    a, b = make_learner(name, 2), make_learner(name, 2)
    for x in rng.normal(0, 1, (600, 2)):
        y = int(x[0] + x[1] > 0.3)
        p = a.predict_one(x)
        a.learn_one(x, y)
        assert b.score_and_learn(x, y) == p
    assert a.n_learned == b.n_learned == 600
