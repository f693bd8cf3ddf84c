"""The queries that SQL can't express, against plain versions over collected rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.functions import stats
from tracelens.plans import q_library
from tracelens.plans.catalog import QUERIES
from tracelens.sources.tables import drive_days, predictions
from tracelens.streaming.detectors import make_detector
from tracelens.streaming.online import make_learner


def test_adwin_replay(spark, sf_dir):
    got = sorted((r["key"], r["idx"]) for r in QUERIES["str_06_adwin_replay"](spark, sf_dir).collect())
    want = []
    rows = q_library._shifted(spark, sf_dir).select("machine_id", "time", "event_id", "loss").collect()
    for key in {r["machine_id"] for r in rows}:
        d = make_detector("adwin")
        for r in sorted((r for r in rows if r["machine_id"] == key), key=lambda r: (r["time"], r["event_id"])):
            d.update(r["loss"])
        want += [(str(key), i) for i in d.drift_indices]
    assert got == sorted(want) and got  # the rate jumps, so there are drifts


def test_prequential(spark, sf_dir):
    got = {(r["key"], r["period"]): (r["tn"], r["fp"], r["fn"], r["tp"], r["drifts"]) for r in QUERIES["str_05_prequential"](spark, sf_dir).collect()}
    want = {}
    rows = sorted(((r["day"].strftime("%Y-%m"), r["day"], r["id"], r["entity"] % 4, r["y_score"], float(r["id"] % 7), r["y_true"]) for r in predictions(spark, sf_dir).collect()))
    for key in range(4):
        m, d = make_learner("vote", 2), make_detector("page_hinkley")
        for month, _, _, k, a, b, y in rows:
            if k != key:
                continue
            n = want.setdefault((str(key), month), [0] * 5)
            hit = int(m.predict_one([a, b]) >= 0.5)
            n[2 * y + hit] += 1
            n[4] += d.update(float(hit != y))
            m.learn_one([a, b], y)
    assert got == {k: tuple(v) for k, v in want.items()}


def test_covariate_scan(spark, sf_dir):
    got = {r["feature"]: (r["n_drifts"], r["first_drift"], r["latency_days"]) for r in QUERIES["str_12_covariate_scan"](spark, sf_dir).collect()}
    rows = sorted((r["date"], r["serial_number"], float(r["smart_197_raw"])) for r in drive_days(spark, sf_dir).collect())
    onset = dt.date(1998, 1, 1)
    for feature, shift in (("smart_197_raw", 0.0), ("shifted", 30.0)):
        values = sorted((t, i, v + (shift if t >= onset else 0.0)) for t, i, v in rows)
        d = make_detector("ks", window_size=200, test_every=50)
        d.set_reference([v for t, _, v in values if t <= dt.date(1995, 12, 31)])
        hits = [t for t, _, v in values if t > dt.date(1995, 12, 31) and d.update(v)]
        assert got[feature] == (len(hits), hits[0] if hits else None, (hits[0] - onset).days if hits else None)
    assert got["shifted"][0] > got["smart_197_raw"][0]


def test_calibration_lowers_the_brier_score(spark, sf_dir):
    got = QUERIES["mod_15_calibrated"](spark, sf_dir).collect()
    rows = [r for r in predictions(spark, sf_dir).collect() if r["id"] % 2 == 1]
    assert sorted(r["id"] for r in got) == sorted(r["id"] for r in rows) and all(0 <= r["calibrated"] <= 1 for r in got)
    y, raw, new = (np.array([r[c] for r in got], float) for c in ("y_true", "y_score", "calibrated"))
    assert stats.brier(y, new) < stats.brier(y, raw)
    order = np.argsort(raw, kind="stable")
    assert (np.diff(new[order]) >= -1e-9).all()  # both kinds keep the order


def test_forest_metrics(spark, sf_dir, monkeypatch):
    """The query's one row against metrics of the collected scores, with a small forest."""
    from tracelens.models import batch

    kept, fit = [], batch.fit_model
    monkeypatch.setattr(batch, "fit_model", lambda *a, **kw: kept.append(fit(*a, **{**kw, "num_trees": 5})) or kept[-1])
    r = QUERIES["mod_02_forest"](spark, sf_dir).first()
    pr = predictions(spark, sf_dir).withColumn("x2", F.col("y_score") * F.col("entity"))
    from tracelens.functions.exprs import hash_bucket

    rows = kept[0].score(pr.where(hash_bucket(F.col("entity"), 10) >= 7)).collect()
    y, s = np.array([x["y_true"] for x in rows]), np.array([x["score"] for x in rows])
    assert r["mcc"] == pytest.approx(stats.mcc(y, (s >= 0.5).astype(int))) and r["roc_auc"] == pytest.approx(stats.roc_auc(y, s))
    assert r["pr_auc"] == pytest.approx(stats.average_precision(y, s)) and r["brier"] == pytest.approx(stats.brier(y, s))


def test_soft_vote_query(spark, sf_dir):
    got = QUERIES["mod_07_soft_vote"](spark, sf_dir)
    assert got.where("in_range <> 1").isEmpty() and got.count() > 0
