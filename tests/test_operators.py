import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.functions import exprs, metrics, stats
from tracelens.operators import conflicts, drives, lifecycle, quality, sampling, temporal

EVENTS = "event_id long, collection_id long, instance_index long, time long, type long, machine_id long, priority long, scheduling_class long, cpu_request double, memory_request double"


def events(spark, *rows):
    """rows: (collection, instance, time, type[, machine[, priority]])"""
    return spark.createDataFrame([(i, r[0], r[1], r[2], r[3], r[4] if len(r) > 4 else None, r[5] if len(r) > 5 else 0, 0, 0.5, 0.5) for i, r in enumerate(rows)], EVENTS)


def test_first_attempt_has_no_history(spark):
    ev = events(spark, (1, 1, 10, 0), (1, 1, 20, 3), (1, 1, 30, 5), (1, 1, 40, 3), (1, 1, 50, 6))
    got = {r["sched_seq"]: r for r in lifecycle.with_history(lifecycle.episodes(ev)).collect()}
    assert (got[1]["terminal_type"], got[1]["prior_fail_count"], got[1]["prior_episode_count"]) == (5, 0, 0)
    assert (got[2]["terminal_type"], got[2]["prior_fail_count"], got[2]["prior_episode_count"]) == (6, 1, 1)


def test_instance_summary_counts_lost_as_failed_and_drops_sentinels(spark):
    ev = events(spark, (1, 1, 0, 0), (1, 1, 1_000_000, 0), (1, 1, 3_000_000, 3), (1, 1, 9_000_000, 8), (1, 1, 2**63 - 1, 6))
    r = lifecycle.instance_summary(ev).first()
    assert (r["outcome"], r["fail_lost_count"], r["queue_time_sec"], r["running_duration_sec"], r["total_events"]) == ("FAIL_LOST", 1, 2.0, 6.0, 3)


@pytest.mark.parametrize("gap,found", [(0, 1), (60, 1), (61, None)])
def test_asof_tolerance(spark, gap, found):
    left = spark.createDataFrame([(1, 100, "a")], "m long, t long, x string")
    right = spark.createDataFrame([(1, 100 + gap, 1), (1, 99, 9), (2, 100, 8)], "m long, t long, v int")
    assert temporal.asof_forward(left, right, ["m"], "t", ["v"], 60).first()["v"] == found


def test_counts_before_leaves_out_equal_times(spark):
    h = spark.createDataFrame([(1, 5), (1, 10), (1, 10), (2, 1)], "k long, t long")
    q = spark.createDataFrame([(1, 10), (1, 11), (1, 10), (3, 9)], "k long, t long")
    got = {(r["k"], r["t"]): r["n"] for r in temporal.counts_before(h, q, ["k"], "t", {"n": F.lit(True)}).collect()}
    assert got == {(1, 10): 1, (1, 11): 3, (3, 9): 0}


def test_interval_is_half_open(spark):
    p = spark.createDataFrame([(1, 10), (1, 20), (1, 99)], "k long, t long")
    i = spark.createDataFrame([(1, 10, 20, "a"), (1, 20, None, "b")], "k long, lo long, hi long, n string")
    got = sorted((r["t"], r["n"]) for r in temporal.in_intervals(p, i, ["k"], "t", "lo", "hi").collect())
    assert got == [(10, "a"), (20, "b"), (99, "b")]


def test_residency_is_cut_and_gaps_have_no_next(spark):
    stay = spark.createDataFrame([(1, 0, 10_000)], "k long, lo long, hi long")
    assert temporal.bins(stay, "lo", "hi", 10, 288).count() == 289
    g = spark.createDataFrame([(1, 1, 5), (1, 3, 7), (1, 4, 8)], "k long, w long, v int")
    assert {r["w"]: r["next_v"] for r in temporal.next_window(g, ["k"], "w", ["v"]).collect()} == {1: None, 3: 8, 4: None}


@pytest.mark.parametrize("gap,n", [(0, 1), (60_000_000, 1), (60_000_001, 0)])
def test_priority_inversion_window(spark, gap, n):
    ev = events(spark, (1, 1, 100, 4, 7, 300), (2, 1, 100 + gap, 3, 7, 100), (3, 1, 100, 4, None, 300))
    assert conflicts.priority_inversion(ev).count() == n


def test_pooled_has_nulls_for_other_features(spark):
    ev = events(spark, (1, 1, 100, 4, 7, 300), (2, 1, 100, 3, 7, 100))
    both = conflicts.pooled(conflicts.priority_inversion(ev), conflicts.scheduling_violations(ev, least=1))
    assert {"priority_gap", "evict_ratio", "conflict_id"} <= set(both.columns)


def drive(spark):
    start = dt.date(2020, 1, 1)
    return spark.createDataFrame([(1, start + dt.timedelta(i), "m", 10**12, int(i == 5), v, None, v, "early") for i, v in enumerate([0, 0, 4, 8, 16, 32])], "serial_number long, date date, model string, capacity_bytes long, failure int, smart_5_raw long, smart_187_raw long, smart_197_raw long, era string")


def test_drive_features(spark):
    t1 = drives.tier1(drive(spark), ("smart_5_raw",), (3,)).orderBy("date").collect()
    assert [r["smart_5_raw_any_3"] for r in t1] == [0, 0, 1, 1, 1, 1]
    assert [r["smart_5_raw_days_since"] for r in t1] == [None, None, 0, 1, 2, 3]
    t2 = drives.tier2(drive(spark), rows=(3,)).orderBy("date").collect()
    assert t2[-1]["smart_197_raw_mean_3"] == pytest.approx(56 / 3)
    assert [r["smart_197_raw_delta_1"] for r in t2] == [None, 0, 4, 4, 8, 16]
    assert [r["failure_within_7d"] for r in drives.targets(drive(spark), (7,)).collect()] == [1] * 6


def test_labels_and_bands(spark):
    d = spark.createDataFrame([(100, 4), (120, 4), (359, 4), (360, 4), (0, 5), (0, 6), (None, 8), (0, 3)], "p long, t long")
    got = d.select(exprs.failure_label(F.col("t")).alias("a"), exprs.failure_label(F.col("t"), F.col("p"), "sensitivity").alias("b"), exprs.priority_band(F.col("p")).alias("c")).collect()
    assert [r["a"] for r in got] == [None, None, None, None, 1, 0, 1, None]
    assert [r["b"] for r in got] == [None, 1, 1, None, 1, 0, 1, None]
    assert got[0]["c"] == "best_effort" and got[6]["c"] == "unknown" and got[3]["c"] == "monitoring"
    with pytest.raises(ValueError):
        exprs.failure_label(F.col("t"), None, "other")


def test_negative_cap_keeps_positives(spark):
    d = spark.createDataFrame([("A", i, int(i == 0)) for i in range(9)] + [("B", 100, 1), ("B", 101, 0)], "e string, id long, y int")
    got = sampling.cap_negatives(d, ["e"], ["id"], "y", 5)
    assert got.where("y = 1").count() == 2 and got.where("e = 'A' and y = 0").count() == 5


def test_split_keeps_entities_whole(spark):
    d = spark.range(2000).withColumn("e", F.col("id") % 100)
    s = sampling.group_split(d, F.col("e"))
    assert s.groupBy("e").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty()
    quality.disjoint(s.where("split = 'train'"), s.where("split = 'test'"), ["e"])


def test_assertions(spark):
    d = spark.createDataFrame([(1, None), (0, 2.0), (0, 3.0), (0, 4.0)], "y int, x double")
    assert quality.class_balance(d, "y", 0.25, 0.01) == 0.25
    assert quality.null_rate(d, "x", 0.25, 0.0) == 0.25
    for bad in (lambda: quality.row_count(d, 5, 9), lambda: quality.one_row_per(d, ["y"]), lambda: quality.null_rate(d.limit(0), "x", 0, 1), lambda: quality.class_balance(d, "y", 0.5, 0.1)):
        with pytest.raises(quality.AssertionFailed):
            bad()
    log = quality.CheckLog()
    log.record("a", 1, 2, False)
    with pytest.raises(quality.AssertionFailed):
        log.require()


def test_metrics_against_numpy(spark):
    r = random.Random(1)
    rows = [(int(r.random() < 0.3), round(r.random(), 2)) for _ in range(500)]
    got = metrics.ranking(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    y, s = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
    wins = np.mean([[1.0 if a > b else 0.5 if a == b else 0.0 for b in s[y == 0]] for a in s[y == 1]])
    assert got["roc_auc"] == pytest.approx(wins)
    assert got["brier"] == pytest.approx(((s - y) ** 2).mean())
    best = metrics.best_threshold(spark.createDataFrame(rows, "y int, s double"), "y", "s", [0.2, 0.5, 0.8]).first()
    assert best["mcc"] == pytest.approx(max(stats.mcc(y, (s >= t).astype(int)) for t in (0.2, 0.5, 0.8)))


def test_statistics():
    assert stats.wilcoxon([1, 2, 3], [1, 2, 3]) == (0.0, 1.0)
    assert stats.wilcoxon(np.arange(1, 9), np.zeros(8))[1] == pytest.approx(2 / 256)
    with pytest.raises(ValueError):
        stats.wilcoxon([1], [1, 2])
    assert np.isnan(stats.stratified_bootstrap(stats.mcc, [1, 1], [1, 0], 5)).all()
    assert stats.mcc([0, 0], [0, 0]) == 0.0
    assert stats.sustainment([0.9, 0.9, 0.5], 0.9, 0.1) == 2
    assert stats.interval_test(0.51, 0.6, 0.5) and not stats.interval_test(0.5, 0.6, 0.5)
    assert stats.tail_p(0.6, 0.55, 0.65, 0.5) < 0.001
