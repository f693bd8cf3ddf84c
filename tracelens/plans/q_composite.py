"""Queries over the library's composite operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.functions import exprs, metrics
from tracelens.operators import conflicts, drives, lifecycle, quality, sampling, temporal
from tracelens.plans.registry import query
from tracelens.sources.tables import drive_days, instance_events, instance_usage, machine_events, predictions

K = ["collection_id", "instance_index"]
HOUR = 3_600_000_000
DAY_US = 24 * HOUR
EPISODES = """ev AS (SELECT *, sum(CASE WHEN type = 3 THEN 1 ELSE 0 END) OVER w AS sched_seq, max(CASE WHEN type = 0 THEN time END) OVER w AS running_last_submit FROM ie
    WINDOW w AS (PARTITION BY collection_id, instance_index ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ep AS (SELECT collection_id, instance_index, CAST(sched_seq AS BIGINT) AS sched_seq, min(CASE WHEN type = 3 THEN time END) AS schedule_time, min(CASE WHEN type = 3 THEN machine_id END) AS scheduled_machine_id,
    min(CASE WHEN type = 3 THEN running_last_submit END) AS attempt_submit_time, arg_min(type, time) FILTER (WHERE type IN (4, 5, 6, 7, 8)) AS terminal_type,
    count(*) FILTER (WHERE type IN (4, 5, 6, 7, 8)) AS n_terminal_events FROM ev WHERE sched_seq >= 1 GROUP BY 1, 2, 3)"""


def rounded(df, *columns, places=6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query(f"WITH {EPISODES} SELECT * FROM ep")
def agg_20_episodes(spark, sf_dir):
    return lifecycle.episodes(instance_events(spark, sf_dir))


@query(f"""WITH {EPISODES} SELECT *, count(*) OVER w AS prior_episode_count, CAST(coalesce(sum(CASE WHEN terminal_type IN (5, 8) THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS prior_fail_count,
    CAST(coalesce(sum(CASE WHEN terminal_type = 6 THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS prior_finish_count, CAST(coalesce(sum(CASE WHEN terminal_type = 4 THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS prior_evict_count
    FROM ep WINDOW w AS (PARTITION BY collection_id, instance_index ORDER BY sched_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def win_03_strictly_prior(spark, sf_dir):
    return lifecycle.with_history(lifecycle.episodes(instance_events(spark, sf_dir)))


@query("""SELECT event_id, CAST(sum(CASE WHEN type = 3 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS sched_seq, max(CASE WHEN type = 0 THEN time END) OVER w AS last_submit FROM ie
    WINDOW w AS (PARTITION BY collection_id, instance_index ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def win_01_marker_sessions(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy(*K).orderBy("time", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return instance_events(spark, sf_dir).select("event_id", F.sum((F.col("type") == 3).cast("long")).over(w).alias("sched_seq"), F.max(F.when(F.col("type") == 0, F.col("time"))).over(w).alias("last_submit"))


@query(f"WITH {EPISODES} SELECT collection_id, instance_index, sched_seq, schedule_time, lead(schedule_time) OVER (PARTITION BY collection_id, instance_index ORDER BY sched_seq) AS next_schedule_time FROM ep")
def win_04_schedule_intervals(spark, sf_dir):
    return lifecycle.schedule_intervals(lifecycle.episodes(instance_events(spark, sf_dir)))


_USAGE = f"""WITH {EPISODES}, iv AS (SELECT collection_id, instance_index, sched_seq, schedule_time, lead(schedule_time) OVER (PARTITION BY collection_id, instance_index ORDER BY sched_seq) AS next_schedule_time FROM ep),
  u AS (SELECT us.*, sched_seq, (start_time - schedule_time) / 1000000 AS sec FROM us JOIN iv USING (collection_id, instance_index)
    WHERE start_time >= schedule_time AND (next_schedule_time IS NULL OR start_time < next_schedule_time) AND start_time <= schedule_time + {24 * HOUR})"""


def _episode_usage(spark, sf_dir):
    iv = lifecycle.schedule_intervals(lifecycle.episodes(instance_events(spark, sf_dir)))
    return lifecycle.usage_in_episodes(instance_usage(spark, sf_dir), iv, 24 * HOUR)


@query(_USAGE + " SELECT event_id, sched_seq, CAST(round(sec * 1000000) AS BIGINT) AS since FROM u")
def joi_14_interval_containment(spark, sf_dir):
    return _episode_usage(spark, sf_dir).select("event_id", "sched_seq", F.round(F.col("sec") * 1_000_000).cast("long").alias("since"))


@query(f"""WITH {EPISODES}, iv AS (SELECT *, lead(schedule_time) OVER (PARTITION BY collection_id, instance_index ORDER BY sched_seq) AS nxt FROM ep)
SELECT iv.collection_id, iv.instance_index, iv.sched_seq, min(e.time) AS first_terminal FROM iv JOIN ie e ON e.collection_id = iv.collection_id AND e.instance_index = iv.instance_index AND e.time >= iv.schedule_time AND (iv.nxt IS NULL OR e.time < iv.nxt)
WHERE e.type IN (4, 5, 6, 7, 8) GROUP BY 1, 2, 3""")
def joi_15_first_terminal(spark, sf_dir):
    ev = instance_events(spark, sf_dir)
    iv = lifecycle.schedule_intervals(lifecycle.episodes(ev))
    ends = ev.where(F.col("type").isin(4, 5, 6, 7, 8)).select(*K, "time")
    return temporal.in_intervals(ends, iv, K, "time", "schedule_time", "next_schedule_time").groupBy(*K, "sched_seq").agg(F.min("time").alias("first_terminal"))


@query(_USAGE + """, r AS (SELECT *, row_number() OVER w AS rn, avg(avg_cpu) OVER (PARTITION BY collection_id, instance_index, sched_seq ORDER BY sec, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS smooth,
    lag(avg_cpu) OVER w AS pc, lag(avg_memory) OVER w AS pm FROM u WINDOW w AS (PARTITION BY collection_id, instance_index, sched_seq ORDER BY sec, event_id))
SELECT collection_id, instance_index, sched_seq, round(covar_pop(CASE WHEN sec <= 40000 THEN avg_cpu END, CASE WHEN sec <= 40000 THEN sec END) / nullif(var_pop(CASE WHEN sec <= 40000 THEN sec END), 0) * 1000, 4) AS cpu_slope,
    round(max(CASE WHEN rn = 2 THEN avg_cpu - pc END), 6) AS initial_cpu_ramp, round(max(CASE WHEN rn = 2 THEN avg_memory - pm END), 6) AS initial_memory_ramp,
    max(CASE WHEN rn = 1 THEN cycles_per_instruction END) AS cpi_value, round(max(CASE WHEN rn = 1 THEN smooth END) / nullif(max(rq.cpu_request), 0), 6) AS first_interval_util_ratio
FROM r JOIN (SELECT collection_id, instance_index, max(cpu_request) AS cpu_request FROM ie GROUP BY 1, 2) rq USING (collection_id, instance_index) GROUP BY 1, 2, 3""")
def agg_16_early_runtime(spark, sf_dir):
    rq = instance_events(spark, sf_dir).groupBy(*K).agg(F.max("cpu_request").alias("cpu_request"))
    f = lifecycle.runtime_features(_episode_usage(spark, sf_dir), [*K, "sched_seq"], (40_000,), rq)
    return f.select(*K, "sched_seq", F.round(F.col("cpu_slope_40000s") * 1000, 4).alias("cpu_slope"), F.round("initial_cpu_ramp", 6).alias("initial_cpu_ramp"), F.round("initial_memory_ramp", 6).alias("initial_memory_ramp"), "cpi_value", F.round("first_interval_util_ratio", 6).alias("first_interval_util_ratio"))


@query(_USAGE + """ SELECT collection_id, instance_index, sched_seq, round(avg(CASE WHEN sec BETWEEN 0 AND 20000 THEN avg_cpu END), 6) AS cpu_mean, max(CASE WHEN sec BETWEEN 0 AND 20000 THEN avg_cpu END) AS cpu_max,
    round(stddev_samp(CASE WHEN sec BETWEEN 0 AND 60000 THEN avg_memory END), 6) AS memory_std FROM u GROUP BY 1, 2, 3""")
def agg_17_windowed(spark, sf_dir):
    w = lifecycle.utilization_windows(_episode_usage(spark, sf_dir), [*K, "sched_seq"], (20_000, 60_000))
    return w.select(*K, "sched_seq", F.round("cpu_mean_20000s", 6).alias("cpu_mean"), F.col("cpu_max_20000s").alias("cpu_max"), F.round("memory_std_60000s", 6).alias("memory_std"))


@query("""SELECT collection_id, instance_index, count(*) AS total_events, count(*) FILTER (WHERE type = 0) AS submit_count, min(CASE WHEN type = 0 THEN time END) AS submit_time, max(CASE WHEN type = 3 THEN time END) AS last_schedule_time,
    arg_max(type, time) AS terminal_type, arg_min(priority, time) AS submit_priority, greatest(count(*) FILTER (WHERE type = 0) - 1, 0) AS resubmission_count, round((max(time) - min(CASE WHEN type = 0 THEN time END)) / 1000000, 3) AS total_lifecycle_sec,
    CASE WHEN arg_max(type, time) IN (5, 8) THEN 'FAIL_LOST' WHEN arg_max(type, time) = 6 THEN 'FINISH' WHEN arg_max(type, time) = 4 AND arg_max(priority, time) >= 360 THEN 'EVICT_MONITORING'
      WHEN arg_max(type, time) = 4 AND arg_max(priority, time) >= 120 THEN 'EVICT_PRODUCTION' WHEN arg_max(type, time) = 4 THEN 'EVICT_LOWER' WHEN arg_max(type, time) = 7 THEN 'KILL' ELSE 'OTHER' END AS outcome FROM ie GROUP BY 1, 2""")
def agg_18_instance_summary(spark, sf_dir):
    s = lifecycle.instance_summary(instance_events(spark, sf_dir))
    return s.select(*K, "total_events", "submit_count", "submit_time", "last_schedule_time", "terminal_type", "submit_priority", "resubmission_count", F.round("total_lifecycle_sec", 3).alias("total_lifecycle_sec"), "outcome")


@query(f"""SELECT e.event_id, e.machine_id, e.time, CASE WHEN r.time - e.time <= {HOUR} THEN r.priority END AS replacing_priority
FROM (SELECT * FROM ie WHERE type = 4) e ASOF LEFT JOIN (SELECT * FROM ie WHERE type = 3) r ON e.machine_id = r.machine_id AND e.time <= r.time""")
def joi_16_asof_forward(spark, sf_dir):
    ev = instance_events(spark, sf_dir)
    left = ev.where("type = 4").select("event_id", "machine_id", "time")
    right = ev.where("type = 3").select("machine_id", "time", F.col("priority").alias("replacing_priority"))
    return temporal.asof_forward(left, right, ["machine_id"], "time", ["replacing_priority"], HOUR)


@query("""SELECT collection_id, instance_index, time, (SELECT count(*) FROM ie h WHERE h.collection_id = q.collection_id AND h.instance_index = q.instance_index AND h.time < q.time AND h.type = 5) AS prior_fail
FROM (SELECT DISTINCT collection_id, instance_index, time FROM ie WHERE type = 4) q""")
def joi_17_counts_before(spark, sf_dir):
    ev = instance_events(spark, sf_dir)
    return temporal.counts_before(ev, ev.where("type = 4"), K, "time", {"prior_fail": F.col("type") == 5})


@query(f"""SELECT collection_id, instance_index, unnest(range(lo, least(hi, lo + 288) + 1)) AS "window" FROM (SELECT collection_id, instance_index, CAST(floor(min(time) / {HOUR}) AS BIGINT) AS lo, CAST(floor(max(time) / {HOUR}) AS BIGINT) AS hi FROM ie GROUP BY 1, 2)""")
def joi_18_interval_bins(spark, sf_dir):
    stay = instance_events(spark, sf_dir).groupBy(*K).agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    return temporal.bins(stay, "lo", "hi", HOUR, 288).select(*K, "window")


@query(f"""WITH g AS (SELECT collection_id, CAST(floor(time / {HOUR}) AS BIGINT) AS "window", count(*) AS n FROM ie GROUP BY 1, 2)
SELECT a.collection_id, a."window", a.n, b.n AS next_n FROM g a LEFT JOIN g b ON b.collection_id = a.collection_id AND b."window" = a."window" + 1""")
def joi_19_next_window(spark, sf_dir):
    g = instance_events(spark, sf_dir).groupBy("collection_id", F.floor(F.col("time") / HOUR).alias("window")).agg(F.count("*").alias("n"))
    return temporal.next_window(g, ["collection_id"], "window", ["n"])


_INST = "inst AS (SELECT collection_id, instance_index, max(cpu_request) AS cpu_request, max(memory_request) AS memory_request, arg_min(priority, time) AS submit_priority, max(CASE WHEN type IN (5, 8) THEN 1 ELSE 0 END) AS failed, max(CASE WHEN type IN (4, 5, 6, 7, 8) THEN 1 ELSE 0 END) AS has_terminal FROM ie GROUP BY 1, 2)"


_SV = f"""g AS (SELECT collection_id, CAST(floor(time / {6 * HOUR}) AS BIGINT) AS w, count(*) FILTER (WHERE type = 3) AS n_schedule, count(*) FILTER (WHERE type = 4) AS n_evict, count(*) FILTER (WHERE type IN (5, 8)) AS n_fail FROM ie GROUP BY 1, 2),
 x AS (SELECT *, n_evict / greatest(n_schedule, 1) AS er, n_fail / greatest(n_schedule, 1) AS fr FROM g)"""


@query(f"""WITH {_SV} SELECT 'sv_' || a.collection_id || '_' || a.w AS conflict_id, a.n_schedule, a.n_evict, a.n_fail, round(a.er, 6) AS evict_ratio, round(a.fr, 6) AS fail_ratio,
 (SELECT count(*) FROM ie h WHERE h.collection_id = a.collection_id AND h.time < a.w * {6 * HOUR} AND h.type IN (5, 8)) AS coll_prior_fail,
 CAST(coalesce(b.er, 0) <= 0.5 AND coalesce(b.fr, 0) <= 0.25 AS INTEGER) AS resolution_outcome
FROM x a LEFT JOIN x b ON b.collection_id = a.collection_id AND b.w = a.w + 1 WHERE a.n_schedule >= 2 AND (a.er > 0.5 OR a.fr > 0.25)""")
def lbl_03_scheduling_violation(spark, sf_dir):
    v = conflicts.scheduling_violations(instance_events(spark, sf_dir), 6 * HOUR, 2)
    return rounded(v, "evict_ratio", "fail_ratio").select("conflict_id", "n_schedule", "n_evict", "n_fail", "evict_ratio", "fail_ratio", "coll_prior_fail", "resolution_outcome")


_MD5 = "CAST(('0x' || substr(md5({}), 1, 8)) AS BIGINT)"


@query(f"SELECT event_id FROM ie WHERE {_MD5.format('CAST(event_id AS VARCHAR)')} % 100 < 10")
def smp_01_bucket_sample(spark, sf_dir):
    return sampling.bucket_sample(instance_events(spark, sf_dir), F.col("event_id"), 100, 10).select("event_id")


@query(f"SELECT event_id, CASE WHEN b < 14 THEN 'train' WHEN b < 17 THEN 'val' ELSE 'test' END AS split FROM (SELECT event_id, {_MD5.format(chr(39) + 'c_' + chr(39) + ' || collection_id')} % 20 AS b FROM ie)")
def smp_03_group_split(spark, sf_dir):
    return sampling.group_split(instance_events(spark, sf_dir), F.concat(F.lit("c_"), F.col("collection_id").cast("string"))).select("event_id", "split")


@query(f"SELECT event_id, CAST(({_MD5.format('CAST(collection_id AS VARCHAR)')} % 1000000) / 1000000 < 0.3 AS INTEGER) AS is_test FROM ie")
def smp_04_unit_split(spark, sf_dir):
    return sampling.test_split(instance_events(spark, sf_dir), F.col("collection_id"), 0.3).select("event_id", "is_test")


@query(f"""SELECT event_id FROM (SELECT event_id, label, row_number() OVER (PARTITION BY collection_id, instance_index, label ORDER BY {_MD5.format('CAST(event_id AS VARCHAR)')} % 2147483648, event_id) AS r
FROM (SELECT *, CASE WHEN type = 5 THEN 1 ELSE 0 END AS label FROM ie)) WHERE label = 1 OR r <= 5""")
def smp_05_negative_cap(spark, sf_dir):
    ev = instance_events(spark, sf_dir).withColumn("label", (F.col("type") == 5).cast("int"))
    return sampling.cap_negatives(ev, K, ["event_id"], "label", 5).select("event_id")


@query(f"""WITH g AS (SELECT l_suppkey AS k, l_suppkey % 4 AS stratum, count(*) AS n, max(CASE WHEN l_returnflag = 'R' AND l_quantity = 50 AND l_linenumber = 7 THEN 1 ELSE 0 END) = 1 AS failed FROM lineitem GROUP BY 1)
SELECT k FROM g WHERE failed UNION ALL SELECT k FROM (SELECT k, sum(n) OVER (PARTITION BY stratum ORDER BY {_MD5.format('CAST(k AS VARCHAR)')} % 2147483648, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(n) OVER (PARTITION BY stratum) AS total FROM g WHERE NOT failed) WHERE run <= total * 0.4""")
def smp_06_working_set(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    bad = (F.col("l_returnflag") == "R") & (F.col("l_quantity") == 50) & (F.col("l_linenumber") == 7)
    g = li.groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"), F.bool_or(bad).alias("failed")).withColumn("stratum", F.col("k") % 4)
    return sampling.working_set(g, "k", ["stratum"], "n", "failed", 0.4)


@query("WITH b AS (SELECT min(time) AS lo, max(time) AS hi FROM ie) SELECT event_id, CAST(floor(floor((time - lo) / 86400000000) * 5 / (floor((hi - lo) / 86400000000) + 1)) AS BIGINT) AS fold FROM ie CROSS JOIN b")
def smp_15_day_folds(spark, sf_dir):
    return sampling.day_folds(instance_events(spark, sf_dir), "time", 24 * HOUR, 5).select("event_id", "fold")


_DW = "(PARTITION BY serial_number ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query(f"""SELECT serial_number, date, max(CASE WHEN smart_5_raw > 0 THEN 1 ELSE 0 END) OVER {_DW.format(6)} AS smart_5_raw_any_7, max(CASE WHEN smart_5_raw > 0 THEN 1 ELSE 0 END) OVER {_DW.format(29)} AS smart_5_raw_any_30,
 CASE WHEN date >= f THEN CAST(date - f AS INTEGER) END AS smart_5_raw_days_since, capacity_bytes / 1e12 AS capacity_tb FROM (SELECT *, min(CASE WHEN smart_5_raw > 0 THEN date END) OVER (PARTITION BY serial_number) AS f FROM dd)""")
def smf_01_tier1(spark, sf_dir):
    return drives.tier1(drive_days(spark, sf_dir), ("smart_5_raw",), (7, 30)).select("serial_number", "date", "smart_5_raw_any_7", "smart_5_raw_any_30", "smart_5_raw_days_since", "capacity_tb")


@query(f"""SELECT serial_number, date, round(avg(smart_197_raw) OVER {_DW.format(6)}, 6) AS mean_7, round(stddev_samp(smart_197_raw) OVER {_DW.format(6)}, 6) AS std_7, round(quantile_cont(smart_197_raw, 0.95) OVER {_DW.format(6)}, 6) AS p95_7,
 smart_197_raw - lag(smart_197_raw, 1) OVER w AS delta_1, smart_197_raw - lag(smart_197_raw, 7) OVER w AS delta_7 FROM dd WINDOW w AS (PARTITION BY serial_number ORDER BY date)""")
def smf_02_tier2(spark, sf_dir):
    t = drives.tier2(drive_days(spark, sf_dir), rows=(7,))
    c = "smart_197_raw"
    return t.select("serial_number", "date", F.round(f"{c}_mean_7", 6).alias("mean_7"), F.round(f"{c}_std_7", 6).alias("std_7"), F.round(f"{c}_p95_7", 6).alias("p95_7"), F.col(f"{c}_delta_1").alias("delta_1"), F.col(f"{c}_delta_7").alias("delta_7"))


@query("""SELECT serial_number, date, vals[CAST(round(0.95 * (len(vals) - 1)) AS INTEGER) + 1] AS near95 FROM (SELECT serial_number, date, list_sort(list(smart_197_raw) OVER (PARTITION BY serial_number ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) AS vals FROM dd)""")
def win_15_rolling_nearest(spark, sf_dir):
    return drive_days(spark, sf_dir).select("serial_number", "date", drives.rolling_nearest("smart_197_raw", 0.95, 7).alias("near95"))


@query(f"""SELECT serial_number, date, CAST(date - min(date) OVER (PARTITION BY serial_number) AS INTEGER) AS drive_age_days, CAST(date - min(date) OVER (PARTITION BY model) AS INTEGER) AS fleet_age_days, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
 CAST(isodow(date) - 1 AS INTEGER) AS weekday, CAST(era = 'middle' AS INTEGER) AS available, round(CASE WHEN era = 'middle' THEN avg(smart_187_raw) OVER {_DW.format(6)} END, 6) AS mean_7 FROM dd""")
def smf_03_tier3(spark, sf_dir):
    t = drives.tier3(drive_days(spark, sf_dir), {"smart_187_raw": ("middle",)})
    return t.select("serial_number", "date", "drive_age_days", "fleet_age_days", "month", "quarter", "weekday", F.col("smart_187_raw_available").alias("available"), F.round("smart_187_raw_mean_7", 6).alias("mean_7"))


@query("""SELECT serial_number, date, CAST(coalesce(f - date BETWEEN 0 AND 7, false) AS INTEGER) AS failure_within_7d, CAST(coalesce(f - date BETWEEN 0 AND 14, false) AS INTEGER) AS failure_within_14d, CAST(coalesce(f - date BETWEEN 0 AND 30, false) AS INTEGER) AS failure_within_30d
FROM (SELECT *, max(CASE WHEN failure = 1 THEN date END) OVER (PARTITION BY serial_number) AS f FROM dd)""")
def smf_04_targets(spark, sf_dir):
    return drives.targets(drive_days(spark, sf_dir)).select("serial_number", "date", "failure_within_7d", "failure_within_14d", "failure_within_30d")


@query("SELECT serial_number, date, max(date) OVER w AS last_obs, max(failure) OVER w AS failure_observed, 1 - max(failure) OVER w AS censored FROM dd WINDOW w AS (PARTITION BY serial_number)")
def smf_05_censoring(spark, sf_dir):
    return drives.censoring(drive_days(spark, sf_dir)).select("serial_number", "date", "last_obs", "failure_observed", "censored")


_CONF = "SELECT entity, count(*) FILTER (WHERE y_true = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y_true = 0 AND p = 1) AS fp, count(*) FILTER (WHERE y_true = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y_true = 1 AND p = 1) AS tp FROM (SELECT *, CAST(y_score >= 0.5 AS INTEGER) AS p FROM pr) GROUP BY 1"


@query(f"""SELECT *, round(coalesce((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc, round(coalesce(2 * tp / nullif((2 * tp + fp + fn)::DOUBLE, 0), 0), 6) AS f1 FROM ({_CONF})""")
def met_01_confusion(spark, sf_dir):
    return rounded(metrics.scores(predictions(spark, sf_dir).withColumn("p", (F.col("y_score") >= 0.5).cast("int")), "y_true", "p", ["entity"]), "mcc", "f1")


@query("""WITH g AS (SELECT y_score AS s, sum(y_true)::DOUBLE AS p, count(*)::DOUBLE AS n FROM pr GROUP BY 1), c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT round(sum(p * cp / cn) / sum(p), 6) AS pr_auc, round(sum((n - p) * (cp - p / 2)) / (sum(p) * (sum(n) - sum(p))), 6) AS roc_auc, (SELECT round(avg((y_score - y_true) * (y_score - y_true)), 6) FROM pr) AS brier FROM c""")
def met_03_ranking(spark, sf_dir):
    return rounded(metrics.ranking(predictions(spark, sf_dir), "y_true", "y_score"), "pr_auc", "roc_auc", "brier")


@query("""SELECT b AS bin, coalesce(n, 0) AS n, mean_score, rate FROM (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS b) LEFT JOIN (SELECT CAST(least(floor(y_score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(y_score), 6) AS mean_score, round(avg(y_true), 6) AS rate FROM pr GROUP BY 1) ON b = bin""")
def met_11_calibration(spark, sf_dir):
    return rounded(metrics.calibration(predictions(spark, sf_dir), "y_true", "y_score"), "mean_score", "rate")


_P = "SELECT s_suppkey AS id, (s_suppkey * 37 % 101 + 1) / 2000 AS p FROM supplier"


def _family(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(F.col("s_suppkey").alias("id"), ((F.col("s_suppkey") * 37 % 101 + 1) / 2000).alias("p"))


@query(f"WITH f AS ({_P}), a AS (SELECT id, p, least(max(((SELECT count(*) FROM f) - i) * p) OVER (ORDER BY p, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS adj FROM (SELECT *, row_number() OVER (ORDER BY p, id) - 1 AS i FROM f)) SELECT id, p, round(adj, 9) AS p_adjusted, CAST(adj < 0.05 AS INTEGER) AS reject FROM a")
def hyp_04_holm(spark, sf_dir):
    return rounded(metrics.holm(_family(spark, sf_dir), "p"), "p_adjusted", places=9)


@query(f"WITH f AS ({_P}), a AS (SELECT id, p, least(min((SELECT count(*) FROM f)::DOUBLE * p / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS adj FROM (SELECT *, row_number() OVER (ORDER BY p, id) AS i FROM f)) SELECT id, p, round(adj, 9) AS p_adjusted, CAST(adj <= 0.05 AS INTEGER) AS reject FROM a")
def hyp_05_benjamini_hochberg(spark, sf_dir):
    return rounded(metrics.benjamini_hochberg(_family(spark, sf_dir), "p"), "p_adjusted", places=9)


@query("""WITH a AS (SELECT avg_cpu AS v FROM us WHERE machine_id < 5), b AS (SELECT avg_cpu AS v FROM us WHERE machine_id >= 5),
 g AS (SELECT v, sum(x) AS x, sum(y) AS y FROM (SELECT v, 1 AS x, 0 AS y FROM a UNION ALL SELECT v, 0, 1 FROM b) GROUP BY 1)
SELECT round(max(abs(fx - fy)), 9) AS ks FROM (SELECT sum(x) OVER w / (SELECT count(*) FROM a)::DOUBLE AS fx, sum(y) OVER w / (SELECT count(*) FROM b)::DOUBLE AS fy FROM g WINDOW w AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
def str_08_ks(spark, sf_dir):
    u = instance_usage(spark, sf_dir)
    return rounded(metrics.ks_statistic(u.where("machine_id < 5"), u.where("machine_id >= 5"), "avg_cpu"), "ks", places=9)


@query("""WITH r AS (SELECT avg_cpu AS v FROM us WHERE machine_id < 5), c AS (SELECT avg_cpu * 1.5 AS v FROM us WHERE machine_id >= 5),
 q AS (SELECT list_distinct(quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM r),
 rb AS (SELECT len(list_filter(e, lambda x: v > x)) AS bin, count(*) / (SELECT count(*) FROM r)::DOUBLE AS s FROM r, q GROUP BY 1), cb AS (SELECT len(list_filter(e, lambda x: v > x)) AS bin, count(*) / (SELECT count(*) FROM c)::DOUBLE AS s FROM c, q GROUP BY 1)
SELECT round(sum((greatest(coalesce(cb.s, 0), 1e-6) - greatest(coalesce(rb.s, 0), 1e-6)) * ln(greatest(coalesce(cb.s, 0), 1e-6) / greatest(coalesce(rb.s, 0), 1e-6))), 6) AS psi FROM rb FULL JOIN cb ON rb.bin = cb.bin""")
def str_09_psi(spark, sf_dir):
    u = instance_usage(spark, sf_dir)
    return rounded(metrics.psi(u.where("machine_id < 5"), u.where("machine_id >= 5").withColumn("avg_cpu", F.col("avg_cpu") * 1.5), "avg_cpu"), "psi")


@query("SELECT 'avg_cpu' AS \"column\", count(*) FILTER (WHERE avg_cpu IS NULL) AS nulls, count(*) AS rows FROM us UNION ALL SELECT 'cycles_per_instruction', count(*) FILTER (WHERE cycles_per_instruction IS NULL), count(*) FROM us")
def agg_28_null_profile(spark, sf_dir):
    return quality.null_profile(instance_usage(spark, sf_dir).select("avg_cpu", "cycles_per_instruction"))


@query("SELECT 'type' AS \"column\", count(DISTINCT type) AS \"distinct\" FROM ie UNION ALL SELECT 'machine_id', count(DISTINCT machine_id) FROM ie UNION ALL SELECT 'priority', count(DISTINCT priority) FROM ie")
def agg_29_cardinality(spark, sf_dir):
    return quality.cardinality(instance_events(spark, sf_dir).select("type", "machine_id", "priority"))


@query("SELECT 'avg_cpu' AS \"column\", count(avg_cpu) AS n, round(avg(avg_cpu), 6) AS mean, round(stddev_samp(avg_cpu), 6) AS sd, min(avg_cpu) AS lo, max(avg_cpu) AS hi, round(quantile_cont(avg_cpu, 0.01), 6) AS q1, round(quantile_cont(avg_cpu, 0.5), 6) AS q50, round(quantile_cont(avg_cpu, 0.99), 6) AS q99 FROM us")
def agg_30_numeric_profile(spark, sf_dir):
    return rounded(quality.numeric_profile(instance_usage(spark, sf_dir), ["avg_cpu"]), "mean", "sd", "q1", "q50", "q99")


@query("SELECT 'type' AS \"column\", CAST(type AS VARCHAR) AS value, n FROM (SELECT type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(type AS VARCHAR)) AS r FROM ie GROUP BY 1) WHERE r <= 5 UNION ALL SELECT 'priority', CAST(priority AS VARCHAR), n FROM (SELECT priority, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST(priority AS VARCHAR)) AS r FROM ie GROUP BY 1) WHERE r <= 5")
def agg_31_column_profile(spark, sf_dir):
    return quality.top_values(instance_events(spark, sf_dir), ["type", "priority"])


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM ie GROUP BY collection_id, instance_index, type)")
def agg_32_duplicate_keys(spark, sf_dir):
    g = instance_events(spark, sf_dir).groupBy(*K, "type").agg(F.count("*").alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


@query("""SELECT model, round((coalesce(p, 0) + 100 * g) / (coalesce(n, 0) + 100), 9) AS rate FROM (SELECT DISTINCT model FROM dd) m LEFT JOIN (SELECT model, sum(failure) AS p, count(*) AS n FROM dd WHERE year(date) < 1998 GROUP BY 1) x USING (model) CROSS JOIN (SELECT avg(failure) AS g FROM dd WHERE year(date) < 1998)""")
def agg_45_target_encoding(spark, sf_dir):
    dd = drive_days(spark, sf_dir)
    past = dd.where("year(date) < 1998")
    x = past.groupBy("model").agg(F.sum("failure").alias("p"), F.count("*").alias("n"))
    g = past.agg(F.avg("failure").alias("g"))
    out = dd.select("model").distinct().join(x, "model", "left").crossJoin(F.broadcast(g))
    return out.select("model", F.round((F.coalesce("p", F.lit(0)) + 100 * F.col("g")) / (F.coalesce("n", F.lit(0)) + 100), 9).alias("rate"))


@query("""SELECT entity, max(y_score) AS top, round(avg(y_score), 6) AS mean, round(avg(y_score) FILTER (WHERE r <= 3), 6) AS top3, max(y_true) AS label FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY y_score DESC, id) AS r FROM pr) GROUP BY 1""")
def agg_48_rollup(spark, sf_dir):
    from pyspark.sql import Window

    r = predictions(spark, sf_dir).withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("y_score"), "id")))
    return r.groupBy("entity").agg(F.max("y_score").alias("top"), F.round(F.avg("y_score"), 6).alias("mean"), F.round(F.avg(F.when(F.col("r") <= 3, F.col("y_score"))), 6).alias("top3"), F.max("y_true").alias("label"))


@query()
def mod_02_forest(spark, sf_dir):
    from tracelens.models.batch import evaluate, fit_model

    pr = predictions(spark, sf_dir).withColumn("x2", F.col("y_score") * F.col("entity"))
    train, test = pr.where(exprs.hash_bucket(F.col("entity"), 10) < 7), pr.where(exprs.hash_bucket(F.col("entity"), 10) >= 7)
    return evaluate(fit_model("random_forest", train, ["y_score", "x2"], "y_true"), test, "y_true")
