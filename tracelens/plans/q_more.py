"""Further queries of the inventory: windows, audits, samples, drift and test statistics in closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelens.plans.registry import both, duck, query  # noqa: F401
from tracelens.sources.tables import drive_days, instance_events, instance_usage, load, predictions

N = "CAST(count(*) AS BIGINT)"
MD5 = "CAST(conv(substring(md5({0}), 1, 8), 16, 10) AS BIGINT)"
MD5_DUCK = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT)"


def hashed(name: str, sql: str) -> None:
    """SQL with {h(expr)} placeholders for the md5 bucket number, one spelling an engine."""
    import re

    put = lambda spelling: re.sub(r"H\[(.*?)\]", lambda m: spelling.format(m[1]), sql)
    both(name, put(MD5).replace("VARCHAR", "STRING"), put(MD5_DUCK))


_O = "PARTITION BY collection_id, instance_index ORDER BY time, event_id"
_D = "PARTITION BY serial_number ORDER BY date"
both("win_02_running_submit", f"SELECT event_id, max(CASE WHEN type = 0 THEN time END) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_last_submit FROM ie")
hashed("win_12_hash_rank", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY collection_id ORDER BY H[CAST(event_id AS VARCHAR)], event_id) AS r FROM ie) a WHERE r <= 3")
both("win_13_rolling_mean", f"SELECT serial_number, date, round(avg(smart_197_raw) OVER ({_D} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 6) AS m FROM dd")
both("win_14_rolling_std", f"SELECT serial_number, date, round(stddev_samp(smart_197_raw) OVER ({_D} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 6) AS s FROM dd")
both("win_16_rolling_any", f"SELECT serial_number, date, max(CASE WHEN smart_5_raw > 0 THEN 1 ELSE 0 END) OVER ({_D} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS any7 FROM dd")
both("win_17_differences", f"SELECT serial_number, date, smart_197_raw - lag(smart_197_raw, 1) OVER ({_D}) AS d1, smart_197_raw - lag(smart_197_raw, 7) OVER ({_D}) AS d7 FROM dd")
both("win_21_query_before_ties", "SELECT machine_id, t, n FROM (SELECT machine_id, t, ord, CAST(sum(hit) OVER (PARTITION BY machine_id ORDER BY t, ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM (SELECT machine_id, time AS t, 1 AS ord, CASE WHEN type = 5 THEN 1 ELSE 0 END AS hit FROM ie UNION ALL SELECT machine_id, max(time), 0, 0 FROM ie GROUP BY 1) a) b WHERE ord = 0")
both("prj_12_reconcile", "SELECT serial_number, date, smart_5_raw, CAST(NULL AS BIGINT) AS smart_9_raw, CAST(NULL AS DOUBLE) AS smart_241_raw FROM dd")
both("prj_22_episode_relabel", "SELECT event_id, CASE WHEN type IN (5, 8) OR (type = 4 AND priority BETWEEN 120 AND 359) THEN 1 WHEN type = 6 THEN 0 ELSE -1 END AS label FROM ie")
both("set_10_unnest_struct", "SELECT event_id, s.k AS k, s.v AS v FROM (SELECT event_id, struct(type AS k, priority AS v) AS s FROM ie) a", "SELECT event_id, s.k AS k, s.v AS v FROM (SELECT event_id, {'k': type, 'v': priority} AS s FROM ie) a")
hashed("srt_04_random_sample", "SELECT event_id FROM ie ORDER BY H[CAST(event_id AS VARCHAR)], event_id LIMIT 50")
both("agg_22_machine_windows", "SELECT machine_id, CAST(floor(start_time / 21600000000) AS BIGINT) AS w, CAST(count(*) AS BIGINT) AS n_concurrent, round(sum(avg_cpu), 4) AS cpu, max(avg_memory) AS mem FROM us GROUP BY 1, 2")
_CURVE = "SELECT days, CAST(count(*) AS BIGINT) AS n, round(percentile(smart_197_raw, 0.5), 6) AS med, round(percentile(smart_197_raw, 0.9), 6) AS p90 FROM (SELECT smart_197_raw, {d} AS days FROM (SELECT *, max(CASE WHEN failure = 1 THEN date END) OVER (PARTITION BY serial_number) AS f FROM dd) a WHERE f IS NOT NULL AND date <= f) b WHERE days <= 60 GROUP BY 1"
_ONSET = "SELECT lead_days, round(avg(smart_197_raw) / max(h.m), 6) AS ratio, CAST(count(*) AS BIGINT) AS n FROM (SELECT d.*, {d} AS days FROM (SELECT *, max(CASE WHEN failure = 1 THEN date END) OVER (PARTITION BY serial_number) AS f FROM dd) d WHERE f IS NOT NULL) a JOIN (SELECT 30 AS lead_days UNION ALL SELECT 90 UNION ALL SELECT 180) l ON a.days BETWEEN l.lead_days - 10 AND l.lead_days + 10 CROSS JOIN (SELECT median(smart_197_raw) AS m FROM dd WHERE failure = 0) h GROUP BY 1"
both("agg_53_category_share", f"SELECT category, {N} AS n FROM (SELECT CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS category FROM (SELECT p_size FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 30) a) b GROUP BY 1")
both("str_03_count_window", f"SELECT event_id, round(avg(cpu_request) OVER ({_O} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS m FROM ie")
both("str_16_prior_shift", "SELECT year(date) AS y, month(date) AS m, round(avg(failure), 9) AS prevalence FROM dd GROUP BY 1, 2")
both("met_07_latency", "SELECT serial_number, datediff(min(CASE WHEN smart_5_raw > 5 THEN date END), min(CASE WHEN failure = 1 THEN date END)) AS latency FROM dd GROUP BY 1", "SELECT serial_number, CAST(min(CASE WHEN smart_5_raw > 5 THEN date END) - min(CASE WHEN failure = 1 THEN date END) AS INTEGER) AS latency FROM dd GROUP BY 1")


@query("SELECT 'a' AS part, event_id, type, CAST(NULL AS DOUBLE) AS avg_cpu FROM ie WHERE type = 5 UNION ALL SELECT 'b', event_id, NULL, avg_cpu FROM us WHERE avg_cpu > 400")
def set_03_diagonal(spark, sf_dir):
    a = instance_events(spark, sf_dir).where("type = 5").select(F.lit("a").alias("part"), "event_id", "type")
    b = instance_usage(spark, sf_dir).where("avg_cpu > 400").select(F.lit("b").alias("part"), "event_id", "avg_cpu")
    return a.unionByName(b, allowMissingColumns=True)


@query()
def mod_15_calibrated(spark, sf_dir):
    from tracelens.models.batch import calibrate

    pr = predictions(spark, sf_dir)
    _, apply = calibrate(pr.where("id % 2 = 0"), "y_score", "y_true")
    return apply(pr.where("id % 2 = 1")).select("id", "y_true", "y_score", "calibrated")




both("set_06_key_difference", "SELECT a.x FROM (SELECT DISTINCT s_nationkey AS x FROM supplier) a LEFT JOIN (SELECT DISTINCT c_nationkey AS x FROM customer) b ON a.x = b.x WHERE b.x IS NULL")
