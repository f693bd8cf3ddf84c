"""Instances, attempts (episodes) and their strictly prior history. Ties in time follow event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions.exprs import failure_label, priority_band, safe_divide, slope, windowed
from tracelens.operators.temporal import in_intervals
from tracelens.schema import EVICT, FAILURE, FINISH, KILL, MICROS, MONITORING_LOW, PRODUCTION_LOW, SCHEDULE, SLOPE_S, SUBMIT, TERMINAL, TIME_AFTER, TIME_BEFORE

KEYS = ["collection_id", "instance_index"]


def instance_summary(events: DataFrame) -> DataFrame:
    """One row per instance: counts, first and last times, first and last attributes, durations, outcome."""
    when = lambda p, x="time": F.when(p, F.col(x))
    t, order = F.col("type"), F.struct("time", "event_id")
    a = events.where((F.col("time") > TIME_BEFORE) & (F.col("time") < TIME_AFTER)).groupBy(*KEYS).agg(
        F.count("*").alias("total_events"), F.count_if(t == SUBMIT).alias("submit_count"), F.count_if(t == SCHEDULE).alias("schedule_count"),
        F.count_if(t == EVICT).alias("evict_count"), F.count_if(t.isin(*FAILURE)).alias("fail_lost_count"),
        F.min(when(t == SUBMIT)).alias("submit_time"), F.min(when(t == SCHEDULE)).alias("first_schedule_time"), F.max(when(t == SCHEDULE)).alias("last_schedule_time"),
        F.max("time").alias("terminal_time"), F.max_by("type", order).alias("terminal_type"), F.max_by("priority", order).alias("terminal_priority"),
        F.max_by("machine_id", order).alias("terminal_machine_id"), F.min_by("priority", order).alias("submit_priority"),
        F.min_by("scheduling_class", order).alias("submit_scheduling_class"), F.max("cpu_request").alias("cpu_request"), F.max("memory_request").alias("memory_request"),
    )
    k, p = F.col("terminal_type"), F.col("terminal_priority")
    outcome = F.when(k.isin(*FAILURE), "FAIL_LOST").when(k == FINISH, "FINISH").when((k == EVICT) & (p >= MONITORING_LOW), "EVICT_MONITORING")
    outcome = outcome.when((k == EVICT) & p.between(PRODUCTION_LOW, MONITORING_LOW - 1), "EVICT_PRODUCTION").when(k == EVICT, "EVICT_LOWER").when(k == KILL, "KILL").otherwise("OTHER")
    return a.withColumns({
        "resubmission_count": F.greatest(F.col("submit_count") - 1, F.lit(0)),
        "queue_time_sec": safe_divide(F.col("first_schedule_time") - F.col("submit_time"), F.lit(MICROS)),
        "running_duration_sec": safe_divide(F.col("terminal_time") - F.col("last_schedule_time"), F.lit(MICROS)),
        "total_lifecycle_sec": safe_divide(F.col("terminal_time") - F.col("submit_time"), F.lit(MICROS)),
        "outcome": outcome,
    })


def episodes(events: DataFrame) -> DataFrame:
    """One row per attempt: each SCHEDULE opens one. What an instance did before its first SCHEDULE is left out."""
    w = Window.partitionBy(*KEYS).orderBy("time", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t, order = F.col("type"), F.struct("time", "event_id")
    ev = events.withColumn("sched_seq", F.sum((t == SCHEDULE).cast("long")).over(w)).withColumn("running_last_submit", F.max(F.when(t == SUBMIT, F.col("time"))).over(w))
    at = lambda c: F.min(F.when(t == SCHEDULE, F.col(c)))
    ends = t.isin(*TERMINAL)
    return ev.where("sched_seq >= 1").groupBy(*KEYS, "sched_seq").agg(
        at("time").alias("schedule_time"), at("machine_id").alias("scheduled_machine_id"), at("running_last_submit").alias("attempt_submit_time"),
        F.min_by(F.when(ends, t), F.when(ends, order)).alias("terminal_type"), F.count_if(ends).alias("n_terminal_events"),
    )


def with_history(eps: DataFrame) -> DataFrame:
    """Attempts with the counts of the instance's earlier attempts; the own one never counts."""
    w = Window.partitionBy(*KEYS).orderBy("sched_seq").rowsBetween(Window.unboundedPreceding, -1)
    t = F.col("terminal_type")
    n = lambda p: F.coalesce(F.sum(F.coalesce(p, F.lit(False)).cast("long")).over(w), F.lit(0))
    return eps.withColumns({
        "prior_episode_count": F.count("*").over(w), "prior_fail_count": n(t.isin(*FAILURE)),
        "prior_finish_count": n(t == FINISH), "prior_evict_count": n(t == EVICT),
    })


def schedule_intervals(eps: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEYS).orderBy("sched_seq")
    return eps.select(*KEYS, "sched_seq", "schedule_time", F.lead("schedule_time").over(w).alias("next_schedule_time"))


def usage_in_episodes(usage: DataFrame, intervals: DataFrame, horizon: int) -> DataFrame:
    """Usage rows with the attempt that was running, and the seconds since it was scheduled."""
    out = in_intervals(usage, intervals, KEYS, "start_time", "schedule_time", "next_schedule_time", horizon)
    return out.withColumn("sec", safe_divide(F.col("start_time") - F.col("schedule_time"), F.lit(MICROS)))


def runtime_features(usage: DataFrame, keys: list[str], slopes: tuple[int, ...] = SLOPE_S, requests: DataFrame | None = None) -> DataFrame:
    """Early-runtime row per key: slopes, ramps, first-interval ratio, first counters (never imputed). usage: sec,
    event_id, avg_cpu, avg_memory, counters."""
    post = usage.where("sec >= 0")
    w = Window.partitionBy(*keys).orderBy("sec", "event_id")
    r = post.withColumn("rn", F.row_number().over(w)).withColumn("smooth", F.avg("avg_cpu").over(w.rowsBetween(0, 2)))
    for c in ("cpu", "memory"):
        r = r.withColumn(f"prev_{c}", F.lag(f"avg_{c}").over(w))
    nth = lambda x, n: F.max(F.when(F.col("rn") == n, x))
    sec = F.col("sec")
    aggs = [slope(F.col(f"avg_{c}"), sec, sec <= h).alias(f"{c}_slope_{h}s") for c in ("cpu", "memory") for h in slopes]
    aggs += [nth(F.col(f"avg_{c}") - F.col(f"prev_{c}"), 2).alias(f"initial_{c}_ramp") for c in ("cpu", "memory")]
    aggs += [nth(F.col("smooth"), 1).alias("first_interval"), nth(F.col("cycles_per_instruction"), 1).alias("cpi_value"), nth(F.col("memory_accesses_per_instruction"), 1).alias("mapi_value")]
    out = r.groupBy(*keys).agg(*aggs)
    if requests is None:
        return out.withColumn("first_interval_util_ratio", F.lit(None).cast("double")).drop("first_interval")
    out = out.join(requests, [k for k in keys if k in requests.columns], "left")
    ratio = F.when(F.col("cpu_request") > 0, safe_divide(F.col("first_interval"), F.col("cpu_request")))
    return out.withColumn("first_interval_util_ratio", ratio).drop("first_interval", "cpu_request")


def utilization_windows(usage: DataFrame, keys: list[str], horizons: tuple[int, ...]) -> DataFrame:
    """Mean, maximum and deviation of cpu and memory over the first seconds of each key."""
    sec = F.col("sec")
    return usage.groupBy(*keys).agg(*windowed("avg_cpu", sec, horizons, "cpu"), *windowed("avg_memory", sec, horizons, "memory"))


# Features known at each point of an attempt's life, by name or beginning (*); each point knows the
# earlier ones' too.
SUBMISSION = ("cpu_request", "memory_request", "request_ratio", "priority_tier_*", "scheduling_class", "submit_*", "prior_fail_count", "has_prior_fail", "resubmission_count", "prior_evict_count", "first_resubmission")
SCHEDULING = ("queue_time", "platform_*")
RUNTIME = ("cpu_slope_*", "memory_slope_*", "initial_cpu_ramp", "initial_memory_ramp", "first_interval_util_ratio", "cpi_value", "mapi_value", "has_hardware_counters")
POINTS = {"at_submission": SUBMISSION, "at_scheduling": SUBMISSION + SCHEDULING, "early_runtime": SUBMISSION + SCHEDULING + RUNTIME}


def feature_columns(columns: list[str], point: str) -> list[str]:
    """Those of the columns that are known at a prediction point; an unknown point raises KeyError."""
    found = []
    for name in POINTS[point]:
        found += sorted(c for c in columns if (c.startswith(name[:-1]) if name.endswith("*") else c == name) and c not in found)
    return found


def point_features(df: DataFrame, point: str, keep: list[str]) -> DataFrame:
    """df with the columns to keep and the features known at a prediction point."""
    return df.select(*keep, *[c for c in feature_columns(df.columns, point) if c not in keep])


def null_indicators(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """Only whether each column is null: missingness as the sole signal."""
    return df.select(*keep, *[F.col(c).isNull().cast("int").alias(f"{c}__isnull") for c in columns])


def submission_features(events: DataFrame) -> DataFrame:
    """One row per attempt with what is known when it is submitted and scheduled, and its outcome's label."""
    eps = with_history(episodes(events))
    t, order = F.col("type"), F.struct("time", "event_id")
    first = events.groupBy(*KEYS).agg(F.max("cpu_request").alias("cpu_request"), F.max("memory_request").alias("memory_request"), F.min_by("scheduling_class", order).alias("scheduling_class"), F.min_by("priority", order).alias("__priority"))
    out = eps.join(first, KEYS)
    hour = F.floor(F.col("attempt_submit_time") / (3600 * MICROS))
    return out.select(
        *KEYS, "sched_seq", "cpu_request", "memory_request", safe_divide(F.col("cpu_request"), F.when(F.col("memory_request") != 0, F.col("memory_request"))).alias("request_ratio"), "scheduling_class",
        *[(priority_band(F.col("__priority")) == b).cast("int").alias(f"priority_tier_{b}") for b in ("free", "best_effort", "mid", "production", "monitoring")],
        (hour % 24).alias("submit_hour"), (F.floor(hour / 24) % 7).alias("submit_day"), "prior_fail_count", (F.col("prior_fail_count") > 0).cast("int").alias("has_prior_fail"),
        F.col("prior_episode_count").alias("resubmission_count"), "prior_evict_count", safe_divide(F.col("schedule_time") - F.col("attempt_submit_time"), F.lit(MICROS)).alias("queue_time"),
        failure_label(F.col("terminal_type")).alias("failure_label"),
    )


def attempt_audits(eps: DataFrame) -> dict[str, DataFrame]:
    """Five audits of attempts: by number of attempts, outcomes by ordinal, first against later ones, gaps in the
    ordinals, and attempts with several or no ends."""
    t = F.col("terminal_type")
    failed = F.count_if(t.isin(*FAILURE))
    per = eps.groupBy(*KEYS).agg(F.count("*").alias("attempts"), failed.alias("failures"), F.max("sched_seq").alias("last"))
    return {
        "by_attempts": per.groupBy("attempts").agg(F.count("*").alias("instances"), F.sum("failures").alias("failures")),
        "by_ordinal": eps.groupBy("sched_seq").agg(F.count("*").alias("n"), failed.alias("failures"), F.count_if(t == FINISH).alias("finishes"), F.count_if(t == EVICT).alias("evictions")),
        "first_and_later": eps.groupBy((F.col("sched_seq") == 1).cast("int").alias("first")).agg(F.count("*").alias("n"), failed.alias("failures")),
        "gaps": per.groupBy((F.col("last") != F.col("attempts")).cast("int").alias("gap")).agg(F.count("*").alias("instances")),
        "ends": eps.groupBy(F.least("n_terminal_events", F.lit(2)).alias("ends")).agg(F.count("*").alias("n")),
    }
