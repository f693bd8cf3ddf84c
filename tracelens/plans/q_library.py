"""Queries that run the library's operators, each beside SQL of its own for the same rows. They stand for the inventory's
rows that have rules of their own."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tracelens.functions import exprs, metrics
from tracelens.operators import conflicts, drives, lifecycle, quality, sampling, strategies, temporal
from tracelens.plans.q_composite import DAY_US, EPISODES, HOUR, K, rounded
from tracelens.plans.registry import query
from tracelens.session import scratch
from tracelens.sources import files
from tracelens.sources.tables import drive_days, instance_events, instance_usage, load, machine_events, predictions

N = "CAST(count(*) AS BIGINT)"


def md5(x: str) -> str:
    """The library's hash number in DuckDB."""
    return f"CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"


ID = md5("CAST(id AS VARCHAR)")
UNIT = f"({ID} % 1000000) / 1000000"


# sources


@query("SELECT event_id, time, type, collection_id, instance_index, cpu_request AS request_cpu, memory_request AS request_memory FROM ie")
def src_01_flatten(spark, sf_dir):
    e = instance_events(spark, sf_dir)
    nested = e.select("event_id", "time", "type", "collection_id", "instance_index", F.struct(F.col("cpu_request").alias("cpu"), F.col("memory_request").alias("memory")).alias("request"))
    return nested.select(*files.flatten(nested))


@query("SELECT event_id, start_time, end_time, avg_cpu AS average_cpu, avg_memory AS average_memory, cycles_per_instruction AS counters_cpi_value FROM us")
def src_01_flatten_usage(spark, sf_dir):
    u = instance_usage(spark, sf_dir)
    counters = F.struct(F.struct(F.col("cycles_per_instruction").alias("value")).alias("cpi")).alias("counters")
    nested = u.select("event_id", "start_time", "end_time", F.struct(F.col("avg_cpu").alias("cpu"), F.col("avg_memory").alias("memory")).alias("average"), counters)
    return nested.select(*files.flatten(nested))


@query("SELECT time, machine_id, capacity_cpus, capacity_memory FROM me")
def src_01_flatten_machines(spark, sf_dir):
    m = machine_events(spark, sf_dir)
    nested = m.select("time", "machine_id", F.struct(F.col("capacity_cpus").alias("cpus"), F.col("capacity_memory").alias("memory")).alias("capacity"))
    return nested.select(*files.flatten(nested))


@query("SELECT collection_id, min(time) AS first_time, max(priority) AS about_priority, max(scheduling_class) AS about_scheduling_class FROM ie GROUP BY 1")
def src_01_flatten_collections(spark, sf_dir):
    about = F.struct(F.max("priority").alias("priority"), F.max("scheduling_class").alias("scheduling_class")).alias("about")
    nested = instance_events(spark, sf_dir).groupBy("collection_id").agg(F.min("time").alias("first_time"), about)
    return nested.select(*files.flatten(nested))


@query("SELECT machine_id, time, 'platform' AS attribute_name, platform_id AS attribute_value FROM me")
def src_01_flatten_attributes(spark, sf_dir):
    nested = machine_events(spark, sf_dir).select("machine_id", "time", F.struct(F.lit("platform").alias("name"), F.col("platform_id").alias("value")).alias("attribute"))
    return nested.select(*files.flatten(nested))


@query(f"SELECT {N} AS rows, CAST(1 AS INTEGER) AS ok FROM us")
def src_02_verified_export(spark, sf_dir):
    u = instance_usage(spark, sf_dir)
    n = u.count()
    got = files.run_verified(u, scratch(spark, "usage"), (n, n), (1, 2**62))
    return spark.createDataFrame([(got["rows"], int(got["ok"]))], "rows long, ok int")


@query(f"SELECT type, {N} AS n FROM ie GROUP BY 1")
def src_03_local_frame(spark, sf_dir):
    instance_events(spark, sf_dir).createOrReplaceTempView("tracelens_src_03")
    return spark.createDataFrame(files.local(spark, "SELECT type, count(*) AS n FROM tracelens_src_03 GROUP BY type"))


@query(f"SELECT {N} AS n, CAST(1 AS INTEGER) AS there, CAST(0 AS INTEGER) AS gone FROM me")
def src_05_ddl(spark, sf_dir):
    machine_events(spark, sf_dir).createOrReplaceTempView("tracelens_src_05")
    files.run_ddl(spark, "CREATE OR REPLACE TEMPORARY VIEW tracelens_src_05_all AS SELECT * FROM tracelens_src_05;\nCREATE OR REPLACE TEMPORARY VIEW tracelens_src_05_none AS SELECT 1 AS x;\nDROP VIEW tracelens_src_05_none")
    there, gone = (int(files.table_exists(spark, f"tracelens_src_05_{x}")) for x in ("all", "none"))
    return spark.createDataFrame([(files.row_count(spark, "tracelens_src_05_all"), there, gone)], "n long, there int, gone int")


@query("SELECT serial_number, date, failure FROM dd")
def src_06_export(spark, sf_dir):
    path = scratch(spark, "drive-days")
    files.export_parquet(drive_days(spark, sf_dir).select("serial_number", "date", "failure"), path)
    return spark.read.parquet(path)


@query("SELECT l_orderkey, l_linenumber FROM lineitem")
def src_08_scan(spark, sf_dir):
    return files.scan(spark, [f"{sf_dir}/lineite*.parquet"], ["l_orderkey", "l_linenumber"])


@query("SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type FROM (DESCRIBE lineitem)")
def src_10_footer_schema(spark, sf_dir):
    return files.schema_of(spark, f"{sf_dir}/lineitem.parquet")


@query(f"SELECT event_type, {N} AS n FROM events GROUP BY 1")
def src_11_stream_sink(spark, sf_dir):
    given, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    e = load(spark, sf_dir, "events").select("event_id", "event_type")
    files.export_parquet(e, given)
    stream = spark.readStream.schema(e.schema).parquet(given)
    files.stream_to_parquet(stream, out, scratch(spark, "stream-checkpoint")).awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS serial_number, CAST(s_suppkey % 2 AS INTEGER) AS failure, CASE WHEN s_suppkey % 3 <> 0 THEN s_suppkey END AS smart_5_raw, CAST(NULL AS BIGINT) AS smart_9_raw FROM supplier")
def src_12_csv(spark, sf_dir):
    s = load(spark, sf_dir, "supplier")
    cells = s.select((F.col("s_suppkey") % 2).alias("failure"), F.lit("x").alias("more"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey").cast("string")).otherwise("NA").alias("smart_5_raw"), F.col("s_suppkey").alias("serial_number"))
    path = scratch(spark, "csv")
    files.write_text(cells, path, "csv")
    return files.read_csv(spark, path, ["serial_number", "failure", "smart_5_raw", "smart_9_raw"])


def _archives(spark, sf_dir) -> dict[str, str]:
    """Archives of drive days by year with a CSV file a month, each written by a task."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("date", "serial_number", "failure", "smart_5_raw")]
    month = F.concat(F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("none")), F.lit(".csv"))
    rows = drive_days(spark, sf_dir).select(F.year("date").alias("y"), month.alias("m"), F.concat_ws(",", *cells).alias("row"))
    return files.zip_files(rows, "y", "m", "row", "date,serial_number,failure,smart_5_raw", scratch(spark, "archives"))


_INGESTED = "SELECT CAST(year(date) AS VARCHAR) AS quarter, date, CAST(serial_number AS VARCHAR) AS serial_number, failure, smart_5_raw FROM dd"


@query(_INGESTED)
def src_14_ingest(spark, sf_dir):
    out = scratch(spark, "quarters")
    files.ingest_quarters(spark, _archives(spark, sf_dir), out, scratch(spark, "log"))
    days = spark.read.parquet(out) if files.exists(spark, out) else spark.createDataFrame([], "date date, serial_number string, failure int, smart_5_raw long, quarter string")
    return days.select(F.col("quarter").cast("string").alias("quarter"), "date", "serial_number", "failure", "smart_5_raw")


@query(f"SELECT quarter AS id, 'completed' AS status, {N} AS rows FROM ({_INGESTED}) GROUP BY 1")
def src_15_log(spark, sf_dir):
    archives, out, log = _archives(spark, sf_dir), scratch(spark, "quarters"), scratch(spark, "log")
    first = dict(list(sorted(archives.items()))[:1])
    files.ingest_quarters(spark, first, out, log)
    files.ingest_quarters(spark, archives, out, log)  # goes on behind what the log lists
    return files.read_log(spark, log).withColumn("id", F.when(F.col("id") != files.NO_ARCHIVE, F.col("id")))


@query("SELECT 'lineitem' AS name, CAST(11 AS INTEGER) AS columns, (SELECT count(*) FROM lineitem) AS rows, CAST(1 AS INTEGER) AS has_bytes UNION ALL SELECT 'events', 6, (SELECT count(*) FROM events), 1")
def src_17_table_size(spark, sf_dir):
    parts = [files.table_metadata(spark, n, f"{sf_dir}/{n}.parquet") for n in ("lineitem", "events")]
    return parts[0].union(parts[1]).select("name", "columns", "rows", (F.col("bytes") > 0).cast("int").alias("has_bytes"))


@query("SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'FLOAT[]' THEN 'array<float>' ELSE 'int' END AS type, CASE WHEN column_type LIKE '%[]' THEN 'REPEATED' ELSE 'NULLABLE' END AS mode FROM (DESCRIBE embeddings)")
def src_17_columns(spark, sf_dir):
    load(spark, sf_dir, "embeddings").createOrReplaceTempView("tracelens_src_17")
    return files.catalog_info(spark, "tracelens_src_17")


@query("SELECT p_partkey, p_brand FROM part")
def src_18_json_sink(spark, sf_dir):
    path = scratch(spark, "json")
    files.write_text(load(spark, sf_dir, "part").select("p_partkey", "p_brand"), path, "json")
    return spark.read.schema("p_partkey long, p_brand string").json(path)


# projections


@query("SELECT event_id, CASE WHEN type IN (5, 8) THEN 1 WHEN type = 6 THEN 0 END AS failure_label, CASE WHEN type IN (5, 8) THEN 1 WHEN type = 4 AND priority >= 120 AND priority < 360 THEN 1 WHEN type = 6 THEN 0 END AS sensitivity_label FROM ie")
def prj_03_failure_label(spark, sf_dir):
    t, p = F.col("type"), F.col("priority")
    return instance_events(spark, sf_dir).select("event_id", exprs.failure_label(t).alias("failure_label"), exprs.failure_label(t, p, "sensitivity").alias("sensitivity_label"))


@query(f"SELECT CASE WHEN priority <= 99 THEN 'free' WHEN priority <= 115 THEN 'best_effort' WHEN priority <= 119 THEN 'mid' WHEN priority <= 359 THEN 'production' WHEN priority >= 360 THEN 'monitoring' ELSE 'unknown' END AS tier, {N} AS n FROM ie GROUP BY 1")
def prj_05_priority_band(spark, sf_dir):
    return instance_events(spark, sf_dir).groupBy(exprs.priority_band(F.col("priority")).alias("tier")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(scheduling_class = 0 AS INTEGER) AS sc_0, CAST(scheduling_class = 1 AS INTEGER) AS sc_1, CAST(scheduling_class = 2 AS INTEGER) AS sc_2, CAST(scheduling_class = 3 AS INTEGER) AS sc_3 FROM ie")
def prj_06_one_hot(spark, sf_dir):
    return instance_events(spark, sf_dir).select("event_id", *exprs.one_hot(F.col("scheduling_class"), [0, 1, 2, 3], "sc_"))


_SUBMITTED = f"""WITH {EPISODES}, h AS (SELECT *, coalesce(sum(CASE WHEN terminal_type IN (5, 8) THEN 1 ELSE 0 END) OVER w, 0) AS pf, count(*) OVER w AS pc, coalesce(sum(CASE WHEN terminal_type = 4 THEN 1 ELSE 0 END) OVER w, 0) AS pe
    FROM ep WINDOW w AS (PARTITION BY collection_id, instance_index ORDER BY sched_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT collection_id, instance_index, max(cpu_request) AS c, max(memory_request) AS m, arg_min(scheduling_class, time) AS sc, arg_min(priority, time) AS p FROM ie GROUP BY 1, 2)"""


@query(_SUBMITTED + """ SELECT collection_id, instance_index, sched_seq, c AS cpu_request, round(c / nullif(m, 0), 6) AS request_ratio, CAST(p <= 99 AS INTEGER) AS priority_tier_free, sc AS scheduling_class,
 CAST(floor(attempt_submit_time / 3600000000) % 24 AS BIGINT) AS submit_hour, CAST(pf AS BIGINT) AS prior_fail_count, CAST(pe AS BIGINT) AS prior_evict_count, pc AS resubmission_count FROM h JOIN f USING (collection_id, instance_index)""")
def prj_23_at_submission(spark, sf_dir):
    f = lifecycle.point_features(lifecycle.submission_features(instance_events(spark, sf_dir)), "at_submission", [*K, "sched_seq"])
    return f.select(*K, "sched_seq", "cpu_request", F.round("request_ratio", 6).alias("request_ratio"), "priority_tier_free", "scheduling_class", "submit_hour", "prior_fail_count", "prior_evict_count", "resubmission_count")


@query("""SELECT point, CAST(n AS INTEGER) AS n_features, has_queue_time FROM (VALUES ('at_submission', 15, 0), ('at_scheduling', 16, 1), ('early_runtime', 16, 1)) t(point, n, has_queue_time)""")
def prj_23_points(spark, sf_dir):
    columns = lifecycle.submission_features(instance_events(spark, sf_dir)).columns
    rows = [(p, len(c := lifecycle.feature_columns(columns, p)), int("queue_time" in c)) for p in lifecycle.POINTS]
    return spark.createDataFrame(rows, "point string, n_features int, has_queue_time int")


@query("SELECT event_id, CAST(cycles_per_instruction IS NULL AS INTEGER) AS cycles_per_instruction__isnull, CAST(avg_cpu IS NULL AS INTEGER) AS avg_cpu__isnull FROM us")
def prj_24_null_indicators(spark, sf_dir):
    return lifecycle.null_indicators(instance_usage(spark, sf_dir), ["cycles_per_instruction", "avg_cpu"], ["event_id"])


# aggregates


@query("SELECT collection_id, instance_index, max(cpu_request) AS cpu_request, max(CAST(type IN (5, 8) AS INTEGER)) AS failed, max(CAST(type IN (4, 5, 6, 7, 8) AS INTEGER)) AS has_terminal, max(CAST(type = 6 AS INTEGER)) AS finished FROM ie GROUP BY 1, 2")
def agg_19_instance_flags(spark, sf_dir):
    return conflicts.instance_flags(instance_events(spark, sf_dir)).select(*K, "cpu_request", "failed", "has_terminal", "finished")


_RATES = "{N} AS drive_days, CAST(sum(failure) AS BIGINT) AS failures, CAST(count(DISTINCT serial_number) AS BIGINT) AS drives, round(sum(failure) * 36500.0::DOUBLE / count(*), 4) AS afr FROM dd GROUP BY".replace("{N}", N)


@query(f"SELECT year(date) AS y, model, {_RATES} 1, 2")
def agg_40_failure_rates(spark, sf_dir):
    return rounded(drives.failure_rates(drive_days(spark, sf_dir), [F.year("date").alias("y"), F.col("model")]), "afr", places=4)


@query(f"SELECT capacity_bytes, {_RATES} 1")
def agg_40_by_capacity(spark, sf_dir):
    return rounded(drives.failure_rates(drive_days(spark, sf_dir), [F.col("capacity_bytes")]), "afr", places=4)


@query(f"SELECT strftime(date, '%Y-%m') AS m, {_RATES} 1")
def agg_40_by_month(spark, sf_dir):
    return rounded(drives.failure_rates(drive_days(spark, sf_dir), [F.date_format("date", "yyyy-MM").alias("m")]), "afr", places=4)


@query(f"SELECT CAST(year(date) AS INTEGER) AS y, {_RATES} 1")
def agg_40_fleet(spark, sf_dir):
    return rounded(drives.failure_rates(drive_days(spark, sf_dir), [F.year("date").alias("y")]), "afr", places=4)


_AHEAD = "b AS (SELECT d.*, CAST(f.f - d.date AS INTEGER) AS days FROM dd d JOIN (SELECT serial_number, max(date) AS f FROM dd WHERE failure = 1 GROUP BY 1) f ON f.serial_number = d.serial_number AND d.date <= f.f)"


@query(f"WITH {_AHEAD} SELECT days, {N} AS n, round(quantile_cont(smart_197_raw, 0.5), 6) AS q50, round(quantile_cont(smart_197_raw, 0.9), 6) AS q90 FROM b WHERE days <= 60 GROUP BY 1")
def agg_43_degradation_curve(spark, sf_dir):
    return rounded(drives.degradation_curve(drive_days(spark, sf_dir), "smart_197_raw", 60, (0.5, 0.9)), "q50", "q90")


@query(f"""WITH {_AHEAD}, l AS (SELECT unnest([90, 60, 30, 14, 7, 1]) AS lead), h AS (SELECT median(smart_197_raw) AS m FROM dd WHERE serial_number NOT IN (SELECT serial_number FROM dd WHERE failure = 1))
SELECT CAST(lead AS INTEGER) AS lead, count(smart_197_raw) AS n, median(smart_197_raw) AS median, round(median(smart_197_raw) / max(h.m), 6) AS ratio FROM b JOIN l ON abs(days - lead) <= 1 CROSS JOIN h GROUP BY 1""")
def agg_44_onset(spark, sf_dir):
    return rounded(drives.degradation_onset(drive_days(spark, sf_dir), "smart_197_raw"), "ratio")


@query(f"""WITH {EPISODES}, p AS (SELECT collection_id, instance_index, count(*) AS attempts, count(*) FILTER (WHERE terminal_type IN (5, 8)) AS f, max(sched_seq) AS last FROM ep GROUP BY 1, 2)
SELECT 'by_attempts' AS audit, attempts AS k, {N} AS n, CAST(sum(f) AS BIGINT) AS failures FROM p GROUP BY 2
UNION ALL SELECT 'by_ordinal', sched_seq, count(*), count(*) FILTER (WHERE terminal_type IN (5, 8)) FROM ep GROUP BY 2
UNION ALL SELECT 'first_and_later', CAST(sched_seq = 1 AS BIGINT), count(*), count(*) FILTER (WHERE terminal_type IN (5, 8)) FROM ep GROUP BY 2
UNION ALL SELECT 'gaps', CAST(last <> attempts AS BIGINT), count(*), NULL FROM p GROUP BY 2
UNION ALL SELECT 'ends', least(n_terminal_events, 2), count(*), NULL FROM ep GROUP BY 2""")
def agg_50_attempt_audit(spark, sf_dir):
    audits, out = lifecycle.attempt_audits(lifecycle.episodes(instance_events(spark, sf_dir))), None
    for name, d in audits.items():
        n = "instances" if "instances" in d.columns else "n"
        failures = F.col("failures") if "failures" in d.columns else F.lit(None)
        one = d.select(F.lit(name).alias("audit"), F.col(d.columns[0]).cast("long").alias("k"), F.col(n).alias("n"), failures.cast("long").alias("failures"))
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH g AS (SELECT collection_id AS k, collection_id % 4 AS stratum, count(*) AS n, max(CAST(type = 5 AND priority > 390 AS INTEGER)) = 1 AS failed FROM ie GROUP BY 1, 2),
s AS (SELECT k FROM g WHERE failed UNION ALL SELECT k FROM (SELECT k, sum(n) OVER (PARTITION BY stratum ORDER BY {md5('CAST(k AS VARCHAR)')} % 2147483648, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(n) OVER (PARTITION BY stratum) AS total FROM g WHERE NOT failed) WHERE run <= total * 0.5)
SELECT stratum, {N} AS before, CAST(count(*) FILTER (WHERE k IN (SELECT k FROM s)) AS BIGINT) AS after, round(count(*) FILTER (WHERE k IN (SELECT k FROM s)) / count(*), 6) AS share FROM g GROUP BY 1""")
def agg_51_strata(spark, sf_dir):
    bad = (F.col("type") == 5) & (F.col("priority") > 390)
    g = instance_events(spark, sf_dir).groupBy(F.col("collection_id").alias("k")).agg(F.count("*").alias("n"), F.bool_or(bad).alias("failed")).withColumn("stratum", F.col("k") % 4)
    kept = sampling.working_set(g, "k", ["stratum"], "n", "failed", 0.5)
    return rounded(sampling.strata_marginals(g, kept, "k", ["stratum"]), "share")


_DENSITY = "SELECT 'hour' AS grain, CAST(date_trunc('hour', ts) AS VARCHAR) AS bucket, {n} AS n FROM events GROUP BY 2 UNION ALL SELECT 'day', CAST(CAST(ts AS DATE) AS VARCHAR), {n} FROM events GROUP BY 2 UNION ALL SELECT 'weekday', CAST(isodow(ts) - 1 AS VARCHAR), {n} FROM events GROUP BY 2 UNION ALL SELECT 'hour_of_day', CAST(hour(ts) AS VARCHAR), {n} FROM events GROUP BY 2"


@query(_DENSITY.format(n=N))
def agg_52_calendar(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss")
    grains = {"hour": hour, "day": F.to_date("ts").cast("string"), "weekday": F.weekday("ts").cast("string"), "hour_of_day": F.hour("ts").cast("string")}
    rows = e.select(F.explode(F.array(*[F.struct(F.lit(g).alias("grain"), c.alias("bucket")) for g, c in grains.items()])).alias("x")).select("x.*")
    return rows.groupBy("grain", "bucket").agg(F.count("*").alias("n"))


# windows


@query(f"SELECT k, run, total FROM (SELECT k, CAST(sum(n) OVER (ORDER BY {md5('CAST(k AS VARCHAR)')} % 2147483648, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS run, CAST(sum(n) OVER () AS BIGINT) AS total FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1)) WHERE run <= total * 0.25")
def win_11_hash_prefix(spark, sf_dir):
    g = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"))
    run = temporal.running_totals(g, exprs.hash_bucket(F.col("k"), 2**31), {"run": F.col("n")}, ties=[F.col("k")])
    return run.crossJoin(F.broadcast(g.agg(F.sum("n").alias("total")))).where("run <= total * 0.25").select("k", "run", "total")


@query("SELECT event_id, CAST(avg(CAST(cycles_per_instruction IS NOT NULL AS INTEGER)) OVER (PARTITION BY collection_id, instance_index) >= 0.5 AS INTEGER) AS has_counters FROM us")
def win_19_majority(spark, sf_dir):
    return drives.majority(instance_usage(spark, sf_dir), K, F.col("cycles_per_instruction"), "has_counters").select("event_id", "has_counters")


@query("SELECT serial_number, round(sum(v) OVER (ORDER BY v DESC, serial_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / CAST(sum(v) OVER () AS DOUBLE), 8) AS share FROM (SELECT serial_number, sum(smart_197_raw) AS v FROM dd GROUP BY 1)")
def win_22_lorenz(spark, sf_dir):
    g = drive_days(spark, sf_dir).groupBy("serial_number").agg(F.sum("smart_197_raw").alias("v"))
    run = temporal.running_totals(g, -F.col("v"), {"run": F.col("v")}, ties=[F.col("serial_number")])
    return run.crossJoin(F.broadcast(g.agg(F.sum("v").alias("total")))).select("serial_number", F.round(F.col("run") / F.col("total"), 8).alias("share"))


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS i FROM part")
def win_23_row_index(spark, sf_dir):
    run = temporal.running_totals(load(spark, sf_dir, "part").select("p_partkey"), F.col("p_partkey"), {"i": F.lit(1)})
    return run.select("p_partkey", (F.col("i") - 1).alias("i"))


# sets and samples


@query("""WITH a AS (SELECT column_name AS name, column_type AS t FROM (DESCRIBE orders)), b AS (SELECT replace(column_name, 'l_', 'o_') AS name, column_type AS t FROM (DESCRIBE lineitem))
SELECT 'only_first' AS part, name FROM a WHERE name NOT IN (SELECT name FROM b) UNION ALL SELECT 'only_second', name FROM b WHERE name NOT IN (SELECT name FROM a)
UNION ALL SELECT 'both', a.name FROM a JOIN b USING (name) UNION ALL SELECT 'changed', a.name FROM a JOIN b ON a.name = b.name AND a.t <> b.t""")
def set_06_schema_difference(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    lines = lines.select(*[F.col(c).alias(c.replace("l_", "o_")) for c in lines.columns])
    found = quality.schema_difference(load(spark, sf_dir, "orders"), lines)
    return spark.createDataFrame([(p, n) for p, names in found.items() for n in names], "part string, name string")


_KEY = "concat(CAST(serial_number AS VARCHAR), '_', CAST(date AS VARCHAR))"
_THIN = f"SELECT serial_number, date, failure FROM dd, (SELECT least(1.0, {{r}} * sum(failure) / (count(*) - sum(failure))) AS keep FROM dd) t WHERE failure = 1 OR ({md5(_KEY)} % 1000000) / 1000000 < keep"


def _day_key():
    return F.concat_ws("_", F.col("serial_number").cast("string"), F.col("date").cast("string"))


@query(f"SELECT serial_number, date FROM dd WHERE ({md5(_KEY)} % 1000000) / 1000000 < 0.05")
def smp_02_fraction(spark, sf_dir):
    return sampling.fraction_sample(drive_days(spark, sf_dir), _day_key(), 0.05).select("serial_number", "date")


@query(_THIN.format(r=10))
def smp_07_thin_healthy(spark, sf_dir):
    return sampling.thin_healthy(drive_days(spark, sf_dir), "failure", _day_key(), 10.0).select("serial_number", "date", "failure")


@query(" UNION ALL ".join(f"SELECT {r}.0::DOUBLE AS ratio, {N} AS n, CAST(sum(failure) AS BIGINT) AS positives FROM ({_THIN.format(r=r)})" for r in (10, 20, 40)))
def smp_08_branches(spark, sf_dir):
    return sampling.ratio_branches(drive_days(spark, sf_dir), "failure", _day_key(), (10, 20, 40))


@query(f"SELECT {md5('CAST(serial_number AS VARCHAR)')} % 40 AS bucket, CAST(count(DISTINCT serial_number) AS BIGINT) AS drives, {N} AS n FROM dd GROUP BY 1")
def smp_09_drive_buckets(spark, sf_dir):
    return sampling.drive_buckets(drive_days(spark, sf_dir), F.col("serial_number")).groupBy("bucket").agg(F.count_distinct("serial_number").alias("drives"), F.count("*").alias("n"))


@query(f"SELECT id FROM pr WHERE {UNIT} < 0.05")
def smp_10_uniform_fraction(spark, sf_dir):
    return sampling.fraction_sample(predictions(spark, sf_dir), F.col("id"), 0.05).select("id")


_RANKED = f"(SELECT id, y_true, row_number() OVER (PARTITION BY y_true ORDER BY {ID} % 2147483648, id) AS r FROM pr) a CROSS JOIN (SELECT sum(y_true) AS p, count(*) AS n FROM pr) t"


@query(f"SELECT id FROM {_RANKED} WHERE y_true = 1 OR r <= greatest(n * 0.4 - p, p)")
def smp_11_negative_budget(spark, sf_dir):
    return sampling.negative_budget(predictions(spark, sf_dir), "y_true", F.col("id"), F.col("n") * 0.4, [F.col("id")]).select("id")


@query(f"SELECT id FROM {_RANKED} WHERE y_true = 1 OR r <= p * 1.5")
def smp_12_rebalance(spark, sf_dir):
    return sampling.rebalance(predictions(spark, sf_dir), "y_true", F.col("id"), 1.5, [F.col("id")]).select("id")


@query(f"""WITH s AS (SELECT entity % 5 AS stratum, count(*) AS n, sum(y_true) AS p FROM pr GROUP BY 1), t AS (SELECT stratum, n, p, n * 500 / (SELECT count(*) FROM pr)::DOUBLE AS part FROM s)
SELECT 'proportional' AS plan, id FROM pr JOIN t ON t.stratum = entity % 5 WHERE {UNIT} < part / n
UNION ALL SELECT 'enriched', id FROM pr JOIN t ON t.stratum = entity % 5 WHERE {UNIT} < CASE WHEN y_true = 1 THEN least(part * 0.5, p) / greatest(p, 1) ELSE (part - least(part * 0.5, p)) / greatest(n - p, 1) END""")
def smp_13_stratified(spark, sf_dir):
    pr = predictions(spark, sf_dir).withColumn("stratum", F.col("entity") % 5)
    one = lambda plan: sampling.stratified(pr, ["stratum"], "y_true", F.col("id"), 500, plan).select(F.lit(plan).alias("plan"), "id")
    return one("proportional").union(one("enriched"))


@query("SELECT model FROM dd GROUP BY 1 HAVING sum(CASE WHEN year(date) < 1998 THEN failure ELSE 0 END) >= 1 AND sum(CASE WHEN year(date) >= 1998 THEN failure ELSE 0 END) >= 1")
def smp_14_models_in_both(spark, sf_dir):
    return sampling.in_both(drive_days(spark, sf_dir), "model", "failure", F.year("date") < 1998)


@query(f"SELECT CAST(f AS INTEGER) AS percent, {N} AS n FROM pr JOIN (SELECT unnest([10, 30, 100]) AS f) g ON {ID} % 100 < g.f GROUP BY 1")
def smp_16_learning_fractions(spark, sf_dir):
    return sampling.learning_fractions(predictions(spark, sf_dir), F.col("id"), (10, 30, 100))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY collection_id, instance_index ORDER BY time, event_id) AS r FROM ie WHERE type = 3) WHERE r = 1")
def smp_17_first_attempts(spark, sf_dir):
    return sampling.first_attempts(instance_events(spark, sf_dir).where("type = 3"), K, ["time", "event_id"]).select("event_id")


# conflicts

_INST = "inst AS (SELECT collection_id, instance_index, max(cpu_request) AS cpu_request, max(memory_request) AS memory_request, arg_min(priority, time) AS submit_priority, max(CASE WHEN type IN (5, 8) THEN 1 ELSE 0 END) AS failed, max(CASE WHEN type IN (4, 5, 6, 7, 8) THEN 1 ELSE 0 END) AS has_terminal FROM ie GROUP BY 1, 2)"
_RC = f"""WITH {_INST}, stay AS (SELECT collection_id, instance_index, machine_id, CAST(floor(min(start_time) / {DAY_US}) AS BIGINT) AS lo, CAST(floor(max(end_time) / {DAY_US}) AS BIGINT) AS hi FROM us GROUP BY 1, 2, 3),
 r AS (SELECT s.*, unnest(range(lo, least(hi, lo + 288) + 1)) AS w FROM stay s), qs AS (SELECT DISTINCT collection_id, instance_index, w FROM r),
 pr_ AS (SELECT q.collection_id, q.instance_index, q.w, count(*) FILTER (WHERE h.type IN (5, 8)) AS pf, count(*) FILTER (WHERE h.type = 0) AS ps FROM qs q LEFT JOIN ie h ON h.collection_id = q.collection_id AND h.instance_index = q.instance_index AND h.time < q.w * {DAY_US} GROUP BY 1, 2, 3),
 g AS (SELECT machine_id, w, count(*) AS n, sum(cpu_request) AS sc, sum(memory_request) AS sm, max(cpu_request) AS xc, max(memory_request) AS xm, avg(submit_priority) AS mp, max(submit_priority) AS xp, avg(CAST(submit_priority >= 360 AS INTEGER)) AS fp,
   CAST(sum(pf) AS BIGINT) AS pft, max(pf) AS pfx, avg(CAST(pf > 0 AS INTEGER)) AS fpf, avg(ps) AS psm, sum(failed) AS nf, sum(has_terminal) AS nt FROM r JOIN inst USING (collection_id, instance_index) JOIN pr_ USING (collection_id, instance_index, w) GROUP BY 1, 2),
 c AS (SELECT machine_id, max(capacity_cpus) AS cc, max(capacity_memory) AS cm FROM me GROUP BY 1)
"""


@query(_RC + f"""SELECT 'rc_' || machine_id || '_' || w AS conflict_id, machine_id, w * {DAY_US} AS start_time, n AS n_concurrent, round(sc, 4) AS sum_cpu_request, round(sm, 4) AS sum_memory_request, xc AS max_cpu_request, xm AS max_memory_request,
 round(sc / cc, 6) AS cpu_oversub_ratio, round(sm / cm, 6) AS memory_oversub_ratio, cc AS capacity_cpus, cm AS capacity_memory, round(mp, 6) AS mean_priority, xp AS max_priority, round(fp, 6) AS frac_production, pft AS prior_fail_total, pfx AS prior_fail_max,
 round(fpf, 6) AS frac_with_prior_fail, round(psm, 6) AS prior_resub_mean, CAST(nf = 0 AS INTEGER) AS resolution_outcome FROM g JOIN c USING (machine_id) WHERE n >= 2 AND nt >= 1 AND (sc / cc > 1 OR sm / cm > 1)""")
def lbl_01_resource_contention(spark, sf_dir):
    r = conflicts.resource_contention(instance_usage(spark, sf_dir), instance_events(spark, sf_dir), machine_events(spark, sf_dir), window=DAY_US)
    r = rounded(r, "cpu_oversub_ratio", "memory_oversub_ratio", "mean_priority", "frac_production", "frac_with_prior_fail", "prior_resub_mean")
    return rounded(r, "sum_cpu_request", "sum_memory_request", places=4).drop("group_key", "conflict_type", "end_time")


_PI = f"""m AS (SELECT e.*, CASE WHEN r.time - e.time <= {HOUR} THEN r.priority END AS rp FROM (SELECT * FROM ie WHERE type = 4) e ASOF LEFT JOIN (SELECT * FROM ie WHERE type = 3) r ON e.machine_id = r.machine_id AND e.time <= r.time),
 mp AS (SELECT m.*, (SELECT count(*) FROM ie h WHERE h.collection_id = m.collection_id AND h.instance_index = m.instance_index AND h.time < m.time AND h.type IN (5, 8)) AS pf FROM m WHERE priority > rp)"""


@query(f"""WITH {_INST}, {_PI} SELECT 'pi_' || machine_id || '_' || collection_id || '_' || instance_index || '_' || time AS conflict_id, priority AS evicted_priority, rp AS replacing_priority, priority - rp AS priority_gap, scheduling_class AS evicted_scheduling_class,
 CAST(priority >= 360 AS INTEGER) AS evicted_is_production, CAST(pf > 0 AS INTEGER) AS evicted_has_prior_fail, pf AS evicted_prior_fail, CAST(failed = 0 AS INTEGER) AS resolution_outcome FROM mp JOIN inst USING (collection_id, instance_index)""")
def lbl_02_priority_inversion(spark, sf_dir):
    p = conflicts.priority_inversion(instance_events(spark, sf_dir), HOUR)
    return p.select("conflict_id", "evicted_priority", "replacing_priority", "priority_gap", "evicted_scheduling_class", "evicted_is_production", "evicted_has_prior_fail", "evicted_prior_fail", "resolution_outcome")


_SV = f"""sv AS (SELECT a.*, CAST(coalesce(b.er, 0) <= 0.5 AND coalesce(b.fr, 0) <= 0.25 AS INTEGER) AS calm FROM x a LEFT JOIN x b ON b.collection_id = a.collection_id AND b.w = a.w + 1 WHERE a.n_schedule >= 2 AND (a.er > 0.5 OR a.fr > 0.25))"""
_SX = f"""g2 AS (SELECT collection_id, CAST(floor(time / {6 * HOUR}) AS BIGINT) AS w, count(*) FILTER (WHERE type = 3) AS n_schedule, count(*) FILTER (WHERE type = 4) AS n_evict, count(*) FILTER (WHERE type IN (5, 8)) AS n_fail FROM ie GROUP BY 1, 2),
 x AS (SELECT *, n_evict / greatest(n_schedule, 1) AS er, n_fail / greatest(n_schedule, 1) AS fr FROM g2)"""


@query(_RC.rstrip() + f""", {_PI}, {_SX}, {_SV}
SELECT 'rc_' || machine_id || '_' || w AS conflict_id, 'm_' || machine_id AS group_key, 'resource_contention' AS conflict_type, machine_id, w * {DAY_US} AS start_time, (w + 1) * {DAY_US} AS end_time, CAST(nf = 0 AS INTEGER) AS resolution_outcome, n AS n_concurrent, CAST(NULL AS BIGINT) AS priority_gap, CAST(NULL AS BIGINT) AS n_evict
  FROM g JOIN c USING (machine_id) WHERE n >= 2 AND nt >= 1 AND (sc / cc > 1 OR sm / cm > 1)
UNION ALL SELECT 'pi_' || machine_id || '_' || collection_id || '_' || instance_index || '_' || time, 'i_' || collection_id || '_' || instance_index, 'priority_inversion', machine_id, time, time + {HOUR}, CAST(failed = 0 AS INTEGER), NULL, priority - rp, NULL FROM mp JOIN inst USING (collection_id, instance_index)
UNION ALL SELECT 'sv_' || collection_id || '_' || w, 'c_' || collection_id, 'scheduling_violation', NULL, w * {6 * HOUR}, (w + 1) * {6 * HOUR}, calm, NULL, NULL, n_evict FROM sv""")
def lbl_04_pooled(spark, sf_dir):
    ev = instance_events(spark, sf_dir)
    frames = conflicts.resource_contention(instance_usage(spark, sf_dir), ev, machine_events(spark, sf_dir), DAY_US), conflicts.priority_inversion(ev, HOUR), conflicts.scheduling_violations(ev, 6 * HOUR, 2)
    return conflicts.pooled(*frames).select(*conflicts.ENVELOPE, "n_concurrent", "priority_gap", "n_evict")


_IN = f"{md5('CAST(machine_id AS VARCHAR)')} % 10 < 3"


@query(f"""SELECT 'machine_events' AS pull, {N} AS n, CAST(sum(event_id) AS BIGINT) AS s FROM ie WHERE {_IN} UNION ALL SELECT 'residency', count(*), CAST(sum(lo) AS BIGINT) FROM (SELECT min(start_time) AS lo FROM us WHERE {_IN} GROUP BY collection_id, instance_index, machine_id)
UNION ALL SELECT 'collection_events', count(*), CAST(sum(event_id) AS BIGINT) FROM ie WHERE collection_id IN (SELECT collection_id FROM us WHERE {_IN}) UNION ALL SELECT 'capacity', count(*), CAST(sum(machine_id) AS BIGINT) FROM (SELECT DISTINCT machine_id FROM me WHERE {_IN})""")
def lbl_05_scoped_pull(spark, sf_dir):
    pulls = conflicts.scoped_pulls(instance_events(spark, sf_dir), instance_usage(spark, sf_dir), machine_events(spark, sf_dir), 10, 3)
    key, out = {"machine_events": "event_id", "residency": "lo", "collection_events": "event_id", "capacity": "machine_id"}, None
    for name, d in pulls.items():
        one = d.agg(F.count("*").alias("n"), F.sum(F.col(key[name]).cast("decimal(19,0)")).cast("decimal(38,0)").alias("s")).select(F.lit(name).alias("pull"), "n", "s")
        out = one if out is None else out.union(one)
    rows = [(r["pull"], r["n"], r["s"]) for r in out.collect()]  # one row per pull
    # sums are longs, as in the SQL; the SQL has no result where one of them doesn't fit, and there they are decimals
    if any(s is not None and abs(s) >= 2**63 for _, _, s in rows):
        return spark.createDataFrame(rows, out.schema)
    return spark.createDataFrame([(p, n, None if s is None else int(s)) for p, n, s in rows], "pull string, n long, s long")


# metrics and tests

_MONTHS = "(SELECT v, CAST(row_number() OVER (ORDER BY m) - 1 AS BIGINT) AS i FROM (SELECT strftime(day, '%Y-%m') AS m, avg(y_score) AS v FROM pr GROUP BY 1))"


def _months(spark, sf_dir):
    """A value a month, with its index: months since the first."""
    m = predictions(spark, sf_dir).groupBy(F.date_format("day", "yyyy-MM").alias("m")).agg(F.avg("y_score").alias("v"))
    return temporal.running_totals(m, F.translate("m", "-", "").cast("int"), {"i": F.lit(1)}).withColumn("i", F.col("i") - 1)


@query(f"SELECT round(covar_pop(v, i) / var_pop(i), 9) AS slope FROM {_MONTHS}")
def met_06_slope(spark, sf_dir):
    return rounded(metrics.slope_over(_months(spark, sf_dir), "i", "v"), "slope", places=9)


@query(f"SELECT CAST(coalesce(min(CASE WHEN v < r * 0.99 THEN i END), max(i) + 1) AS BIGINT) AS periods FROM (SELECT i, v, first_value(v) OVER (ORDER BY i) AS r FROM {_MONTHS})")
def met_09_sustainment(spark, sf_dir):
    return metrics.sustainment(_months(spark, sf_dir), "i", "v", 0.99)


@query("SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM (SELECT tp * k AS tp, fn * k AS fn, tn, fp FROM (SELECT *, 0.1 * (tn + fp) / 0.9 / (tp + fn) AS k FROM (SELECT count(*) FILTER (WHERE y_true = 1 AND y_score >= 0.5)::DOUBLE AS tp, count(*) FILTER (WHERE y_true = 1 AND y_score < 0.5)::DOUBLE AS fn, count(*) FILTER (WHERE y_true = 0 AND y_score < 0.5)::DOUBLE AS tn, count(*) FILTER (WHERE y_true = 0 AND y_score >= 0.5)::DOUBLE AS fp FROM pr)))")
def met_10_fixed_prevalence(spark, sf_dir):
    return rounded(metrics.mcc_at_prevalence(predictions(spark, sf_dir).withColumn("p", (F.col("y_score") >= 0.5).cast("int")), "y_true", "p", 0.1), "mcc")


@query("""SELECT name, round(auc, 6) AS auc, CASE WHEN auc >= 0.5 THEN 1 ELSE -1 END AS direction FROM (SELECT name, (r1 - n1 * (n1 + 1) / 2) / (n1 * n0) AS auc FROM (SELECT name, sum(CASE WHEN y = 1 THEN rk ELSE 0 END) AS r1, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n0
 FROM (SELECT name, y, rank() OVER (PARTITION BY name ORDER BY v) + (count(*) OVER (PARTITION BY name, v) - 1) / 2.0::DOUBLE AS rk FROM (SELECT 'y_score' AS name, y_score AS v, y_true AS y FROM pr UNION ALL SELECT 'entity', entity::DOUBLE, y_true FROM pr)) GROUP BY 1))""")
def met_13_univariate_auc(spark, sf_dir):
    return rounded(metrics.univariate_auc(predictions(spark, sf_dir), "y_true", ["y_score", "entity"]), "auc")


_IV = "SELECT {by} avg(y_score) AS m, 1.959963984540054 * stddev_samp(y_score) / sqrt(count(*)) AS h FROM pr"


@query(f"SELECT entity, CAST(m - h > 0.5 AS INTEGER) AS reject FROM ({_IV.format(by='entity,')} GROUP BY 1)")
def hyp_01_interval_test(spark, sf_dir):
    i = metrics.mean_interval(predictions(spark, sf_dir), "y_score", ["entity"])
    return i.select("entity", metrics.beats(F.col("low"), F.col("high"), 0.5).alias("reject"))


@query("SELECT round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d FROM (SELECT avg(y_score) FILTER (WHERE y_true = 1) AS m1, avg(y_score) FILTER (WHERE y_true = 0) AS m0, var_samp(y_score) FILTER (WHERE y_true = 1) AS v1, var_samp(y_score) FILTER (WHERE y_true = 0) AS v0, count(*) FILTER (WHERE y_true = 1) AS n1, count(*) FILTER (WHERE y_true = 0) AS n0 FROM pr)")
def hyp_03_cohens_d(spark, sf_dir):
    return rounded(metrics.effect_size(predictions(spark, sf_dir), "y_score", "y_true"), "d")


@query(f"SELECT a.entity, CAST(a.m - a.h <= r.m + r.h AND r.m - r.h <= a.m + a.h AS INTEGER) AS overlaps FROM ({_IV.format(by='entity,')} GROUP BY 1) a CROSS JOIN ({_IV.format(by='')}) r")
def hyp_07_overlap(spark, sf_dir):
    pr = predictions(spark, sf_dir)
    ref = metrics.mean_interval(pr, "y_score").select(F.col("low").alias("ref_low"), F.col("high").alias("ref_high"))
    i = metrics.mean_interval(pr, "y_score", ["entity"]).crossJoin(F.broadcast(ref))
    return i.select("entity", metrics.overlaps(F.col("low"), F.col("high"), F.col("ref_low"), F.col("ref_high")).alias("overlaps"))


@query("""WITH a AS (SELECT DISTINCT machine_id FROM ie), b AS (SELECT DISTINCT type FROM ie), c AS (SELECT a.machine_id, b.type, count(e.event_id)::DOUBLE AS n FROM a CROSS JOIN b LEFT JOIN ie e ON e.machine_id = a.machine_id AND e.type = b.type GROUP BY 1, 2),
 d AS (SELECT n, sum(n) OVER (PARTITION BY machine_id) * sum(n) OVER (PARTITION BY type) / sum(n) OVER () AS e FROM c) SELECT round(sum((n - e) * (n - e) / e), 6) AS chi2, ((SELECT count(*) FROM a) - 1) * ((SELECT count(*) FROM b) - 1) AS df FROM d""")
def hyp_08_chi_square(spark, sf_dir):
    return rounded(metrics.chi_square(instance_events(spark, sf_dir), "machine_id", "type"), "chi2")


# assertions


def assertion(name: str, measured: str, passes: str, run, head: str = ""):
    """A query of one row for an assertion: what it has measured, and whether it holds."""

    def f(spark, sf_dir):
        log = quality.CheckLog()
        seen = []
        ok = log.run(name, "", lambda: seen.append(run(spark, sf_dir)) or seen[0])
        value = log.rows[0][2]
        return spark.createDataFrame([(None if value == "None" else round(float(value), 9), "PASS" if ok else "FAIL")], "observed double, status string")

    f.__name__ = name
    query(f"WITH {head}m AS (SELECT {measured}) SELECT round(CAST(v AS DOUBLE), 9) AS observed, CASE WHEN {passes} THEN 'PASS' ELSE 'FAIL' END AS status FROM m")(f)


def _labelled(spark, sf_dir):
    return instance_events(spark, sf_dir).withColumn("label", exprs.failure_label(F.col("type")))


_LABEL = "(CASE WHEN type IN (5, 8) THEN 1 WHEN type = 6 THEN 0 END)"
assertion("dq_01_class_balance", "avg(y_true) AS v FROM pr", "abs(v - 0.33) <= 0.1", lambda s, d: quality.class_balance(predictions(s, d), "y_true", 0.33, 0.1))
assertion("dq_02_null_rate", "avg(CAST(cycles_per_instruction IS NULL AS INTEGER)) AS v FROM us", "abs(v - 0.2) <= 0.05", lambda s, d: quality.null_rate(instance_usage(s, d), "cycles_per_instruction", 0.2, 0.05))
assertion("dq_03_inversion", "median(cpu_request) FILTER (WHERE type = 6) - median(cpu_request) FILTER (WHERE type = 5) AS v FROM ie", "v > 0", lambda s, d: quality.inversion(_labelled(s, d).where("label is not null"), "cpu_request", "label"))
assertion("dq_04_monitoring", f"count(*) FILTER (WHERE type = 4 AND priority >= 360 AND {_LABEL} IS NOT NULL) AS v FROM ie", "v = 0", lambda s, d: quality.monitoring_unlabelled(_labelled(s, d), "type", "priority", "label"))
assertion("dq_05_row_count", "count(*) AS v FROM ie", "v BETWEEN 1 AND 1000000000", lambda s, d: quality.row_count(instance_events(s, d), 1, 1_000_000_000))
assertion("dq_06_failure_events", "count(*) AS v FROM ie WHERE type IN (5, 8)", "abs(v - 2000) <= 0.5 * 2000", lambda s, d: quality.event_count(instance_events(s, d), F.col("type").isin(5, 8), 2000, 0.5))
assertion("dq_07_one_row_per_day", "coalesce(sum(n - 1), 0) AS v FROM (SELECT count(*) AS n FROM dd GROUP BY serial_number, date)", "v = 0", lambda s, d: quality.one_row_per(drive_days(s, d), ["serial_number", "date"]))
assertion("dq_08_era_complete", "count(*) AS v FROM dd WHERE era NOT IN ('early', 'middle') OR era IS NULL", "v = 0", lambda s, d: quality.eras_complete(drive_days(s, d), "era", ("early", "middle")))
assertion("dq_09_expansion", "count(DISTINCT CASE WHEN date >= DATE '1995-03-01' THEN serial_number END) - count(DISTINCT CASE WHEN date < DATE '1995-03-01' THEN serial_number END) AS v FROM dd", "v > 0", lambda s, d: quality.grows(drive_days(s, d), "serial_number", "date", dt.date(1995, 3, 1)))
assertion("dq_11_leakage_guard", "count(*) FILTER (WHERE sched_seq = 1 AND pc > 0) AS v FROM h", "v = 0", lambda s, d: quality.first_attempts_clean(lifecycle.with_history(lifecycle.episodes(instance_events(s, d))), "sched_seq", ["prior_episode_count", "prior_fail_count", "prior_evict_count"]), f"{EPISODES}, h AS (SELECT sched_seq, count(*) OVER (PARTITION BY collection_id, instance_index ORDER BY sched_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pc FROM ep), ")
assertion("dq_12_disjoint", f"count(*) AS v FROM (SELECT DISTINCT entity FROM pr WHERE {md5('CAST(entity AS VARCHAR)')} % 20 < 14) a JOIN (SELECT DISTINCT entity FROM pr WHERE {md5('CAST(entity AS VARCHAR)')} % 20 >= 17) b USING (entity)", "v = 0", lambda s, d: (lambda x: quality.disjoint(x.where("split = 'train'"), x.where("split = 'test'"), ["entity"]))(sampling.group_split(predictions(s, d), F.col("entity"))))
assertion("dq_13_schema_parity", "9 AS v", "v = 9", lambda s, d: quality.same_schema(drive_days(s, d).where("failure = 1"), drive_days(s, d).where("failure = 0")))
assertion("dq_14_labels", f"count(*) FILTER (WHERE type IN (4, 5, 6, 8) AND {_LABEL} IS NULL) AS v FROM ie", "v = 0", lambda s, d: quality.labels_complete(_labelled(s, d), "type", "label", (4, 5, 6, 8)))


@query("SELECT 'rows' AS \"check\", 'PASS' AS status UNION ALL SELECT 'era', 'FAIL'")
def dq_10_check_log(spark, sf_dir):
    log, dd = quality.CheckLog(), drive_days(spark, sf_dir)
    log.run("rows", ">0", lambda: quality.row_count(dd, 1, 2**62))
    log.run("era", "early only", lambda: quality.eras_complete(dd, "era", ("early",)))
    return log.frame(spark).select("check", "status")


# models


@query("SELECT y_true, round(n / (2.0::DOUBLE * c), 9) AS weight FROM (SELECT y_true, count(*)::DOUBLE AS c FROM pr GROUP BY 1) CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM pr)")
def mod_12_class_weights(spark, sf_dir):
    from tracelens.models.batch import class_weights

    return rounded(class_weights(predictions(spark, sf_dir), "y_true"), "weight", places=9)


_CELLS = "SELECT t, count(*) FILTER (WHERE y_score >= t AND y_true = 1)::DOUBLE AS tp, count(*) FILTER (WHERE y_score >= t AND y_true = 0)::DOUBLE AS fp, count(*) FILTER (WHERE y_score < t AND y_true = 1)::DOUBLE AS fn, count(*) FILTER (WHERE y_score < t AND y_true = 0)::DOUBLE AS tn FROM pr CROSS JOIN g GROUP BY 1"


@query(f"WITH g AS (SELECT DISTINCT unnest(quantile_cont(y_score, [(0.01 + 0.01 * i)::DOUBLE FOR i IN range(99)])) AS t FROM pr), c AS ({_CELLS}) SELECT t AS threshold, round(mcc, 6) AS mcc FROM (SELECT t, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM c) ORDER BY round(mcc, 9) DESC, t LIMIT 1")
def mod_16_threshold(spark, sf_dir):
    pr = predictions(spark, sf_dir)
    return rounded(metrics.best_threshold(pr, "y_true", "y_score", metrics.quantile_grid(pr, "y_score", 99, 0.01, 0.99)), "mcc")


@query(f"WITH g AS (SELECT DISTINCT unnest(quantile_cont(y_score, [(0.5 + 0.499 * i / 49)::DOUBLE FOR i IN range(50)])) AS t FROM pr), c AS ({_CELLS}) SELECT t AS threshold, round(tp / (tp + fn), 6) AS averted, round((tp + fp) / (tp + fp + tn + fn), 6) AS triggered FROM c ORDER BY round(tp / (tp + fn) - (tp + fp) / (tp + fp + tn + fn), 9) DESC, t LIMIT 1")
def mod_17_pareto_knee(spark, sf_dir):
    pr = predictions(spark, sf_dir)
    return rounded(metrics.pareto_knee(pr, "y_true", "y_score", metrics.quantile_grid(pr, "y_score", 50, 0.5, 0.999)), "averted", "triggered").drop("gain")


_SIM = f"""risk AS (SELECT machine_id, avg(CAST(type IN (5, 8) AS INTEGER)) AS risk FROM ie WHERE time < (SELECT quantile_cont(time, 0.5) FROM ie) AND type IN (5, 6, 8) GROUP BY 1 HAVING count(*) >= 20),
 a AS (SELECT CAST(floor(start_time / {DAY_US}) AS BIGINT) AS w, avg_cpu AS used, avg_cpu + avg_memory AS alloc, (event_id * 37 % 101) / 101 AS score, coalesce(risk, 0) >= (SELECT quantile_cont(risk, 0.75) FROM risk) AS high FROM us LEFT JOIN risk USING (machine_id)),
 k AS (SELECT *, score < 0.8 AS keep_migrate, score < 0.5 AS keep_admit, NOT (score >= 0.8 AND coalesce(high, FALSE)) AS keep_pack FROM a), b AS (SELECT w, sum(used) / sum(alloc) AS e FROM k GROUP BY 1 HAVING sum(alloc) > 0)"""
_GAIN = "SELECT '{0}' AS strategy, count(*) AS windows, round(avg(CAST(s.e / b.e - 1 > 0 AS INTEGER)), 6) AS improved, round(quantile_cont(s.e / b.e - 1, 0.5), 6) AS median_gain, (SELECT round(sum(CASE WHEN NOT {0} THEN alloc ELSE 0 END) / sum(alloc), 6) FROM k) AS reclaimed FROM b JOIN (SELECT w, sum(used) / sum(alloc) AS e FROM k WHERE {0} GROUP BY 1 HAVING sum(alloc) > 0) s USING (w) WHERE b.e > 0"


@query(f"WITH {_SIM} " + " UNION ALL ".join(_GAIN.format(x) for x in ("keep_migrate", "keep_admit", "keep_pack")))
def mod_21_strategies(spark, sf_dir):
    ev = instance_events(spark, sf_dir)
    middle = ev.agg(F.percentile("time", 0.5).alias("t")).first()["t"] or 0
    u = instance_usage(spark, sf_dir).select("machine_id", F.floor(F.col("start_time") / DAY_US).alias("w"), F.col("avg_cpu").alias("used"), (F.col("avg_cpu") + F.col("avg_memory")).alias("alloc"), (F.col("event_id") * 37 % 101 / 101).alias("score"))
    kept = strategies.strategies(u, strategies.machine_risk(ev, middle), "score", 0.8, 0.5)
    names = ("keep_migrate", "keep_admit", "keep_pack")
    return rounded(strategies.evaluate(kept, "w", "used", "alloc", {n: n for n in names}), "improved", "median_gain", "reclaimed")


@query(f"SELECT id, 1.0::DOUBLE AS in_range FROM pr WHERE {ID} % 10 >= 7")
def mod_07_soft_vote(spark, sf_dir):
    from tracelens.models.batch import fit_model, soft_vote

    pr = predictions(spark, sf_dir).withColumn("x2", (F.col("entity") % 7).cast("double"))
    train, test = (pr.where(exprs.hash_bucket(F.col("id"), 10) < 7), pr.where(exprs.hash_bucket(F.col("id"), 10) >= 7))
    ms = [fit_model(n, train, ["y_score", "x2"], "y_true") for n in ("logistic", "decision_tree")]
    return soft_vote(ms, [2.0, 1.0], test, "vote").select("id", F.col("vote").between(0, 1).cast("double").alias("in_range"))


# streams


def _shifted(spark, sf_dir):
    """A 0/1 loss per machine whose rate jumps half-way through its events."""
    from pyspark.sql import Window

    w = Window.partitionBy("machine_id").orderBy("time", "event_id")
    e = instance_events(spark, sf_dir).select("machine_id", "time", "event_id", F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("machine_id")).alias("n"))
    chance = exprs.hash_unit(F.col("event_id"))
    return e.withColumn("loss", (chance < F.when(F.col("i") * 2 > F.col("n"), 0.8).otherwise(0.1)).cast("double"))


@query()
def str_06_adwin_replay(spark, sf_dir):
    from tracelens.streaming.stream import replay_detector

    return replay_detector(_shifted(spark, sf_dir), "machine_id", ["time", "event_id"], "loss", "adwin")


#: The detector's recursion, row by row in SQL: s is (n, mean, total, low, drift) behind each row.
@query("""WITH RECURSIVE e AS (SELECT machine_id AS key, row_number() OVER (PARTITION BY machine_id ORDER BY time, event_id) AS i, cpu_request AS x FROM ie),
s AS (SELECT key, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS total, CAST('inf' AS DOUBLE) AS low, FALSE AS drift FROM (SELECT DISTINCT key FROM e)
UNION ALL SELECT key, i, CASE WHEN d THEN 0 ELSE n END, CASE WHEN d THEN 0 ELSE mean END, CASE WHEN d THEN 0 ELSE total END, CASE WHEN d THEN CAST('inf' AS DOUBLE) ELSE low END, d FROM (
 SELECT *, n >= 30 AND total - low > 500 AS d FROM (SELECT key, i, n, mean, total, least(low, total) AS low FROM (
  SELECT key, i, n, mean, 0.9999 * total + x - mean - 0.01 AS total, low FROM (SELECT s.key, e.i, s.n + 1 AS n, s.mean + (e.x - s.mean) / (s.n + 1) AS mean, s.total, s.low, e.x FROM s JOIN e ON e.key = s.key AND e.i = s.i + 1)))))
SELECT CAST(key AS VARCHAR) AS key, i - 1 AS idx FROM s WHERE drift""")
def str_07_page_hinkley_replay(spark, sf_dir):
    from tracelens.streaming.stream import replay_detector

    return replay_detector(instance_events(spark, sf_dir), "machine_id", ["time", "event_id"], "cpu_request", "page_hinkley", threshold=500.0)


@query()
def str_05_prequential(spark, sf_dir):
    from tracelens.streaming.stream import prequential

    pr = predictions(spark, sf_dir).withColumns({"month": F.date_format("day", "yyyy-MM"), "k": F.col("entity") % 4, "lateness": (F.col("id") % 7).cast("double")})
    return prequential(pr, "k", "month", ["day", "id"], ["y_score", "lateness"], "y_true", "vote", "page_hinkley")


@query()
def str_12_covariate_scan(spark, sf_dir):
    from tracelens.streaming.stream import covariate_scan

    d = drive_days(spark, sf_dir).withColumn("shifted", F.col("smart_197_raw") + F.when(F.col("date") >= dt.date(1998, 1, 1), 30).otherwise(0))
    return covariate_scan(d, ["smart_197_raw", "shifted"], "date", dt.date(1995, 12, 31), "ks", "serial_number", dt.date(1998, 1, 1), window_size=200, test_every=50)


_SHARE = "SELECT strftime(date, '%Y-%m') AS month, {c} FROM dd GROUP BY 1"


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", min(month) FILTER (WHERE s < 0.5) AS month, round(arg_min(s, month) FILTER (WHERE s < 0.5), 6) AS share FROM ({_SHARE.format(c=f'avg(CAST({c} IS NOT NULL AS INTEGER)) AS s')})" for c in ("smart_187_raw", "smart_5_raw")))
def str_13_availability(spark, sf_dir):
    from tracelens.streaming.stream import availability

    return rounded(availability(drive_days(spark, sf_dir), "date", ["smart_187_raw", "smart_5_raw"]), "share")


@query("SELECT CASE WHEN event_type = 'error' THEN 'adwin' ELSE 'ks' END AS detector, strftime(ts, '%Y-%m') AS month, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2")
def str_17_events_by_month(spark, sf_dir):
    from tracelens.streaming.stream import events_by_month

    e = load(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    return events_by_month(e.withColumn("detector", F.when(F.col("event_type") == "error", "adwin").otherwise("ks")), "detector", "ts")
