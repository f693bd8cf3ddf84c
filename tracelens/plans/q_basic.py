"""Projections, filters, aggregates, joins, windows and reshaping in SQL that both engines read."""

from __future__ import annotations

from tracelens.plans.registry import both

BAND = "CASE WHEN priority <= 99 THEN 'free' WHEN priority <= 115 THEN 'best_effort' WHEN priority <= 119 THEN 'mid' WHEN priority <= 359 THEN 'production' WHEN priority >= 360 THEN 'monitoring' ELSE 'unknown' END"
N = "CAST(count(*) AS BIGINT)"


def pct(sql: str) -> str:
    """Spark's percentile() in DuckDB's spelling."""
    return sql.replace("percentile(", "quantile_cont(")


both("prj_01_sentinel_filter", "SELECT event_id, time FROM ie WHERE time > 0 AND time < 9223372036854775807")
both("prj_02_drop_null_requests", "SELECT event_id FROM us WHERE avg_cpu IS NOT NULL AND cycles_per_instruction IS NOT NULL")
both("prj_04_indicators", "SELECT event_id, CASE WHEN cycles_per_instruction IS NOT NULL THEN 1 ELSE 0 END AS has_cpi_value, CASE WHEN memory_accesses_per_instruction IS NOT NULL THEN 1 ELSE 0 END AS has_mapi_value FROM us")
both("prj_07_suffix_map", "SELECT platform_id, CAST(dense_rank() OVER (ORDER BY platform_id) - 1 AS BIGINT) AS suffix FROM (SELECT DISTINCT platform_id FROM me) p")
both("prj_08_drop_keep", "SELECT * EXCEPT (cpu_request, memory_request, type) FROM ie", "SELECT * EXCLUDE (cpu_request, memory_request, type) FROM ie")
both("prj_09_model_filter", "SELECT serial_number, date FROM dd WHERE model NOT IN ('Brand#1', 'Brand#2')")
both("prj_10_model_regex", "SELECT model, CAST(count(*) AS BIGINT) AS n FROM dd WHERE regexp_like(model, '(?i)brand#1.') GROUP BY model", "SELECT model, CAST(count(*) AS BIGINT) AS n FROM dd WHERE regexp_matches(model, '(?i)brand#1.') GROUP BY model")
both("prj_11_era", "SELECT serial_number, date, CASE WHEN date BETWEEN DATE '1990-01-01' AND DATE '1996-12-31' THEN 'early' WHEN date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31' THEN 'middle' WHEN date BETWEEN DATE '2000-01-01' AND DATE '2001-06-30' THEN 'late' ELSE 'unknown' END AS era_label FROM dd")
both("prj_13_manufacturer", "SELECT p_partkey, CASE WHEN name LIKE 'ECO%' THEN 'Economy' WHEN name LIKE 'PRO%' THEN 'Promo' WHEN name LIKE 'STA%' THEN 'Standard' ELSE 'Other' END AS manufacturer FROM (SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'STANDARD' ELSE p_type END AS name FROM part) x")
both("prj_14_historical", "SELECT collection_id, instance_index, greatest(n_fail - CASE WHEN last_type = 5 THEN 1 ELSE 0 END, 0) AS prior_fail, CASE WHEN n_submit > 1 THEN 1 ELSE 0 END AS is_resubmitted, CASE WHEN n_fail - CASE WHEN last_type = 5 THEN 1 ELSE 0 END > 0 THEN 1 ELSE 0 END AS has_prior_fail FROM (SELECT collection_id, instance_index, CAST(count(*) FILTER (WHERE type = 5) AS BIGINT) AS n_fail, count(*) FILTER (WHERE type = 0) AS n_submit, max_by(type, time) AS last_type FROM ie GROUP BY 1, 2) x")
both("prj_15_position", "SELECT collection_id, instance_index, round(CASE WHEN size > 0 THEN CAST(instance_index AS DOUBLE) / size END, 6) AS lifecycle_position FROM (SELECT collection_id, instance_index, count(*) OVER (PARTITION BY collection_id) AS size FROM (SELECT DISTINCT collection_id, instance_index FROM ie) a) b")
both("prj_16_safe_ratio", "SELECT event_id, round(cpu_request / nullif(CAST(scheduling_class AS DOUBLE), 0), 6) AS ratio FROM ie")
both("prj_17_counter_default", "SELECT event_id, coalesce(cycles_per_instruction, 0) AS cpi FROM us")
both("prj_18_era_available", "SELECT era, CASE WHEN era IN ('middle') THEN 1 ELSE 0 END AS has_187, CAST(count(*) AS BIGINT) AS n FROM dd GROUP BY 1, 2")
both("prj_19_predicates", "SELECT event_id FROM ie WHERE type IN (3, 4) AND priority BETWEEN 120 AND 359 AND machine_id IS NOT NULL AND ((collection_id = 1 AND instance_index = 2) OR (collection_id = 3 AND instance_index = 4) OR collection_id > 15)")
both("prj_20_outcome", f"SELECT outcome, {N} AS n FROM (SELECT CASE WHEN terminal_type IN (5, 8) THEN 'FAIL_LOST' WHEN terminal_type = 6 THEN 'FINISH' WHEN terminal_type = 4 AND terminal_priority >= 360 THEN 'EVICT_MONITORING' WHEN terminal_type = 4 AND terminal_priority BETWEEN 120 AND 359 THEN 'EVICT_PRODUCTION' WHEN terminal_type = 4 THEN 'EVICT_LOWER' WHEN terminal_type = 7 THEN 'KILL' ELSE 'OTHER' END AS outcome FROM (SELECT max_by(type, time) AS terminal_type, max_by(priority, time) AS terminal_priority FROM ie GROUP BY collection_id, instance_index) a) b GROUP BY outcome")
both("prj_21_flags", "SELECT id, CASE WHEN y_score >= 0.5 THEN 1 ELSE 0 END AS flag_50, CASE WHEN y_score >= 0.75 THEN 1 ELSE 0 END AS flag_75 FROM pr")
both("joi_01_inner_equi", "SELECT i.event_id, m.platform_id FROM ie i JOIN (SELECT machine_id, min(platform_id) AS platform_id FROM me GROUP BY machine_id) m ON i.machine_id = m.machine_id")
both("joi_02_latest_dimension", "SELECT i.event_id, m.capacity_cpus, m.platform_id FROM ie i JOIN (SELECT machine_id, max_by(capacity_cpus, time) AS capacity_cpus, max_by(platform_id, time) AS platform_id FROM me GROUP BY machine_id) m ON i.machine_id = m.machine_id")
both("joi_03_left_backbone", "SELECT b.collection_id, a.n_fail, c.n_view FROM (SELECT DISTINCT collection_id FROM ie) b LEFT JOIN (SELECT collection_id, CAST(count(*) AS BIGINT) AS n_fail FROM ie WHERE type = 5 AND priority > 380 GROUP BY 1) a ON a.collection_id = b.collection_id LEFT JOIN (SELECT collection_id, CAST(count(*) AS BIGINT) AS n_view FROM ie WHERE type = 3 GROUP BY 1) c ON c.collection_id = b.collection_id")
both("joi_04_left_fill", "SELECT b.machine_id, coalesce(a.n, 0) AS n FROM (SELECT DISTINCT machine_id FROM ie) b LEFT JOIN (SELECT machine_id, CAST(count(*) AS BIGINT) AS n FROM ie WHERE priority = 396 AND type = 6 GROUP BY 1) a ON a.machine_id = b.machine_id")
both("joi_05_left_semi", "SELECT i.event_id FROM ie i LEFT SEMI JOIN (SELECT machine_id FROM me WHERE platform_id = 'P1') m ON i.machine_id = m.machine_id", "SELECT i.event_id FROM ie i SEMI JOIN (SELECT machine_id FROM me WHERE platform_id = 'P1') m ON i.machine_id = m.machine_id")
both("joi_06_distinct_key_join", "SELECT i.event_id FROM ie i JOIN (SELECT DISTINCT collection_id, instance_index FROM ie WHERE type = 5 AND priority > 388) f ON i.collection_id = f.collection_id AND i.instance_index = f.instance_index")
both("joi_07_mark_join", "SELECT i.event_id, CASE WHEN m.machine_id IS NOT NULL THEN 1 ELSE 0 END AS marked FROM ie i LEFT JOIN (SELECT DISTINCT machine_id FROM me WHERE capacity_cpus > 403 AND machine_id < 5) m ON i.machine_id = m.machine_id")
both("joi_08_membership", "SELECT event_id FROM ie WHERE collection_id IN (SELECT collection_id FROM ie WHERE type = 5 AND priority > 392)")
both("joi_09_bounds", "SELECT i.event_id, CAST(floor((i.time - b.lo) / 86400000000) AS BIGINT) AS day, CASE WHEN i.time = b.hi THEN 1 ELSE 0 END AS is_last FROM ie i CROSS JOIN (SELECT min(time) AS lo, max(time) AS hi FROM ie) b")
both("joi_10_labelled_windows", f"SELECT w.label, {N} AS n, round(avg(i.cpu_request), 6) AS mean FROM (SELECT time, cpu_request, (SELECT min(time) FROM ie) AS lo FROM ie) i JOIN (SELECT 'day' AS label, 86400000000 AS size UNION ALL SELECT 'week', 604800000000 UNION ALL SELECT 'fortnight', 1209600000000) w ON i.time - i.lo < w.size GROUP BY w.label")
_BAND = "SELECT f.event_id, CAST(count(u.event_id) AS BIGINT) AS n, round(avg(u.avg_cpu), 6) AS mean FROM (SELECT event_id, collection_id, instance_index, time FROM ie WHERE type = {t}) f {j} JOIN us u ON u.collection_id = f.collection_id AND u.instance_index = f.instance_index AND {on} GROUP BY f.event_id"
both("joi_11_band_before", _BAND.format(t=5, j="LEFT", on="u.start_time >= f.time - 86400000000 AND u.start_time < f.time"))
both("joi_12_band_symmetric", _BAND.format(t=3, j="", on="u.start_time BETWEEN f.time - 21600000000 AND f.time + 21600000000"))
both("joi_13_band_after", _BAND.format(t=3, j="", on="u.start_time BETWEEN f.time AND f.time + 86400000000"))
both("joi_20_exact_event", "SELECT a.event_id, b.event_id AS usage_id FROM ie a JOIN us b ON a.collection_id = b.collection_id AND a.instance_index = b.instance_index AND a.time = b.start_time WHERE a.type = 3")
both("joi_21_encoding", "SELECT d.serial_number, d.date, coalesce(e.rate, g.rate) AS rate FROM dd d LEFT JOIN (SELECT model, round(avg(failure), 6) AS rate FROM dd WHERE year(date) < 1998 AND model > 'Brand#15' GROUP BY model) e ON e.model = d.model CROSS JOIN (SELECT round(avg(failure), 6) AS rate FROM dd WHERE year(date) < 1998) g WHERE year(d.date) >= 2001")
both("joi_22_pivot_join", "SELECT a.y, a.m, a.v AS mean, b.v AS top FROM (SELECT year(day) AS y, month(day) AS m, round(avg(y_score), 6) AS v FROM pr GROUP BY 1, 2) a LEFT JOIN (SELECT year(day) AS y, month(day) AS m, max(y_score) AS v FROM pr WHERE y_true = 1 GROUP BY 1, 2) b ON a.y = b.y AND a.m = b.m")
both("joi_23_baseline_strategy", "SELECT a.w, round(b.v - a.v, 6) AS gain FROM (SELECT CAST(floor(start_time / 3600000000) AS BIGINT) AS w, avg(avg_cpu) AS v FROM us GROUP BY 1) a JOIN (SELECT CAST(floor(start_time / 3600000000) AS BIGINT) AS w, avg(avg_cpu) AS v FROM us WHERE avg_memory < 100 GROUP BY 1) b ON a.w = b.w")
both("agg_01_basic", f"SELECT type, {N} AS n, round(sum(cpu_request), 4) AS total, round(avg(cpu_request), 6) AS mean, min(cpu_request) AS lo, max(cpu_request) AS hi FROM ie GROUP BY type")
both("agg_02_count_if", "SELECT machine_id, CAST(count(*) FILTER (WHERE type = 5) AS BIGINT) AS n_fail, CAST(count(*) FILTER (WHERE type = 6) AS BIGINT) AS n_finish FROM ie GROUP BY 1")
both("agg_03_conditional_min", "SELECT collection_id, instance_index, min(CASE WHEN type = 0 THEN time END) AS submit_time, max(CASE WHEN type = 3 THEN time END) AS last_schedule FROM ie GROUP BY 1, 2")
both("agg_04_arg_extremes", "SELECT collection_id, instance_index, max_by(type, time) AS last_type, min_by(priority, time) AS first_priority FROM ie GROUP BY 1, 2")
both("agg_05_first_match", "SELECT collection_id, instance_index, min_by(type, time) FILTER (WHERE type IN (4, 5, 6)) AS first_terminal FROM ie GROUP BY 1, 2")
both("agg_06_any_value", "SELECT machine_id, max(platform_id) AS any_platform FROM me GROUP BY 1")
both("agg_07_count_distinct", "SELECT CAST(count(DISTINCT collection_id) AS BIGINT) AS collections, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT collection_id, instance_index FROM ie) x) AS instances FROM ie")
both("agg_08_stddev", "SELECT collection_id, instance_index, machine_id, round(stddev_samp(avg_cpu), 6) AS sd FROM us GROUP BY 1, 2, 3")
_Q = "SELECT type, round(percentile(cpu_request, 0.25), 6) AS p25, round(percentile(cpu_request, 0.5), 6) AS p50, round(percentile(cpu_request, 0.99), 6) AS p99 FROM ie GROUP BY type"
both("agg_09_quantiles", _Q, pct(_Q))
both("agg_10_median", "SELECT machine_id, round(median(avg_cpu), 6) AS med FROM us GROUP BY 1")
both("agg_11_top_count", f"SELECT priority, n FROM (SELECT priority, n, row_number() OVER (ORDER BY n DESC, priority) AS r FROM (SELECT priority, {N} AS n FROM ie GROUP BY 1) a) b WHERE r <= 5")
both("agg_12_mode", "SELECT collection_id, mode(priority, true) AS top FROM ie GROUP BY 1", "SELECT collection_id, priority AS top FROM (SELECT collection_id, priority, row_number() OVER (PARTITION BY collection_id ORDER BY count(*) DESC, priority) AS r FROM ie GROUP BY 1, 2) a WHERE r = 1")
both("agg_13_ordered_strings", "SELECT collection_id, instance_index, listagg(CAST(type AS STRING), '>') WITHIN GROUP (ORDER BY time) AS path FROM ie GROUP BY 1, 2", "SELECT collection_id, instance_index, string_agg(CAST(type AS VARCHAR), '>' ORDER BY time) AS path FROM ie GROUP BY 1, 2")
both("agg_14_ols_slope", "SELECT collection_id, round((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0), 4) AS slope FROM (SELECT collection_id, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * y) AS sxy, sum(x * x) AS sxx FROM (SELECT collection_id, (start_time - (SELECT min(start_time) FROM us)) / 86400000000 AS x, avg_cpu AS y FROM us) a GROUP BY 1 HAVING count(*) >= 3) b")
both("agg_15_covar_slope", "SELECT collection_id, round(covar_pop(y, x) / nullif(var_pop(x), 0), 6) AS slope FROM (SELECT collection_id, (start_time - (SELECT min(start_time) FROM us)) / 86400000000 AS x, avg_cpu AS y FROM us) a WHERE x <= 10 GROUP BY 1")
both("agg_21_capacity_max", "SELECT machine_id, max(capacity_cpus) AS capacity_cpus, max(capacity_memory) AS capacity_memory FROM me GROUP BY 1")
both("agg_23_churn", "SELECT collection_id, w, n_schedule, n_evict, n_fail, round(n_evict / CAST(greatest(n_schedule, 1) AS DOUBLE), 6) AS evict_ratio, round(n_fail / CAST(greatest(n_schedule, 1) AS DOUBLE), 6) AS fail_ratio FROM (SELECT collection_id, CAST(floor(time / 86400000000) AS BIGINT) AS w, CAST(count(*) FILTER (WHERE type = 3) AS BIGINT) AS n_schedule, CAST(count(*) FILTER (WHERE type = 4) AS BIGINT) AS n_evict, CAST(count(*) FILTER (WHERE type IN (5, 8)) AS BIGINT) AS n_fail FROM ie GROUP BY 1, 2) a")
both("agg_24_percent_of_total", f"SELECT type, {N} AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM ie GROUP BY type", f"SELECT type, {N} AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS pct FROM ie GROUP BY type")
both("agg_25_having", f"SELECT collection_id, instance_index, {N} AS n FROM ie WHERE type = 5 GROUP BY 1, 2 HAVING count(*) >= 14")
both("agg_27_scalar_subqueries", "SELECT (SELECT CAST(count(*) AS BIGINT) FROM ie) AS n_ie, (SELECT CAST(count(*) AS BIGINT) FROM ie i JOIN us u ON i.event_id = u.event_id) AS n_joined, (SELECT CAST(count(*) AS BIGINT) FROM me) AS n_me")
both("agg_33_coverage", f"SELECT min(time) AS lo, max(time) AS hi, CAST(count(DISTINCT time) AS BIGINT) AS times, {N} AS n, round((max(time) - min(time)) / 86400000000, 6) AS days FROM ie")
both("agg_34_class_balance", "SELECT y_true, CAST(n AS BIGINT) AS n, round(n / CAST(min(n) OVER () AS DOUBLE), 6) AS imbalance FROM (SELECT y_true, count(*) AS n FROM pr GROUP BY 1) a")
both("agg_35_contingency", f"SELECT CASE WHEN cycles_per_instruction IS NULL THEN 'absent' ELSE 'present' END AS counter, CASE WHEN avg_cpu > 50 THEN 'high' ELSE 'low' END AS load, {N} AS n FROM us GROUP BY 1, 2")
both("agg_36_bucket_histogram", f"SELECT bucket, {N} AS n FROM (SELECT CASE WHEN cpu_request < 5 THEN '1: <5' WHEN cpu_request < 20 THEN '2: 5-20' WHEN cpu_request < 100 THEN '3: 20-100' ELSE '4: 100+' END AS bucket FROM ie) a GROUP BY bucket ORDER BY bucket")
both("agg_37_deciles", f"SELECT CAST(floor(y_score * 10) AS BIGINT) AS decile, {N} AS n, round(avg(y_true), 6) AS rate FROM pr GROUP BY 1")
both("agg_38_pivot", "SELECT * FROM (SELECT machine_id, type, event_id FROM ie) PIVOT (count(event_id) FOR type IN (0 AS t0, 3 AS t3, 5 AS t5))", "SELECT machine_id, count(*) FILTER (WHERE type = 0) AS t0, count(*) FILTER (WHERE type = 3) AS t3, count(*) FILTER (WHERE type = 5) AS t5 FROM ie GROUP BY 1")
_CENSUS = "SELECT y, q, id, CAST(count(v) AS BIGINT) AS present, CAST(count(*) AS BIGINT) AS n FROM (SELECT year(date) AS y, quarter(date) AS q, {u}) a GROUP BY 1, 2, 3"
both("agg_39_availability", _CENSUS.format(u="stack(3, 5, smart_5_raw, 187, smart_187_raw, 197, smart_197_raw) AS (id, v) FROM dd"), _CENSUS.format(u="unnest([5, 187, 197]) AS id, unnest([smart_5_raw, smart_187_raw, smart_197_raw]) AS v FROM dd"))
both("agg_41_time_to_failure", "SELECT d.serial_number, datediff(max(CASE WHEN failure = 1 THEN date END), min(date)) AS days FROM dd d LEFT SEMI JOIN (SELECT serial_number FROM dd WHERE failure = 1) f ON d.serial_number = f.serial_number GROUP BY 1", "SELECT d.serial_number, CAST(datediff('day', min(date), max(CASE WHEN failure = 1 THEN date END)) AS INTEGER) AS days FROM dd d SEMI JOIN (SELECT serial_number FROM dd WHERE failure = 1) f ON d.serial_number = f.serial_number GROUP BY 1")
both("agg_42_terminal", f"SELECT serial_number, min(date) AS first_date, max(date) AS last_date, max(failure) AS failure_observed, 1 - max(failure) AS censored, {N} AS n_obs FROM dd GROUP BY 1")
both("agg_46_ratio_of_sums", "SELECT machine_id, w, round(used / alloc, 6) AS efficiency FROM (SELECT machine_id, CAST(floor(start_time / 3600000000) AS BIGINT) AS w, sum(avg_cpu) AS used, sum(avg_memory) AS alloc FROM us GROUP BY 1, 2) a WHERE alloc > 0")
both("agg_47_risk_rate", f"SELECT machine_id, round(avg(CASE WHEN type = 5 THEN 1.0 ELSE 0.0 END), 4) AS risk, {N} AS n FROM ie GROUP BY 1 HAVING count(*) >= 20")
both("agg_49_first_flag", "SELECT a.collection_id, f.t - a.t AS lead FROM (SELECT collection_id, min(time) AS t FROM ie WHERE priority >= 360 GROUP BY 1) a JOIN (SELECT collection_id, min(time) AS t FROM ie WHERE type = 5 GROUP BY 1) f ON a.collection_id = f.collection_id")
both("agg_52_densities", f"SELECT CAST(floor(time / 3600000000) % 24 AS BIGINT) AS hour_of_day, CAST(floor(time / 86400000000) % 7 AS BIGINT) AS day_of_week, {N} AS n FROM ie GROUP BY 1, 2")
both("win_06_latest_row", "SELECT machine_id, platform_id, capacity_cpus FROM (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY time DESC) AS rn FROM me) a WHERE rn = 1")
both("win_07_repeat_ordinal", "SELECT event_id, CAST(row_number() OVER (PARTITION BY collection_id, instance_index, type ORDER BY time, event_id) AS BIGINT) AS ordinal FROM ie")
both("win_04_lead", "SELECT event_id, lead(time) OVER (PARTITION BY collection_id, instance_index ORDER BY time, event_id) AS next_time FROM ie")
both("win_05_lag", "SELECT event_id, lag(avg_cpu) OVER (PARTITION BY collection_id, instance_index ORDER BY start_time, event_id) AS prev_cpu, lag(avg_memory) OVER (PARTITION BY collection_id, instance_index ORDER BY start_time, event_id) AS prev_memory FROM us")
both("win_08_forward_mean", "SELECT event_id, round(avg(avg_cpu) OVER (PARTITION BY collection_id, instance_index ORDER BY start_time, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 6) AS m FROM us")
both("win_09_share", "SELECT type, machine_id, round(n / CAST(sum(n) OVER () AS DOUBLE), 8) AS of_all, round(n / CAST(sum(n) OVER (PARTITION BY type) AS DOUBLE), 8) AS of_type FROM (SELECT type, machine_id, count(*) AS n FROM ie GROUP BY 1, 2) a")
both("win_10_partition_count", "SELECT DISTINCT collection_id, CAST(count(*) OVER (PARTITION BY collection_id) AS BIGINT) AS n FROM ie")
both("win_18_partition_constants", "SELECT serial_number, date, min(CASE WHEN smart_5_raw > 0 THEN date END) OVER (PARTITION BY serial_number) AS first_non_zero, min(date) OVER (PARTITION BY serial_number) AS drive_start, max(date) OVER (PARTITION BY serial_number) AS last_obs FROM dd")
both("win_20_ordinal", "SELECT event_id, CAST(row_number() OVER (PARTITION BY collection_id ORDER BY time, event_id) - 1 AS BIGINT) AS i FROM ie")
both("srt_01_order", "SELECT p_brand, p_size, p_partkey FROM part ORDER BY p_brand DESC, p_size, p_partkey")
both("srt_02_order_case", f"SELECT {BAND} AS tier, {N} AS n, min(CASE WHEN priority <= 99 THEN 1 WHEN priority <= 115 THEN 2 ELSE 3 END) AS rank FROM ie GROUP BY 1 ORDER BY rank")
both("srt_03_top_n", "SELECT event_id, cpu_request FROM ie ORDER BY cpu_request DESC, event_id LIMIT 10")
both("srt_06_top_in_group", "SELECT collection_id, round(avg(cpu_request), 6) AS top3 FROM (SELECT collection_id, cpu_request, row_number() OVER (PARTITION BY collection_id ORDER BY cpu_request DESC, event_id) AS r FROM ie) a WHERE r <= 3 GROUP BY 1")
both("srt_08_top_values", f"SELECT col, val, n FROM (SELECT col, val, n, row_number() OVER (PARTITION BY col ORDER BY n DESC, val) AS r FROM (SELECT 'type' AS col, type AS val, {N} AS n FROM ie GROUP BY 2 UNION ALL SELECT 'priority', priority, {N} FROM ie GROUP BY 2) a) b WHERE r <= 5")
both("srt_09_best_row", "SELECT model, max_by(serial_number, s) AS serial_number FROM (SELECT model, serial_number, sum(smart_197_raw) * 1000000 + serial_number AS s FROM dd GROUP BY 1, 2) a GROUP BY 1")
both("set_01_union_all", "SELECT event_id, 'view' AS part FROM ie WHERE type = 3 UNION ALL SELECT event_id, 'high' FROM ie WHERE priority > 380")
both("set_02_vertical", "SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_acctbal AS DOUBLE) AS v FROM supplier UNION ALL SELECT CAST(c_custkey AS BIGINT), CAST(c_acctbal AS DOUBLE) FROM customer")
both("set_04_distinct", "SELECT DISTINCT collection_id, type FROM ie")
both("set_05_dedup_keys", "SELECT machine_id, type, event_id FROM (SELECT machine_id, type, event_id, row_number() OVER (PARTITION BY machine_id, type ORDER BY time, event_id) AS r FROM ie) a WHERE r = 1")
both("set_07_upsert", "SELECT id, v FROM (SELECT s_suppkey AS id, s_acctbal AS v FROM supplier) old LEFT ANTI JOIN (SELECT c_custkey AS id FROM customer) new ON old.id = new.id UNION ALL SELECT c_custkey, c_acctbal FROM customer", "SELECT id, v FROM (SELECT s_suppkey AS id, s_acctbal AS v FROM supplier) old ANTI JOIN (SELECT c_custkey AS id FROM customer) new ON old.id = new.id UNION ALL SELECT c_custkey, c_acctbal FROM customer")
both("set_08_sections", f"SELECT 'by_type' AS section, CAST(type AS STRING) AS k, {N} AS n, CAST(NULL AS DOUBLE) AS mean FROM ie GROUP BY 2 UNION ALL SELECT 'by_platform', platform_id, {N}, round(avg(capacity_cpus), 6) FROM me GROUP BY 2", f"SELECT 'by_type' AS section, CAST(type AS VARCHAR) AS k, {N} AS n, CAST(NULL AS DOUBLE) AS mean FROM ie GROUP BY 2 UNION ALL SELECT 'by_platform', platform_id, {N}, round(avg(capacity_cpus), 6) FROM me GROUP BY 2")
both("set_09_explode_range", "SELECT p_partkey, explode(sequence(1, p_size)) AS i FROM part", "SELECT p_partkey, unnest(range(1, p_size + 1)) AS i FROM part")
both("fun_scalars", "SELECT event_id, coalesce(nullif(type, 0), -1) AS a, floor(cpu_request) AS b, abs(priority - 200) AS c, greatest(priority, 100) AS d, least(priority, 100) AS e, round(ln(cpu_request + 1), 6) AS f, round(sin(cpu_request), 6) AS g, concat('i_', CAST(collection_id AS STRING), '_', CAST(instance_index AS STRING)) AS h FROM ie", "SELECT event_id, coalesce(nullif(type, 0), -1) AS a, CAST(floor(cpu_request) AS BIGINT) AS b, abs(priority - 200) AS c, greatest(priority, 100) AS d, least(priority, 100) AS e, round(ln(cpu_request + 1), 6) AS f, round(sin(cpu_request), 6) AS g, concat('i_', CAST(collection_id AS VARCHAR), '_', CAST(instance_index AS VARCHAR)) AS h FROM ie")
both("fun_dates", "SELECT DISTINCT date, year(date) AS y, quarter(date) AS q, month(date) AS m, weekday(date) AS wd, date_format(date, 'yyyy-MM') AS ym, concat(CAST(year(date) AS STRING), 'Q', CAST(quarter(date) AS STRING)) AS yq FROM dd", "SELECT DISTINCT date, CAST(year(date) AS INTEGER) AS y, CAST(quarter(date) AS INTEGER) AS q, CAST(month(date) AS INTEGER) AS m, CAST(isodow(date) - 1 AS INTEGER) AS wd, strftime(date, '%Y-%m') AS ym, CAST(year(date) AS VARCHAR) || 'Q' || CAST(quarter(date) AS VARCHAR) AS yq FROM dd")
both("str_01_tumbling", f"SELECT CAST(floor(time / 300000000) AS BIGINT) AS w, {N} AS n FROM ie GROUP BY 1")
both("str_02_monthly", f"SELECT year(day) AS y, month(day) AS m, {N} AS n, round(avg(y_true), 6) AS prevalence FROM pr GROUP BY 1, 2")
both("str_14_recurring", "SELECT y, m, round(sqrt(power((v - a) / s, 2) + power((w - b) / t, 2)), 6) AS distance FROM (SELECT year(date) AS y, month(date) AS m, avg(smart_5_raw) AS v, avg(smart_197_raw) AS w FROM dd GROUP BY 1, 2) x CROSS JOIN (SELECT avg(smart_5_raw) AS a, stddev_samp(smart_5_raw) AS s, avg(smart_197_raw) AS b, stddev_samp(smart_197_raw) AS t FROM dd) g")
both("str_15_unseen", "SELECT y, round(avg(unseen), 6) AS share FROM (SELECT year(d.date) AS y, CASE WHEN k.model IS NULL THEN 1.0 ELSE 0.0 END AS unseen FROM dd d LEFT JOIN (SELECT DISTINCT model FROM dd WHERE date < DATE '1995-02-10') k ON k.model = d.model) a GROUP BY 1", "SELECT y, round(avg(unseen), 6) AS share FROM (SELECT year(d.date) AS y, CASE WHEN k.model IS NULL THEN 1.0::DOUBLE ELSE 0 END AS unseen FROM dd d LEFT JOIN (SELECT DISTINCT model FROM dd WHERE date < DATE '1995-02-10') k ON k.model = d.model) a GROUP BY 1")
