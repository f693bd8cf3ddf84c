"""Tables of the test data, and telemetry tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.session import ship


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    return e.withColumn("time", micros("ts")).withColumn("k", F.get_json_object("props", "$.k").cast("long"))


#: Event types of the test table and the codes they stand for.
KINDS = {"signup": 0, "view": 3, "click": 4, "error": 5, "purchase": 6}


def instance_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v)]), F.col("event_type")).cast("long")
    return _events(spark, sf_dir).select(
        "event_id", (F.col("user_id") % 20).alias("collection_id"), F.expr("user_id div 20").alias("instance_index"), "time", kind.alias("type"),
        (F.col("event_id") % 10).alias("machine_id"), (F.col("k") * 4).alias("priority"), (F.col("k") % 4).alias("scheduling_class"),
        F.col("value").alias("cpu_request"), (F.col("value") / 2).alias("memory_request"),
    )


def instance_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counter = F.when(F.col("k") % 5 != 0, F.col("k") / 8)
    return _events(spark, sf_dir).select(
        "event_id", (F.col("user_id") % 20).alias("collection_id"), F.expr("user_id div 20").alias("instance_index"), (F.col("event_id") % 10).alias("machine_id"),
        F.col("time").alias("start_time"), (F.col("time") + 300_000_000).alias("end_time"), F.col("value").alias("avg_cpu"), (F.col("value") / 4 + F.col("k")).alias("avg_memory"),
        counter.alias("cycles_per_instruction"), (counter * 2).alias("memory_accesses_per_instruction"),
    )


def machine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    return s.select((F.col("s_suppkey") * 1000).alias("time"), (F.col("s_suppkey") % 10).alias("machine_id"), F.concat(F.lit("P"), (F.col("s_nationkey") % 4).cast("string")).alias("platform_id"), (F.col("s_suppkey") % 7 + 400.0).alias("capacity_cpus"), (F.col("s_suppkey") % 5 + 200.0).alias("capacity_memory"))


def drive_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part and ship date; counter 187 is missing outside the middle era."""
    li, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    day = li.groupBy(F.col("l_partkey").alias("serial_number"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.max((F.col("l_returnflag") == "R").cast("int") * (F.col("l_linenumber") == 7).cast("int")).alias("failure"),
        F.sum(F.greatest(F.col("l_quantity") - 40, F.lit(0))).cast("long").alias("smart_5_raw"),
        F.sum("l_linenumber").cast("long").alias("s187"),
        F.sum("l_quantity").cast("long").alias("smart_197_raw"),
    )
    p = part.select(F.col("p_partkey").alias("serial_number"), F.col("p_brand").alias("model"), (F.col("p_size").cast("long") * 1_000_000_000_000).alias("capacity_bytes"))
    era = F.when(F.year("date") <= 1996, "early").when(F.year("date") <= 1999, "middle").otherwise("late")
    return day.join(p, "serial_number").withColumn("era", era).select(
        "serial_number", "date", "model", "capacity_bytes", "failure", "smart_5_raw", F.when(F.col("era") == "middle", F.col("s187")).alias("smart_187_raw"), "smart_197_raw", "era",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label and a score for metrics: late lines against quantity."""
    li = load(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_suppkey").alias("entity"),
        (F.col("l_returnflag") == "R").cast("int").alias("y_true"), (F.col("l_quantity") / 64 + F.col("l_linenumber") / 64).alias("y_score"), F.col("l_shipdate").cast("date").alias("day"),
    )


VIEWS = {"ie": instance_events, "us": instance_usage, "me": machine_events, "dd": drive_days, "pr": predictions}

# The same in DuckDB's dialect, for oracles.
SQL_VIEWS = {
    "ie": """SELECT event_id, user_id % 20 AS collection_id, user_id // 20 AS instance_index, epoch_us(ts) AS time,
        CAST(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 3 WHEN 'click' THEN 4 WHEN 'error' THEN 5 WHEN 'purchase' THEN 6 END AS BIGINT) AS type,
        event_id % 10 AS machine_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 4 AS priority,
        CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 AS scheduling_class, value AS cpu_request, value / 2 AS memory_request FROM events""",
    "us": """SELECT event_id, user_id % 20 AS collection_id, user_id // 20 AS instance_index, event_id % 10 AS machine_id, epoch_us(ts) AS start_time,
        epoch_us(ts) + 300000000 AS end_time, value AS avg_cpu, value / 4 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS avg_memory,
        CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) / 8 END AS cycles_per_instruction,
        CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) / 8 * 2 END AS memory_accesses_per_instruction FROM events""",
    "me": """SELECT s_suppkey * 1000 AS time, s_suppkey % 10 AS machine_id, 'P' || CAST(s_nationkey % 4 AS VARCHAR) AS platform_id,
        s_suppkey % 7 + 400.0::DOUBLE AS capacity_cpus, s_suppkey % 5 + 200.0::DOUBLE AS capacity_memory FROM supplier""",
    "dd": """SELECT serial_number, date, p_brand AS model, CAST(p_size AS BIGINT) * 1000000000000 AS capacity_bytes, failure, smart_5_raw,
        CASE WHEN year(date) BETWEEN 1997 AND 1999 THEN s187 END AS smart_187_raw, smart_197_raw,
        CASE WHEN year(date) <= 1996 THEN 'early' WHEN year(date) <= 1999 THEN 'middle' ELSE 'late' END AS era
        FROM (SELECT l_partkey AS serial_number, CAST(l_shipdate AS DATE) AS date, CAST(max(CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 1 ELSE 0 END) AS INTEGER) AS failure,
            CAST(sum(greatest(l_quantity - 40, 0)) AS BIGINT) AS smart_5_raw, CAST(sum(l_linenumber) AS BIGINT) AS s187, CAST(sum(l_quantity) AS BIGINT) AS smart_197_raw
            FROM lineitem GROUP BY 1, 2) JOIN part ON p_partkey = serial_number""",
    "pr": """SELECT l_orderkey * 8 + l_linenumber AS id, l_suppkey AS entity, CAST(l_returnflag = 'R' AS INTEGER) AS y_true,
        l_quantity / 64 + l_linenumber / 64 AS y_score, CAST(l_shipdate AS DATE) AS day FROM lineitem""",
}
