"""Drive-day features, targets and censoring. Windows count rows of one drive in date order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.schema import HORIZON_DAYS, ROLLING_ROWS


def drive():
    return Window.partitionBy("serial_number")


def by_date():
    return drive().orderBy("date")


def last(n: int):
    return by_date().rowsBetween(-(n - 1), 0)


def rolling_nearest(c: str, q: float, n: int) -> Column:
    """Quantile of the last n rows' values, the nearest one (nulls left out)."""
    vals = F.sort_array(F.collect_list(c).over(last(n)))
    return F.get(vals, F.round(F.lit(q) * (F.size(vals) - 1)).cast("int"))


def tier1(dd: DataFrame, counters: tuple[str, ...] = ("smart_5_raw", "smart_197_raw"), rows: tuple[int, ...] = ROLLING_ROWS) -> DataFrame:
    """Any non-zero value lately, days since the first, capacity in TB."""
    out = dd
    for c in counters:
        flag = F.coalesce((F.col(c) > 0).cast("int"), F.lit(0))
        out = out.withColumns({f"{c}_any_{n}": F.max(flag).over(last(n)) for n in rows})
        first = F.min(F.when(F.col(c) > 0, F.col("date"))).over(drive())
        out = out.withColumn(f"{c}_days_since", F.when(F.col("date") >= first, F.datediff("date", first)))
    return out.withColumn("capacity_tb", F.col("capacity_bytes") / 1e12)


def tier2(dd: DataFrame, counters: tuple[str, ...] = ("smart_197_raw",), rows: tuple[int, ...] = ROLLING_ROWS) -> DataFrame:
    """Rolling mean, deviation, quantiles, and differences to 1 and 7 rows before."""
    out = dd
    for c in counters:
        for n in rows:
            out = out.withColumns({f"{c}_mean_{n}": F.avg(c).over(last(n)), f"{c}_std_{n}": F.stddev_samp(c).over(last(n)), f"{c}_p95_{n}": F.percentile(c, 0.95).over(last(n)), f"{c}_near95_{n}": rolling_nearest(c, 0.95, n)})
        out = out.withColumns({f"{c}_delta_{k}": F.col(c) - F.lag(c, k).over(by_date()) for k in (1, 7)})
    return out


def tier3(dd: DataFrame, available: dict[str, tuple[str, ...]]) -> DataFrame:
    """Ages, calendar parts, and for each counter whether its era has it. available: counter -> eras."""
    start = F.min("date").over(drive())
    fleets = dd.groupBy(F.col("model").alias("__model")).agg(F.min("date").alias("__fleet"))  # a row per model
    out = dd.join(fleets, F.col("model").eqNullSafe(F.col("__model")), "left").drop("__model").withColumns({
        "drive_age_days": F.datediff("date", start), "month": F.month("date"), "quarter": F.quarter("date"), "weekday": F.weekday("date"),
        "fleet_age_days": F.datediff("date", "__fleet"),
    }).drop("__fleet")
    for c, eras in available.items():
        out = out.withColumn(f"{c}_available", F.col("era").isin(*eras).cast("int"))
        out = out.withColumn(f"{c}_mean_7", F.when(F.col(f"{c}_available") == 1, F.avg(c).over(last(7))))
    return out


def targets(dd: DataFrame, horizons: tuple[int, ...] = HORIZON_DAYS) -> DataFrame:
    """Whether the drive fails within h days from this row on."""
    failed = F.max(F.when(F.col("failure") == 1, F.col("date"))).over(drive())
    ahead = F.datediff(failed, "date")
    return dd.withColumns({f"failure_within_{h}d": F.coalesce(ahead.between(0, h), F.lit(False)).cast("int") for h in horizons})


def censoring(dd: DataFrame) -> DataFrame:
    seen = F.max("failure").over(drive())
    return dd.withColumns({"last_obs": F.max("date").over(drive()), "failure_observed": seen, "censored": 1 - seen})


def failure_rates(dd: DataFrame, by: list[Column]) -> DataFrame:
    """Drive days, failures, drives and the annualised failure rate in percent by group."""
    n, f = F.count("*"), F.sum(F.col("failure").cast("long"))
    return dd.groupBy(*by).agg(n.alias("drive_days"), f.alias("failures"), F.count_distinct("serial_number").alias("drives"), (f * 36500.0 / n).alias("afr"))


def days_before_failure(dd: DataFrame) -> DataFrame:
    """Rows of failed drives up to the failure, with the days that are left."""
    failed = dd.where("failure = 1").groupBy("serial_number").agg(F.max("date").alias("__failed"))
    out = dd.join(failed, "serial_number").where(F.col("date") <= F.col("__failed"))
    return out.withColumn("days", F.datediff("__failed", "date")).drop("__failed")


def degradation_curve(dd: DataFrame, counter: str, most: int, quantiles: tuple[float, ...]) -> DataFrame:
    """Quantiles of a counter by days before the failure."""
    d = days_before_failure(dd).where(F.col("days") <= most)
    return d.groupBy("days").agg(F.count("*").alias("n"), *[F.percentile(counter, q).alias(f"q{round(q * 100)}") for q in quantiles])


def degradation_onset(dd: DataFrame, counter: str, leads: tuple[int, ...] = (90, 60, 30, 14, 7, 1), within: int = 1) -> DataFrame:
    """Median of a counter at each lead time (give or take `within` days) and its ratio to the median of the drives that
    never fail. A row belongs to the few leads near it: no join with the leads."""
    d = days_before_failure(dd)
    near = F.filter(F.array(*[F.lit(x) for x in leads]), lambda x: F.abs(F.col("days") - x) <= within)
    healthy = dd.join(dd.where("failure = 1").select("serial_number"), "serial_number", "left_anti").agg(F.percentile(counter, 0.5).alias("healthy"))
    m = d.select(F.explode(near).alias("lead"), F.col(counter).alias("v")).groupBy("lead").agg(F.count("v").alias("n"), F.percentile("v", 0.5).alias("median"))
    return m.crossJoin(F.broadcast(healthy)).select("lead", "n", "median", F.try_divide("median", "healthy").alias("ratio"))


def majority(df: DataFrame, entity: list[str], value: Column, out: str) -> DataFrame:
    """df with 1 on each row of an entity of which at least half the rows have the value, else 0."""
    return df.withColumn(out, (F.avg(value.isNotNull().cast("double")).over(Window.partitionBy(*entity)) >= 0.5).cast("int"))
