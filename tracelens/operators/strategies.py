"""What scheduling by risk would gain: attempts that a strategy removes no longer use or hold anything, and efficiency is
the used share of what is allocated, by window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.schema import FAILURE, FINISH


def machine_risk(events: DataFrame, before: int, least: int = 20) -> DataFrame:
    """Share of failed among the ended (failed or finished) events of each machine before a time, with `least` such
    events or more."""
    t = F.col("type")
    ended = events.where(F.col("machine_id").isNotNull() & (F.col("time") < before) & t.isin(*FAILURE, FINISH))
    return ended.groupBy("machine_id").agg(F.avg(t.isin(*FAILURE).cast("double")).alias("risk"), F.count("*").alias("n_ended")).where(F.col("n_ended") >= least)


def strategies(attempts: DataFrame, risk: DataFrame, score: str, migrate_from: float, admit_from: float = 0.5, quantile: float = 0.75) -> DataFrame:
    """attempts with keep_migrate, keep_admit and keep_pack: preemptive migration and admission control remove what
    scores high, packing only such of it as is on machines of the riskiest quantile."""
    cut = risk.agg(F.percentile("risk", quantile).alias("__cut"))
    rows = attempts.join(risk.select("machine_id", F.col("risk").alias("__risk")), "machine_id", "left").crossJoin(F.broadcast(cut))
    flagged = F.col(score) >= migrate_from
    high = F.coalesce(F.coalesce("__risk", F.lit(0.0)) >= F.col("__cut"), F.lit(False))
    return rows.withColumns({"keep_migrate": ~flagged, "keep_admit": F.col(score) < admit_from, "keep_pack": ~(flagged & high)}).drop("__risk", "__cut")


def window_efficiency(attempts: DataFrame, window: str, used: str, alloc: str, keep: Column | None = None) -> DataFrame:
    """window, efficiency of the attempts kept; windows without allocation are left out."""
    d = attempts if keep is None else attempts.where(keep)
    g = d.groupBy(window).agg(F.sum(used).alias("used"), F.sum(alloc).alias("alloc")).where("alloc > 0")
    return g.select(window, (F.col("used") / F.col("alloc")).alias("efficiency"))


def evaluate(attempts: DataFrame, window: str, used: str, alloc: str, keeps: dict[str, str]) -> DataFrame:
    """A row per strategy: windows, the share that improved, the median relative improvement and the share of the
    allocation reclaimed."""
    base = window_efficiency(attempts, window, used, alloc).withColumnRenamed("efficiency", "__base").where("__base > 0")
    out = None
    for name, keep in keeps.items():
        gain = F.col("efficiency") / F.col("__base") - 1
        g = base.join(window_efficiency(attempts, window, used, alloc, F.col(keep)), window).withColumn("gain", gain)
        one = g.agg(F.count("*").alias("windows"), F.avg((F.col("gain") > 0).cast("double")).alias("improved"), F.percentile("gain", 0.5).alias("median_gain"))
        freed = attempts.agg(F.try_divide(F.sum(F.when(~F.col(keep), F.col(alloc)).otherwise(0.0)), F.sum(alloc)).alias("reclaimed"))
        one = one.crossJoin(F.broadcast(freed)).withColumn("strategy", F.lit(name))
        out = one if out is None else out.union(one)
    return out
