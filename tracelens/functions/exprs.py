"""Column macros."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelens.schema import MONITORING_LOW, PRIORITY_BANDS, PRODUCTION_LOW


def safe_divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def priority_band(c: Column) -> Column:
    out = F.lit("unknown")
    for name, lo, hi in reversed(PRIORITY_BANDS):
        inside = (c >= lo if lo is not None else F.lit(True)) & (c <= hi if hi is not None else F.lit(True))
        out = F.when(inside, name).otherwise(out)
    return F.when(c.isNull(), "unknown").otherwise(out)


def failure_label(kind: Column, priority: Column | None = None, branch: str = "primary") -> Column:
    """1 failed, 0 finished, else null; branch "sensitivity" counts production evictions as failures."""
    if branch not in ("primary", "sensitivity"):
        raise ValueError(f"unknown branch {branch!r}")
    out = F.when(kind.isin(5, 8), 1).when(kind == 6, 0)
    if branch == "sensitivity":
        if priority is None:
            raise ValueError("the sensitivity branch needs a priority")
        out = F.when(kind.isin(5, 8) | ((kind == 4) & priority.between(PRODUCTION_LOW, MONITORING_LOW - 1)), 1).when(kind == 6, 0)
    return out


def one_hot(c: Column, levels: list, prefix: str) -> list[Column]:
    return [F.coalesce((c == v).cast("int"), F.lit(0)).alias(f"{prefix}{v}") for v in levels]


def hash_bucket(key: Column, size: int) -> Column:
    """md5-based bucket in [0, size); the same in DuckDB."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % size


def hash_unit(key: Column) -> Column:
    return hash_bucket(key, 1_000_000) / 1e6


def slope(y: Column, x: Column, when: Column) -> Column:
    """OLS slope over the rows where `when`; null without spread in x."""
    return F.try_divide(F.covar_pop(F.when(when, y), F.when(when, x)), F.var_pop(F.when(when & y.isNotNull(), x)))


def windowed(value: str, sec: Column, horizons: tuple[int, ...], name: str) -> list[Column]:
    """Mean, maximum and standard deviation of a value over the first seconds."""
    out = []
    for h in horizons:
        x = F.when(sec.between(0, h), F.col(value))
        out += [F.avg(x).alias(f"{name}_mean_{h}s"), F.max(x).alias(f"{name}_max_{h}s"), F.stddev_samp(x).alias(f"{name}_std_{h}s")]
    return out
