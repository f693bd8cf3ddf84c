"""Joins on time: as-of, strictly-before counts, interval containment, binning; running totals over a whole table.
None needs a range join's product: as-of joins and counts are windows over a tagged union, binning explodes each
interval into its bins, running totals carry the sums of ranges of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Most ranges that an order over a whole table is cut into.
RANGES = 256


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], tolerance: int) -> DataFrame:
    """Each left row with values of the next right row of its key, at most tolerance later; an equal time counts.
    left and right share the names in by and on; right rows of equal time: the least values. Linear in the rows of a key:
    from the latest time on, the last right row passed is carried along."""
    keys = [*by, on]
    rest = [c for c in left.columns if c not in keys]
    cols = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    k, t = [f"__k{i}" for i in range(len(by))], f"__k{len(by)}"
    tag = left.select(*cols, F.struct(*[F.col(f"`{c}`") for c in rest], F.lit(0).alias("__")).alias("__l"), F.lit(0).alias("__side"))
    found = right.where(F.col(f"`{on}`").isNotNull()).select(*cols, F.struct(F.col(f"`{on}`").alias("__at"), *[F.col(f"`{v}`") for v in values]).alias("__r"), F.lit(1).alias("__side"))
    both = tag.unionByName(found, allowMissingColumns=True)
    passed = Window.partitionBy(*k).orderBy(F.desc_nulls_last(t), F.desc("__side"), F.desc("__r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("__n", F.last("__r", ignorenulls=True).over(passed)).where("__side = 0")
    near = F.col("__n.__at") - F.col(t) <= tolerance
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keys)], *[F.col(f"__l.`{c}`").alias(c) for c in rest], *[F.when(near, F.col(f"__n.`{v}`")).alias(v) for v in values])


def counts_before(history: DataFrame, queries: DataFrame, by: list[str], time: str, counts: dict[str, Column]) -> DataFrame:
    """For each distinct query (by, time): how many history rows of its key came strictly before, per named predicate."""
    keys = [*by, time]
    cols = [F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]
    q = queries.select(*cols).distinct().select("*", F.lit(0).alias("__ord"), *[F.lit(0).cast("long").alias(n) for n in counts])
    h = history.select(*cols, F.lit(1).alias("__ord"), *[F.coalesce(p.cast("long"), F.lit(0)).alias(n) for n, p in counts.items()])
    before = Window.partitionBy(*[f"__k{i}" for i in range(len(by))]).orderBy(f"__k{len(by)}", "__ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = q.unionByName(h).select("*", *[F.sum(n).over(before).alias(f"__s{i}") for i, n in enumerate(counts)])
    return out.where("__ord = 0").select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], *[F.col(f"__s{i}").alias(n) for i, n in enumerate(counts)])


def running_totals(df: DataFrame, key: Column, sums: dict[str, Column], by: list[str] = (), ties: list[Column] = ()) -> DataFrame:
    """df with running totals in the order of a numeric key, then ties; sums: name -> value. Null keys come first.

    The order over the whole table (or over each of few groups `by`) is cut into RANGES ranges at approximate quantiles
    of the key; a range is summed by itself, and the sums of the ranges before it are carried in. Only the quantiles
    reach the driver. Rows of one key stay in one range."""
    spark = df.sparkSession
    n = min(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = df.withColumns({"__key": key.cast("double"), **{f"__v{i}": c for i, c in enumerate(sums.values())}})
    cuts = d.agg(F.percentile_approx("__key", [i / n for i in range(1, n)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    d = d.withColumn("__range", F.when(F.col("__key").isNull(), -1).otherwise(F.size(F.filter(bounds, lambda b: b < F.col("__key")))))
    part = d.groupBy(*by, "__range").agg(*[F.sum(f"__v{i}").alias(f"__p{i}") for i in range(len(sums))])
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*by, "__range", *[F.coalesce(F.sum(f"__p{i}").over(earlier), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))])
    within = Window.partitionBy(*by, "__range").orderBy("__key", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.select("*", *[F.sum(f"__v{i}").over(within).alias(f"__w{i}") for i in range(len(sums))])
    on = [d[c].eqNullSafe(part[c]) for c in by] + [d["__range"] == part["__range"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    out = d.join(part, cond)
    return out.select(*[d[c] for c in df.columns], *[(F.col(f"__w{i}") + F.col(f"__b{i}")).alias(name) for i, name in enumerate(sums)])


def in_intervals(points: DataFrame, intervals: DataFrame, by: list[str], time: str, start: str, end: str, horizon: int | None = None) -> DataFrame:
    """Points in the half-open interval [start, end) of their key (null end: open), at most horizon after start."""
    inside = (F.col(time) >= F.col(start)) & (F.col(end).isNull() | (F.col(time) < F.col(end)))
    if horizon is not None:
        inside = inside & (F.col(time) <= F.col(start) + horizon)
    return points.join(intervals, by).where(inside)


def bins(df: DataFrame, start: str, end: str, size: int, most: int, out: str = "window") -> DataFrame:
    """A row for each window of the given size that [start, end] touches, at most `most` after the first."""
    lo, hi = F.floor(F.col(start) / size), F.floor(F.col(end) / size)
    return df.withColumn(out, F.explode(F.sequence(lo, F.least(hi, lo + most))))


def next_window(df: DataFrame, by: list[str], window: str, values: list[str], prefix: str = "next_") -> DataFrame:
    """df with the values of the window after its own; a gap gives nulls (lead() would skip it)."""
    nxt = df.select(*by, (F.col(window) - 1).alias(window), *[F.col(v).alias(prefix + v) for v in values])
    return df.join(nxt, [*by, window], "left")
