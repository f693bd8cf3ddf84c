"""Metrics, thresholds and calibration as aggregates: nothing is collected but one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.operators.temporal import running_totals


def mcc_of(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    tp, fp, tn, fn = (c.cast("double") for c in (tp, fp, tn, fn))
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return F.when(below == 0, F.lit(0.0)).otherwise(F.try_divide(tp * tn - fp * fn, below))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    below = 2 * tp + fp + fn
    return F.when(below == 0, F.lit(0.0)).otherwise(F.try_divide((2 * tp).cast("double"), below))


def confusion(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    cell = 2 * F.col(y) + F.col(p)
    return df.groupBy(*by).agg(*[F.count_if(cell == v).alias(n) for n, v in (("tn", 0), ("fp", 1), ("fn", 2), ("tp", 3))])


def scores(df: DataFrame, y: str, p: str, by: list[str] = ()) -> DataFrame:
    c = confusion(df, y, p, by)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.withColumns({"mcc": mcc_of(tp, fp, tn, fn), "f1": f1_of(tp, fp, fn)})


def _by_score(df: DataFrame, y: str, score: str, by: list[str] = ()) -> DataFrame:
    """Positives and rows at each distinct score; at most one row a score goes on."""
    return df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.count("*").alias("n"))


def ranking(df: DataFrame, y: str, score: str) -> DataFrame:
    """One row: average precision, ROC-AUC (ties count half) and Brier score. The order over all scores is cut into
    ranges (running_totals)."""
    g = running_totals(_by_score(df, y, score), -F.col("s"), {"cp": F.col("p"), "cn": F.col("n")})
    one = g.agg(
        F.sum(F.col("p") * F.col("cp") / F.col("cn")).alias("ap"), F.sum("p").alias("pos"), F.sum("n").alias("all"),
        F.sum((F.col("n") - F.col("p")) * (F.col("cp") - F.col("p") / 2)).alias("wins"),
    )
    brier = df.agg(F.avg((F.col(score) - F.col(y)) * (F.col(score) - F.col(y))).alias("brier"))
    return one.crossJoin(brier).select(F.try_divide("ap", F.col("pos").cast("double")).alias("pr_auc"), F.try_divide("wins", F.col("pos").cast("double") * (F.col("all") - F.col("pos"))).alias("roc_auc"), "brier")


def univariate_auc(df: DataFrame, y: str, columns: list[str]) -> DataFrame:
    """name, auc, direction of each column as a score on its own; direction 1: high values mean label 1. Nulls are left
    out."""
    rows = df.select(F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("s")) for c in columns])).alias("x")).select("y", "x.*").where("s is not null")
    g = running_totals(_by_score(rows, "y", "s", ["name"]), F.col("s"), {"cn": F.col("n") - F.col("p")}, ["name"])
    negatives = F.col("n") - F.col("p")
    one = g.groupBy("name").agg(F.sum("p").alias("pos"), F.sum(negatives).alias("neg"), F.sum(F.col("p") * (F.col("cn") - negatives / 2)).alias("wins"))
    return one.withColumn("auc", F.try_divide("wins", F.col("pos").cast("double") * F.col("neg"))).select("name", "auc", F.when(F.col("auc") >= 0.5, 1).when(F.col("auc") < 0.5, -1).alias("direction"))


def quantile_grid(df: DataFrame, score: str, steps: int, lo: float, hi: float) -> list[float]:
    """The distinct quantiles of a score at `steps` levels from lo to hi."""
    levels = [lo + (hi - lo) * i / (steps - 1) for i in range(steps)] if steps > 1 else [lo]
    return sorted(set(df.agg(F.percentile(score, levels).alias("q")).first()["q"] or []))


def _steps(grid: list[float], value: Column) -> Column:
    """How many steps of a sorted grid a value reaches."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t <= value)) if grid else F.lit(0)


def threshold_table(df: DataFrame, y: str, score: str, grid: list[float]) -> DataFrame:
    """threshold, tp, fp, tn, fn at each step of a grid. One pass: rows are counted between the steps, then summed from
    above over the grid (a bounded table)."""
    grid = sorted({float(t) for t in grid})
    steps = df.sparkSession.createDataFrame([(i + 1, t) for i, t in enumerate(grid)], "i int, threshold double")
    h = df.groupBy(_steps(grid, F.col(score).cast("double")).alias("i")).agg(F.sum(F.col(y).cast("long")).alias("p"), F.count("*").alias("n"))
    all_ = h.agg(F.sum("p").alias("pos"), F.sum("n").alias("all"))
    up = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = steps.join(h, "i", "left").na.fill(0, ["p", "n"]).withColumns({"tp": F.sum("p").over(up), "flagged": F.sum("n").over(up)}).crossJoin(F.broadcast(all_))
    fp, fn = F.col("flagged") - F.col("tp"), F.col("pos") - F.col("tp")
    return c.select("threshold", "tp", fp.alias("fp"), (F.col("all") - F.col("pos") - fp).alias("tn"), fn.alias("fn"))


def best_threshold(df: DataFrame, y: str, score: str, grid: list[float]) -> DataFrame:
    """One row: the threshold of the grid with the highest MCC (the least one at ties)."""
    c = threshold_table(df, y, score, grid).withColumn("mcc", mcc_of(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")))
    return c.orderBy(F.desc("mcc"), "threshold").limit(1).select("threshold", "mcc")


def pareto_knee(df: DataFrame, y: str, score: str, grid: list[float]) -> DataFrame:
    """One row: the threshold of the grid where the share of failures averted most exceeds the share of rows triggered
    (the least one at ties)."""
    c = threshold_table(df, y, score, grid)
    averted = F.try_divide(F.col("tp"), (F.col("tp") + F.col("fn")).cast("double"))
    triggered = F.try_divide(F.col("tp") + F.col("fp"), (F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")).cast("double"))
    c = c.withColumns({"averted": averted, "triggered": triggered, "gain": averted - triggered})
    return c.orderBy(F.desc("gain"), "threshold").limit(1).select("threshold", "averted", "triggered", "gain")


def calibration(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """A row per equal-width bin, empty ones too; the right edge belongs to the last."""
    g = df.groupBy(F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(y).alias("rate"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(g, "bin", "left").na.fill(0, ["n"])


def holm(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Holm's step-down adjusted p-values; rejected where below alpha. A family of tests is a small frame."""
    w = Window.orderBy(p, *[c for c in df.columns if c != p])
    m = df.count()
    out = df.withColumn("__i", F.row_number().over(w) - 1)
    adj = F.least(F.max((F.lit(m) - F.col("__i")) * F.col(p)).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0))
    return out.withColumn("p_adjusted", adj).withColumn("reject", (F.col("p_adjusted") < alpha).cast("int")).drop("__i")


def benjamini_hochberg(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    w = Window.orderBy(p, *[c for c in df.columns if c != p])
    m = df.count()
    out = df.withColumn("__i", F.row_number().over(w))
    adj = F.least(F.min(F.lit(float(m)) * F.col(p) / F.col("__i")).over(Window.orderBy("__i").rowsBetween(0, Window.unboundedFollowing)), F.lit(1.0))
    return out.withColumn("p_adjusted", adj).withColumn("reject", (F.col("p_adjusted") <= alpha).cast("int")).drop("__i")


def psi(reference: DataFrame, current: DataFrame, value: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """One row: population stability index over the reference's distinct quantile edges with open ends."""
    q = reference.agg(F.percentile(value, [i / bins for i in range(1, bins)]).alias("q")).first()["q"] or []
    edges = sorted(set(q))
    if not edges:
        raise ValueError("the reference has no values")
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(value)))
    share = lambda d, n: d.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("c")).select("bin", (F.col("c") / F.sum("c").over(Window.partitionBy())).alias(n))
    j = share(reference, "r").join(share(current, "c"), "bin", "full")
    r, c = (F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(eps)) for x in ("r", "c"))
    return j.agg(F.sum((c - r) * F.log(c / r)).alias("psi"))


def ks_statistic(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row: the largest distance between the two distribution functions."""
    both = a.select(F.col(value).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(value, F.lit(0), F.lit(1))).where("v is not null")
    g = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    run = running_totals(g, F.col("v"), {"ca": F.col("a"), "cb": F.col("b")})
    all_ = g.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return run.crossJoin(F.broadcast(all_)).agg(F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("ks"))


def slope_over(df: DataFrame, index: str, value: str) -> DataFrame:
    """One row: OLS slope of a value over an index (null under two points)."""
    return df.agg(F.try_divide(F.covar_pop(value, index), F.var_pop(index)).alias("slope"))


def sustainment(df: DataFrame, index: str, value: str, share: float) -> DataFrame:
    """One row: periods before the first one whose value is below `share` of the first period's; all if there is none."""
    first = df.agg(F.min_by(value, index).alias("__first"), (F.max(index) + 1).alias("__all"))
    low = F.min(F.when(F.col(value) < F.col("__first") * share, F.col(index)))
    return df.crossJoin(F.broadcast(first)).agg(F.coalesce(low, F.max("__all")).cast("long").alias("periods"))


def mcc_at_prevalence(df: DataFrame, y: str, p: str, prevalence: float) -> DataFrame:
    """One row: MCC with the counts of the class in excess scaled down to a prevalence of positives."""
    c = confusion(df, y, p)
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    pos, neg = tp + fn, tn + fp
    high = pos > prevalence * (pos + neg)
    kp = F.when(high, F.try_divide(prevalence * neg / (1 - prevalence), pos)).otherwise(1.0)
    kn = F.when(high, 1.0).otherwise(F.try_divide(pos * (1 - prevalence) / prevalence, neg))
    return c.select(mcc_of(tp * kp, fp * kn, tn * kn, fn * kp).alias("mcc"))


def mean_interval(df: DataFrame, value: str, by: list[str] = (), z: float = 1.959963984540054) -> DataFrame:
    """Mean and its normal interval by group: value, low, high."""
    half = z * F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))
    return df.groupBy(*by).agg(F.avg(value).alias("value"), (F.avg(value) - half).alias("low"), (F.avg(value) + half).alias("high"))


def beats(low: Column, high: Column, threshold: float, greater: bool = True) -> Column:
    """1 where a whole interval lies strictly beyond a threshold."""
    return F.coalesce((low > threshold) if greater else (high < threshold), F.lit(False)).cast("int")


def overlaps(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return ((a_low <= b_high) & (b_low <= a_high)).cast("int")


def effect_size(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: Cohen's d of group 1 against group 0 with the pooled deviation; null with under two values in a group."""
    at = lambda g: F.when(F.col(group) == g, F.col(value))
    one = df.agg(*[f(at(g)).alias(f"{n}{g}") for g in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), F.col("n1") + F.col("n0") - 2))
    return one.select(F.when((F.col("n1") > 1) & (F.col("n0") > 1), F.coalesce(F.try_divide(F.col("m1") - F.col("m0"), pooled), F.lit(0.0))).alias("d"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the statistic of independence of two columns and its degrees of freedom. The table of counts is a x b."""
    c = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    rows, columns, all_ = c.groupBy("a").agg(F.sum("n").alias("r")), c.groupBy("b").agg(F.sum("n").alias("k")), c.agg(F.sum("n").alias("t"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"))
    # a pair that doesn't occur has n = 0 and adds its expected count; these sum to t less the others' expected counts
    full = c.join(rows, "a").join(columns, "b").crossJoin(F.broadcast(all_)).withColumn("e", F.col("r") * F.col("k") / F.col("t"))
    one = full.groupBy("t", "na", "nb").agg(F.sum((F.col("n") - F.col("e")) * (F.col("n") - F.col("e")) / F.col("e")).alias("s"), F.sum("e").alias("e"))
    return one.select((F.col("s") + F.col("t") - F.col("e")).alias("chi2"), ((F.col("na") - 1) * (F.col("nb") - 1)).alias("df"))
