"""Assertions on tables and profiles of their columns. An assertion raises AssertionFailed; a check log collects
outcomes and raises once at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.schema import EVICT, MONITORING_LOW


class AssertionFailed(AssertionError):
    """observed: what the assertion has measured."""

    def __init__(self, message: str, observed=None):
        super().__init__(message)
        self.observed = observed


def _need(ok: bool, message: str, observed=None):
    if not ok:
        raise AssertionFailed(message, observed)
    return observed


def class_balance(df: DataFrame, label: str, expected: float, tolerance: float) -> float:
    r = df.agg(F.avg(F.col(label).cast("double")).alias("r")).first()["r"]
    return _need(r is not None and abs(r - expected) <= tolerance, f"share of {label} is {r}, expected {expected}", r)


def null_rate(df: DataFrame, column: str, expected: float, tolerance: float) -> float:
    r = df.agg(F.avg(F.col(column).isNull().cast("double")).alias("r")).first()["r"]
    _need(r is not None, "empty frame")
    return _need(abs(r - expected) <= tolerance, f"null rate of {column} is {r}, expected {expected}", r)


def row_count(df: DataFrame, lo: int, hi: int) -> int:
    n = df.count()
    return _need(lo <= n <= hi, f"{n} rows, expected {lo} to {hi}", n)


def inversion(df: DataFrame, value: str, label: str) -> float:
    """How far the median of the failed (label 1) is below that of the finished (0)."""
    m = {r[label]: r["m"] for r in df.groupBy(label).agg(F.median(value).alias("m")).collect()}
    _need(m.get(1) is not None and m.get(0) is not None, f"medians {m}")
    return _need(m[1] < m[0], f"medians {m}", m[0] - m[1])


def none_where(df: DataFrame, bad: Column, message: str, most: int = 0) -> int:
    """At most `most` rows where bad: unlabelled evictions, unknown eras, history on first attempts."""
    n = df.where(bad).count()
    return _need(n <= most, f"{message}: {n} rows", n)


def event_count(df: DataFrame, flag: Column, expected: int, tolerance: float) -> int:
    n = df.where(flag).count()
    return _need(abs(n - expected) <= tolerance * expected, f"{n} events, expected {expected}", n)


def one_row_per(df: DataFrame, keys: list[str]) -> int:
    n = df.groupBy(*keys).count().where("count > 1").agg(F.sum(F.col("count") - 1).alias("n")).first()["n"] or 0
    return _need(n == 0, f"{n} surplus rows for {keys}", n)


def disjoint(a: DataFrame, b: DataFrame, keys: list[str]) -> int:
    n = a.join(b, keys, "left_semi").select(*keys).distinct().count()
    return _need(n == 0, f"{n} shared {keys}", n)


def grows(df: DataFrame, entity: str, date: str, cutoff) -> int:
    """More entities after the cutoff than before: by how many."""
    r = df.agg(F.count_distinct(F.when(F.col(date) < cutoff, F.col(entity))).alias("a"), F.count_distinct(F.when(F.col(date) >= cutoff, F.col(entity))).alias("b")).first()
    return _need(r["b"] > r["a"], f"{r['a']} before, {r['b']} after {cutoff}", r["b"] - r["a"])


def eras_complete(df: DataFrame, era: str, known: tuple[str, ...]) -> int:
    """No row outside the known eras."""
    return none_where(df, F.col(era).isNull() | ~F.col(era).isin(*known), "unknown era")


def monitoring_unlabelled(df: DataFrame, kind: str, priority: str, label: str) -> int:
    """Evictions of monitoring jobs have no label."""
    return none_where(df, (F.col(kind) == EVICT) & (F.col(priority) >= MONITORING_LOW) & F.col(label).isNotNull(), "labelled evictions of monitoring jobs")


def first_attempts_clean(df: DataFrame, ordinal: str, history: list[str]) -> int:
    """First attempts have no history."""
    bad = F.lit(False)
    for c in history:
        bad = bad | (F.col(c) > 0)
    return none_where(df, (F.col(ordinal) == 1) & bad, "first attempts with a history")


def labels_complete(df: DataFrame, kind: str, label: str, kinds: tuple[int, ...]) -> int:
    """Every event of these kinds has a label."""
    return none_where(df, F.col(kind).isin(*kinds) & F.col(label).isNull(), "events without label")


def same_schema(*frames: DataFrame) -> int:
    """The number of columns that all frames share, if these are all."""
    kinds = {tuple(f.dtypes) for f in frames}
    return _need(len(kinds) == 1, "schemas differ", len(frames[0].columns))


def schema_difference(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Columns of one frame only and of both, and those of both whose types differ."""
    x, y = dict(a.dtypes), dict(b.dtypes)
    both = sorted(x.keys() & y.keys())
    return {"only_first": sorted(x.keys() - y.keys()), "only_second": sorted(y.keys() - x.keys()), "both": both, "changed": [c for c in both if x[c] != y[c]]}


class CheckLog:
    """Named outcomes; as a frame, and raising if one failed."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, str, str]] = []

    def record(self, check: str, expected, observed, ok: bool) -> bool:
        self.rows.append((check, str(expected), str(observed), "PASS" if ok else "FAIL"))
        return ok

    def run(self, check: str, expected, assertion) -> bool:
        """Record whether an assertion holds, and what it has measured."""
        try:
            return self.record(check, expected, assertion(), True)
        except AssertionFailed as e:
            return self.record(check, expected, e.observed, False)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "check string, expected string, observed string, status string")

    def require(self) -> None:
        bad = [r[0] for r in self.rows if r[3] == "FAIL"]
        _need(not bad, f"failed: {bad}")


def null_profile(df: DataFrame) -> DataFrame:
    """column, nulls, rows: one pass."""
    one = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return one.select("__n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns])).alias("x")).select("x.column", "x.nulls", F.col("__n").alias("rows"))


def cardinality(df: DataFrame) -> DataFrame:
    """column, distinct (exact; arrays by element): one pass over an unpivoted frame."""
    flat = [c for c, k in df.dtypes if not k.startswith("array")]
    arrays = [c for c, k in df.dtypes if k.startswith("array")]
    as_row = lambda c, v: F.struct(F.lit(c).alias("column"), F.to_json(F.struct(v.alias("v"))).alias("v"))
    elements = lambda c: F.transform(F.coalesce(F.col(f"`{c}`"), F.array()), lambda x: as_row(c, x))
    parts = F.concat(F.array(*[as_row(c, F.col(f"`{c}`")) for c in flat]), *[elements(c) for c in arrays])
    rows = df.select(F.explode(parts).alias("x")).select("x.*").where("v <> '{}'")
    return rows.distinct().groupBy("column").agg(F.count("*").alias("distinct"))


def numeric_profile(df: DataFrame, columns: list[str], quantiles: tuple[float, ...] = (0.01, 0.5, 0.99)) -> DataFrame:
    """A row per column: count, mean, deviation, extremes, exact quantiles."""
    stats = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi"), *[F.percentile(c, q).alias(f"q{int(q * 100)}") for q in quantiles])
    return df.agg(F.array(*[stats(c) for c in columns]).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """column, value, n: the k most frequent values of each column, by value at ties."""
    from pyspark.sql import Window

    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    g = rows.groupBy("column", "value").agg(F.count("*").alias("n"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("r") <= k).drop("r")
