"""Deterministic, entity-safe samples and splits. Buckets are md5-based, so reruns and other engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelens.functions.exprs import hash_bucket, hash_unit
from tracelens.operators.temporal import running_totals


def bucket_sample(df: DataFrame, key: Column, size: int, keep: int) -> DataFrame:
    return df.where(hash_bucket(key, size) < keep)


def group_split(df: DataFrame, key: Column, buckets: int = 20, train: int = 14, val: int = 3, out: str = "split") -> DataFrame:
    """All rows of an entity on one side: train, val or test by its bucket."""
    b = hash_bucket(key, buckets)
    return df.withColumn(out, F.when(b < train, "train").when(b < train + val, "val").otherwise("test"))


def test_split(df: DataFrame, key: Column, test_frac: float, out: str = "is_test") -> DataFrame:
    return df.withColumn(out, (hash_unit(key) < test_frac).cast("int"))


def cap_negatives(df: DataFrame, entity: list[str], row_id: list[str], label: str, cap: int) -> DataFrame:
    """All positives, and of each entity's negatives the first `cap` in hash order."""
    key = hash_bucket(F.concat_ws("_", *row_id), 2**31)
    r = F.row_number().over(Window.partitionBy(*entity, label).orderBy(key, *row_id))
    return df.withColumn("__r", r).where((F.col(label) == 1) | (F.col("__r") <= cap)).drop("__r")


def working_set(groups: DataFrame, key: str, strata: list[str], size: str, failed: str, fraction: float) -> DataFrame:
    """Keys kept: all failed ones, and of each stratum of the others the prefix in hash order that stays within
    fraction of the stratum's size. groups: one row per key."""
    ok = groups.where(~F.col(failed))
    run = running_totals(ok, hash_bucket(F.col(key), 2**31), {"__run": F.col(size)}, strata, [F.col(key)])
    total = ok.groupBy(*strata).agg(F.sum(size).alias("__all"))
    kept = run.join(total, strata).where(F.col("__run") <= F.col("__all") * fraction).select(key)
    return groups.where(F.col(failed)).select(key).union(kept)


def strata_marginals(groups: DataFrame, kept: DataFrame, key: str, strata: list[str]) -> DataFrame:
    """Per stratum: keys before and after a selection, and the share kept."""
    n = groups.groupBy(*strata).agg(F.count("*").alias("before"))
    m = groups.join(kept.select(key), key, "left_semi").groupBy(*strata).agg(F.count("*").alias("after"))
    out = n.join(m, strata, "left").na.fill(0, ["after"])
    return out.withColumn("share", F.col("after") / F.col("before"))


def thin_healthy(df: DataFrame, label: str, key: Column, ratio: float) -> DataFrame:
    """All positives and about `ratio` negatives for each, chosen by hash."""
    n = df.agg(F.sum(F.col(label)).alias("p"), F.count("*").alias("n")).first()
    negatives = (n["n"] or 0) - (n["p"] or 0)
    keep = min(1.0, ratio * (n["p"] or 0) / negatives) if negatives else 1.0
    return df.where((F.col(label) == 1) | (hash_unit(key) < keep))


def ratio_branches(df: DataFrame, label: str, key: Column, ratios: tuple[float, ...]) -> DataFrame:
    """Rows and positives of thin_healthy at each ratio of negatives to positives."""
    out = None
    for r in ratios:
        one = thin_healthy(df, label, key, r).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("positives")).withColumn("ratio", F.lit(float(r)))
        out = one if out is None else out.union(one)
    return out


def drive_buckets(df: DataFrame, key: Column, buckets: int = 40, out: str = "bucket") -> DataFrame:
    """The bucket of each row's entity: whole histories stay together."""
    return df.withColumn(out, hash_bucket(key, buckets))


def fraction_sample(df: DataFrame, key: Column, share: float) -> DataFrame:
    """Rows of a share of the keys, by hash: the prevalence stays."""
    return df.where(hash_unit(key) < share)


def first_negatives(df: DataFrame, label: str, key: Column, keep: Column, ties: list[Column]) -> DataFrame:
    """All positives, and the first `keep` negatives in hash order; keep: over p (positives) and n (rows). The rank among
    all negatives is a running total over ranges of the hash."""
    totals = df.agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n")).select(keep.alias("__keep"))
    ranked = running_totals(df.where(F.col(label) != 1), hash_bucket(key, 2**31), {"__rank": F.lit(1)}, ties=ties)
    chosen = ranked.crossJoin(F.broadcast(totals)).where(F.col("__rank") <= F.col("__keep")).select(*[F.col(f"`{c}`") for c in df.columns])
    return df.where(F.col(label) == 1).union(chosen)


def negative_budget(df: DataFrame, label: str, key: Column, cap: Column, ties: list[Column]) -> DataFrame:
    """All positives, and negatives up to a budget of max(cap - positives, positives); cap: over p and n."""
    return first_negatives(df, label, key, F.greatest(cap - F.col("p"), F.col("p")), ties)


def rebalance(df: DataFrame, label: str, key: Column, ratio: float, ties: list[Column]) -> DataFrame:
    """All positives, and `ratio` negatives for each."""
    return first_negatives(df, label, key, F.col("p") * ratio, ties)


def stratified(df: DataFrame, strata: list[str], label: str, key: Column, size: int, plan: str = "proportional", enriched: float = 0.5) -> DataFrame:
    """About `size` rows by hash. plan "proportional": the same share of each stratum and label; "enriched": of each
    stratum's part of the rows a share `enriched` are positives, as far as there are any."""
    if plan not in ("proportional", "enriched"):
        raise ValueError(f"unknown plan {plan!r}")
    counts = df.groupBy(*strata).agg(F.count("*").alias("__n"), F.sum(F.col(label).cast("long")).alias("__p"))
    all_ = df.agg(F.count("*").alias("__all"))
    part = counts.crossJoin(F.broadcast(all_)).withColumn("__part", F.col("__n") * size / F.col("__all"))
    if plan == "proportional":
        share = F.col("__part") / F.col("__n")
    else:
        positives = F.least(F.col("__part") * enriched, F.col("__p").cast("double"))
        negatives = F.greatest(F.col("__n") - F.col("__p"), F.lit(1))
        share = F.when(F.col(label) == 1, positives / F.greatest(F.col("__p"), F.lit(1))).otherwise((F.col("__part") - positives) / negatives)
    return df.join(part, strata).where(hash_unit(key) < share).select(*[F.col(f"`{c}`") for c in df.columns])


def in_both(df: DataFrame, entity: str, label: str, side: Column, least: int = 1) -> DataFrame:
    """Entities with at least `least` positives on either side of a split."""
    n = df.groupBy(entity).agg(F.sum(F.when(side, F.col(label).cast("long"))).alias("a"), F.sum(F.when(~side, F.col(label).cast("long"))).alias("b"))
    return n.where(f"a >= {least} and b >= {least}").select(entity)


def learning_fractions(df: DataFrame, key: Column, percents: tuple[int, ...], out: str = "percent") -> DataFrame:
    """Rows per nested fraction: a row of bucket b belongs to each fraction over b. One pass and a sum over 100 numbers."""
    b = df.groupBy(hash_bucket(key, 100).alias("b")).agg(F.count("*").alias("n"))
    steps = F.explode(F.filter(F.array(*[F.lit(p) for p in percents]), lambda p: p > F.col("b"))).alias(out)
    return b.select(steps, "n").groupBy(out).agg(F.sum("n").alias("n"))


def first_attempts(df: DataFrame, entity: list[str], order: list[str]) -> DataFrame:
    """The first row of each entity."""
    at = F.struct(*order, *[F.col(f"`{c}`") for c in df.columns if c not in order])
    first = df.groupBy(*[F.col(c).alias(f"__{c}") for c in entity]).agg(F.min(at).alias("__first"))
    return first.select(*[F.col(f"__first.`{c}`").alias(c) for c in df.columns])


def day_folds(df: DataFrame, time: str, day: int, folds: int, out: str = "fold") -> DataFrame:
    """Walk-forward fold by day: rows of fold f train on folds before."""
    first = df.agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    d = F.floor((F.col(time) - F.col("__lo")) / day)
    days = F.floor((F.col("__hi") - F.col("__lo")) / day) + 1
    return df.crossJoin(F.broadcast(first)).withColumn(out, F.floor(d * folds / days)).drop("__lo", "__hi")
