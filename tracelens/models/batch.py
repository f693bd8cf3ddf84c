"""Batch models over pyspark.ml: one wrapper, factories, soft vote, calibration, search, ablation, evaluation.

Boosted libraries of the usual Python stack aren't available: boosted trees are pyspark.ml's, with class weights.
"xgboost" and "lightgbm" are those under their names, with scale_pos_weight or balanced weights. A balanced forest is a
vote of forests, each fitted to all positives and as many negatives, drawn anew by hash."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelens.functions import metrics
from tracelens.functions.exprs import hash_bucket, hash_unit
from tracelens.models import forest
from tracelens.schema import SEED
from tracelens.session import scratch

NAMES = ("random_forest", "balanced_forest", "xgboost", "lightgbm", "gradient_boosting", "decision_tree", "linear_svm", "logistic", "sgd_logistic", "neural_net", "most_frequent")


@dataclass
class Fitted:
    """A fitted pipeline; score() adds the column score, the probability of label 1 (the margin for linear_svm)."""

    name: str
    pipeline: PipelineModel | None
    features: list[str]
    constant: float = 0.0
    indicators: list[str] = field(default_factory=list)
    members: list[Fitted] = field(default_factory=list)
    #: borders of a forest's bins, where it was fitted by its cells, and the score of each cell once it is known
    cuts: list[list[float]] = field(default_factory=list)
    cells: list[float] | None = None

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        if self.members:
            return soft_vote(self.members, [1.0] * len(self.members), df, out)
        if self.pipeline is None:
            return df.withColumn(out, F.lit(self.constant))
        given = df.select("*", *_inputs(self.features, self.indicators))
        if self.cells is None:
            self.cells = forest.grid(self.pipeline.stages[-1], df.sparkSession, self.cuts)
        if self.cells is not None:
            filled = forest.score(self.pipeline.stages[0].transform(given), _columns(self.features, self.indicators), self.cuts, self.cells, "__s")
            return filled.select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("__s").alias(out))
        scored = self.pipeline.transform(given)
        column = "rawPrediction" if self.name == "linear_svm" else "probability"
        return scored.withColumn("__s", vector_to_array(column)[1]).select(*[F.col(f"`{c}`") for c in df.columns if c != out], F.col("__s").alias(out))

    predict_proba = score

    def importances(self) -> dict[str, float]:
        """By feature; a missing-value indicator counts for its feature. AttributeError where a model has none."""
        if self.members:
            parts = [m.importances() for m in self.members]
            return {f: sum(p[f] for p in parts) / len(parts) for f in self.features}
        last = self.pipeline.stages[-1] if self.pipeline else None
        if hasattr(last, "featureImportances"):
            v = last.featureImportances.toArray()
        elif hasattr(last, "coefficients"):
            v = abs(last.coefficients.toArray())
        else:
            raise AttributeError(f"{self.name} has no importances")
        out = dict(zip(self.features, map(float, v), strict=False))
        for c, x in zip(self.indicators, v[len(self.features) :], strict=True):
            out[c] += float(x)
        return out

    feature_importances = importances

    def save(self, path: str) -> None:
        """As a folder: what the wrapper knows, and the pipeline or the members."""
        from tracelens.session import SparkSession

        spark = SparkSession.getActiveSession()
        about = {"name": self.name, "features": self.features, "constant": self.constant, "indicators": self.indicators, "members": len(self.members), "fitted": self.pipeline is not None, "cuts": self.cuts}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        if self.pipeline is not None:
            self.pipeline.write().overwrite().save(f"{path}/pipeline")
        for i, m in enumerate(self.members):
            m.save(f"{path}/member-{i}")

    @staticmethod
    def load(path: str) -> Fitted:
        from tracelens.session import SparkSession

        about = json.loads(SparkSession.getActiveSession().read.text(f"{path}/about").first()["value"])
        members = [Fitted.load(f"{path}/member-{i}") for i in range(about.pop("members"))]
        pipeline = PipelineModel.load(f"{path}/pipeline") if about.pop("fitted") else None
        return Fitted(**about, pipeline=pipeline, members=members)


def _inputs(features: list[str], indicators: list[str]) -> list[Column]:
    as_double = [F.col(f"`{c}`").cast("double").alias(f"__x{i}") for i, c in enumerate(features)]
    return as_double + [F.col(f"`{c}`").isNull().cast("double").alias(f"__na{i}") for i, c in enumerate(indicators)]


def _columns(features: list[str], indicators: list[str]) -> list[str]:
    """What goes into a model: the features with medians for nulls, and the indicators."""
    return [*[f"__m{i}" for i in range(len(features))], *[f"__na{i}" for i in range(len(indicators))]]


def _classifier(name: str, n: int, label: str, weight: str, **kw):
    both = {"featuresCol": "features", "labelCol": label}
    if name == "random_forest":
        return RandomForestClassifier(numTrees=kw.get("num_trees", 300), maxDepth=kw.get("max_depth", 8), seed=SEED, weightCol=weight, **both)
    if name in ("gradient_boosting", "xgboost", "lightgbm"):
        return GBTClassifier(maxIter=kw.get("rounds", 50), maxDepth=kw.get("max_depth", 5), stepSize=kw.get("rate", 0.1), seed=SEED, weightCol=weight, **both)
    if name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=kw.get("max_depth", 8), seed=SEED, weightCol=weight, **both)
    if name == "linear_svm":
        return LinearSVC(weightCol=weight, regParam=kw.get("reg", 0.0), **both)
    if name in ("logistic", "sgd_logistic"):
        # few first-order steps with a ridge stand for the stochastic descent
        reg, steps = (kw.get("reg", 0.0), kw.get("steps", 100)) if name == "logistic" else (kw.get("reg", 1e-4), kw.get("steps", 20))
        return LogisticRegression(weightCol=weight, regParam=reg, maxIter=steps, **both)
    return MultilayerPerceptronClassifier(layers=[n, kw.get("hidden", 32), 2], seed=SEED, maxIter=kw.get("steps", 100), **both)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, weight: n / (classes x n of the class)."""
    c = df.groupBy(label).agg(F.count("*").cast("double").alias("__c"))
    all_ = c.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    return c.crossJoin(F.broadcast(all_)).select(label, (F.col("__n") / (F.col("__k") * F.col("__c"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, out: str = "__weight") -> DataFrame:
    """Balanced weights by row; they are two numbers."""
    w = F.lit(1.0)
    for r in class_weights(df, label).collect():
        w = F.when(F.col(label) == r[label], r["weight"]).otherwise(w)
    return df.withColumn(out, w)


def scale_pos_weight(df: DataFrame, label: str) -> float:
    """Negatives per positive; 1 without either."""
    r = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    return r["n"] / r["p"] if r["p"] and r["n"] else 1.0


def undersample(df: DataFrame, label: str, key: Column, draw: int, ratio: float = 1.0) -> DataFrame:
    """All positives and about `ratio` negatives for each, another draw for each number."""
    keep = min(1.0, ratio / scale_pos_weight(df, label))
    return df.where((F.col(label) == 1) | (hash_unit(F.concat_ws("_", key.cast("string"), F.lit(str(draw)))) < keep))


def smote(df: DataFrame, features: list[str], label: str, ratio: float = 1.0, k: int = 5, buckets: int | None = None) -> DataFrame:
    """df and synthetic positives between positives and their near neighbours, until there are `ratio` for each negative.
    For training folds only. Only features and label of the synthetic rows are set.

    Neighbours are those in a random cell of about 1,000 positives, so that no task holds all of them."""
    r = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    more = max(0, int(r["n"] * ratio) - r["p"])
    if not more or r["p"] < 2:
        return df
    each, cells = more / r["p"], buckets or max(1, r["p"] // 1000)
    positives = df.where(F.col(label) == 1).select(*[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)]).na.fill(0.0)
    names = [f"f{i}" for i in range(len(features))]
    kind = ", ".join(f"{c} double" for c in names)

    def between(pdf):
        import numpy as np
        import pandas as pd

        x = pdf.sort_values(names)[names].to_numpy(float)
        rng = np.random.default_rng(SEED)
        if len(x) < 2:
            return pd.DataFrame(np.repeat(x, round(each), axis=0), columns=names)
        made = []
        for i in range(len(x)):
            n = int(each) + (rng.random() < each - int(each))
            d = ((x - x[i]) ** 2).sum(axis=1)
            d[i] = np.inf
            near = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
            to = x[rng.choice(near, n)]
            made.append(x[i] + rng.random((n, 1)) * (to - x[i]))
        return pd.DataFrame(np.concatenate(made), columns=names)

    cell = F.pmod(F.xxhash64(*names), F.lit(cells)).alias("cell")
    new = positives.select(cell, *names).groupBy("cell").applyInPandas(lambda pdf: between(pdf.drop(columns="cell")), kind)
    typed = {c: t for c, t in df.dtypes}
    new = new.select(*[F.col(f"f{i}").cast(typed[c]).alias(c) for i, c in enumerate(features)], F.lit(1).cast(typed[label]).alias(label))
    return df.unionByName(new, allowMissingColumns=True)


def fit_model(name: str, df: DataFrame, features: list[str], label: str, indicators: bool = False, weights: str | None = None, **kw) -> Fitted:
    """A fitted model by name. indicators: a column more for each feature that has nulls. weights: a column of row
    weights; else balanced ones, for "xgboost" scale_pos_weight (negatives per positive unless pinned in kw), for the
    balanced forest and the net none."""
    if name not in NAMES:
        raise KeyError(name)
    if name == "most_frequent":
        r = df.agg(F.avg(F.col(label).cast("double")).alias("r")).first()["r"] or 0.0
        return Fitted(name, None, features, float(r >= 0.5))
    if name == "balanced_forest":
        n, trees = kw.get("draws", 5), kw.get("num_trees", 300)
        key = kw.get("key", F.xxhash64(*[F.col(f"`{c}`") for c in features]))
        parts = [fit_model("random_forest", undersample(df, label, key, i), features, label, indicators, num_trees=max(1, trees // n), max_depth=kw.get("max_depth", 8)) for i in range(n)]
        return Fitted(name, None, features, members=parts)
    if weights is not None:
        data = df.withColumn("__weight", F.col(weights).cast("double"))
    elif name == "xgboost":
        data = df.withColumn("__weight", F.when(F.col(label) == 1, float(kw.get("scale_pos_weight") or scale_pos_weight(df, label))).otherwise(1.0))
    else:
        data = with_class_weights(df, label)
    missing: list[str] = []
    if indicators:
        nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(features)]).first()
        missing = [c for i, c in enumerate(features) if nulls[i]]
    data = data.select("*", *_inputs(features, missing))
    raw, columns = [f"__x{i}" for i in range(len(features))], _columns(features, missing)
    medians = columns[: len(features)]
    scaled = name in ("neural_net", "linear_svm", "sgd_logistic")
    steps = [Imputer(strategy="median", inputCols=raw, outputCols=medians), VectorAssembler(inputCols=columns, outputCol="__v" if scaled else "features", handleInvalid="keep")]
    if scaled:
        steps.append(StandardScaler(inputCol="__v", outputCol="features", withMean=True, withStd=True))
    if name == "random_forest":
        fill = steps[0].fit(data)
        trees = forest.fit(fill.transform(data), columns, label, "__weight", kw.get("num_trees", 300), kw.get("max_depth", 8))
        if trees is not None:
            return Fitted(name, PipelineModel([fill, steps[1], trees[0]]), features, indicators=missing, cuts=trees[1])
    fitted = Pipeline(stages=[*steps, _classifier(name, len(columns), label, "__weight", **kw)]).fit(data)
    return Fitted(name, fitted, features, indicators=missing)


def soft_vote(models: list[Fitted], weights: list[float], df: DataFrame, out: str = "score") -> DataFrame:
    """Mean of the models' scores by normalised weights."""
    total = sum(weights)
    names = [f"__vote_{out}_{i}" for i in range(len(models))]
    for m, c in zip(models, names, strict=True):
        df = m.score(df, c)
    vote = sum(F.col(c) * (w / total) for c, w in zip(names, weights, strict=True))
    return df.withColumn(out, vote).drop(*names)


def vote_importances(models: list[Fitted], weights: list[float]) -> dict[str, float]:
    """Members' importances, each scaled to a sum of 1, by normalised weights; members without any are left out."""
    parts = []
    for m, w in zip(models, weights, strict=True):
        try:
            x = m.importances()
        except AttributeError:
            continue
        parts.append((w, {f: v / (sum(x.values()) or 1.0) for f, v in x.items()}))
    total = sum(w for w, _ in parts) or 1.0
    return {f: sum(w * x.get(f, 0.0) for w, x in parts) / total for f in models[0].features}


def permutation_importance(model: Fitted, df: DataFrame, label: str, key: str) -> DataFrame:
    """feature, drop: how much ROC-AUC falls when a feature's values are dealt anew among the rows (by rank in the order
    of a hash, so the job is two sorts a feature and no product)."""
    from tracelens.operators.temporal import running_totals

    base = metrics.ranking(model.score(df), label, "score").first()["roc_auc"]
    spark, rows = df.sparkSession, []
    ranked = lambda d, salt: running_totals(d, hash_bucket(F.concat_ws("_", F.col(key).cast("string"), F.lit(salt)), 2**31), {"__rank": F.lit(1)}, ties=[F.col(key)])
    for f in model.features:
        values = ranked(df.select(key, f), f"values {f}").select("__rank", F.col(f).alias("__dealt"))
        mixed = ranked(df, "rows").join(values, "__rank").withColumn(f, F.col("__dealt")).drop("__rank", "__dealt")
        rows.append((f, base - metrics.ranking(model.score(mixed), label, "score").first()["roc_auc"]))
    return spark.createDataFrame(rows, "feature string, drop double")


def search(name: str, train: DataFrame, valid: DataFrame, features: list[str], label: str, grid: list[dict], metric: str = "pr_auc") -> tuple[dict, Fitted, DataFrame]:
    """The grid's parameters with the best metric on a validation frame (the first at ties), their model, and a frame of
    all trials (trial, parameters, value)."""
    trials = []
    for p in grid:
        m = fit_model(name, train, features, label, **p)
        v = evaluate(m, valid, label).first()[metric]
        trials.append((p, m, -math.inf if v is None else float(v)))
    best = max(range(len(trials)), key=lambda i: (trials[i][2], -i))
    table = train.sparkSession.createDataFrame([(i, json.dumps(p, sort_keys=True), v) for i, (p, _, v) in enumerate(trials)], "trial int, parameters string, value double")
    return trials[best][0], trials[best][1], table


def random_grid(space: dict[str, list], trials: int, seed: int = SEED) -> list[dict]:
    """Distinct random points of a space of parameter values, all of them if there are no more than asked."""
    import itertools
    import random

    points = [dict(zip(space, v, strict=True)) for v in itertools.product(*space.values())]
    return points if len(points) <= trials else random.Random(seed).sample(points, trials)


def ablation(name: str, train: DataFrame, test: DataFrame, feature_sets: dict[str, list[str]], label: str, **kw) -> DataFrame:
    """A row per feature set: its size and the metrics of a model fitted to it."""
    out = None
    for part, features in feature_sets.items():
        one = evaluate(fit_model(name, train, features, label, **kw), test, label).select(F.lit(part).alias("features"), F.lit(len(features)).alias("n_features"), "mcc", "f1", "pr_auc", "roc_auc", "brier")
        out = one if out is None else out.union(one)
    return out


def calibrate(val: DataFrame, score: str, label: str):
    """(kind, function of a frame): isotonic or logistic on the score, whichever has the lower Brier on val."""
    iso_in = val.withColumn("label", F.col(label).cast("double")).withColumn("features", F.col(score).cast("double"))
    iso = IsotonicRegression(labelCol="label", featuresCol="features").fit(iso_in)
    assemble = VectorAssembler(inputCols=[score], outputCol="__v")
    platt = LogisticRegression(featuresCol="__v", labelCol=label).fit(assemble.transform(val))

    def by_iso(df: DataFrame) -> DataFrame:
        return iso.transform(df.withColumn("features", F.col(score).cast("double"))).withColumnRenamed("prediction", "calibrated").drop("features")

    def by_platt(df: DataFrame) -> DataFrame:
        p = platt.transform(assemble.transform(df))
        return p.withColumn("calibrated", vector_to_array("probability")[1]).drop("__v", "rawPrediction", "probability", "prediction")

    brier = lambda d: d.agg(F.avg((F.col("calibrated") - F.col(label)) ** 2).alias("b")).first()["b"]
    return ("isotonic", by_iso) if brier(by_iso(val)) <= brier(by_platt(val)) else ("platt", by_platt)


def evaluate(model: Fitted, df: DataFrame, label: str, threshold: float = 0.5) -> DataFrame:
    """One row: confusion, MCC, F1, PR-AUC, ROC-AUC, Brier. The rows are scored once, here, and their scores written."""
    path = scratch(df.sparkSession, "scores")
    model.score(df).select(label, "score").write.parquet(path)
    s = df.sparkSession.read.parquet(path).withColumn("p", (F.col("score") >= threshold).cast("int"))
    return metrics.scores(s, label, "p").crossJoin(metrics.ranking(s, label, "score"))
