"""Random forest fitted to the counts of binned rows.

As in pyspark.ml's forest, features are cut into about 32 bins and each tree draws every row Poisson(1) times. Rows with
the same bins, label and weight are alike to it, and their draws together are Poisson(number of such rows): so a tree
needs the table of cells (bins, label, weight, count) and not the rows. All rows are read for the bins' borders and for
the counts; the trees are then grown in tasks of their own, whatever the number of rows. pyspark.ml's trainer instead
holds each row with a number a tree and sends it down all trees at each level.

Splits, leaves, subsets of features, and pruning of leaves that agree are pyspark.ml's, and so is the model: the nodes are
written in its format and loaded. Where there are more cells than CELL_VALUES allows (many features), fit() returns None
and the caller fits pyspark.ml's forest to the rows.

The model's score is one number within a cell of the bins. Where all features' bins make at most GRID cells, each cell
is scored once and rows look theirs up; else rows pass the trees.
"""

from __future__ import annotations

import itertools
import json
import math
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.schema import SEED
from tracelens.session import scratch, ship

BINS = 32
#: Most values of a table of cells that goes to the driver and the tasks.
CELL_VALUES = 4_000_000
#: Most cells that are scored once for all rows.
GRID = 20_000

NODES = """treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, gain double,
    leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"""
_SPLIT = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
_NODE = pa.struct([
    ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()),
    ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", _SPLIT),
])


def borders(df: DataFrame, columns: list[str]) -> list[list[float]]:
    """Where each column is cut: a row is left of t if its value is at most t. All distinct values of a column that has
    few; else its quantiles, and for one that several levels share the value before it too."""
    levels = [i / BINS for i in range(1, BINS)]
    found = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("d", F.approx_count_distinct), ("m", F.max), ("q", lambda c: F.percentile_approx(c, levels, 10_000)))]).first()
    few = [i for i in range(len(columns)) if found[f"d{i}"] <= 1.25 * BINS]  # the estimate is within a few percent
    cuts = {i: sorted(set(found[f"q{i}"])) for i in range(len(columns)) if i not in few}
    more = [F.collect_set(columns[i]).alias(f"v{i}") for i in few]
    shared = [(i, t) for i, ts in cuts.items() for t in ts if found[f"q{i}"].count(t) > 1]
    more += [F.max(F.when(F.col(columns[i]) < t, F.col(columns[i]))).alias(f"b{k}") for k, (i, t) in enumerate(shared)]
    if more:
        row = df.agg(*more).first()
        cuts |= {i: row[f"v{i}"] for i in few}
        for k, (i, _) in enumerate(shared):
            cuts[i] = [*cuts[i], *([row[f"b{k}"]] if row[f"b{k}"] is not None else [])]
    # nothing is right of the largest value; NaN is, of all others
    return [sorted({float(t) + 0.0 for t in cuts[i] if not math.isnan(t) and t < found[f"m{i}"]}) for i in range(len(columns))]


def binned(df: DataFrame, columns: list[str], cuts: list[list[float]]) -> tuple[DataFrame, list[Column]]:
    """df with what the second needs: the bin of each column."""
    cut = [i for i, t in enumerate(cuts) if t]
    if cut:
        # the buckets are [low, high), the bins (low, high]
        edges = [[-math.inf, *(float(np.nextafter(t, math.inf)) for t in cuts[i]), math.inf] for i in cut]
        df = Bucketizer(splitsArray=edges, inputCols=[columns[i] for i in cut], outputCols=[f"__b{i}" for i in cut], handleInvalid="keep").transform(df)
    return df, [(F.least(F.col(f"__b{i}"), F.lit(float(len(t)))) if t else F.lit(0)).cast("int") for i, t in enumerate(cuts)]


def cells(df: DataFrame, columns: list[str], cuts: list[list[float]], label: str, weight: str) -> DataFrame:
    """b0, b1, ... (bin of each column), y, w, n: the rows of each kind."""
    df, bins = binned(df, columns, cuts)
    keys = [*[b.alias(f"b{i}") for i, b in enumerate(bins)], F.col(label).cast("int").alias("y"), F.col(weight).cast("double").alias("w")]
    return df.select(*keys).groupBy(*[f"b{i}" for i in range(len(cuts))], "y", "w").agg(F.count("*").alias("n"))


def grid(model: RandomForestClassificationModel, spark: SparkSession, cuts: list[list[float]]) -> list[float] | None:
    """The probability of label 1 in each cell of the bins, the last column's bins first; None over GRID cells. It is one
    number within a cell, as all splits are at the bins' borders."""
    if not cuts or math.prod(len(t) + 1 for t in cuts) > GRID:
        return None
    points = [(k, Vectors.dense(x)) for k, x in enumerate(itertools.product(*[[*t, math.inf] for t in cuts]))]
    scored = model.transform(spark.createDataFrame(points, ["cell", "features"]))
    return [r["s"] for r in sorted(scored.select("cell", vector_to_array("probability")[1].alias("s")).collect())]


def score(df: DataFrame, columns: list[str], cuts: list[list[float]], values: list[float], out: str) -> DataFrame:
    """df with the values of the rows' cells; rows don't pass the trees."""
    kept = df.columns
    df, bins = binned(df, columns, cuts)
    cell = F.lit(0)
    for b, t in zip(bins, cuts, strict=True):
        cell = cell * (len(t) + 1) + b
    table = df.sparkSession.createDataFrame(list(enumerate(values)), "__cell int, __value double")
    found = df.withColumn("__cell", cell).join(F.broadcast(table), "__cell", "left")
    return found.select(*[F.col(f"`{c}`") for c in kept], F.col("__value").alias(out))


def _gini(s: np.ndarray) -> np.ndarray:
    total = s.sum(-1)
    return np.where(total > 0, 1 - (s * s).sum(-1) / np.where(total > 0, total * total, 1), 0.0)


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray, cuts: list[list[float]], classes: int, depth: int, rng: np.random.Generator) -> list[dict]:
    """The nodes of one tree over cells with n rows and the weight w each, in the order of a walk from the root. Grown by
    levels, all nodes of a level at once."""
    features, wide = bins.shape[1], max(map(len, cuts)) + 1
    some = math.ceil(math.sqrt(features))
    at = np.flatnonzero(n)
    bins, y, w, n = bins[at].astype(np.int64), y[at], w[at], n[at]
    base, count, where = 0, 1, np.zeros(len(at), np.int64)  # the level's nodes, each cell's among them
    levels: list[tuple] = []
    for level in range(depth + 1):
        stats, rows = np.bincount(where * classes + y, w, count * classes).reshape(count, classes), np.bincount(where, n, count)
        impurity, total = _gini(stats), stats.sum(1)
        gain, feature, cut = np.zeros(count), np.full(count, -1), np.zeros(count, np.int64)
        if level < depth:
            taken = np.zeros((count, features), bool)
            np.put_along_axis(taken, rng.random((count, features)).argsort(1)[:, :some], True, 1)
            for f in (f for f in range(features) if cuts[f]):
                place = where * wide + bins[:, f]
                left = np.bincount(place * classes + y, w, count * wide * classes).reshape(count, wide, classes).cumsum(1)[:, : len(cuts[f])]
                less = np.bincount(place, n, count * wide).reshape(count, wide).cumsum(1)[:, : len(cuts[f])]
                share = left.sum(2) / np.where(total > 0, total, 1)[:, None]
                g = impurity[:, None] - share * _gini(left) - (1 - share) * _gini(stats[:, None] - left)
                g[(less == 0) | (less == rows[:, None])] = -1.0
                k = g.argmax(1)
                g = g[np.arange(count), k]
                better = (g > gain) & taken[:, f] & (impurity > 1e-14)
                gain[better], feature[better], cut[better] = g[better], f, k[better]
        split = feature >= 0
        first = np.where(split, base + count + 2 * (split.cumsum() - 1), -1)
        levels += zip(stats.tolist(), impurity.tolist(), rows.tolist(), gain.tolist(), feature.tolist(), cut.tolist(), first.tolist(), strict=True)
        on = split[where]
        bins, y, w, n, where = bins[on], y[on], w[on], n[on], where[on]
        where = first[where] - base - count + (bins[np.arange(len(where)), feature[where]] > cut[where])
        base, count = base + count, 2 * int(split.sum())
        if not count:
            break

    nodes: list[dict] = []

    def walk(i: int) -> dict:
        stats, impurity, rows, gain, f, k, first = levels[i]
        me = {"id": len(nodes), "prediction": float(np.argmax(stats)), "impurity": impurity, "impurityStats": stats, "rawCount": int(rows), "gain": -1.0, "leftChild": -1, "rightChild": -1, "split": {"featureIndex": -1, "leftCategoriesOrThreshold": [], "numCategories": -1}}
        nodes.append(me)
        if first < 0:
            return me
        left, right = walk(first), walk(first + 1)
        if left["leftChild"] < 0 and right["leftChild"] < 0 and left["prediction"] == right["prediction"]:
            del nodes[me["id"] + 1 :]
            me["prediction"] = left["prediction"]
        else:
            me |= {"gain": gain, "leftChild": left["id"], "rightChild": right["id"], "split": {"featureIndex": f, "leftCategoriesOrThreshold": [cuts[f][k]], "numCategories": -1}}
        return me

    walk(0)
    return nodes


def _trees(table, cuts: list[list[float]], classes: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, y, w, n = table.value
        for batch in batches:
            for tree in batch.column("id").to_pylist():
                rng = np.random.default_rng([SEED, tree])
                drawn = rng.poisson(n)
                found = grow(bins, y, w * drawn, drawn, cuts, classes, depth, rng)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(found), pa.int32()), pa.array(found, _NODE)], ["treeID", "nodeData"])

    return run


def _about(kind: str, uid: str, estimator, given: dict, **more) -> str:
    return json.dumps({"class": f"org.apache.spark.ml.classification.{kind}", "timestamp": int(time.time() * 1000), "sparkVersion": pyspark.__version__, "uid": uid, "paramMap": given, "defaultParamMap": {p.name: v for p, v in estimator._defaultParamMap.items()}, **more})


def fit(df: DataFrame, columns: list[str], label: str, weight: str, num_trees: int, max_depth: int) -> tuple[RandomForestClassificationModel, list[list[float]]] | None:
    """A forest over the columns (doubles without nulls), as a vector named "features", and the borders of its bins. None
    if the cells are too many, or none."""
    spark = df.sparkSession
    if not columns or df.isEmpty():
        return None
    cuts = borders(df, columns)
    most = CELL_VALUES // (len(columns) + 3)
    found = cells(df, columns, cuts, label, weight).limit(most + 1).toArrow()
    if found.num_rows > most or any(found.column(c).null_count for c in ("y", "w")):
        return None
    found = found.sort_by([(c, "ascending") for c in found.column_names])  # draws go by a cell's place
    bins = np.stack([found.column(f"b{i}").to_numpy() for i in range(len(columns))], axis=1).astype(np.int16)
    y, w, n = (found.column(c).to_numpy() for c in "ywn")
    if y.min() < 0:
        return None
    classes = max(2, int(y.max()) + 1)

    ship(spark)
    path, uid = scratch(spark, "forest"), f"RandomForestClassifier_{uuid.uuid4().hex[:12]}"
    table = spark.sparkContext.broadcast((bins, y.astype(np.int64), w, n))
    tasks = min(num_trees, 4 * spark.sparkContext.defaultParallelism)
    grown = spark.range(0, num_trees, 1, tasks).mapInArrow(_trees(table, cuts, classes, max_depth), NODES)
    grown.write.parquet(f"{path}/data")
    given = {"labelCol": label, "weightCol": weight, "maxDepth": max_depth, "seed": SEED}
    size = {"numFeatures": len(columns), "numClasses": classes}
    forest = _about("RandomForestClassificationModel", uid, RandomForestClassifier(), {**given, "featuresCol": "features", "numTrees": num_trees}, **size, numTrees=num_trees)
    tree = DecisionTreeClassifier()
    spark.createDataFrame([(i, _about("DecisionTreeClassificationModel", f"dtc_{uuid.uuid4().hex[:12]}", tree, given, **size), 1.0) for i in range(num_trees)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(forest,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path), cuts
