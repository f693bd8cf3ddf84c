import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tracelens.models import batch, forest


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    y = (rng.random(3000) < 0.3).astype(int)
    a, b = rng.normal(1.5 * y, 1.0), np.round(rng.normal(0, 2, 3000))
    values = [(i, float(a[i]), None if i % 9 == 0 else float("nan") if i % 50 == 1 else float(b[i]), int(y[i])) for i in range(3000)]
    return spark.createDataFrame(values, "id long, a double, b double, y int").cache()


def test_forest_needs_the_cells_only_and_scores_as_its_trees(rows, monkeypatch):
    peer = batch.Pipeline(stages=[batch.Imputer(strategy="median", inputCols=["a", "b"], outputCols=["__m0", "__m1"]), batch.VectorAssembler(inputCols=["__m0", "__m1"], outputCol="features"), RandomForestClassifier(numTrees=100, maxDepth=4, labelCol="y", seed=1, weightCol="w")])
    theirs = peer.fit(batch.with_class_weights(rows, "y", "w")).transform(rows.withColumn("w", F.lit(1.0)))
    theirs = {r["id"]: r["s"] for r in theirs.select("id", vector_to_array("probability")[1].alias("s")).collect()}

    def refuse(*_):
        raise AssertionError("rows are sent down all trees at each level")

    monkeypatch.setattr(RandomForestClassifier, "_fit", refuse)
    m = batch.fit_model("random_forest", rows, ["a", "b"], "y", num_trees=100, max_depth=4)
    trees = m.pipeline.stages[-1]
    assert trees.getNumTrees == 100 and max(t.depth for t in trees.trees) == 4
    mine = {r["id"]: r["score"] for r in m.score(rows).collect()}
    through = m.pipeline.transform(rows.select("*", *batch._inputs(["a", "b"], []))).select("id", vector_to_array("probability")[1].alias("s"))
    assert mine == {r["id"]: r["s"] for r in through.collect()} and len(mine) == 3000
    gap = np.array([mine[i] - theirs[i] for i in mine])
    assert abs(gap.mean()) < 0.01 and np.abs(gap).mean() < 0.03


def test_all_rows_are_in_the_cells(rows):
    filled = rows.na.fill(0.0, ["b"]).withColumn("w", F.lit(1.0))
    cuts = forest.borders(filled, ["a", "b"])
    assert forest.cells(filled, ["a", "b"], cuts, "y", "w").agg(F.sum("n")).first()[0] == 3000
    one = forest.grow(np.array([[0], [1], [2]]), np.array([0, 1, 1]), np.array([3.0, 2.0, 1.0]), np.array([3, 2, 1]), [[0.5, 1.5]], 2, 3, np.random.default_rng(0))
    assert [x["impurityStats"] for x in one] == [[3.0, 3.0], [3.0, 0.0], [0.0, 3.0]] and one[0]["split"]["leftCategoriesOrThreshold"] == [0.5] and one[0]["rawCount"] == 6


def test_borders_of_few_and_of_common_values(spark):
    n = 2000
    odd = spark.createDataFrame([(float(i % 3), float(i) if i < 60 else 99.0, 5.0, float(i == 0)) for i in range(n)], "a double, b double, c double, d double")
    a, b, c, d = forest.borders(odd, ["a", "b", "c", "d"])
    assert a == [0.0, 1.0] and 59.0 in b and 99.0 not in b and c == [] and d == [0.0]


def test_too_many_cells_go_to_the_other_trainer(rows, monkeypatch):
    monkeypatch.setattr(forest, "CELL_VALUES", 10)
    m = batch.fit_model("random_forest", rows, ["a", "b"], "y", num_trees=3, max_depth=2)
    assert m.cuts == [] and m.pipeline.stages[-1].getNumTrees == 3
    assert batch.evaluate(m, rows, "y").first()["roc_auc"] > 0.8
