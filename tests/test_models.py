import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelens.models import batch


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    y = (rng.random(600) < 0.25).astype(int)
    a, b = rng.normal(2.0 * y, 1.0), rng.normal(0, 1, 600)
    rows = [(i, float(a[i]), None if i % 9 == 0 else float(b[i]), int(y[i])) for i in range(600)]
    return spark.createDataFrame(rows, "id long, a double, b double, y int").cache()


SMALL = {"random_forest": {"num_trees": 10}, "balanced_forest": {"num_trees": 10, "draws": 2}, "xgboost": {"rounds": 5}, "lightgbm": {"rounds": 5}, "gradient_boosting": {"rounds": 5}}


@pytest.mark.parametrize("name", [n for n in batch.NAMES if n != "most_frequent"])
def test_models_rank_and_survive_saving(name, data, tmp_path):
    m = batch.fit_model(name, data, ["a", "b"], "y", indicators=True, **SMALL.get(name, {}))
    before = {r["id"]: r["score"] for r in m.score(data).collect()}
    m.save(str(tmp_path / "m"))
    again = batch.Fitted.load(str(tmp_path / "m"))
    assert {r["id"]: r["score"] for r in again.score(data).collect()} == before and again.features == ["a", "b"]
    assert m.score(data).columns == [*data.columns, "score"]
    auc = batch.metrics.ranking(m.score(data), "y", "score").first()["roc_auc"]
    assert auc > 0.85
    if name == "neural_net":
        with pytest.raises(AttributeError):
            m.importances()
    else:
        x = m.importances()
        assert set(x) == {"a", "b"} and x["a"] > x["b"]


def test_names_weights_and_votes(data):
    with pytest.raises(KeyError):
        batch.fit_model("none", data, ["a"], "y")
    n = {r["y"]: r["count"] for r in data.groupBy("y").count().collect()}
    assert batch.scale_pos_weight(data, "y") == n[0] / n[1]
    assert {r["y"]: r["weight"] for r in batch.class_weights(data, "y").collect()} == {k: pytest.approx(600 / (2 * v)) for k, v in n.items()}
    pair = [batch.fit_model("logistic", data, ["a", "b"], "y"), batch.fit_model("most_frequent", data, ["a", "b"], "y")]
    both = batch.soft_vote(pair, [3.0, 1.0], data).collect()
    alone = {r["id"]: r["score"] for r in pair[0].score(data).collect()}
    assert all(r["score"] == pytest.approx(0.75 * alone[r["id"]]) for r in both)
    x = batch.vote_importances(pair, [3.0, 1.0])
    assert sum(x.values()) == pytest.approx(1.0)


def test_oversampling_stays_between_positives(data):
    out = batch.smote(data, ["a", "b"], "y")
    n = {r["y"]: r["count"] for r in out.groupBy("y").count().collect()}
    assert n[0] == data.where("y = 0").count() and abs(n[1] - n[0]) < 0.1 * n[0]
    lo, hi = data.where("y = 1").agg(F.min("a"), F.max("a")).first()
    assert out.where("id is null").where(~F.col("a").between(lo - 1e-9, hi + 1e-9)).isEmpty()
    assert batch.smote(data.where("y = 0"), ["a"], "y").count() == n[0]


def test_search_ablation_and_permutation(data):
    train, test = data.where("id % 3 > 0"), data.where("id % 3 = 0")
    grid = batch.random_grid({"max_depth": [1, 3], "num_trees": [3]}, 9)
    assert grid == [{"max_depth": 1, "num_trees": 3}, {"max_depth": 3, "num_trees": 3}]
    best, model, trials = batch.search("random_forest", train, test, ["a", "b"], "y", grid)
    values = [r["value"] for r in trials.orderBy("trial").collect()]
    assert best == grid[int(np.argmax(values))] and len(values) == 2
    table = {r["features"]: r["roc_auc"] for r in batch.ablation("logistic", train, test, {"both": ["a", "b"], "noise": ["b"]}, "y").collect()}
    assert table["both"] > 0.85 > table["noise"]
    drops = {r["feature"]: r["drop"] for r in batch.permutation_importance(model, test, "y", "id").collect()}
    assert drops["a"] > 0.2 > abs(drops["b"])
