"""Models, folds and search on a small separable table."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from inkvane.ml import folds, models
from inkvane.ml.models import Classifier
from inkvane.ml.search import Search, cross_val, forward_selection, seeded, train_eval
from inkvane.operators.tabular import assembled


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(80).select("id", (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 2 + F.rand(1) * 0.4).alias("good"), F.rand(2).alias("noise"))
    return assembled(rows, ["good", "noise"]).persist()


@pytest.mark.parametrize(("name", "params"), [("logreg", {}), ("rfc", {"n_estimators": 5}), ("etc", {"n_estimators": 5}), ("catboost", {"n_estimators": 2}), ("mlp", {"hidden_dim": 4, "epochs": 30})])
def test_models_learn(table, name, params):
    assert train_eval(name, params, table.where("id < 60"), table.where("id >= 60")) > 0.9


def test_stacking(table):
    fitted = Classifier("stacking", {"folds": 2, "bases": ("rfc", "logreg"), "rfc": {"n_estimators": 3}}).fit(table)
    got = fitted.predict_proba(table)
    assert {"prediction", "proba"} <= set(got.columns) and folds.evaluated(got) > 0.9


def test_folds(table):
    got = folds.stratified_folds(table, 5).groupBy("label", "fold").count().collect()
    assert len(got) == 10 and {r["count"] for r in got} == {8}
    rng = np.random.default_rng(3)
    ids = rng.choice(10**6, 500, replace=False).tolist()
    rows = table.sparkSession.createDataFrame([(i, int(rng.integers(0, 3)) if k > 2 else 7) for k, i in enumerate(ids)], "id long, label int")
    want = rows.withColumn("want", F.ntile(5).over(Window.partitionBy("label").orderBy("id")) - 1)
    got = folds.stratified_folds(rows, 5).join(want, ["id", "label"])
    assert got.count() == 500 and got.where("fold <> want").count() == 0 and folds.stratified_folds(rows.limit(0)).count() == 0
    train, out = folds.hold_out(table, 0.3)
    assert train.count() + out.count() == 80 and 10 < out.count() < 40


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (2, 0)], "label int, prediction int")
    assert folds.evaluated(df) == 0.5
    # by hand: F1 of 1 is 2/3 (support 2), of 0 is 1/2 (1), of 2 is 0 (1)
    assert folds.evaluated(df, "f1_weighted") == pytest.approx((2 * 2 / 3 + 0.5) / 4)
    with pytest.raises(ValueError):
        folds.evaluated(df, "other")
    with pytest.raises(ValueError):
        train_eval("logreg", {}, df, df, "other")


def test_search(table):
    search = Search("logreg", table, folds=2, start=2, fixed={"max_iter": 5})
    assert search.run(3).score > 0.9 and len(search.trials) == 3
    assert Search("logreg", table, seed=1).suggest()[0] == Search("logreg", table, seed=1).suggest()[0]
    assert cross_val("logreg", {}, table, folds=2) > 0.9 and seeded(3) == 3


def test_searches_sample_what_the_back_end_takes(table):
    for name in ("rfc", "lightgbm", "catboost", "mlp", "embed_lstm"):
        params = Search(name, table, seed=2).suggest()[0]
        assert params and set(params) <= models.HONOURED[name]
    trees = models.create_model("catboost", {"n_estimators": 2500, "learning_rate": 0.05})
    assert trees.getMaxIter() == 2500 and trees.getStepSize() == 0.05
    assert models.create_model("rfc", {"max_depth": None}).getMaxDepth() == 30
    assert len({(models.create_model(n).getStepSize(), models.create_model(n).getMaxIter()) for n in ("lightgbm", "catboost")}) == 2


def test_perceptron_over_word_vectors(spark):
    words = spark.createDataFrame([("good", [1.0, 0.0]), ("bad", [0.0, 1.0])], "token string, vec array<float>")
    pairs = spark.createDataFrame([(i, ["good news", "bad things"][i % 2], float(i % 2)) for i in range(40)], "id long, summary string, label double")
    rows = models.summary_vectors(pairs, words)
    assert train_eval("embed_lstm", {"mlp_hidden_dim": 4, "epochs": 30}, rows, rows) == 1.0


def test_forward_selection(table):
    got = forward_selection(table.drop("features"), ["noise", "good"], 1, folds=2)
    assert got[0][0] == ["good"]


def test_few_tasks_for_cached_tables(spark):
    """A table that many jobs read has a partition for each core, whatever the exchange before it; no row is lost."""
    rows = spark.range(0, 1000, numPartitions=4).repartition(90).persist()
    cores = spark.sparkContext.defaultParallelism
    assert folds.compact(rows).rdd.getNumPartitions() == cores and folds.compact(rows, most=100).rdd.getNumPartitions() == 10
    assert sorted(r["id"] for r in folds.compact(rows).collect()) == list(range(1000))
    rows.unpersist()


def test_texts_are_read_once_for_models(spark, data):
    from inkvane.plans import catalogue

    train, test = catalogue._table(spark, data)
    for df in (train, test):
        assert "InMemoryTableScan" in df._jdf.queryExecution().executedPlan().toString()
