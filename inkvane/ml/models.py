"""Classifiers by name, over a vector column ``features``.

logreg, rfc and mlp are Spark's own. etc (extra trees) is a forest without bootstrap. xgboost is the library's public
Spark class where it can be imported and takes every parameter; else it, lightgbm and catboost are Spark's boosted trees
with the parameters that those know (``HONOURED``) and the library's own defaults for rate and depth. embed_lstm has no
Spark equivalent: a perceptron stands for it, meant for summed word vectors (``summary_vectors``). stacking is below.
"""

from __future__ import annotations

import importlib.util
import math
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkvane.ml.folds import stratified_folds
from inkvane.operators.embed import summed

BOOSTED = ("xgboost", "lightgbm", "catboost")
#: Trees, rate and depth where a parameter is not given: the libraries' own defaults.
BOOSTED_DEFAULTS = {"xgboost": (100, 0.3, 6), "lightgbm": (100, 0.1, 5), "catboost": (1000, 0.03, 6)}
MOST_DEPTH = 30  # Spark's own limit
#: Parameters that reach Spark's models; a search samples no others.
HONOURED = {
    "logreg": {"max_iter", "C"},
    "rfc": {"n_estimators", "criterion", "max_depth", "min_samples_leaf", "max_features", "min_impurity_decrease"},
    "etc": {"n_estimators", "criterion", "max_depth", "min_samples_leaf", "max_features", "min_impurity_decrease"},
    "xgboost": {"n_estimators", "subsample", "colsample_bynode"},
    "lightgbm": {"n_estimators", "num_leaves", "min_split_gain", "min_child_samples", "subsample"},
    "catboost": {"n_estimators", "learning_rate", "grow_policy", "min_data_in_leaf", "bootstrap_type", "subsample"},
    "mlp": {"nb_hidden_layers", "hidden_dim", "epochs"},
    "embed_lstm": {"nb_mlp_layers", "mlp_hidden_dim", "epochs"},
    "stacking": set(),
}
MODELS = ("logreg", "rfc", "etc", *BOOSTED, "mlp", "embed_lstm", "stacking")


def _forest(p: dict[str, Any], bootstrap: bool) -> RandomForestClassifier:
    share = p.get("max_features", "auto")
    depth = p.get("max_depth") or MOST_DEPTH  # None: as deep as Spark goes
    return RandomForestClassifier(
        numTrees=p.get("n_estimators", 100),
        impurity=p.get("criterion", "gini"),
        maxDepth=min(depth, MOST_DEPTH),
        minInstancesPerNode=p.get("min_samples_leaf", 1),
        minInfoGain=p.get("min_impurity_decrease", 0.0),
        featureSubsetStrategy=str(share),
        bootstrap=bootstrap,
        seed=p.get("seed", 0),
    )


def _boosted(name: str, p: dict[str, Any]) -> Estimator:
    if name == "xgboost":
        try:
            from xgboost.spark import SparkXGBClassifier

            return SparkXGBClassifier(random_state=p.get("seed", 0), **{k: v for k, v in p.items() if k != "seed"})
        except ImportError:
            pass
    trees, rate, depth = BOOSTED_DEFAULTS[name]
    if "num_leaves" in p:
        depth = max(1, math.ceil(math.log2(p["num_leaves"])))
    return GBTClassifier(
        maxIter=p.get("n_estimators", trees),
        stepSize=p.get("learning_rate", rate),
        maxDepth=min(p.get("max_depth", depth), MOST_DEPTH),
        minInstancesPerNode=p.get("min_child_samples", p.get("min_data_in_leaf", 1)),
        minInfoGain=p.get("min_split_gain", 0.0),
        subsamplingRate=p.get("subsample", 1.0),
        featureSubsetStrategy=str(p.get("colsample_bynode", "all")),
        seed=p.get("seed", 0),
    )


def create_model(name: str, params: dict[str, Any] | None = None, inputs: int = 0, rows: int = 0) -> Estimator:
    """inputs: number of features (perceptrons); rows: number of training rows (scale of the penalty of logreg)."""
    p = params or {}
    if name == "logreg":
        return LogisticRegression(maxIter=p.get("max_iter", 100), regParam=1.0 / (p.get("C", 1.0) * max(rows, 1)), elasticNetParam=0.0, standardization=False)
    if name in ("rfc", "etc"):
        return _forest(p, name == "rfc")
    if name in BOOSTED:
        return _boosted(name, p)
    if name in ("mlp", "embed_lstm"):
        hidden = [p.get("hidden_dim", p.get("mlp_hidden_dim", 50))] * p.get("nb_hidden_layers", p.get("nb_mlp_layers", 1))
        return MultilayerPerceptronClassifier(layers=[inputs, *hidden, 2], maxIter=p.get("epochs", 50), seed=p.get("seed", 0))
    if name == "stacking":
        return Stacking(p)
    raise ValueError(f"no model {name!r}")


def honoured(name: str) -> set[str] | None:
    """The parameters that the model's back end takes; None: all."""
    if name == "xgboost" and importlib.util.find_spec("xgboost"):
        return None
    return HONOURED[name]


def summary_vectors(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """pairs with features, the summed word vectors of the summary: what embed_lstm is fitted on. table: (token, vec)."""
    got = summed(pairs, table).select("id", array_to_vector("vec").alias("features"))
    return pairs.drop("features").join(got, "id")


def inputs_of(df: DataFrame) -> int:
    row = df.select("features").first()
    return len(row[0]) if row else 0


class Fitted:
    """A fitted classifier with predict and predict_proba."""

    def __init__(self, model):
        self.model = model

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    predict = transform

    def predict_proba(self, df: DataFrame) -> DataFrame:
        return self.transform(df).withColumn("proba", vector_to_array("probability"))


class Classifier:
    """fit, predict and predict_proba of a named model over (id, features, label)."""

    def __init__(self, name: str, params: dict[str, Any] | None = None):
        if name not in MODELS:
            raise ValueError(f"no model {name!r}")
        self.name, self.params = name, params or {}

    def fit(self, train: DataFrame) -> Fitted:
        rows = train.count() if self.name == "logreg" else 0
        inputs = inputs_of(train) if self.name in ("mlp", "embed_lstm") else 0
        return Fitted(create_model(self.name, self.params, inputs, rows).fit(train))


#: Parameters of the bases where none are given. Fixed values, of those that Spark's models know.
BASE_PARAMETERS = {
    "rfc": {"n_estimators": 234, "criterion": "entropy", "min_samples_leaf": 3, "max_features": 0.4},
    "lightgbm": {"n_estimators": 208, "num_leaves": 94, "min_split_gain": 2.65e-4, "min_child_samples": 10, "subsample": 0.935},
    "xgboost": {"n_estimators": 241, "subsample": 0.828, "colsample_bynode": 0.75},
    "catboost": {"n_estimators": 2442, "learning_rate": 0.022, "min_data_in_leaf": 2, "subsample": 0.62},
}


class Stacking:
    """Out-of-fold class predictions of several models, and a logistic regression over them."""

    def __init__(self, params: dict[str, Any] | None = None):
        p = params or {}
        seed = p.get("seed", p.get("random_state", 0))
        self.folds = p.get("folds", 5)
        self.bases = [(n, {"seed": seed, **p.get(n, BASE_PARAMETERS.get(n, {}))}) for n in p.get("bases", ("rfc", *BOOSTED))]

    def fit(self, train: DataFrame) -> StackingModel:
        rows = stratified_folds(train.select("id", "features", "label"), self.folds).persist()
        names = [f"base_{i}" for i in range(len(self.bases))]
        parts = []
        for k in range(self.folds):
            fit, out = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
            parts.append(StackingModel.votes([Classifier(n, p).fit(fit) for n, p in self.bases], names, out).select("id", "label", "votes"))
        meta = parts[0]
        for part in parts[1:]:
            meta = meta.union(part)
        final = LogisticRegression(featuresCol="votes", regParam=1.0 / max(1, rows.count()), standardization=False).fit(meta)
        bases = [Classifier(n, p).fit(rows) for n, p in self.bases]
        rows.unpersist()
        return StackingModel(bases, names, final)


class StackingModel:
    def __init__(self, bases: list[Fitted], names: list[str], final):
        self.bases, self.names, self.final = bases, names, final

    @staticmethod
    def votes(bases: list[Fitted], names: list[str], df: DataFrame) -> DataFrame:
        own = df.columns
        for model, name in zip(bases, names, strict=True):
            done = [c for c in df.columns if c not in ("rawPrediction", "probability", "prediction")]
            df = model.transform(df).select(*done, F.col("prediction").alias(name))
        return df.select(*own, array_to_vector(F.array(*names)).alias("votes"))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.final.transform(self.votes(self.bases, self.names, df)).drop("votes")
