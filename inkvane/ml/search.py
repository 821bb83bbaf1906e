"""Training, cross validation, search over parameters, forward selection of features."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkvane.ml.folds import compact, evaluated, stratified_folds
from inkvane.ml.models import MODELS, Classifier, honoured
from inkvane.operators.tabular import assembled


def train_predict(name: str, params: dict[str, Any], train: DataFrame, other: DataFrame) -> DataFrame:
    """other with prediction."""
    return Classifier(name, params).fit(train).transform(other)


def train_eval(name: str, params: dict[str, Any], train: DataFrame, other: DataFrame, metric: str = "accuracy") -> float:
    if metric not in ("accuracy", "f1_weighted"):
        raise ValueError(f"no metric {metric!r}")
    return evaluated(train_predict(name, params, train, other), metric)


def cross_val(name: str, params: dict[str, Any], train: DataFrame, metric: str = "accuracy", folds: int = 5, parallelism: int = 4) -> float:
    """Mean metric over stratified folds; folds are fitted side by side over one cached table."""
    rows = train if "fold" in train.columns else stratified_folds(train, folds)
    rows = rows.persist()
    try:
        few = compact(rows)
        one = lambda k: train_eval(name, params, few.where(F.col("fold") != k), few.where(F.col("fold") == k), metric)
        with ThreadPoolExecutor(parallelism) as pool:
            return sum(pool.map(one, range(folds))) / folds
    finally:
        rows.unpersist()


@dataclass(frozen=True)
class Range:
    """A parameter between two numbers; by its logarithm if ``log``; whole if both are whole."""

    low: float
    high: float
    log: bool = False

    def place(self, u: float) -> float:
        if self.log:
            return math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        if isinstance(self.low, int) and isinstance(self.high, int):
            return min(self.high, self.low + int(u * (self.high - self.low + 1)))
        return self.low + u * (self.high - self.low)


@dataclass(frozen=True)
class Choice:
    options: tuple

    def place(self, u: float) -> Any:
        return self.options[min(len(self.options) - 1, int(u * len(self.options)))]


#: Search spaces: ranges and options are fixed values. A key "a|b=c" holds only where parameter b is c.
SPACES: dict[str, dict[str, Range | Choice]] = {
    "logreg": {"max_iter": Range(100, 500), "C": Range(1e-1, 1e4, True)},
    "rfc": {
        "n_estimators": Range(30, 500), "criterion": Choice(("gini", "entropy")), "max_depth": Choice((5, 6, 7, None)), "min_samples_split": Range(2, 8),
        "min_samples_leaf": Range(1, 10), "max_features": Choice(("auto", 0.4, 0.8)), "ccp_alpha": Range(1e-8, 1e-5, True),
    },
    "etc": {
        "n_estimators": Range(200, 500), "criterion": Choice(("gini",)), "min_samples_split": Range(2, 4), "min_samples_leaf": Range(1, 2),
        "min_impurity_decrease": Range(1e-9, 1e-6, True), "ccp_alpha": Range(1e-8, 1e-5, True),
    },
    "xgboost": {
        "n_estimators": Range(30, 250), "gamma": Range(1e-3, 1e-1), "subsample": Range(0.2, 1.0), "colsample_bytree": Range(0.6, 1.0), "colsample_bylevel": Range(0.6, 1.0),
        "colsample_bynode": Range(0.6, 1.0), "max_delta_step": Range(0.0, 1.0), "reg_alpha": Range(1e-7, 1e-4, True), "reg_lambda": Range(1e-7, 1e-4, True), "grow_policy": Choice(("depthwise", "lossguide")),
    },
    "catboost": {
        "n_estimators": Range(50, 2500), "learning_rate": Range(1e-3, 1e-1, True), "grow_policy": Choice(("SymmetricTree", "Depthwise")), "bootstrap_type": Choice(("Bayesian", "Bernoulli", "MVS")),
        "leaf_estimation_iterations": Range(3, 15), "leaf_estimation_backtracking": Choice(("No", "AnyImprovement")), "od_type": Choice(("IncToDec", "Iter")), "l2_leaf_reg": Range(1e-7, 1e-2, True),
        "min_data_in_leaf|grow_policy=Depthwise": Range(1, 10), "boosting_type|grow_policy=SymmetricTree": Choice(("Ordered", "Plain")), "score_function|boosting_type=Plain": Choice(("Cosine", "L2")),
        "bagging_temperature|bootstrap_type=Bayesian": Range(1e-2, 5.0, True), "subsample|bootstrap_type=Bernoulli": Range(0.4, 1.0), "subsample|bootstrap_type=MVS": Range(0.4, 1.0),
    },
    "lightgbm": {
        "n_estimators": Range(50, 250), "num_leaves": Range(10, 100), "min_split_gain": Range(1e-6, 1e-2, True), "min_child_weight": Range(1e-7, 1e-4, True), "min_child_samples": Range(2, 15),
        "subsample": Range(0.2, 1.0), "subsample_freq": Range(0, 6), "reg_alpha": Range(1e-6, 1e-3, True), "reg_lambda": Range(1e-6, 1e-3, True),
    },
    "mlp": {
        "nb_hidden_layers": Range(1, 4), "hidden_dim": Range(50, 400), "hidden_act": Choice(("sigmoid", "tanh", "relu")), "hidden_init": Choice(("uniform", "glorot_uniform")), "learning_rate": Range(5e-3, 1e-1, True),
        "optim_name": Choice(("adam", "rmsprop")), "rho|optim_name=rmsprop": Range(0.8, 0.95), "momentum|optim_name=rmsprop": Range(0.0, 0.95), "epochs": Range(25, 100), "batch_size": Choice((128, 256, 512)),
    },
    "embed_lstm": {
        "bidirectional": Choice((True, False)), "nb_lstm_layers": Range(1, 2), "lstm_hidden_dim": Range(250, 350), "lstm_dropout": Range(0.25, 0.4), "lstm_recurrent_dropout": Range(0.25, 0.4),
        "nb_mlp_layers": Range(1, 2), "mlp_hidden_dim": Range(400, 600), "mlp_hidden_act": Choice(("tanh", "relu")), "mlp_hidden_init": Choice(("uniform", "glorot_uniform")), "mlp_dropout": Range(0.7, 0.9),
        "learning_rate": Range(5e-4, 5e-3, True), "optim_name": Choice(("adam", "rmsprop")), "rho|optim_name=rmsprop": Range(0.8, 0.95), "momentum|optim_name=rmsprop": Range(0.0, 0.95), "epochs": Range(25, 40), "batch_size": Choice((128, 256, 512)),
    },
    "stacking": {},
}


def sampled(name: str, rng: random.Random, near: dict[str, float] | None = None, spread: float = 0.15) -> tuple[dict[str, Any], dict[str, float]]:
    """(parameters, their places in [0, 1)); near: places to stay close to. Only parameters that the back end takes are sampled."""
    if name not in SPACES:
        raise ValueError(f"no model {name!r}")
    takes = honoured(name)
    params: dict[str, Any] = {}
    places: dict[str, float] = {}
    for key, space in SPACES[name].items():
        own, _, rule = key.partition("|")
        if takes is not None and own not in takes:
            continue
        if rule:
            other, _, value = rule.partition("=")
            if str(params.get(other)) != value:
                continue
        u = rng.random() if not near or key not in near else min(0.999999, max(0.0, rng.gauss(near[key], spread)))
        params[own], places[key] = space.place(u), u
    return params, places


@dataclass
class Trial:
    params: dict[str, Any]
    places: dict[str, float]
    score: float


@dataclass
class Search:
    """Trials of one model: a random start, then candidates near good trials are compared by the ratio of densities of
    good and other trials at them, as tree-structured Parzen estimators do; the best is tried. Seeded and sequential."""

    name: str
    train: DataFrame
    metric: str = "accuracy"
    seed: int = 0
    folds: int = 5
    start: int = 8
    fixed: dict[str, Any] = field(default_factory=dict)
    trials: list[Trial] = field(default_factory=list)

    def __post_init__(self):
        if self.name not in MODELS:
            raise ValueError(f"no model {self.name!r}")
        self.rng = random.Random(self.seed)

    def _density(self, places: dict[str, float], trials: list[Trial]) -> float:
        total = 0.0
        for key, u in places.items():
            seen = [t.places[key] for t in trials if key in t.places]
            total += math.log(1e-3 + sum(math.exp(-(((u - v) / 0.15) ** 2) / 2) for v in seen) / max(1, len(seen)))
        return total

    def suggest(self) -> tuple[dict[str, Any], dict[str, float]]:
        if len(self.trials) < self.start:
            return sampled(self.name, self.rng)
        ranked = sorted(self.trials, key=lambda t: -t.score)
        good, rest = ranked[: max(1, len(ranked) // 4)], ranked[max(1, len(ranked) // 4) :]
        options = [sampled(self.name, self.rng, self.rng.choice(good).places) for _ in range(24)]
        return max(options, key=lambda o: self._density(o[1], good) - self._density(o[1], rest))

    def run(self, n: int) -> Trial:
        rows = stratified_folds(self.train, self.folds).persist()
        for _ in range(n):
            params, places = self.suggest()
            params = {"seed": self.seed, **params, **self.fixed}
            self.trials.append(Trial(params, places, cross_val(self.name, params, rows, self.metric, self.folds)))
        rows.unpersist()
        return self.best

    @property
    def best(self) -> Trial:
        return max(self.trials, key=lambda t: t.score)


def forward_selection(table: DataFrame, columns: list[str], k: int = 5, name: str = "logreg", params: dict[str, Any] | None = None, folds: int = 5, floating: bool = True) -> list[tuple[list[str], float]]:
    """Sequential forward selection, floating: the best set of each size 1 .. k, and its score. table: id, label, columns."""
    rows = stratified_folds(table, folds).persist()
    seen: dict[frozenset, float] = {}

    def score(names: list[str]) -> float:
        key = frozenset(names)
        if key not in seen:
            seen[key] = cross_val(name, params or {}, assembled(rows, sorted(names)), folds=folds)
        return seen[key]

    best: dict[int, tuple[float, list[str]]] = {}
    chosen: list[str] = []
    while len(chosen) < k:
        chosen = chosen + [max((c for c in columns if c not in chosen), key=lambda c: (score(chosen + [c]), -columns.index(c)))]
        if len(chosen) not in best or score(chosen) > best[len(chosen)][0]:
            best[len(chosen)] = (score(chosen), chosen)
        while floating and len(chosen) > 2:
            less = max(([c for c in chosen if c != gone] for gone in chosen), key=score)
            if score(less) <= best[len(less)][0]:
                break
            chosen = less
            best[len(less)] = (score(less), less)
        chosen = best[len(chosen)][1]
    rows.unpersist()
    return [(best[n][1], best[n][0]) for n in sorted(best)]


def learning_rate(epoch: int, first: float) -> float:
    """A tenth of the rate after every 40 epochs."""
    return 0.1 ** int(epoch / 40) * first


def seeded(seed: int | None) -> int:
    """The seed that every estimator is given; a random one if there is none."""
    return random.SystemRandom().randrange(2**31) if seed is None else seed
