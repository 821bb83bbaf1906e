"""Operators on feature tables: products, dropping, correlation pruning, scaling, projection, names."""

from __future__ import annotations

import functools
import operator
import warnings
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from inkvane.functions.sums import summed_arrays
from inkvane.functions.weights import power
from inkvane.plans.spec import product_feature, unique

TEXT_COLUMNS = ("document", "summary")
KEYS = ("id", "label")
ROWS = 256  # rows of a projection that are held in a core's cache
#: Names of tags with symbols. Fixed values.
SYMBOLS = {
    "$": "dollar_tag",
    "''": "apostrophe_tag",
    "(": "obracket_tag",
    ")": "cbracket_tag",
    ",": "comma_tag",
    "--": "dash_tag",
    ".": "period_tag",
    ":": "column_tag",
    "``": "code_tag",
}


def q(name: str) -> Column:
    """A column by its exact name."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric(df: DataFrame) -> list[str]:
    """Feature columns: numbers other than id and label."""
    return [c for c, t in df.dtypes if c not in KEYS and t.split("(")[0] in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")]


# Products


def fixed_products(df: DataFrame, specs: list[str] | None) -> DataFrame:
    """df with a column for each product of powers, named by its spec."""
    new = {}
    for spec in unique(specs):
        factors = product_feature(spec)
        missing = [n for n, _ in factors if n not in df.columns]
        if missing:
            raise ValueError(f"{spec!r}: no column {missing[0]!r}")
        new[spec] = functools.reduce(operator.mul, [power(q(n), k) for n, k in factors])
    return df.withColumns(new)


def monomials(columns: list[str], degree: int) -> list[tuple[str, ...]]:
    """All products of 2 to degree columns, by size, then by position."""
    return [m for d in range(2, degree + 1) for m in combinations_with_replacement(columns, d)]


def monomial_name(m: tuple[str, ...]) -> str:
    parts = {c: m.count(c) for c in m}
    return " ".join(c if k == 1 else f"{c}^{k}" for c, k in parts.items())


def interactions(df: DataFrame, columns: list[str] | None, degree: int = 2) -> DataFrame:
    columns = columns if columns is not None else numeric(df)
    new = {monomial_name(m): functools.reduce(operator.mul, [power(q(c), m.count(c)) for c in dict.fromkeys(m)]) for m in monomials(columns, degree)}
    return df.withColumns({n: c for n, c in new.items() if n not in df.columns})


def products(df: DataFrame, fixed: list[str] | None = None, columns: list[str] | None = None, every: bool = False, degree: int = 2) -> DataFrame:
    """Fixed products and interactions; ``every`` means interactions of all features and no fixed products."""
    if every:
        return interactions(df, None, degree)
    df = fixed_products(df, fixed)
    return interactions(df, columns, degree) if columns else df


# Dropping


def drop_list(df: DataFrame, names: list[str], errors: str = "ignore") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if errors == "raise" and missing:
        raise ValueError(f"no columns {missing}")
    return df.select(*[q(c) for c in df.columns if c not in names])


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, population covariances, variances): the latter two of each pair over the rows that have both, the variance
    being that of the first; NaN where there are none.

    Two passes: means, then sums of products about them, a matrix product for each Arrow batch. Its size is the number
    of columns squared, whatever the number of rows.
    """
    n = len(columns)
    if not n:
        return np.zeros(0), np.zeros((0, 0)), np.zeros((0, 0))
    values = [q(c).cast("double") for c in columns]
    means = np.array([np.nan if m is None else m for m in df.agg(*[F.avg(v) for v in values]).first()])

    def products(batch):
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - np.nan_to_num(means)
        has = np.ones_like(x)
        for i, c in enumerate(batch.columns):
            if c.null_count:
                empty = c.is_null().to_numpy(zero_copy_only=False)
                x[empty, i], has[empty, i] = 0, 0
        return np.stack([x.T @ x, x.T @ has, (x * x).T @ has, has.T @ has])

    both, first, square, count = summed_arrays(df.select(*[v.alias(f"c{i}") for i, v in enumerate(values)]), products, (4, n, n))
    with np.errstate(divide="ignore", invalid="ignore"):
        return means, both / count - (first / count) * (first / count).T, square / count - (first / count) ** 2


def correlations(df: DataFrame, columns: list[str] | None = None) -> np.ndarray:
    """Pearson correlations; NaN for constant columns."""
    columns = columns if columns is not None else numeric(df)
    _, cov, var = moments(df, columns)
    # A constant column's products about its mean are rounding errors at most.
    low, high = (np.array(df.agg(*[f(q(c).cast("double")) for c in columns]).first(), float) if columns else np.zeros(0) for f in (F.min, F.max))
    var[low == high] = 0
    with np.errstate(divide="ignore", invalid="ignore"):
        out = cov / np.sqrt(var * var.T)
    out[~(var * var.T > 0)] = np.nan
    return out


def correlated(columns: list[str], corr: np.ndarray, threshold: float) -> list[str]:
    """Columns for which an earlier one, kept or not, has a correlation above the threshold (signed)."""
    return [columns[j] for j in range(len(columns)) if any(corr[i, j] > threshold for i in range(j))]


def drop_correlated(train: DataFrame, test: DataFrame | None = None, threshold: float = 1.0) -> tuple[DataFrame, DataFrame | None]:
    if threshold >= 1:
        return train, test
    columns = numeric(train)
    gone = correlated(columns, correlations(train, columns), threshold)
    return drop_list(train, gone), drop_list(test, gone) if test is not None else None


# Scaling


class Scaler:
    """Fitted on training data by one aggregation; ``standard`` (population deviation) or ``positive`` (range)."""

    def __init__(self, method: str, columns: list[str], centre: dict[str, float], width: dict[str, float]):
        self.method, self.columns, self.centre, self.width = method, columns, centre, width

    @classmethod
    def fit(cls, train: DataFrame, method: str = "standard", columns: list[str] | None = None) -> Scaler:
        if method not in ("standard", "positive"):
            raise ValueError(f"no scaling method {method!r}")
        columns = columns if columns is not None else numeric(train)
        if not columns:
            return cls(method, [], {}, {})
        pair = (F.avg, F.stddev_pop) if method == "standard" else (F.min, F.max)
        got = train.agg(*[f(q(c).cast("double")) for c in columns for f in pair]).first()
        low = {c: got[2 * i] or 0.0 for i, c in enumerate(columns)}
        second = {c: got[2 * i + 1] or 0.0 for i, c in enumerate(columns)}
        width = second if method == "standard" else {c: second[c] - low[c] for c in columns}
        return cls(method, columns, low, {c: w or 1.0 for c, w in width.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (q(c).cast("double") - F.lit(self.centre[c])) / F.lit(self.width[c]) for c in self.columns})


# Projection


class RatioPCA:
    """Principal components of centred features, as many as explain more than a ratio of the variance."""

    def __init__(self, columns: list[str], means: list[float], components: np.ndarray, ratios: np.ndarray):
        self.columns, self.means, self.components, self.ratios = columns, means, components, ratios

    @classmethod
    def fit(cls, train: DataFrame, ratio: float, columns: list[str] | None = None) -> RatioPCA:
        """The eigenvectors of the covariance are found on the driver (columns squared numbers)."""
        columns = columns if columns is not None else numeric(train)
        n = len(columns)
        means, cov, _ = moments(train, columns)
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values)
        values, vectors = np.maximum(values[order], 0), vectors[:, order]
        ratios = values / values.sum() if values.sum() else values
        k = min(n, int((np.cumsum(ratios) <= ratio).sum()) + 1)
        vectors = vectors[:, :k]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)] < 0, -1, 1)
        return cls(columns, means.tolist(), vectors, ratios[:k])

    def transform(self, df: DataFrame) -> DataFrame:
        """df with the components in place of the features; null where one of these is.

        Sums of so many products are no SQL expressions: as such they grow with columns times components and are too
        large to compile. They are matrix products by Arrow batch, added in the order of the columns, so that a row's
        result does not depend on the rows beside it.
        """
        kept = [q(c) for c in df.columns if c not in self.columns]
        if not self.columns:
            return df.select(*kept)
        first = len(kept)
        names, means, weights = [f"PCA_{k + 1}" for k in range(self.components.shape[1])], np.array(self.means, float), np.ascontiguousarray(self.components)

        def projected(batches):
            for batch in batches:
                given = batch.columns[first:]
                empty, out = np.zeros(batch.num_rows, bool), np.zeros((batch.num_rows, len(names)))
                x = np.empty((batch.num_rows, len(given)))
                for j, c in enumerate(given):
                    x[:, j] = c.to_numpy(zero_copy_only=False)
                    if c.null_count:
                        empty |= c.is_null().to_numpy(zero_copy_only=False)
                x -= means
                for at in range(0, batch.num_rows, ROWS):
                    part, total = x[at : at + ROWS], out[at : at + ROWS]
                    for j in range(len(given)):
                        total += part[:, j, None] * weights[j]
                parts = [pa.array(out[:, k], mask=empty) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:first], *parts], names=[*batch.schema.names[:first], *names])

        rows = df.select(*kept, *[q(c).cast("double").alias(f"__c{i}") for i, c in enumerate(self.columns)])
        schema = StructType([*rows.schema.fields[:first], *[StructField(n, DoubleType()) for n in names]])
        return rows.mapInArrow(projected, schema)


def perform_pca(train: DataFrame, test: DataFrame | None = None, ratio: float = 1.0, scaled: bool = True) -> tuple[DataFrame, DataFrame | None]:
    if not 0 < ratio < 1:
        return train, test
    if not scaled:
        warnings.warn("principal components of features that were not rescaled", stacklevel=2)
    model = RatioPCA.fit(train, ratio)
    return model.transform(train), model.transform(test) if test is not None else None


# Names


def sanitized(name: str) -> str:
    """A column name with the symbols of tags spelt out; longer symbols first."""
    for symbol in sorted(SYMBOLS, key=len, reverse=True):
        name = name.replace(symbol, SYMBOLS[symbol])
    return name


def sanitize(df: DataFrame) -> DataFrame:
    return df.toDF(*map(sanitized, df.columns))


def merge_label(features: DataFrame, labels: DataFrame) -> DataFrame:
    """features with the label of the same id, null where there is none."""
    return features.join(labels.select("id", "label"), "id", "left")


def assembled(df: DataFrame, columns: list[str], output: str = "features") -> DataFrame:
    """df with the columns as one vector; nulls count as 0."""
    return df.withColumn(output, array_to_vector(F.array(*[F.coalesce(q(c).cast("double"), F.lit(0.0)) for c in columns])))


__all__ = ["Scaler", "RatioPCA", "vector_to_array"]
