"""Three programs: ``features``, ``clean`` and ``search``. Run as ``python -m inkvane.cli <program> ...``."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkvane.functions.weights import Constants
from inkvane.ml.models import MODELS, summary_vectors
from inkvane.ml.search import Search, seeded, train_predict
from inkvane.operators.embed import FILES, trained_vectors
from inkvane.operators.features import cleaned
from inkvane.operators.tabular import assembled, numeric
from inkvane.plans.features import FeatureTable, Settings
from inkvane.sources import io
from inkvane.sources.pairs import corpus

log = logging.getLogger("inkvane")


def share(text: str) -> float:
    """A number from 0 to 1."""
    try:
        value = float(text)
    except ValueError:
        raise argparse.ArgumentTypeError(f"{text!r} is no number") from None
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError(f"{value} is not between 0 and 1")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="inkvane", description=__doc__)
    sub = top.add_subparsers(dest="program", required=True)
    flag = argparse.BooleanOptionalAction

    f = sub.add_parser("features")
    f.add_argument("--seed", type=int, default=42)
    d = Settings()
    for name, default in (("regex-feat", d.regex), ("idf-feat", d.idf), ("tag-feat", d.tags), ("gltr-feat", d.ranks), ("embed-feat", []), ("fixed-poly-feat", []), ("poly-feat", []), ("excl-feat", d.excluded)):
        f.add_argument(f"--{name}", nargs="*", default=default)
    for name, default in (("idf-d", 0.1), ("idf-b", 0.5), ("idf-k", 1.0)):
        f.add_argument(f"--{name}", type=float, default=default)
    f.add_argument("--idf-svd", type=int, default=1)
    f.add_argument("--all-poly-feat", action=flag, default=False)
    f.add_argument("--poly-degree", type=int, default=2)
    f.add_argument("--max-correlation", type=share, default=1.0)
    f.add_argument("--rescale-data", action=flag, default=True)
    f.add_argument("--scaling-method", choices=("standard", "positive"), default="standard")
    f.add_argument("--pca-ratio", type=share, default=1.0)

    c = sub.add_parser("clean")
    c.add_argument("--clean-text", action=flag, default=True)

    s = sub.add_parser("search")
    s.add_argument("--seed", type=int, default=42)
    s.add_argument("--models-names", nargs="+", choices=MODELS, default=["rfc"])
    s.add_argument("--embeddings-name", default="glove")
    s.add_argument("--trials", type=int, default=25)
    s.add_argument("--submission", action=flag, default=True)
    s.add_argument("--metric", choices=("accuracy", "f1_weighted"), default="accuracy")
    s.add_argument("--results", default="results")
    for p, suffix in ((f, "final"), (c, "clean"), (s, "final")):
        p.add_argument("--data-path", default="data")
        p.add_argument("--file-suffix", default=suffix)
        if p is not s:
            p.add_argument("--save-data", action=flag, default=True)
    return top


def sets(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, more documents) of a data folder."""
    return io.read_columns_json(spark, f"{folder}/train_set.json"), io.read_columns_json(spark, f"{folder}/test_set.json", label=False), io.read_columns_json(spark, f"{folder}/documents.json", label=False, summary=False)


def vectors_of(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """(token, vec) tables of the embeddings that are read from files: embed/glove_300.txt and embed/google_300.gz."""
    readers = {"glove": lambda: io.read_vectors(spark, f"{folder}/embed/glove_300.txt"), "google": lambda: io.read_binary_vectors(spark, f"{folder}/embed/google_300.gz")}
    return {n: readers[n]() for n in names if n in FILES}


def make_features(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    train, test, more = sets(spark, a.data_path)
    settings = Settings(
        regex=a.regex_feat, idf=a.idf_feat, constants=Constants(a.idf_d, a.idf_b, a.idf_k), components=a.idf_svd, tags=a.tag_feat, ranks=a.gltr_feat, embeddings=a.embed_feat, products=a.fixed_poly_feat, interactions=a.poly_feat,
        all_interactions=a.all_poly_feat, degree=a.poly_degree, excluded=a.excl_feat, max_correlation=a.max_correlation, rescale=a.rescale_data, scaling=a.scaling_method, pca_ratio=a.pca_ratio, seed=seeded(a.seed),
    )
    table = FeatureTable(settings, vectors_of(spark, a.data_path, settings.embeddings)).fit(train, more)
    out = table.transform(train), table.transform(test)
    log.info("features: %s", ", ".join(numeric(out[0])))
    if a.save_data:
        for name, df in zip(("train", "test"), out, strict=True):
            io.write_csv(df, f"{a.data_path}/{name}_{a.file_suffix}.csv", "overwrite")
    return out


def clean_texts(spark: SparkSession, a: argparse.Namespace) -> list[DataFrame]:
    out = [cleaned(df) if a.clean_text else df for df in sets(spark, a.data_path)]
    if a.save_data:
        for name, df in zip(("train", "test", "documents"), out, strict=True):
            io.write_csv(df, f"{a.data_path}/{name}_{a.file_suffix}.csv", "overwrite")
    return out


def schema_of(spark: SparkSession, path: str) -> str:
    """Numbers for every column of a feature table's header."""
    names = spark.read.option("header", True).csv(path).columns
    kinds = {"id": "long", "label": "int"}
    return ", ".join(f"`{n}` {kinds.get(n, 'double')}" for n in names)


def search(spark: SparkSession, a: argparse.Namespace) -> dict[str, float]:
    train, labels, test = io.features(spark, a.data_path, a.file_suffix, schema_of(spark, f"{a.data_path}/train_{a.file_suffix}.csv"))
    columns = numeric(train)
    scores = {}
    for name in a.models_names:
        if "embed" in name:
            rows, other = embedded_texts(spark, a)
        else:
            rows, other = assembled(train.join(labels, "id"), columns), assembled(test, columns)
        rows = rows.select("id", "features", F.col("label").cast("double").alias("label")).persist()
        best = Search(name, rows, a.metric, seeded(a.seed)).run(a.trials)
        scores[name] = best.score
        log.info("%s: %.4f with %s", name, best.score, best.params)
        if a.submission:
            io.write_submission(train_predict(name, best.params, rows, other), a.results, best.score, a.metric)
        rows.unpersist()
    return scores


def embedded_texts(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """(train, test) with summed word vectors of the summaries: read from a file by name, else trained on the corpus."""
    train, test, more = sets(spark, a.data_path)
    table = vectors_of(spark, a.data_path, [a.embeddings_name]).get(a.embeddings_name)
    if table is None:
        table = trained_vectors(corpus(train, more), seed=seeded(a.seed))[1]
    return summary_vectors(train, table), summary_vectors(test, table)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("inkvane").getOrCreate()
    {"features": make_features, "clean": clean_texts, "search": search}[a.program](spark, a)


if __name__ == "__main__":
    main()
