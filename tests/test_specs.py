"""Names that must be refused, and names that must be made."""

import argparse

import pytest

from inkvane import cli
from inkvane.functions.text import pattern_of
from inkvane.functions.weights import Corpus, composed
from inkvane.ml.models import Classifier, create_model
from inkvane.ml.search import SPACES, Choice, Range, learning_rate, sampled
from inkvane.operators import tabular
from inkvane.plans import spec
from inkvane.plans.features import Settings


@pytest.mark.parametrize(
    ("parse", "name"),
    [
        (spec.regex_feature, "word_11_count"), (spec.regex_feature, "foo_count"), (spec.regex_feature, "char_max"), (spec.regex_feature, "foo_word_3_count"), (spec.tag_feature, "XX_count"), (spec.tag_feature, "NN_max"),
        (spec.rank_feature, "top_4"), (spec.rank_feature, "count_x"), (spec.rank_feature, "count_0"), (spec.product_feature, "char_count^x"), (spec.idf_feature, "z_cos"), (spec.idf_feature, "n_max"), (spec.idf_feature, "n"),
        (pattern_of, "word_0"), (create_model, "xx"), (Classifier, "e"),
    ],
)
def test_refused(parse, name):
    with pytest.raises(ValueError):
        parse(name)


def test_parsed():
    f = spec.regex_feature("upper_word_ratio")
    assert (f.subject, f.kind) == ("upper_word", "ratio")
    assert spec.tag_feature("tags_wd_count").kind == "wd_count"
    assert spec.product_feature("a^2 b") == [("a", 2), ("b", 1)]
    assert spec.unique(["a", "b", "a"]) == ["a", "b"]


def test_settings_fail_early():
    for wrong in ({"regex": ["foo_count"]}, {"idf": ["x_cos"]}, {"tags": ["XX_count"]}, {"ranks": ["top_1"]}, {"products": ["a^b"]}, {"scaling": "other"}):
        with pytest.raises(ValueError):
            Settings(**wrong)


def test_names():
    assert tabular.sanitized("$_overlap") == "dollar_tag_overlap" and tabular.sanitized("PRP$_count") == "PRPdollar_tag_count"
    assert tabular.sanitized("''_count") == "apostrophe_tag_count" and tabular.sanitized("--_count") == "dash_tag_count"
    assert [tabular.monomial_name(m) for m in tabular.monomials(["a", "b"], 3)] == ["a^2", "a b", "b^2", "a^3", "a^2 b", "a b^2", "b^3"]


def test_shares():
    assert cli.share("0.5") == 0.5
    for wrong in ("1.5", "-1", "x"):
        with pytest.raises(argparse.ArgumentTypeError):
            cli.share(wrong)


def test_programs():
    a = cli.parser().parse_args(["features", "--no-rescale-data", "--no-save-data", "--pca-ratio", "0.9", "--regex-feat", "char_count"])
    assert not a.rescale_data and not a.save_data and a.pca_ratio == 0.9 and a.regex_feat == ["char_count"]
    assert not cli.parser().parse_args(["clean", "--no-clean-text"]).clean_text
    assert cli.parser().parse_args(["search", "--no-submission", "--models-names", "logreg"]).models_names == ["logreg"]


def test_spaces():
    import random

    for name in SPACES:
        params, places = sampled(name, random.Random(1))
        assert all(0 <= u < 1 for u in places.values())
        if name == "catboost":
            assert ("min_data_in_leaf" in params) == (params["grow_policy"] == "Depthwise")
    assert Range(1, 3).place(0.999) == 3 and Choice((1, 2)).place(0.6) == 2 and Range(1e-2, 1e2, True).place(0.5) == pytest.approx(1)
    assert learning_rate(0, 0.1) == 0.1 and learning_rate(85, 1.0) == pytest.approx(0.01)


def test_letters_apply_from_left_to_right(spark):
    import math

    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1,), (7,)], "tf long")
    c = Corpus(10, 20.0)
    got = df.orderBy("tf").select(*[composed(x, F.col("tf"), c).alias(x) for x in ("n", "w", "l", "d", "p", "k", "kp", "pk")]).collect()
    x = 7.0
    p = 1 - 0.5 + 0.5 * (10 / 20.0)
    want = [x, 1 + math.log(x), 1 + math.log(1 + math.log(x)), x + 0.1, x / p, 2 * x / (1 + x), 2 * x / (1 + x) / p, 2 * (x / p) / (1 + x / p)]
    assert list(got[1]) == pytest.approx(want) and got[0]["w"] == 1
    with pytest.raises(ValueError):
        composed("z", F.col("tf"), c)


def test_vectors_are_trained_by_the_whole_job(spark, data, monkeypatch):
    """The query leaves size, window and iterations to the operator, whose defaults are those of the README."""
    import inspect

    from inkvane.operators import embed
    from inkvane.plans import catalogue

    given, real = {}, embed.trained_vectors
    monkeypatch.setattr(embed, "trained_vectors", lambda rows, **kw: given.update(kw) or real(rows.limit(5), size=8, iterations=1, min_count=1))
    assert len(catalogue.w2v_features(spark, data).columns) == 9
    assert not set(given) & {"size", "window", "iterations", "min_count"} and given["partitions"] == spark.sparkContext.defaultParallelism
    defaults = {k: p.default for k, p in inspect.signature(real).parameters.items()}
    assert (defaults["size"], defaults["window"], defaults["iterations"]) == (300, 20, 25)
