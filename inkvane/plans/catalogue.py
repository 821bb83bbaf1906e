"""The queries of the library by name, with their SQL where SQL can express them.

Each query runs over whole tables. Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

import itertools

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkvane.functions import tagging, text
from inkvane.functions.order import numbered
from inkvane.functions.stopwords import STOP_WORDS
from inkvane.functions.weights import Corpus, composed, power
from inkvane.ml import folds
from inkvane.ml.models import Classifier
from inkvane.ml.search import cross_val, forward_selection
from inkvane.operators import embed, features, lm, tabular, tfidf
from inkvane.plans.features import FeatureTable, Settings
from inkvane.plans.oracles import ORACLE_SQL
from inkvane.sources import io
from inkvane.sources import pairs as P

RATIO_SPECS = ["char_ratio", "word_ratio", "upper_word_ratio"]
COUNT_NAMES = ["char", "word", "sent", "upper_char", "upper_word", "numeric", "dash", "group", "is_first_upper", "is_last_ponct", "space_before_ponct", "word_1", "word_3", "word_10"]
DIMS = 64  # components of embeddings, each a column of a numeric table


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(tabular.q(c), 6).alias(c) if t == "double" else tabular.q(c) for c, t in df.dtypes])


def scan_pairs(s: SparkSession, d: str) -> DataFrame:
    return P.pairs(s, d)


def csv_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Written to the warehouse as CSV and read again: new lines, quotes and commas survive."""
    path, rows = _folder(s, "csv"), P.pairs(s, d).select("id", "document", "summary", "label")
    io.write_csv(rows, path)
    return io.read_csv(s, path, rows.schema)


def _folder(s: SparkSession, name: str) -> str:
    import uuid

    return f"{s.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def json_columns(s: SparkSession, d: str) -> DataFrame:
    """The small table of benchmark items written as JSON of the layout {column: {id: value}}, and read again."""
    rows = P.table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("k"), "text")
    entries = F.map_from_entries(F.collect_list(F.struct("k", "text")))  # one value is what the layout is
    path = _folder(s, "json")
    rows.agg(entries.alias("document")).withColumn("summary", F.col("document")).coalesce(1).write.json(path)
    return io.read_columns_json(s, path, label=False)


def vector_text(s: SparkSession, d: str) -> DataFrame:
    """Vectors written as lines of a token and its numbers, and read again."""
    lines = P.table(s, d, "embeddings").select(F.concat(F.lit("v"), "vec_id", F.lit(" "), F.array_join(F.col("embedding").cast("array<string>"), " ")).alias("value"))
    path = _folder(s, "vectors")
    lines.write.text(path)
    return io.read_vectors(s, path, DIMS).select("token", *[F.round(F.col("vec")[i].cast("double"), 6).alias(f"e{i}") for i in range(DIMS)])


def clean_csv(s: SparkSession, d: str) -> DataFrame:
    """Cleaned texts beside the texts, written as CSV and read again."""
    path, rows = _folder(s, "clean"), features.cleaned(P.pairs(s, d).select("id", "document", "summary"))
    io.write_csv(rows, path)
    return io.read_csv(s, path, rows.schema)


def submission(s: SparkSession, d: str) -> DataFrame:
    """Predictions of a rule, written as a submission and read again."""
    path = io.write_submission(_folded(s, d).select("id", "prediction"), _folder(s, "results"), 0.5)
    return io.read_csv(s, path, "id long, `0` int")


def label_merge(s: SparkSession, d: str) -> DataFrame:
    p = P.pairs(s, d)
    got = tabular.merge_label(p.drop("label").select("id", F.length("document").alias("n")), p.where(~P.is_test()))
    return got.withColumn("label", F.col("label").cast("double"))


def drop_list(s: SparkSession, d: str) -> DataFrame:
    p = features.regex_features(P.pairs(s, d), ["char_count", "word_count", "sent_count"])
    return tabular.drop_list(p, ["document", "summary", "word_count", "absent"])


def sanitize_names(s: SparkSession, d: str) -> DataFrame:
    return tabular.sanitize(features.tag_features(P.pairs(s, d), ["$_overlap", ":_overlap", "PRP$_count", "''_count"]).drop("document", "summary"))


def regex_count(s: SparkSession, d: str) -> DataFrame:
    return features.regex_features(P.pairs(s, d).withColumn("summary", F.col("document")), [f"{n}_count" for n in COUNT_NAMES]).drop("document", "summary", "label")


def regex_avg(s: SparkSession, d: str) -> DataFrame:
    return rounded(features.regex_features(P.pairs(s, d).withColumn("summary", F.col("document")), ["word_avg", "sent_avg", "group_avg", "numeric_avg"]).drop("document", "summary", "label"))


def regex_overlap(s: SparkSession, d: str) -> DataFrame:
    return features.regex_features(P.conversation_pairs(s, d), ["word_overlap", "upper_word_overlap", "word_3_overlap", "group_overlap"]).drop("document", "summary")


def regex_ratio(s: SparkSession, d: str) -> DataFrame:
    return rounded(features.regex_features(P.conversation_pairs(s, d), [*RATIO_SPECS, "dash_ratio"]).drop("document", "summary"))


def regex_features(s: SparkSession, d: str) -> DataFrame:
    """Flagship: the default regex features of every pair."""
    return rounded(features.regex_features(P.pairs(s, d)).drop("document", "summary"))


def clean_text(s: SparkSession, d: str) -> DataFrame:
    return features.cleaned(P.pairs(s, d)).select("id", "document_clean", "summary_clean")


def tokens_clean(s: SparkSession, d: str) -> DataFrame:
    t = text.word_tokens(F.col("document"), STOP_WORDS)
    return P.pairs(s, d).select("id", F.array_join(t, " ").alias("tokens"), F.size(t).cast("long").alias("n"))


def corpus_union(s: SparkSession, d: str) -> DataFrame:
    return P.fit_corpus(s, d)


def corpus_stats(s: SparkSession, d: str) -> DataFrame:
    return P.fit_corpus(s, d).agg(F.count("*").alias("n"), F.round(F.avg(F.length("document")), 6).alias("mean_length"))


def term_counts(s: SparkSession, d: str) -> DataFrame:
    return tfidf.term_counts(P.fit_corpus(s, d), "document")


def _vocabulary(s: SparkSession, d: str) -> DataFrame:
    return tfidf.vocabulary(P.fit_corpus(s, d), "document")


def vocab_topk(s: SparkSession, d: str) -> DataFrame:
    return _vocabulary(s, d)


def _idf(s: SparkSession, d: str) -> tuple[Corpus, DataFrame]:
    stats = tfidf.corpus_stats(P.fit_corpus(s, d))
    return stats, tfidf.with_idf(_vocabulary(s, d), stats.rows)


def idf_weights(s: SparkSession, d: str) -> DataFrame:
    return rounded(_idf(s, d)[1].select("term", "df", "idf"))


def idf_compose(s: SparkSession, d: str) -> DataFrame:
    stats = tfidf.corpus_stats(P.fit_corpus(s, d))
    counts = tfidf.term_counts(P.fit_corpus(s, d), "document").groupBy("tf").agg(F.count("*").alias("cells"))
    return rounded(counts.select("tf", "cells", *[composed(c, F.col("tf"), stats).alias(f"x_{c}") for c in ("n", "w", "l", "d", "p", "k", "wdk")]))


def idf_cos(s: SparkSession, d: str) -> DataFrame:
    stats, idf = _idf(s, d)
    p = P.pairs(s, d)
    left, right = (tfidf.weighted(tfidf.term_counts(p, c), idf, "n", stats) for c in ("document", "summary"))
    got = tfidf.cosine(left, right)
    return rounded(p.select("id").join(got, "id", "left").select("id", F.coalesce("cos", F.lit(0.0)).alias("cos")))


def _idf_features(s: SparkSession, d: str, spec: str) -> DataFrame:
    model = tfidf.fit_tfidf(P.fit_corpus(s, d), [spec])
    return model.transform(P.pairs(s, d)).drop("document", "summary", "label")


def idf_count_svd(s: SparkSession, d: str) -> DataFrame:
    return _idf_features(s, d, "n_count")


def idf_svd(s: SparkSession, d: str) -> DataFrame:
    return _idf_features(s, d, "n_idf")


def idf_lda(s: SparkSession, d: str) -> DataFrame:
    return _idf_features(s, d, "n_lda")


def _tagged(s: SparkSession, d: str) -> DataFrame:
    return P.pairs(s, d).select("id", tagging.tagged(F.col("document")).alias("t"))


def tag_tokens(s: SparkSession, d: str) -> DataFrame:
    return _tagged(s, d).select("id", F.explode("t").alias("x")).groupBy("id", "x.tag").agg(F.count("*").alias("n"), F.sum(F.length("x.token")).alias("chars"))


def tag_noun_adj(s: SparkSession, d: str) -> DataFrame:
    t = tagging.tagged(F.col("document"), nouns_and_adjectives=True)
    return P.pairs(s, d).select("id", F.size(t).cast("long").alias("n"), F.array_join(F.transform(t, lambda x: x["token"]), " ").alias("tokens"))


def tag_string(s: SparkSession, d: str) -> DataFrame:
    return P.pairs(s, d).select("id", tagging.tag_string(tagging.tagged(F.col("summary"))).alias("tags"))


def _tag(s: SparkSession, d: str, specs: list[str]) -> DataFrame:
    return rounded(features.tag_features(P.conversation_pairs(s, d), specs).drop("document", "summary"))


def tag_count(s: SparkSession, d: str) -> DataFrame:
    return _tag(s, d, ["DT_count", "NN_count", "MD_count", "VBD_count"])


def tag_avg(s: SparkSession, d: str) -> DataFrame:
    return _tag(s, d, ["NN_avg", "JJ_avg"])


def tag_overlap(s: SparkSession, d: str) -> DataFrame:
    return _tag(s, d, ["DT_overlap", "NN_overlap"])


def tag_ratio(s: SparkSession, d: str) -> DataFrame:
    return _tag(s, d, ["DT_ratio", "CD_ratio"])


def tag_features(s: SparkSession, d: str) -> DataFrame:
    return rounded(features.tag_features(P.pairs(s, d)).drop("document", "summary"))


def _bigram(s: SparkSession, d: str) -> lm.BigramModel:
    return lm.BigramModel.fit(P.fit_corpus(s, d))


def tag_idf_cos(s: SparkSession, d: str) -> DataFrame:
    """Cosine of the tag sequences of document and summary, weighted by their idf in the corpus."""
    model = tfidf.fit_tag_tfidf(P.fit_corpus(s, d), ["tags_n_cos"])
    return rounded(model.transform(P.pairs(s, d)).drop("document", "summary", "label"))


def lm_rank(s: SparkSession, d: str) -> DataFrame:
    got = _bigram(s, d).ranked(P.pairs(s, d), "summary")
    return rounded(got.groupBy("id").agg(F.count("*").alias("tokens"), F.count("rank").alias("known"), F.coalesce(F.sum("rank"), F.lit(0)).alias("ranks"), F.sum("prob").alias("sum_prob")))


def lm_topk(s: SparkSession, d: str) -> DataFrame:
    return _bigram(s, d).top(5).select("prev", "token", F.col("rank").cast("long").alias("rank"), "prob")


def lm_topk_probs(s: SparkSession, d: str) -> DataFrame:
    return rounded(_bigram(s, d).top_probabilities(5).select("prev", "token", "prob"))


def lm_postprocess(s: SparkSession, d: str) -> DataFrame:
    words = P.table(s, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    marks = F.explode(F.array(*[F.lit(m) for m in ("", "Ġ", "â", "Ċ", "ľ", "Ŀ", "Ļ", "ĠĻ")]))
    return words.select("item_id", "pos", marks.alias("mark"), "w").select("item_id", F.col("pos").cast("long").alias("pos"), "mark", lm.postprocess(F.concat("mark", "w")).alias("shown"))


def _ranks(s: SparkSession, d: str, specs: list[str]) -> DataFrame:
    return lm.rank_features(P.pairs(s, d), _bigram(s, d), specs).drop("document", "summary", "label")


def gltr_count_hist(s: SparkSession, d: str) -> DataFrame:
    return _ranks(s, d, ["count_4"])


def gltr_frac_hist(s: SparkSession, d: str) -> DataFrame:
    return _ranks(s, d, ["frac_10"])


def gltr_features(s: SparkSession, d: str) -> DataFrame:
    return _ranks(s, d, ["logcount_4", "frac_4"])


def toy_vectors(s: SparkSession, d: str) -> DataFrame:
    """(token, vec): the vocabulary in order, with the rows of embeddings in turn."""
    v = P.table(s, d, "embeddings")
    n = v.count()
    order = _vocabulary(s, d).select("term", (F.row_number().over(Window.orderBy(F.desc("cf"), "term")) - 1).alias("r"))
    rows = numbered(v, "k", "vec_id").select("k", F.col("embedding").alias("vec"))
    return order.join(rows, F.col("r") % n == F.col("k")).select(F.col("term").alias("token"), "vec")


def embed_sum(s: SparkSession, d: str) -> DataFrame:
    got = embed.summed(P.pairs(s, d), toy_vectors(s, d), "summary")
    return got.select("id", *[F.round(F.col("vec")[i], 6).alias(f"v_{i}") for i in range(DIMS)])


def pad_sequences(s: SparkSession, d: str) -> DataFrame:
    train, _ = P.train_test(s, d)
    return embed.padded(P.pairs(s, d), embed.word_index(train)).select("id", F.array_join("sequence", " ").alias("sequence"))


def w2v_features(s: SparkSession, d: str) -> DataFrame:
    """The operator's whole training job, in a partition for each core: Spark averages their vectors after each iteration."""
    model, _ = embed.trained_vectors(P.fit_corpus(s, d), partitions=s.sparkContext.defaultParallelism)
    size = model.getVectorSize()
    return embed.transformed(model, P.pairs(s, d)).select("id", *[F.col("vec")[i].alias(f"summary_train_{i}") for i in range(size)])


def _numbers(s: SparkSession, d: str) -> DataFrame:
    return rounded(features.regex_features(P.pairs(s, d), ["char_count", "word_count", "upper_word_count", "sent_avg"]).drop("document", "summary"))


def poly_power(s: SparkSession, d: str) -> DataFrame:
    return rounded(_numbers(s, d).select("id", power(F.col("word_count"), 2).alias("word_count_2"), power(F.col("sent_avg"), 3).alias("sent_avg_3")))


def poly_fixed(s: SparkSession, d: str) -> DataFrame:
    df = tabular.fixed_products(_numbers(s, d), ["word_count^2 sent_avg", "char_count word_count"])
    return rounded(df.select("id", "word_count^2 sent_avg", "char_count word_count"))


def poly_interactions(s: SparkSession, d: str) -> DataFrame:
    df = _numbers(s, d)
    out = tabular.interactions(df, ["word_count", "upper_word_count", "sent_avg"], 3)
    return rounded(out.select("id", *[tabular.q(c) for c in out.columns if c not in df.columns]))


def poly_all(s: SparkSession, d: str) -> DataFrame:
    """Interactions of all features."""
    return rounded(tabular.products(_numbers(s, d), ["never used"], every=True))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    e = P.table(s, d, "embeddings")
    wide = e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMS)])
    return wide.withColumns({"twice": F.col("e0") * 2 + F.col("e1") * 0.01, "minus": -F.col("e0"), "same": F.lit(1.0)})


def corr_matrix(s: SparkSession, d: str) -> DataFrame:
    df = _vectors(s, d).drop("same")
    columns = tabular.numeric(df)
    corr = tabular.correlations(df, columns)
    return s.createDataFrame([(a, b, round(float(corr[i, j]), 6)) for i, a in enumerate(columns) for j, b in enumerate(columns)], "a string, b string, r double")


def drop_corr(s: SparkSession, d: str) -> DataFrame:
    df = _vectors(s, d)
    return rounded(tabular.drop_correlated(df, threshold=0.9)[0])


def _scaled(s: SparkSession, d: str, method: str) -> DataFrame:
    df = _numbers(s, d)
    df = df.withColumn("same", F.lit(3.0))
    return rounded(tabular.Scaler.fit(df.where(~P.is_test()), method).transform(df).drop("label"))


def scale_standard(s: SparkSession, d: str) -> DataFrame:
    return _scaled(s, d, "standard")


def scale_positive(s: SparkSession, d: str) -> DataFrame:
    return _scaled(s, d, "positive")


def pca(s: SparkSession, d: str) -> DataFrame:
    return tabular.perform_pca(_vectors(s, d), ratio=0.9)[0]


def _folded(s: SparkSession, d: str) -> DataFrame:
    rows = features.regex_features(P.pairs(s, d), ["upper_word_count", "word_count"])
    rule = (F.col("upper_word_count") * 3 < F.col("word_count")).cast("int")
    return folds.stratified_folds(rows.select("id", "label", rule.alias("prediction")))


def kfold_stratified(s: SparkSession, d: str) -> DataFrame:
    return _folded(s, d).select("id", "label", F.col("fold").cast("long").alias("fold"))


def metric_accuracy(s: SparkSession, d: str) -> DataFrame:
    return _folded(s, d).agg(F.round(folds.accuracy(F.col("label"), F.col("prediction")), 6).alias("accuracy"))


def metric_f1_weighted(s: SparkSession, d: str) -> DataFrame:
    return rounded(folds.f1_weighted(_folded(s, d)))


def cv_mean(s: SparkSession, d: str) -> DataFrame:
    per = _folded(s, d).groupBy("fold").agg(folds.accuracy(F.col("label"), F.col("prediction")).alias("a"))
    return per.agg(F.round(F.avg("a"), 6).alias("score"))


def _table(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) with a vector of the regex features, scaled on train. Numbers are cached, so that texts are read once."""
    df = features.regex_features(P.pairs(s, d)).drop("document", "summary").fillna(0.0).persist()
    scaler = tabular.Scaler.fit(df.where(~P.is_test()))
    df = tabular.assembled(scaler.transform(df), scaler.columns).select("id", "features", F.col("label").cast("double").alias("label"))
    return df.where(~P.is_test()), df.where(P.is_test())


def _predicted(s: SparkSession, d: str, name: str, params: dict) -> DataFrame:
    train, test = _table(s, d)
    return Classifier(name, params).fit(train.persist()).transform(test).select("id", "label", "prediction")


def logreg(s: SparkSession, d: str) -> DataFrame:
    train, test = _table(s, d)
    return Classifier("logreg").fit(train.persist()).predict_proba(test).select("id", "label", "prediction", F.round(F.col("proba")[1], 4).alias("p"))


def rfc(s: SparkSession, d: str) -> DataFrame:
    return _predicted(s, d, "rfc", {"n_estimators": 20, "max_depth": 6})


def extra_trees(s: SparkSession, d: str) -> DataFrame:
    return _predicted(s, d, "etc", {"n_estimators": 20, "max_depth": 6})


def gbt(s: SparkSession, d: str) -> DataFrame:
    return _predicted(s, d, "lightgbm", {"n_estimators": 10, "num_leaves": 16})


def mlp(s: SparkSession, d: str) -> DataFrame:
    return _predicted(s, d, "mlp", {"hidden_dim": 8, "epochs": 20})


def stacking(s: SparkSession, d: str) -> DataFrame:
    small = {"n_estimators": 5, "max_depth": 4}
    return _predicted(s, d, "stacking", {"folds": 3, "bases": ("rfc", "lightgbm"), "rfc": small, "lightgbm": {"n_estimators": 3, "num_leaves": 16}})


def cross_validated(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(cross_val("logreg", {}, _table(s, d)[0]),)], "score double")


def sfs(s: SparkSession, d: str) -> DataFrame:
    df = features.regex_features(P.pairs(s, d), ["upper_word_ratio", "sent_avg", "word_3_count"]).drop("document", "summary").fillna(0.0)
    got = forward_selection(df.withColumn("label", F.col("label").cast("double")), ["upper_word_ratio", "sent_avg", "word_3_count"], 2, folds=3)
    return s.createDataFrame([(len(names), " ".join(names), score) for names, score in got], "size int, names string, score double")


def kde_by_label(s: SparkSession, d: str) -> DataFrame:
    from inkvane.operators.plots import densities

    got = densities(_numbers(s, d), "sent_avg", 50)
    return got.select("label", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


def full_pipeline(s: SparkSession, d: str) -> DataFrame:
    train, test = P.train_test(s, d)
    settings = Settings(tags=[*features.DEFAULT_TAGS, "tags_n_count"])
    return FeatureTable(settings).fit_transform(train, P.more_docs(s, d), test)


QUERIES = {
    f.__name__: f
    for f in itertools.chain(
        (scan_pairs, csv_roundtrip, json_columns, vector_text, clean_csv, submission, label_merge, drop_list, sanitize_names, regex_count, regex_avg, regex_overlap, regex_ratio, regex_features, clean_text, tokens_clean),
        (corpus_union, corpus_stats, term_counts, vocab_topk, idf_weights, idf_compose, idf_cos, idf_count_svd, idf_svd, idf_lda),
        (tag_tokens, tag_noun_adj, tag_string, tag_count, tag_avg, tag_overlap, tag_ratio, tag_features, tag_idf_cos),
        (lm_rank, lm_topk, lm_topk_probs, lm_postprocess, gltr_count_hist, gltr_frac_hist, gltr_features, embed_sum, pad_sequences, w2v_features),
        (poly_power, poly_fixed, poly_interactions, poly_all, corr_matrix, drop_corr, scale_standard, scale_positive, pca),
        (kfold_stratified, metric_accuracy, metric_f1_weighted, cv_mean, logreg, rfc, extra_trees, gbt, mlp, stacking, cross_validated, sfs, kde_by_label, full_pipeline),
    )
}
__all__ = ["ORACLE_SQL", "QUERIES", "vector_to_array"]
