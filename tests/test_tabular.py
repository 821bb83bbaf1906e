"""Feature tables: scaling, pruning, projection, histograms, files."""

import glob
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkvane.operators import embed, lm, tabular, tfidf
from inkvane.sources import io


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    rows = [(i, float(a), float(2 * a + 0.01 * b), float(-a), float(c), 3.0, i % 2) for i, (a, b, c) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, twice double, minus double, c double, same double, label int")


def test_scaling(table):
    got = tabular.Scaler.fit(table).transform(table).toPandas()
    assert got["a"].mean() == pytest.approx(0, abs=1e-9) and got["a"].std(ddof=0) == pytest.approx(1) and (got["same"] == 0).all()
    got = tabular.Scaler.fit(table, "positive").transform(table).toPandas()
    assert got["c"].min() == 0 and got["c"].max() == 1 and (got["same"] == 0).all() and set(got["label"]) == {0, 1}
    with pytest.raises(ValueError):
        tabular.Scaler.fit(table, "other")


def test_pruning_is_signed_and_by_earlier_columns(table):
    kept, test = tabular.drop_correlated(table, table, 0.9)
    assert kept.columns == ["id", "a", "minus", "c", "same", "label"] == test.columns
    assert tabular.drop_correlated(table, None, 1.0)[0] is table
    assert tabular.correlated(["x", "y", "z"], np.array([[1, 0.95, 0.1], [0.95, 1, 0.95], [0.1, 0.95, 1]]), 0.9) == ["y", "z"]


def test_drop_list(table):
    assert "a" not in tabular.drop_list(table, ["a", "none"]).columns
    with pytest.raises(ValueError):
        tabular.drop_list(table, ["none"], "raise")


def test_pca(table):
    model = tabular.RatioPCA.fit(table, 0.95)
    got = model.transform(table).toPandas()
    names = [c for c in got.columns if c.startswith("PCA_")]
    assert np.allclose(got[names].mean(), 0) and (np.diff(got[names].var()) <= 1e-12).all()
    assert model.ratios[:-1].sum() <= 0.95 < model.ratios.sum() + 1e-12
    assert np.allclose(model.components.T @ model.components, np.eye(len(names)))
    assert tabular.perform_pca(table, ratio=1.0)[0] is table
    with pytest.warns(UserWarning):
        tabular.perform_pca(table, ratio=0.5, scaled=False)


def test_pca_of_many_columns_is_no_large_expression(spark):
    x = np.random.default_rng(2).normal(size=(300, 40))
    rows = [(i, "kept", *[None if (i, j) == (7, 3) else float(v) for j, v in enumerate(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, name string, " + ", ".join(f"`c.{j}` double" for j in range(40)))
    model = tabular.RatioPCA.fit(df, 0.99)
    out = model.transform(df)
    k = model.components.shape[1]
    assert k > 30 and len(out._jdf.queryExecution().analyzed().toString()) < 100 * (40 + k) + 5000  # not columns times components
    assert out.columns == ["id", "name", *[f"PCA_{i + 1}" for i in range(k)]]
    got = {r["id"]: r for r in out.collect()}
    want = (x - np.array(model.means)) @ model.components
    assert all(np.allclose(got[i][2:], want[i], atol=1e-9) for i in range(300) if i != 7)
    assert got[7]["name"] == "kept" and set(got[7][2:]) == {None} and len(got) == 300


def test_submission_is_written_by_every_task(spark, tmp_path):
    rows = spark.range(0, 100, numPartitions=4).select("id", (F.col("id") % 2).alias("prediction"))
    path = io.write_submission(rows, str(tmp_path), 0.75)
    assert len(glob.glob(f"{path}/part-*")) == 4
    assert sorted(map(tuple, io.read_csv(spark, path, "id long, `0` int").collect())) == [(i, i % 2) for i in range(100)]


def test_correlations_skip_nulls(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4)) + [0, 1e6, -5, 2]
    x[rng.random((300, 4)) < 0.1] = np.nan
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    want = pd.DataFrame(x).corr().to_numpy()
    assert np.allclose(tabular.correlations(df, list("abcd")), want, atol=1e-7)
    empty = tabular.correlations(df.limit(0), list("abcd"))
    assert empty.shape == (4, 4) and np.isnan(empty).all()


def test_products(table):
    got = tabular.products(table, ["a^2 c"], ["a", "c"], degree=2).first()
    assert got["a^2 c"] == pytest.approx(got["a"] ** 2 * got["c"]) and got["a c"] == pytest.approx(got["a"] * got["c"])
    assert len(tabular.interactions(table, None, 2).columns) == len(table.columns) + 15
    with pytest.raises(ValueError):
        tabular.fixed_products(table, ["none^2"])


def test_histograms(spark):
    rows = [(1, [(0, 0.5), (0, 0.1), (3, 0.1), (120, 0.00001)]), (2, [(4, 0.2)]), (3, [(None, 0.0)])]
    df = spark.createDataFrame(rows, "id long, r array<struct<rank:int,prob:double>>")
    for kind, bins in (("count", 4), ("frac", 10), ("logcount", 4)):
        values, low, high = lm.rank_values(F.col("r"), kind)
        df2 = df.select("id", values.alias("v"), low.alias("lo"), high.alias("hi"))
        got = {r[0]: list(r[1:]) for r in df2.select("id", *lm.histogram(F.col("v"), F.col("lo"), F.col("hi"), bins)).collect()}
        for i, r in rows[:2]:
            e = 1e-7
            ranks = [x[0] for x in r]
            if kind == "frac":
                v = [x[1] for x in r]
                edges = np.linspace(min(v) - e, max(v) + e, bins + 1)
            else:
                v = [math.log(x + e) for x in ranks] if kind == "logcount" else ranks
                edges = np.linspace(math.log(min(ranks) + e) - e, math.log(max(ranks) + e) + e, bins + 1)
            assert got[i] == np.histogram(v, bins=edges)[0].tolist(), (kind, i)


def test_language_model(spark):
    docs = spark.createDataFrame([(1, "aa bb aa bb aa cc")], "id long, document string")
    model = lm.BigramModel.fit(docs)
    got = model.check_probabilities(spark.createDataFrame([(7, "aa bb dd")], "id long, summary string"), "summary", 1).first()
    assert got["bpe_strings"] == ["<s>", "aa", "bb", "dd"]
    assert [tuple(x) for x in got["real_topk"]] == [(0, 1.0), (0, 0.66667), (None, 0.0)]
    assert [[tuple(y) for y in x] for x in got["pred_topk"]] == [[("aa", 1.0)], [("bb", 0.66667)], [("aa", 1.0)]]
    assert 1 <= len(model.sample(5, seed=1)) <= 5  # it ends where nothing follows


def test_ranks_of_followers(spark):
    """Counts of followers down, then the token, whatever the number of equal counts."""
    rng = np.random.default_rng(6)
    lines = [(i, " ".join(f"w{j}" for j in rng.zipf(1.5, 50) % 40)) for i in range(30)]
    model = lm.BigramModel.fit(spark.createDataFrame(lines, "id long, document string"))
    seen = {}
    for _, t in lines:
        words = ["<s>", *[w for w in t.split() if len(w) > 1]]
        for a, b in zip(words, words[1:], strict=False):
            seen.setdefault(a, {}).setdefault(b, 0)
            seen[a][b] += 1
    want = {(a, b): (k, c, sum(n.values())) for a, n in seen.items() for k, (b, c) in enumerate(sorted(n.items(), key=lambda x: (-x[1], x[0])))}
    assert {(r["prev"], r["token"]): (r["rank"], r["c"], r["total"]) for r in model.table.collect()} == want


def test_ranks_by_several_tasks_and_of_marked_pairs(spark, monkeypatch):
    """The same ranks where followers are put in order by groups, and where the pairs of other rows are marked."""
    rng = np.random.default_rng(8)
    lines = [(i, " ".join(f"{'abc'[j % 3]}{j}" for j in rng.zipf(1.4, 60) % 50)) for i in range(30)] + [(30, ""), (31, None)]
    docs = spark.createDataFrame(lines, "id long, document string")
    want = sorted(map(tuple, lm.BigramModel.fit(docs).table.collect()))
    monkeypatch.setattr(lm.BigramModel, "MANY", 3)
    monkeypatch.setattr(lm.BigramModel, "SHARE", 1)
    model = lm.BigramModel.fit(docs)
    assert sorted(map(tuple, model.table.collect())) == want and len({r[0] for r in want}) > 10
    table = {(r[0], r[1]): (r[5], r[4]) for r in want}
    rows = spark.createDataFrame([(1, lines[0][1]), (2, lines[1][1] + " unseen a1 a1"), (3, ""), (4, None)], "id long, summary string")
    for m in (model, lm.BigramModel(model.table)):
        got = m.ranked(rows, "summary").collect()
        assert len(got) == sum(len([w for w in t.split() if len(w) > 1]) for t in (lines[0][1], lines[1][1] + " unseen a1 a1"))
        assert all((r["rank"], r["prob"]) == table.get((r["prev"], r["token"]), (None, 0.0)) for r in got)


def test_corpus_of_ranks_is_read_once(spark):
    docs = spark.createDataFrame([(1, "aa bb aa cc"), (2, "aa dd")], "id long, document string").repartition(2)
    table = lm.BigramModel.fit(docs).table
    assert table.count() == 5
    plan = table.select("prev", "token", "rank", "total")
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Generate") == 1 and final.count("regexp_extract_all") == 1, final


def test_topics_of_rows_in_parts(monkeypatch):
    """Shares and weights as worked out a row at a time by the formula, whatever rows are taken together."""
    def digamma(v):  # by differences of the logarithm of gamma
        f = np.vectorize(lambda y: (math.lgamma(y * (1 + 1e-5)) - math.lgamma(y * (1 - 1e-5))) / (2e-5 * y))
        return f(v)

    rng = np.random.default_rng(5)
    lengths = np.array([0, 7, 40, 0, 1, 300, 12, 25, 0])
    at = np.concatenate([np.sort(rng.choice(400, n, replace=False)) for n in lengths])
    x, topics = rng.integers(1, 9, len(at)).astype(float), rng.gamma(2.0, 0.5, (3, 400))
    words = np.exp(digamma(topics) - digamma(topics.sum(axis=1, keepdims=True))).T
    shares, weights = np.zeros((len(lengths), 3)), np.zeros((len(at), 3))
    for i, (a, n) in enumerate(zip(np.cumsum(lengths) - lengths, lengths, strict=True)):
        gamma, of, count = np.ones(3), words[at[a : a + n]], x[a : a + n]
        for _ in range(100):
            share = np.exp(digamma(gamma) - digamma(gamma.sum()))
            new = 1 / 3 + share * (of * (count / (of @ share))[:, None]).sum(axis=0)
            gamma, moved = new, np.abs(new - gamma).mean()
            if moved < 1e-3:
                break
        shares[i] = gamma / gamma.sum()
        share = of * np.exp(digamma(gamma) - digamma(gamma.sum()))
        weights[a : a + n] = share * (count / share.sum(axis=1))[:, None]
    for cells in (1, 45, tfidf.CELLS):
        monkeypatch.setattr(tfidf, "CELLS", cells)
        got = tfidf.topic_inference(topics)(lengths, at, x)
        assert np.allclose(got[0], shares, atol=1e-5) and np.allclose(got[1], weights, atol=1e-5)


def test_embeddings_by_name(spark, tmp_path):
    from inkvane import cli
    from inkvane.plans.features import FeatureTable, Settings

    (tmp_path / "embed").mkdir()
    (tmp_path / "embed" / "glove_300.txt").write_text("cat " + " ".join(["1"] * 300) + "\n")
    assert cli.vectors_of(spark, str(tmp_path), ["glove", "own"])["glove"].count() == 1
    pairs = spark.createDataFrame([(1, "a cat", "cat", 1)], "id long, document string, summary string, label int")
    with pytest.raises(ValueError, match="glove"):
        FeatureTable(Settings(regex=[], idf=[], tags=[], ranks=[], embeddings=["glove"])).fit(pairs)


def test_embeddings(spark):
    table = spark.createDataFrame([("cat", [3.0, 0.0]), ("dog", [0.0, 4.0]), ("anti", [-3.0, 0.0])], "token string, vec array<float>")
    rows = spark.createDataFrame([(1, "cat cat dog"), (2, "none"), (3, "cat anti")], "id long, summary string")
    got = dict(embed.summed(rows, table).collect())
    assert got[1] == pytest.approx([6 / math.hypot(6, 4), 4 / math.hypot(6, 4)]) and got[2] == [0, 0] and got[3] == [0, 0]
    index = embed.word_index(rows)
    seq = dict(embed.padded(rows, index, length=2).collect())
    assert seq[2][0] == 0 and len(seq[1]) == 2 and dict(index.collect())["cat"] == 1
    assert embed.embedding_matrix(index, table, 2).count() == index.count() + 1


def test_tfidf_model(spark):
    docs = spark.createDataFrame([(i, f"alpha beta gamma{i} alpha delta{i % 3}") for i in range(12)], "id long, document string")
    pairs = docs.withColumn("summary", F.split("document", " ")[0])
    model = tfidf.fit_tfidf(docs, ["n_count", "w_idf", "n_lda", "n_cos"], components=2)
    got = model.transform(pairs).toPandas()
    assert np.allclose(got[["n_lda_0", "n_lda_1", "n_lda_2"]].sum(axis=1), 1) and got["n_cos"].between(0, 1).all()
    assert {"n_count_PCA_1", "n_count_PCA_2", "w_idf_PCA_2"} <= set(got.columns)
    index, size = model._index()
    rows = tfidf.sparse_rows(model._weights(docs, "document", "n"), index, "x")
    v = tfidf.truncated_svd(rows, size, 2)
    dense = np.zeros((12, size))
    for r in rows.collect():
        dense[r["id"], r["indices"]] = r["values"]
    assert np.allclose(v.T @ v, np.eye(2), atol=1e-8)
    assert np.allclose(np.linalg.norm(dense @ v, axis=0), np.linalg.svd(dense)[1][:2], atol=1e-6)  # the second value is not single


def test_topics_read_every_document(spark):
    """Topics are those of a plain batch fit, whatever the partitions; every word's count is in them."""
    rng = np.random.default_rng(1)
    lines = [(i, " ".join(f"{'abc'[i % 3]}word{j}" for j in rng.integers(0, 20, 30)) + f" rare{i}") for i in range(60)]
    docs = spark.createDataFrame(lines, "id long, document string")
    pairs = docs.withColumn("summary", F.col("document"))
    one, many = (tfidf.fit_tfidf(docs.repartition(n, "id"), ["n_lda"]) for n in (1, 7))
    a, b = (m.transform(pairs).toPandas().sort_values("id").filter(like="n_lda").to_numpy() for m in (one, many))
    assert np.allclose(a, b, atol=1e-6)
    terms = [r[0] for r in one.idf.select("term").orderBy("term").collect()]
    counts = np.array([[t.split().count(w) for w in terms] for _, t in lines], float)
    topics = one.projections["n", "lda"]
    assert np.allclose(topics.sum(axis=0) - 1, counts.sum(axis=0))

    def digamma(x):  # by the differences of log gamma
        f = np.vectorize(math.lgamma)
        return (f(x - 2e-3) - 8 * f(x - 1e-3) + 8 * f(x + 1e-3) - f(x + 2e-3)) / 12e-3

    def expected(x):
        return np.exp(digamma(x) - digamma(x.sum(axis=-1, keepdims=True)))

    want = np.random.default_rng(0).gamma(100.0, 0.01, topics.shape)
    for _ in range(10):
        word, total = expected(want), np.zeros_like(want)
        for c in counts:
            g, last = np.ones(3), np.zeros(3)
            for _ in range(100):
                last, e = g, expected(g)
                g = 1 / 3 + e * (word @ (c / (e @ word)))
                if np.abs(g - last).mean() < 1e-3:
                    break
            e = expected(g)
            total += np.outer(e, c / (e @ word)) * word
        want = 1 / 3 + total
    assert np.allclose(sorted(topics.sum(axis=1)), sorted(want.sum(axis=1)), rtol=1e-4)


def test_files(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nwith lines', ""), (2, " spaces ", "x")]
    df = spark.createDataFrame(rows, "id long, document string, summary string")
    io.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "c"), df.schema).collect())) == rows
    (tmp_path / "j.json").write_text('{"document": {"0": "a", "5": "b"}, "summary": {"0": "c", "5": "d"}, "label": {"0": 1, "5": 0}}')
    assert sorted(map(tuple, io.read_columns_json(spark, str(tmp_path / "j.json")).collect())) == [(0, "a", "c", 1), (5, "b", "d", 0)]
    (tmp_path / "v.txt").write_text("cat 1 2\nbad x 2\nnew york 3 4\nshort 1\n")
    assert sorted((r[0], list(r[1])) for r in io.read_vectors(spark, str(tmp_path / "v.txt"), 2).collect()) == [("cat", [1, 2]), ("new york", [3, 4])]
    (tmp_path / "w.bin").write_bytes(b"2 2\ncat " + np.array([1, 2], "<f4").tobytes() + b"\ndog " + np.array([3, 4], "<f4").tobytes() + b"\n")
    assert sorted((r[0], list(r[1])) for r in io.read_binary_vectors(spark, str(tmp_path / "w.bin")).collect()) == [("cat", [1, 2]), ("dog", [3, 4])]
    many = np.random.default_rng(0).normal(size=(3000, 100)).astype("<f4")
    (tmp_path / "m.bin").write_bytes(b"3000 100\n" + b"".join(f"w{i} ".encode() + v.tobytes() + b"\n" * (i % 2) for i, v in enumerate(many)))
    got = {r[0]: r[1] for r in io.read_binary_vectors(spark, str(tmp_path / "m.bin")).collect()}
    assert len(got) == 3000 and all(np.allclose(got[f"w{i}"], many[i]) for i in (0, 1, 1500, 2999))
    assert io.submission_name(0.91234).endswith("_cv_ac_0.912")


def test_numbered(spark):
    from inkvane.functions.order import numbered

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = numbered(df.repartition(7), "n", F.desc("x"), first=1).collect()
    assert all(r["n"] == 1000 - r["x"] for r in got) and len(got) == 1000


def test_densities(table):
    from inkvane.operators.plots import densities

    got = densities(table, "a", 200).toPandas()
    for _, part in got.groupby("label"):
        part = part.sort_values("x")
        assert 0.7 < np.trapezoid(part["density"], part["x"]) < 1.05


def test_feature_table_of_all_rows_at_once(spark, data):
    """fit_transform is fit, then transform, with the columns of all rows cached."""
    from inkvane.plans.features import FeatureTable, Settings
    from inkvane.sources import pairs as P

    train, test = P.train_test(spark, data)
    settings = Settings(regex=["word_count"], idf=["n_cos"], tags=["DT_count", "tags_n_cos"], ranks=["count_4"])
    model = FeatureTable(settings).fit(train, P.more_docs(spark, data))
    want = model.transform(train.unionByName(test))
    got = FeatureTable(settings).fit_transform(train, P.more_docs(spark, data), test)
    assert got.columns == want.columns
    frames = [df.toPandas().sort_values("id").reset_index(drop=True) for df in (got, want)]
    assert np.allclose(*[f.to_numpy(float) for f in frames], atol=1e-9, equal_nan=True)
    assert "InMemory" in got._jdf.queryExecution().optimizedPlan().toString()
