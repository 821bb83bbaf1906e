"""Text functions against Python's re and hand-made rows."""

import re

import pytest
from pyspark.sql import functions as F

from inkvane.functions import tagging, text
from inkvane.operators import features

ROWS = ["", "   ", "A b , c .", "x ?y", "a\tb !", "Été Paris A1 Àb", "n½ x² a_b", "Hello World-Wide Web. ok!", "end.\n", "It 's a test ; end '", "Two\nlines. And More Words Here? yes!", "A-B C"]
PYTHON = {
    "char": ".", "word": r"\b\w+\b", "sent": r"([A-Z][^\.!?]*[\.!?])", "upper_char": "[A-Z]", "upper_word": r"\b[A-Z]\w+", "numeric": "[0-9]", "dash": "[-]",
    "group": r"([A-Z][\w-]*(?:\s+[A-Z][\w-]*)+)", "is_first_upper": "^[A-Z]", "is_last_ponct": "[?.!,:;']$", "space_before_ponct": "[ ][?.!,:;']", "word_3": r"\b\w{3}\b", "word_1": r"\b\w{1}\b",
}


@pytest.fixture(scope="module")
def hand(spark):
    return spark.createDataFrame(list(enumerate(ROWS)), "id long, t string")


@pytest.mark.parametrize("name", sorted(PYTHON))
def test_catalogue_finds_what_python_finds(hand, name):
    got = dict(hand.select("id", text.matches(F.col("t"), name)).collect())
    assert [got[i] for i in range(len(ROWS))] == [re.findall(PYTHON[name], t) for t in ROWS]


@pytest.mark.parametrize("name", ["word", "sent", "group", "upper_word", "word_3"])
def test_catalogue_on_documents(spark, data, name):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("text", text.match_count(F.col("text"), name)).collect()
    assert all(n == len(re.findall(PYTHON[name], t)) for t, n in rows)


def test_clean(hand):
    def python(t):
        return re.sub(" +", " ", re.sub(r"\s([?.!,:;'](?:\s|$))", r"\1", t)).strip()

    assert [r[0] for r in hand.orderBy("id").select(text.clean(F.col("t"))).collect()] == [python(t) for t in ROWS]


def test_tokens(hand):
    def python(t):
        t = re.sub(" +", " ", "".join(c for c in t.lower() if c not in text.PUNCTUATION)).strip()
        return [x for x in t.split(" ") if x.isalpha()]

    assert [r[0] for r in hand.orderBy("id").select(text.word_tokens(F.col("t"))).collect()] == [python(t) for t in ROWS]


def test_stop_words_keep_repeats(spark):
    df = spark.createDataFrame([("the cat the cat sat",)], "t string")
    assert df.select(text.word_tokens(F.col("t"), ["the"])).first()[0] == ["cat", "cat", "sat"]


def test_features_of_hand_made_pairs(spark):
    df = spark.createDataFrame([(1, "One two. Two THREE", "Two one two"), (2, "no capitals", "Yes"), (3, "", "")], "id long, document string, summary string")
    got = {r["id"]: r for r in features.regex_features(df, ["word_count", "word_avg", "word_overlap", "upper_word_ratio", "word_count"]).collect()}
    assert got[1]["word_count"] == 3 and got[1]["word_avg"] == 3 and got[1]["word_overlap"] == 2
    assert got[2]["upper_word_ratio"] is None and got[3]["word_avg"] == 0


def test_overlap_is_at_most_either_set(spark, data):
    from inkvane.sources.pairs import conversation_pairs

    df = features.regex_features(conversation_pairs(spark, data), ["word_overlap"])
    sizes = [F.size(F.array_distinct(text.matches(F.col(c), "word"))).alias(c[0]) for c in ("summary", "document")]
    assert all(n <= min(a, b) for n, a, b in df.select("word_overlap", *sizes).collect())


def test_tagger(spark):
    df = spark.createDataFrame([("The dogs, quickly running, saw Paris and 3 cats",), ("",)], "t string")
    got = [[tuple(x) for x in r[0]] for r in df.select(tagging.tagged(F.col("t"))).collect()]
    assert got[0] == [("the", "DT"), ("dogs", "NNS"), ("quickly", "RB"), ("running", "VBG"), ("saw", "NN"), ("paris", "NNS"), ("and", "CC"), ("3", "CD"), ("cats", "NNS")]
    assert got[1] == [] and len(tagging.TAGS) == 45
    kept = df.select(tagging.tagged(F.col("t"), nouns_and_adjectives=True)).first()[0]
    assert {x["tag"] for x in kept} <= set(tagging.KEPT)


def test_streams_give_the_same_columns(spark, tmp_path):
    from inkvane.streaming.score import read_stream, scored, write_stream

    rows = spark.createDataFrame([(1, "A long Text here.", "A Text ."), (2, "b", "c")], "id long, document string, summary string")
    rows.write.parquet(str(tmp_path / "in"))
    write_stream(scored(read_stream(spark, str(tmp_path / "in")), ["word_count", "upper_word_ratio"], ["DT_count"]), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = scored(rows, ["word_count", "upper_word_ratio"], ["DT_count"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stems(spark):
    from inkvane.functions.stem import measure, stem, stemmed

    # examples of the published algorithm
    words = "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat hopping:hop falling:fall hissing:hiss filing:file happy:happi sky:sky relational:relat conditional:condit digitizer:digit vietnamization:vietnam triplicate:triplic hopeful:hope goodness:good revival:reviv adjustment:adjust adoption:adopt probate:probat rate:rate cease:ceas controll:control roll:roll"
    for pair in words.split():
        word, want = pair.split(":")
        assert stem(word) == want, word
    assert [measure(w) for w in ("tree", "by", "trouble", "oats", "private")] == [0, 0, 1, 1, 2]
    df = spark.createDataFrame([("Cats running",), (None,)], "t string")
    got = [r[0] for r in df.select(tagging.tagged(F.col("t"), stem=stemmed)).collect()]
    assert [x["token"] for x in got[0]] == ["cat", "run"] and got[1] is None
