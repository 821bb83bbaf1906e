"""Row-local features of pairs (document, summary): regex, tags, cleaning. One projection for all that are asked for.

They hold on batch and streaming DataFrames alike, need no shuffle and stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkvane.functions import tagging, text
from inkvane.plans.spec import Feature, regex_feature, tag_feature, unique

DEFAULT_REGEX = "char_count char_ratio word_count word_overlap word_ratio sent_avg upper_word_ratio group_overlap is_last_ponct_count space_before_ponct_count word_3_count".split()
DEFAULT_TAGS = "DT_count DT_overlap MD_count NN_overlap RB_count $_overlap :_overlap".split()


def regex_column(f: Feature) -> Column:
    s, d = F.col("summary"), F.col("document")
    if f.kind == "count":
        return text.match_count(s, f.subject)
    if f.kind == "avg":
        return text.mean_length(text.matches(s, f.subject))
    if f.kind == "ratio":
        return text.ratio(text.match_count(s, f.subject), text.match_count(d, f.subject))
    return text.overlap(text.matches(s, f.subject), text.matches(d, f.subject))


def regex_features(pairs: DataFrame, specs: list[str] | None = None) -> DataFrame:
    """pairs with a column for each regex feature, named by its spec."""
    wanted = [regex_feature(s) for s in unique(specs if specs is not None else DEFAULT_REGEX)]
    return pairs.withColumns({f.spec: regex_column(f) for f in wanted if f.spec not in pairs.columns})


def tag_columns(pairs: DataFrame, tagger: tagging.Tagger = tagging.rule_tagger) -> DataFrame:
    """pairs with s_tags and d_tags, arrays of (token, tag), each made once."""
    return pairs.withColumns({"s_tags": tagging.tagged(F.col("summary"), tagger), "d_tags": tagging.tagged(F.col("document"), tagger)})


def tag_column(f: Feature) -> Column:
    s, d = tagging.tokens_with(F.col("s_tags"), f.subject), tagging.tokens_with(F.col("d_tags"), f.subject)
    if f.kind == "count":
        return F.size(s).cast("double")
    if f.kind == "avg":
        return text.mean_length(s)
    if f.kind == "ratio":
        return text.ratio(F.size(s).cast("double"), F.size(d).cast("double"))
    return text.overlap(s, d)


def tag_features(pairs: DataFrame, specs: list[str] | None = None, tagger: tagging.Tagger = tagging.rule_tagger) -> DataFrame:
    """pairs with a column for each ordinary tag feature; ``tags_*`` features need a corpus, see ``tfidf``."""
    wanted = [tag_feature(s) for s in unique(specs if specs is not None else DEFAULT_TAGS)]
    wanted = [f for f in wanted if f.subject != "tags" and f.spec not in pairs.columns]
    if not wanted:
        return pairs
    rows = tag_columns(pairs, tagger)
    return rows.withColumns({f.spec: tag_column(f) for f in wanted}).drop("s_tags", "d_tags")


def cleaned(rows: DataFrame) -> DataFrame:
    """rows with document_clean and, if there is a summary, summary_clean."""
    return rows.withColumns({f"{c}_clean": text.clean(F.col(c)) for c in ("document", "summary") if c in rows.columns})
