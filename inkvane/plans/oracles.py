"""SQL for the library's queries, written for DuckDB and independent of the Spark plans."""

from __future__ import annotations

from inkvane.functions import tagging
from inkvane.functions.stopwords import STOP_WORDS
from inkvane.functions.text import PUNCTUATION

W = r"[\p{L}\p{N}_]"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PAIRS = "p AS (SELECT d.doc_id AS id, text AS document, split_part(text, chr(10), 1) AS summary, quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
CONV = (
    "p AS (SELECT conv_id, turn, text AS document, nt AS summary FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr, "
    "lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM conversations) WHERE role = 'user' AND nr = 'assistant')"
)
CORPUS = PAIRS + ", c AS (SELECT id, document FROM p WHERE id % 5 <> 0 UNION ALL SELECT doc_id, text FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))"
TERM = rf"regexp_extract_all(lower(document), '{W}{{2,}}')"
COUNTS = CORPUS + f", t AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({TERM}) AS term FROM c) GROUP BY id, term)"
VOCAB = COUNTS + ", v AS (SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM t GROUP BY term ORDER BY cf DESC, term LIMIT 10000)"
STATS = "s AS (SELECT count(*) AS n, avg(length(document)) AS m FROM c)"


def found(name: str, t: str) -> str:
    """The list of matches of a catalogue name in a text."""
    if name == "char":
        return f"regexp_extract_all({t}, '.')"
    if name == "word":
        return f"regexp_extract_all({t}, '{W}+')"
    if name.startswith("word_"):
        return f"list_filter(regexp_extract_all({t}, '{W}+'), lambda x: length(x) = {name[5:]})"
    if name == "upper_word":
        return f"list_filter(regexp_extract_all({t}, '{W}+'), lambda x: regexp_matches(x, '^[A-Z].'))"
    pattern = {
        "sent": r"[A-Z][^\.!?]*[\.!?]",
        "upper_char": "[A-Z]",
        "numeric": "[0-9]",
        "dash": "[-]",
        "group": r"[A-Z][\p{L}\p{N}_-]*(?:\s+[A-Z][\p{L}\p{N}_-]*)+",
        "is_first_upper": "^[A-Z]",
        "is_last_ponct": "[?.!,:;'']\\n?$",
        "space_before_ponct": "[ ][?.!,:;'']",
    }[name]
    return f"regexp_extract_all({t}, '{pattern}')"


def count(name: str, t: str) -> str:
    return f"CAST(len({found(name, t)}) AS DOUBLE)"


def mean(parts: str) -> str:
    return f"coalesce(round(list_avg(list_transform({parts}, lambda x: length(x))), 6), 0.0)"


def shared(a: str, b: str) -> str:
    return f"CAST(len(list_distinct(list_intersect({a}, {b}))) AS BIGINT)"


def quotient(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN NULL ELSE round({a} / {b}, 6) END"


def regex_column(spec: str) -> str:
    name, _, kind = spec.rpartition("_")
    s, d = found(name, "summary"), found(name, "document")
    value = {"count": count(name, "summary"), "avg": mean(s), "overlap": shared(s, d), "ratio": quotient(count(name, "summary"), count(name, "document"))}[kind]
    return f'{value} AS "{spec}"'


def plain(t: str) -> str:
    """Tokens without punctuation, split at spaces."""
    return f"string_split(regexp_replace(regexp_replace(translate({t}, {sql_str(PUNCTUATION)}, ''), ' +', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), ' ')"


def clean(t: str) -> str:
    inner = f"regexp_replace({t}, '\\s([?.!,:;''](?:\\s|$))', '\\1', 'g')"
    return f"regexp_replace(regexp_replace({inner}, ' +', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def tag_case(x: str) -> str:
    out = f"CASE WHEN regexp_matches({x}, '^[0-9][0-9.,-]*$') THEN 'CD'"
    for tag, words in tagging.LEXICON.items():
        out += f" WHEN {x} IN ({', '.join(map(sql_str, words.split()))}) THEN '{tag}'"
    for suffix, tag in tagging.SUFFIXES:
        out += f" WHEN {x} LIKE '%{suffix}' AND length({x}) > {len(suffix)} THEN '{tag}'"
    return out + " ELSE 'NN' END"


def tagged_tokens(t: str) -> str:
    return f"list_transform(list_filter({plain(f'lower({t})')}, lambda x: x <> ''), lambda x: {{'token': x, 'tag': {tag_case('x')}}})"


def tagged_pairs(base: str) -> str:
    return f"{base}, g AS (SELECT *, {tagged_tokens('summary')} AS st, {tagged_tokens('document')} AS dt FROM p)"


def tag_column(spec: str) -> str:
    tag, _, kind = spec.partition("_")
    s, d = (f"list_transform(list_filter({c}, lambda x: x.tag = {sql_str(tag)}), lambda x: x.token)" for c in ("st", "dt"))
    value = {"count": f"CAST(len({s}) AS DOUBLE)", "avg": mean(s), "overlap": shared(s, d), "ratio": quotient(f"CAST(len({s}) AS DOUBLE)", f"len({d})")}[kind]
    return f'{value} AS "{spec}"'


def tag_query(base: str, keys: str, specs: list[str], names: dict[str, str] | None = None) -> str:
    columns = ", ".join(tag_column(s) if not names else tag_column(s).rsplit(" AS ", 1)[0] + f" AS {names[s]}" for s in specs)
    return f"WITH {tagged_pairs(base)} SELECT {keys}, {columns} FROM g"


BIGRAMS = (
    COUNTS
    + f", w AS (SELECT id, {TERM} AS w FROM c), b AS (SELECT CASE WHEN i = 1 THEN '<s>' ELSE w[i - 1] END AS prev, w[i] AS token FROM (SELECT w, unnest(generate_series(1, len(w))) AS i FROM w)), "
    "k AS (SELECT prev, token, count(*) AS c FROM b GROUP BY prev, token), "
    "m AS (SELECT prev, token, c, row_number() OVER (PARTITION BY prev ORDER BY c DESC, token) - 1 AS rank, round(c / CAST(sum(c) OVER (PARTITION BY prev) AS DOUBLE), 5) AS prob FROM k)"
)
RANKED = (
    BIGRAMS
    + rf", sw AS (SELECT id, regexp_extract_all(lower(summary), '{W}{{2,}}') AS w FROM p), sb AS (SELECT id, CASE WHEN i = 1 THEN '<s>' ELSE w[i - 1] END AS prev, w[i] AS token FROM (SELECT id, w, unnest(generate_series(1, len(w))) AS i FROM sw)), "
    "r AS (SELECT id, m.rank, coalesce(m.prob, 0) AS prob FROM sb LEFT JOIN m ON sb.prev = m.prev AND sb.token = m.token)"
)


def histogram(kind: str, bins: int) -> tuple[str, str, str]:
    """(CTEs for the edges, columns, name of the relation)."""
    value = {"frac": "prob", "count": "CAST(rank AS DOUBLE)", "logcount": "ln(rank + 1e-7)"}[kind]
    low, high = ("min(prob) - 1e-7", "max(prob) + 1e-7") if kind == "frac" else ("ln(min(rank) + 1e-7) - 1e-7", "ln(max(rank) + 1e-7) + 1e-7")
    e = f"e_{kind}"
    ctes = f"{e} AS (SELECT id, {low} AS lo, {high} AS hi FROM r GROUP BY id)"
    edge = lambda k: "lo" if k == 0 else "hi" if k == bins else f"(lo + {k} * (hi - lo) / {bins}.0::DOUBLE)"
    columns = ", ".join(f"count(CASE WHEN {value} >= {edge(k)} AND {value} {'<=' if k == bins - 1 else '<'} {edge(k + 1)} THEN 1 END) AS topk_{kind}_{k}" for k in range(bins))
    return ctes, f"h_{kind} AS (SELECT r.id, {columns} FROM r JOIN {e} ON r.id = {e}.id GROUP BY r.id)", ", ".join(f"coalesce(topk_{kind}_{k}, 0) AS topk_{kind}_{k}" for k in range(bins))


def hist_query(kinds: dict[str, int]) -> str:
    parts = {k: histogram(k, b) for k, b in kinds.items()}
    ctes = ", ".join(f"{a}, {b}" for a, b, _ in parts.values())
    joins = " ".join(f"LEFT JOIN h_{k} ON p.id = h_{k}.id" for k in kinds)
    return f"WITH {RANKED}, {ctes} SELECT p.id, {', '.join(c for _, _, c in parts.values())} FROM p {joins}"


NUMBERS = f"{PAIRS}, x AS (SELECT id, label, {', '.join(regex_column(s) for s in ('char_count', 'word_count', 'upper_word_count', 'sent_avg'))} FROM p)"
VECTORS = "x AS (SELECT vec_id AS id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(64)) + " FROM embeddings), y AS (SELECT *, e0 * 2 + e1 * 0.01::DOUBLE AS twice, -e0 AS minus FROM x)"
COLUMNS = [*[f"e{i}" for i in range(64)], "twice", "minus"]
SCALED = ["char_count", "word_count", "upper_word_count", "sent_avg", "same"]
FOLDS = (
    f"{PAIRS}, q AS (SELECT id, label, CAST(len({found('upper_word', 'summary')}) * 3 < len({found('word', 'summary')}) AS INTEGER) AS prediction FROM p), "
    "f AS (SELECT *, ntile(5) OVER (PARTITION BY label ORDER BY id) - 1 AS fold FROM q)"
)


def scaled(method: str) -> str:
    pair = ("avg", "stddev_pop") if method == "standard" else ("min", "max")
    stats = ", ".join(f"{f}({c}) AS {c}_{i}" for c in SCALED for i, f in enumerate(pair))
    if method == "standard":
        column = lambda c: f"round(({c} - {c}_0) / CASE WHEN {c}_1 = 0 THEN 1 ELSE {c}_1 END, 6) AS {c}"
    else:
        column = lambda c: f"round(({c} - {c}_0) / CASE WHEN {c}_1 = {c}_0 THEN 1 ELSE {c}_1 - {c}_0 END, 6) AS {c}"
    return f"WITH {NUMBERS}, n AS (SELECT *, 3.0::DOUBLE AS same FROM x), s AS (SELECT {stats} FROM n WHERE id % 5 <> 0) SELECT id, {', '.join(map(column, SCALED))} FROM n, s"


def products_query() -> str:
    from inkvane.operators.tabular import monomial_name, monomials

    columns = ", ".join(f'round({" * ".join(m)}, 6) AS "{monomial_name(m)}"' for m in monomials(["word_count", "upper_word_count", "sent_avg"], 3))
    return f"WITH {NUMBERS} SELECT id, {columns} FROM x"


REGEX_DEFAULT = "char_count char_ratio word_count word_overlap word_ratio sent_avg upper_word_ratio group_overlap is_last_ponct_count space_before_ponct_count word_3_count".split()
ALL_COUNTS = ["char", "word", "sent", "upper_char", "upper_word", "numeric", "dash", "group", "is_first_upper", "is_last_ponct", "space_before_ponct", "word_1", "word_3", "word_10"]
TAG_NAMES = {"$_overlap": "dollar_tag_overlap", ":_overlap": "column_tag_overlap", "PRP$_count": "PRPdollar_tag_count", "''_count": "apostrophe_tag_count"}
TOKENS = f"list_filter({plain('lower(document)')}, lambda x: regexp_matches(x, '^\\p{{L}}+$') AND NOT list_contains([{', '.join(map(sql_str, STOP_WORDS))}], x))"
SUMMARY_TOKENS = TOKENS.replace("document", "summary")
FILTERED = "translate(lower(summary), '!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~' || chr(9) || chr(10), repeat(' ', 33))"
SEQUENCE = f"list_filter(string_split({FILTERED}, ' '), lambda x: x <> '')"
WEIGHTS = {
    "n": "tf", "w": "1 + ln(tf)", "l": "1 + ln(1 + ln(tf))", "d": "tf + 0.1::DOUBLE", "p": "tf / (0.5::DOUBLE + 0.5::DOUBLE * (n / m))", "k": "2.0::DOUBLE * tf / (1 + tf)",
    "wdk": "2.0::DOUBLE * (1.1::DOUBLE + ln(tf)) / (2.1::DOUBLE + ln(tf))",
}


#: Tag sequences as terms: runs of two or more word characters of the joined tags, in lower case.
TAG_TERM = rf"regexp_extract_all(lower(array_to_string(list_transform({tagged_tokens('document')}, lambda x: x.tag), '_')), '{W}{{2,}}')"


def tag_idf_query() -> str:
    counts = lambda name, source, column: f"{name} AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({TAG_TERM.replace('document', column)}) AS term FROM {source}) GROUP BY id, term)"
    side = lambda name, source: f"{name} AS (SELECT u.id, u.term, u.tf * (ln(s.n / CAST(v.df AS DOUBLE)) + 1) AS x FROM {source} u JOIN v ON u.term = v.term, s)"
    return (
        f"WITH {CORPUS}, {counts('t', 'c', 'document')}, v AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM t GROUP BY term ORDER BY cf DESC, term LIMIT 100), {STATS}, "
        f"{counts('td', 'p', 'document')}, {counts('ts', 'p', 'summary')}, {side('a', 'td')}, {side('b', 'ts')}, "
        "ab AS (SELECT a.id, sum(a.x * b.x) AS d FROM a JOIN b ON a.id = b.id AND a.term = b.term GROUP BY a.id), na AS (SELECT id, sqrt(sum(x * x)) AS l FROM a GROUP BY id), nb AS (SELECT id, sqrt(sum(x * x)) AS l FROM b GROUP BY id) "
        "SELECT p.id, coalesce(round(d / (na.l * nb.l), 6), 0.0) AS n_cos_tags FROM p LEFT JOIN ab ON p.id = ab.id LEFT JOIN na ON p.id = na.id LEFT JOIN nb ON p.id = nb.id"
    )


def all_products() -> str:
    columns = ["char_count", "word_count", "upper_word_count", "sent_avg"]
    made = [f'round({a} * {b}, 6) AS "{a if a == b else a + " " + b}{"^2" if a == b else ""}"' for i, a in enumerate(columns) for b in columns[i:]]
    return f"WITH {NUMBERS} SELECT id, label, {', '.join(columns)}, {', '.join(made)} FROM x"


def density_query(points: int = 50) -> str:
    return (
        f"WITH {NUMBERS}, e AS (SELECT min(sent_avg) AS lo, max(sent_avg) AS hi, (max(sent_avg) - min(sent_avg)) / {20 * points}.0::DOUBLE AS st FROM x), "
        "g AS (SELECT label, count(*) AS n, greatest(1.06::DOUBLE * stddev_pop(sent_avg) * pow(count(*), -0.2::DOUBLE), any_value(st)) AS h FROM x, e GROUP BY label), "
        "b AS (SELECT label, floor((sent_avg - lo) / st) AS bin, count(*) AS c FROM x, e GROUP BY 1, 2), "
        f"q AS (SELECT lo + (hi - lo) * i / {points - 1}.0::DOUBLE AS x FROM e, (SELECT unnest(generate_series(0, {points - 1})) AS i)), "
        "z AS (SELECT b.label, q.x, c, n, h, (q.x - (lo + (bin + 0.5::DOUBLE) * st)) / h AS z FROM b JOIN g ON b.label = g.label, q, e) "
        "SELECT label, round(x, 6) AS x, round(sum(c * exp(-z * z / 2) / (n * h * 2.5066282746310002::DOUBLE)), 6) AS density FROM z GROUP BY label, x"
    )


def cos_side(name: str, column: str) -> str:
    return f"{name} AS (SELECT u.id, u.term, u.tf * (ln(s.n / CAST(v.df AS DOUBLE)) + 1) AS x FROM (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower({column}), '{W}{{2,}}')) AS term FROM p) GROUP BY id, term) u JOIN v ON u.term = v.term, s)"


SQL = {
    "scan_pairs": f"WITH {PAIRS} SELECT * FROM p",
    "csv_roundtrip": f"WITH {PAIRS} SELECT * FROM p",
    "json_columns": "SELECT item_id AS id, text AS document, text AS summary FROM benchmark",
    "vector_text": "SELECT 'v' || vec_id AS token, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS e{i}" for i in range(64)) + " FROM embeddings",
    "clean_csv": f"WITH {PAIRS} SELECT id, document, summary, {clean('document')} AS document_clean, {clean('summary')} AS summary_clean FROM p",
    "submission": f'WITH {FOLDS} SELECT id, prediction AS "0" FROM f',
    "tag_idf_cos": tag_idf_query(),
    "poly_all": all_products(),
    "kde_by_label": density_query(),
    "label_merge": f"WITH {PAIRS} SELECT id, CAST(length(document) AS INTEGER) AS n, CAST(CASE WHEN id % 5 <> 0 THEN label END AS DOUBLE) AS label FROM p",
    "drop_list": f"WITH {PAIRS} SELECT id, label, {count('char', 'summary')} AS char_count, {count('sent', 'summary')} AS sent_count FROM p",
    "sanitize_names": tag_query(PAIRS, "id, label", list(TAG_NAMES), TAG_NAMES),
    "regex_count": f"WITH {PAIRS} SELECT id, {', '.join(f'{count(n, "document")} AS {n}_count' for n in ALL_COUNTS)} FROM p",
    "regex_avg": f"WITH {PAIRS} SELECT id, {', '.join(f'{mean(found(n, "document"))} AS {n}_avg' for n in ('word', 'sent', 'group', 'numeric'))} FROM p",
    "regex_overlap": f"WITH {CONV} SELECT conv_id, turn, {', '.join(regex_column(s) for s in ('word_overlap', 'upper_word_overlap', 'word_3_overlap', 'group_overlap'))} FROM p",
    "regex_ratio": f"WITH {CONV} SELECT conv_id, turn, {', '.join(regex_column(s) for s in ('char_ratio', 'word_ratio', 'upper_word_ratio', 'dash_ratio'))} FROM p",
    "regex_features": f"WITH {PAIRS} SELECT id, label, {', '.join(map(regex_column, REGEX_DEFAULT))} FROM p",
    "clean_text": f"WITH {PAIRS} SELECT id, {clean('document')} AS document_clean, {clean('summary')} AS summary_clean FROM p",
    "tokens_clean": f"WITH {PAIRS} SELECT id, array_to_string({TOKENS}, ' ') AS tokens, len({TOKENS}) AS n FROM p",
    "corpus_union": f"WITH {CORPUS} SELECT id, document FROM c",
    "corpus_stats": f"WITH {CORPUS} SELECT count(*) AS n, round(avg(length(document)), 6) AS mean_length FROM c",
    "term_counts": f"WITH {COUNTS} SELECT id, term, tf FROM t",
    "vocab_topk": f"WITH {VOCAB} SELECT term, cf, df FROM v",
    "idf_weights": f"WITH {VOCAB}, {STATS} SELECT term, df, round(ln(n / CAST(df AS DOUBLE)) + 1, 6) AS idf FROM v, s",
    "idf_compose": f"WITH {COUNTS}, {STATS} SELECT tf, count(*) AS cells, {', '.join(f'round(CAST(any_value({e}) AS DOUBLE), 6) AS x_{k}' for k, e in WEIGHTS.items())} FROM t, s GROUP BY tf",
    "idf_cos": f"WITH {VOCAB}, {STATS}, {cos_side('a', 'document')}, {cos_side('b', 'summary')}, "
    "ab AS (SELECT a.id, sum(a.x * b.x) AS d FROM a JOIN b ON a.id = b.id AND a.term = b.term GROUP BY a.id), na AS (SELECT id, sqrt(sum(x * x)) AS l FROM a GROUP BY id), nb AS (SELECT id, sqrt(sum(x * x)) AS l FROM b GROUP BY id) "
    "SELECT p.id, coalesce(round(d / (na.l * nb.l), 6), 0.0) AS cos FROM p LEFT JOIN ab ON p.id = ab.id LEFT JOIN na ON p.id = na.id LEFT JOIN nb ON p.id = nb.id",
    "tag_tokens": f"WITH {PAIRS}, g AS (SELECT id, unnest({tagged_tokens('document')}) AS x FROM p) SELECT id, x.tag AS tag, count(*) AS n, CAST(sum(length(x.token)) AS BIGINT) AS chars FROM g GROUP BY id, x.tag",
    "tag_noun_adj": f"WITH {PAIRS}, g AS (SELECT id, list_filter({tagged_tokens('document')}, lambda x: x.tag IN ('NN', 'NNS', 'NNP', 'NNPS', 'JJ', 'JJS', 'JJR')) AS t FROM p) SELECT id, len(t) AS n, array_to_string(list_transform(t, lambda x: x.token), ' ') AS tokens FROM g",
    "tag_string": f"WITH {PAIRS} SELECT id, array_to_string(list_transform({tagged_tokens('summary')}, lambda x: x.tag), '_') AS tags FROM p",
    "tag_count": tag_query(CONV, "conv_id, turn", ["DT_count", "NN_count", "MD_count", "VBD_count"]),
    "tag_avg": tag_query(CONV, "conv_id, turn", ["NN_avg", "JJ_avg"]),
    "tag_overlap": tag_query(CONV, "conv_id, turn", ["DT_overlap", "NN_overlap"]),
    "tag_ratio": tag_query(CONV, "conv_id, turn", ["DT_ratio", "CD_ratio"]),
    "tag_features": tag_query(PAIRS, "id, label", "DT_count DT_overlap MD_count NN_overlap RB_count $_overlap :_overlap".split()),
    "lm_rank": f"WITH {RANKED} SELECT id, count(*) AS tokens, count(rank) AS known, CAST(coalesce(sum(rank), 0) AS BIGINT) AS ranks, round(sum(prob), 6) AS sum_prob FROM r GROUP BY id",
    "lm_topk": f"WITH {BIGRAMS} SELECT prev, token, rank, prob FROM m WHERE rank < 5",
    "lm_topk_probs": f"WITH {BIGRAMS} SELECT prev, token, round(c / CAST(sum(c) OVER (PARTITION BY prev) AS DOUBLE), 6) AS prob FROM m WHERE rank < 5",
    "lm_postprocess": "WITH x AS (SELECT item_id, string_split(text, ' ') AS x FROM benchmark), y AS (SELECT item_id, unnest(x) AS w, generate_subscripts(x, 1) - 1 AS pos FROM x), w AS (SELECT item_id, pos, unnest(['', 'Ġ', 'â', 'Ċ', 'ľ', 'Ŀ', 'Ļ', 'ĠĻ']) AS mark, w FROM y) "
    "SELECT item_id, pos, mark, CASE mark WHEN '' THEN w WHEN 'Ġ' THEN 'Ġ' || w WHEN 'â' THEN ' ' WHEN 'Ċ' THEN 'Ċ ' WHEN 'ľ' THEN '“' WHEN 'Ŀ' THEN '”' WHEN 'Ļ' THEN '''' ELSE 'Ġ''' END AS shown FROM w",
    "gltr_count_hist": hist_query({"count": 4}),
    "gltr_frac_hist": hist_query({"frac": 10}),
    "gltr_features": hist_query({"logcount": 4, "frac": 4}),
    "embed_sum": f"WITH {VOCAB}, o AS (SELECT term, row_number() OVER (ORDER BY cf DESC, term) - 1 AS r FROM v), e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, embedding AS vec FROM embeddings), "
    "z AS (SELECT term AS token, vec FROM o JOIN e ON r % (SELECT count(*) FROM embeddings) = k), "
    f"y AS (SELECT id, token, count(*) AS c FROM (SELECT id, unnest({SUMMARY_TOKENS}) AS token FROM p) GROUP BY id, token), "
    "u AS (SELECT id, i, sum(c * CAST(vec[i] AS DOUBLE)) AS x FROM (SELECT id, c, vec, unnest(generate_series(1, 64)) AS i FROM y JOIN z ON y.token = z.token) GROUP BY id, i), "
    "l AS (SELECT id, sqrt(sum(x * x)) AS l FROM u GROUP BY id) "
    "SELECT p.id, " + ", ".join(f"coalesce(round(max(CASE WHEN i = {k + 1} THEN x / l END), 6), 0.0) AS v_{k}" for k in range(64)) + " FROM p LEFT JOIN u ON p.id = u.id LEFT JOIN l ON p.id = l.id GROUP BY p.id",
    "pad_sequences": rf"WITH {PAIRS}, a AS (SELECT id, {SEQUENCE} AS w FROM p), n AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) AS k FROM (SELECT unnest(w) AS token FROM a WHERE id % 5 <> 0) GROUP BY token), "
    "q AS (SELECT id, list(k ORDER BY i) AS s FROM (SELECT id, unnest(w) AS token, generate_subscripts(w, 1) AS i FROM a) x JOIN n ON x.token = n.token GROUP BY id), "
    "j AS (SELECT p.id, coalesce(s, []) AS s FROM p LEFT JOIN q ON p.id = q.id) SELECT id, array_to_string(list_concat(list_transform(generate_series(1, greatest(70 - len(s), 0)), lambda x: 0), s[greatest(len(s) - 69, 1):]), ' ') AS sequence FROM j",
    "poly_power": f"WITH {NUMBERS} SELECT id, round(pow(word_count, 2), 6) AS word_count_2, round(pow(sent_avg, 3), 6) AS sent_avg_3 FROM x",
    "poly_fixed": f'WITH {NUMBERS} SELECT id, round(pow(word_count, 2) * sent_avg, 6) AS "word_count^2 sent_avg", round(char_count * word_count, 6) AS "char_count word_count" FROM x',
    "poly_interactions": products_query(),
    "corr_matrix": f"WITH {VECTORS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM y" for a in COLUMNS for b in COLUMNS),
    "drop_corr": f"WITH {VECTORS} SELECT id, {', '.join(f'round({c}, 6) AS {c}' for c in COLUMNS if c != 'twice')}, 1.0::DOUBLE AS same FROM y",
    "scale_standard": scaled("standard"),
    "scale_positive": scaled("positive"),
    "kfold_stratified": f"WITH {FOLDS} SELECT id, label, fold FROM f",
    "metric_accuracy": f"WITH {FOLDS} SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM f",
    "metric_f1_weighted": f"WITH {FOLDS}, c AS (SELECT DISTINCT label AS c FROM f), k AS (SELECT c, count(CASE WHEN label = c THEN 1 END) AS support, count(CASE WHEN label = c AND prediction = c THEN 1 END) AS tp, count(CASE WHEN prediction = c THEN 1 END) AS predicted FROM c, f GROUP BY c) "
    "SELECT round(sum(support * 2.0 * tp / (support + predicted)) / sum(support), 6) AS f1 FROM k",
    "cv_mean": f"WITH {FOLDS}, a AS (SELECT fold, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS a FROM f GROUP BY fold) SELECT round(avg(a), 6) AS score FROM a",
}
ORACLE_SQL = SQL
