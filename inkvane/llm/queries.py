"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from inkvane.llm import chat, mixing, pii
from inkvane.llm.chat import op3_chat
from inkvane.llm.decontaminate import op5_decontaminate
from inkvane.llm.jaccard import op8_jaccard_join
from inkvane.llm.mixing import op1_mixing
from inkvane.llm.pii import op4_pii
from inkvane.llm.quality import op9_quality
from inkvane.llm.substrings import op7_substring_dedup
from inkvane.llm.urls import op6_url_filter
from inkvane.llm.vectors import op10_embedding_dedup
from inkvane.llm.wavelet import op2_token_ids

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_token_ids": op2_token_ids,
    "op3_chat": op3_chat,
    "op4_pii": op4_pii,
    "op5_decontaminate": op5_decontaminate,
    "op6_url_filter": op6_url_filter,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_quality": op9_quality,
    "op10_embedding_dedup": op10_embedding_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op4_pii": pii.ORACLE,
    "op3_chat": chat.ORACLE,
    "op7_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13),
        g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS k FROM p),
        m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM g) WHERE least < doc_id),
        c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS j FROM m),
        a AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
        r AS (SELECT a.doc_id, count(c.j) AS gone, string_agg(CASE WHEN c.j IS NULL THEN word END, ' ' ORDER BY a.j) AS kept
              FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.j = c.j GROUP BY a.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN r ON d.doc_id = r.doc_id""",
    "op10_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
              WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
        c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least AS component_id, vec_id = least AS kept
        FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a""",
    "op8_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS k
              FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        p AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE common * 9 >= 4 * (x.n + y.n)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
        g AS (SELECT a, min(b) AS least FROM r GROUP BY a),
        l AS (SELECT a, count(*) AS n FROM p GROUP BY a)
        SELECT doc_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links, least AS component_id, doc_id = least AS kept
        FROM documents JOIN g ON doc_id = g.a LEFT JOIN l ON doc_id = l.a""",
}
