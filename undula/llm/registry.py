"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from undula.llm.decontaminate import op7_decontaminate
from undula.llm.hard_negatives import op13_hard_negatives
from undula.llm.html_text import op9_html_text
from undula.llm.maxent_lm import op11_maxent_lm
from undula.llm.packing import op10_pack
from undula.llm.pii import op4_pii
from undula.llm.prefix_trie import op12_prefix_trie
from undula.llm.quality import op1_quality
from undula.llm.simhash import op8_simhash
from undula.llm.suffix_dedup import op6_suffix_dedup
from undula.llm.token_count import op5_token_count
from undula.llm.toxicity import op2_toxicity
from undula.llm.vector_dedup import op3_vector_dedup


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality, op2_toxicity, op3_vector_dedup, op4_pii, op5_token_count, op6_suffix_dedup, op7_decontaminate, op8_simhash, op9_html_text, op10_pack, op11_maxent_lm, op12_prefix_trie, op13_hard_negatives)}


_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98::DOUBLE),
 r(a, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.a, r.c FROM r JOIN l ON l.b = r.a),
 k AS (SELECT a, min(c) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(k.c, e.vec_id) AS component_id, coalesce(k.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN k ON k.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""

_TRIE = """
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
   sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS name FROM conversations WHERE conv_id IS NOT NULL),
 p AS (SELECT conv_id, name, length(text) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name) AS pos FROM o),
 c AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
   xor(list_reduce([ord(x) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')],
     lambda a, x: list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(a, CAST(x AS BIGINT))), 4294967295::BIGINT), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM p)),
 k AS (SELECT c.*, (SELECT count(*) FROM p WHERE p.conv_id = c.base AND pos <= c.h) AS taken FROM c),
 r AS (SELECT k.conv_id, p.pos AS depth, p.name, p.chars FROM k JOIN p ON p.conv_id = k.base AND p.pos <= k.h
   UNION ALL SELECT k.conv_id, p.pos - k.h + k.taken, p.name, p.chars FROM k JOIN p ON p.conv_id = k.conv_id AND p.pos > k.h
   UNION ALL SELECT conv_id, 0, '', 0 FROM k),
 s AS (SELECT *, sha256(string_agg(name, ',') OVER w) AS node, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
 t AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM s),
 n AS (SELECT node, min(parent) AS parent, min(conv_id) AS conv_id, min(depth) AS depth, min(chars) AS chars, count(*) AS n_convs,
   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM t GROUP BY node),
 q AS (SELECT n.*, (SELECT count(*) FROM n m WHERE m.parent = n.node) AS n_children FROM n),
 a AS (SELECT DISTINCT x.node AS top, y.node AS below FROM t x JOIN t y ON x.conv_id = y.conv_id AND x.depth <= y.depth),
 u AS (SELECT a.top, count(*) FILTER (q.n_children = 0) AS n_leaves, sum((q.n_convs - 1) * q.chars) AS saved_tokens FROM a JOIN q ON q.node = a.below GROUP BY a.top)
SELECT q.conv_id, q.depth, f.conv_id AS parent_conv_id, q.n_convs, q.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, q.ends_sha256
FROM q JOIN u ON u.top = q.node LEFT JOIN n f ON f.node = q.parent
"""

_NEGATIVES = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings
   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.q) = len(b.q)),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
 n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
   FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    """Vectors and conversations only: fitted models, tokenizers, XXH64 and page parsing have no SQL form; tests hold those against brute force."""
    return {"op3_vector_dedup": _VECTORS, "op12_prefix_trie": _TRIE, "op13_hard_negatives": _NEGATIVES}
