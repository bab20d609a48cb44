"""Queries of the training-data operators and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from .bpe import op4_byte_bpe
from .conversation_repair import op13_conversation_repair
from .decontaminate import op1_decontaminate
from .embedding_dedup import op5_embeddings
from .hard_negatives import op12_hard_negatives
from .line_dedup import op8_line_dedup
from .near_dedup import op7_minhash
from .pii import op11_pii
from .quality import op3_quality
from .sharding import op9_sharding
from .token_counts import op10_token_counts
from .toxicity import op2_toxicity
from .url_rules import op6_url_rules


#: Links of equal labels by cosine, and the smallest id reachable.
OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM comp
"""

#: Exact Jaccard similarity over shared shingles, and the smallest id reachable.
OP7 = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), sized AS (SELECT doc_id, len(s) AS n, s FROM sets
), items AS (SELECT doc_id, n, unnest(s) AS x FROM sized
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
  FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id
), half AS (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (n + m - c)
), links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half
), reach(a, b) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, n::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN comp USING (doc_id)
"""


#: All anchors against all rows; integer inner products are exact in doubles here.
OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), positives AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scores n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
)
SELECT * FROM ranked WHERE rank <= 5
"""

#: Edits turn by turn, all conversations in step: the cheapest way into each state, with its audit and its lines. crc32 is taken bit by bit.
OP13 = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), keyed AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), lambda i: ord(k[i])::BIGINT)), lambda acc, b:
    list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 20 AS lot
  FROM given
), damaged AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role,
    CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN lot = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM keyed WHERE lot <> 0
), placed AS (
  SELECT *, row_number() OVER o AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, left(role, 1) AS ini,
    lag(left(role, 1)) OVER o || left(role, 1) AS two, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 32), left(text, 64), sha256(role || chr(0) || text), copy)
), faults AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed
), fills(state, role, after) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)
), keeps(state, ini, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserts(state, after, cost, audit, lines) AS (
  SELECT state, state, 0, '', []::VARCHAR[] FROM fills UNION ALL SELECT state, after, 2, 'I', [role || ':'] FROM fills
  UNION ALL SELECT a.state, b.after, 4, 'II', [a.role || ':', b.role || ':'] FROM fills a JOIN fills b ON a.after = b.state
), steps AS (
  SELECT f.conv_id, f.pos, e.state, e.after, e.cost + CASE WHEN fault = 'truncated' AND e.edit <> 'D' THEN 1 ELSE 0 END AS cost, e.edit,
    CASE e.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'R' THEN [e.role || ':' || f.text] ELSE [f.role || ':' || f.text] END AS lines
  FROM faults f JOIN (
    SELECT state, state AS after, 3 AS cost, 'D' AS edit, NULL AS role, NULL AS ini FROM fills
    UNION ALL SELECT state, after, 2, 'R', role, NULL FROM fills UNION ALL SELECT state, after, 0, 'K', NULL, ini FROM keeps
  ) e ON (e.ini IS NULL OR e.ini = f.ini) AND (e.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
), ways(conv_id, pos, state, best) AS (
  SELECT c.conv_id, 0::BIGINT, i.after, {'cost': i.cost, 'audit': i.audit, 'lines': i.lines} FROM (SELECT DISTINCT conv_id FROM faults) c, inserts i WHERE i.state = 0 AND i.cost = (SELECT min(cost) FROM inserts j WHERE j.state = 0 AND j.after = i.after)
  UNION ALL
  SELECT conv_id, pos, state, min({'cost': cost, 'audit': audit, 'lines': lines}) FROM (
    SELECT w.conv_id, s.pos, i.after AS state, w.best.cost + s.cost + i.cost AS cost, w.best.audit || s.edit || i.audit AS audit, list_concat(w.best.lines, list_concat(s.lines, i.lines)) AS lines
    FROM ways w JOIN steps s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND s.pos = w.pos + 1 AND s.state = w.state JOIN inserts i ON i.state = s.after
  ) GROUP BY conv_id, pos, state
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM faults GROUP BY conv_id
), ends AS (
  SELECT w.conv_id, min(w.best) AS e FROM ways w JOIN counts c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.pos = c.n WHERE w.state IN (0, 3) GROUP BY w.conv_id
)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.cost, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN counts c ON g.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ends ON g.conv_id IS NOT DISTINCT FROM ends.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": op1_decontaminate,
        "op2_toxicity": op2_toxicity,
        "op3_quality": op3_quality,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_embeddings": op5_embeddings,
        "op6_url_rules": op6_url_rules,
        "op7_minhash": op7_minhash,
        "op8_line_dedup": op8_line_dedup,
        "op9_sharding": op9_sharding,
        "op10_token_counts": op10_token_counts,
        "op11_pii": op11_pii,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_conversation_repair": op13_conversation_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_embeddings": OP5,
        "op7_minhash": OP7,
        "op12_hard_negatives": OP12,
        "op13_conversation_repair": OP13,
        **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
    }
