"""Ordered computations, joins, ranking and set operations."""

from __future__ import annotations

SPANS = "SELECT DISTINCT doc_id, CAST(line AS BIGINT) AS a, CAST(line AS BIGINT) + 1 AS b FROM line_features WHERE n_digits > 0"
LINE_WORDS = "SELECT DISTINCT l.doc_id, l.line, w.w FROM (SELECT doc_id, line FROM line_features WHERE n_words >= 10) l JOIN (SELECT doc_id, sent AS line, w FROM sentence_words) w ON l.doc_id = w.doc_id AND l.line = w.line"
#: Ids in blocks, so a running count needs one row a block in one place.
BLOCK = "CAST(floor(doc_id / 4096.0) AS BIGINT)"
BAGS = "SELECT doc_id, lower(w) AS t, count(*) AS n FROM words GROUP BY doc_id, lower(w)"
LENGTHS = "SELECT d.doc_id, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id"

QUERIES = {
    "w2_longest_run": lambda q: "SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, block, count(*) AS c FROM (SELECT doc_id, n, sent - row_number() OVER (PARTITION BY doc_id ORDER BY sent) AS block FROM sentence_lengths WHERE n <= 8) r GROUP BY doc_id, block) b GROUP BY doc_id",
    "w3_equal_run": lambda q: "SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, block, count(*) AS c FROM (SELECT doc_id, CAST(sum(changed) OVER (PARTITION BY doc_id ORDER BY sent) AS BIGINT) AS block FROM (SELECT doc_id, sent, CASE WHEN n = lag(n) OVER (PARTITION BY doc_id ORDER BY sent) THEN 0 ELSE 1 END AS changed FROM sentence_lengths) x) y GROUP BY doc_id, block) z GROUP BY doc_id",
    "w4_occurrence_index": lambda q: "SELECT doc_id, t, count(*) AS beyond_first FROM (SELECT doc_id, lower(w) AS t, row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY pos) AS k FROM words) o WHERE k > 1 GROUP BY doc_id, t",
    "w5_first_use": lambda q: "SELECT doc_id, t, CAST(first_pos AS BIGINT) AS first_pos, uses FROM (SELECT doc_id, lower(w) AS t, min(pos) AS first_pos, count(*) AS uses FROM words GROUP BY doc_id, lower(w)) f WHERE uses >= 5",
    "w6_seen_before": lambda q: "SELECT f.doc_id, f.sent, count(*) AS new_words FROM (SELECT doc_id, w, CAST(min(sent) AS BIGINT) AS sent FROM sentence_words GROUP BY doc_id, w) f GROUP BY f.doc_id, f.sent",
    "w10_section_ends": lambda q: "SELECT doc_id, CAST(line AS BIGINT) AS first_line, CAST(lead(line) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS BIGINT) AS last_line FROM line_features WHERE n_words <= 3 AND chars > 0",
    "w11_positions": lambda q: "SELECT doc_id, CAST(sent AS BIGINT) AS sent, CASE WHEN k = 1 THEN 'first' WHEN k = c THEN 'last' ELSE 'middle' END AS place FROM (SELECT doc_id, sent, row_number() OVER (PARTITION BY doc_id ORDER BY sent) AS k, count(*) OVER (PARTITION BY doc_id) AS c FROM sentence_lengths) s",
    "w13_triage": lambda q: "SELECT doc_id, CAST(sent AS BIGINT) AS sent, n FROM (SELECT doc_id, sent, n, row_number() OVER (PARTITION BY doc_id ORDER BY n, sent) AS k FROM sentence_lengths) s WHERE k <= 3",
    "w15_systematic_sample": lambda q: f"SELECT doc_id, k FROM (SELECT d.doc_id, b.before_ + row_number() OVER (PARTITION BY d.block ORDER BY d.doc_id) - 1 AS k, t.n FROM (SELECT doc_id, {BLOCK} AS block FROM documents) d JOIN (SELECT block, CAST(sum(c) OVER (ORDER BY block ROWS UNBOUNDED PRECEDING) AS BIGINT) - c AS before_ FROM (SELECT {BLOCK} AS block, count(*) AS c FROM documents GROUP BY 1) g) b ON d.block = b.block CROSS JOIN (SELECT count(*) AS n FROM documents) t) s WHERE k = CAST(floor(CAST(floor(k * 50.0 / n) AS BIGINT) * n / 50.0) AS BIGINT)",
    "w16_spread_sample": lambda q: f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {q.md5('concat(20260713, doc_id)')}) AS k FROM documents) d WHERE k <= 4",
    "w17_last_definition": lambda q: "SELECT lower(w) AS t, max(pos) AS last_pos FROM (SELECT w, CAST(pos AS BIGINT) AS pos FROM words) x GROUP BY lower(w)",
    "j1_term_frequency": lambda q: "SELECT c.doc_id, count(*) AS n_terms, CAST(sum(CASE WHEN coalesce(d.n, 0) < 3 THEN 1 ELSE 0 END) AS BIGINT) AS rare FROM (SELECT DISTINCT doc_id, lower(w) AS t FROM words) c LEFT JOIN df d ON c.t = d.t GROUP BY c.doc_id",
    "j2_judged_pairs": lambda q: "SELECT p.doc_id, count(*) AS judged FROM pairs p WHERE EXISTS (SELECT 1 FROM df d WHERE d.t = p.a AND d.n >= 10) AND EXISTS (SELECT 1 FROM df d WHERE d.t = p.b AND d.n >= 10) GROUP BY p.doc_id",
    "j4_lines_in_sections": lambda q: f"SELECT l.doc_id, s.a, count(*) AS n_lines FROM line_features l JOIN ({SPANS}) s ON l.doc_id = s.doc_id AND l.line BETWEEN s.a AND s.b GROUP BY l.doc_id, s.a",
    "j5_lines_outside_spans": lambda q: f"SELECT l.doc_id, count(*) AS n_lines FROM line_features l WHERE NOT EXISTS (SELECT 1 FROM ({SPANS}) s WHERE s.doc_id = l.doc_id AND s.a <= l.line AND l.line <= s.b) GROUP BY l.doc_id",
    "j11_anti_join": lambda q: "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "j12_registry": lambda q: "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unmeasured' WHEN l.quality = 0 THEN 'integrity_blocker' ELSE 'measured' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "j18_bag_difference": lambda q: f"SELECT a.doc_id, a.t, a.n - coalesce(b.n, 0) AS more FROM ({BAGS}) a LEFT JOIN (SELECT doc_id + 1 AS doc_id, t, n FROM ({BAGS}) x) b ON a.doc_id = b.doc_id AND a.t = b.t WHERE a.n > coalesce(b.n, 0)",
    "j19_top_k": lambda q: f"SELECT query_id, vec_id, score FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM (SELECT a.vec_id AS query_id, e.vec_id, round({q.dot('a.embedding', 'e.embedding')} / nullif(sqrt({q.dot('a.embedding', 'a.embedding')} * {q.dot('e.embedding', 'e.embedding')}), 0), 4) AS score FROM embeddings e CROSS JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) a) s) r WHERE k <= 10",
    "o6_top_words": lambda q: "SELECT t, n FROM (SELECT lower(w) AS t, count(*) AS n FROM words GROUP BY lower(w)) c ORDER BY n DESC, t LIMIT 50",
    "o7_lead_feature": lambda q: "SELECT doc_id, CASE WHEN c >= g AND c >= w THEN 'commas' WHEN g >= w THEN 'digits' ELSE 'words' END AS lead FROM (SELECT doc_id, sum(n_commas) * 10 AS c, sum(n_digits) * 10 AS g, sum(n_words) AS w FROM line_features GROUP BY doc_id) f",
    "u2_shared_terms": lambda q: "SELECT source, count(*) AS shared FROM (SELECT source, t FROM terms INTERSECT SELECT source, t FROM (SELECT t, count(DISTINCT source) AS k FROM terms GROUP BY t HAVING count(DISTINCT source) >= 2) w JOIN (SELECT DISTINCT source FROM documents) s ON true) x GROUP BY source",
    "u3_own_terms": lambda q: f"SELECT doc_id, w, count(*) AS more FROM (SELECT d.doc_id, lower(w) AS w FROM words d EXCEPT ALL SELECT p.doc_id + 1, lower(w) FROM words p) x GROUP BY doc_id, w",
    "u4_first_of_each": lambda q: f"SELECT {q.md5('text')} AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY {q.md5('text')}",
    "x5_cosine_neighbours": lambda q: f"SELECT a.vec_id, round(sum(a.v * b.v) / nullif(sqrt(sum(a.v * a.v)), 0) / nullif(sqrt(sum(b.v * b.v)), 0), 4) AS cosine FROM ({q.vec('dim', 'v')}) a JOIN (SELECT vec_id - 1 AS p, dim AS d, v FROM ({q.vec('dim', 'v')}) z) b ON a.vec_id = b.p AND a.dim = b.d GROUP BY a.vec_id",
    "x10_conformal_p": lambda q: f"SELECT s.doc_id, round((1.0 + t.total - r.below) / (1.0 + t.total), 6) AS p FROM ({LENGTHS}) s JOIN (SELECT n_chars, CAST(sum(c) OVER (ORDER BY n_chars ROWS UNBOUNDED PRECEDING) AS BIGINT) - c AS below FROM (SELECT n_chars, count(*) AS c FROM ({LENGTHS}) x GROUP BY n_chars) g) r ON s.n_chars IS NOT DISTINCT FROM r.n_chars CROSS JOIN (SELECT count(*) AS total FROM labels) t",
}
