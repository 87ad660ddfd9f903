"""Profiles of units against references: shapes, strata, gates, label joins, and single lexical rules."""

from __future__ import annotations

from ..functions.dialect import Dialect
from .findings import lexical, words_in
from .measures import DISCOURSE_STOPWORDS

LABELLED = "SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"
DOC = "SELECT doc_id, source, CAST(avg(n) AS DOUBLE) AS m, CAST(stddev_pop(n) AS DOUBLE) AS sd, count(*) AS k, CAST(max(n) AS DOUBLE) AS longest FROM sentence_lengths GROUP BY doc_id, source"
SETS = f"SELECT DISTINCT doc_id, sent, w FROM sentence_words WHERE length(w) >= 3 AND w NOT IN {words_in(DISCOURSE_STOPWORDS)}"
OVERLAP = f"SELECT x.doc_id, x.sent, CAST(x.shared AS DOUBLE) / x.size AS coverage, CAST(x.shared AS DOUBLE) / (x.size + y.size - x.shared) AS jaccard FROM (SELECT c.doc_id, c.sent, count(p.w) AS shared, count(*) AS size FROM ({SETS}) c LEFT JOIN (SELECT doc_id, sent + 1 AS sent, w FROM ({SETS}) s) p ON c.doc_id = p.doc_id AND c.sent = p.sent AND c.w = p.w GROUP BY c.doc_id, c.sent) x JOIN (SELECT doc_id, sent + 1 AS sent, count(*) AS size FROM ({SETS}) s GROUP BY doc_id, sent) y ON x.doc_id = y.doc_id AND x.sent = y.sent"
BANK = "SELECT a, b, count(DISTINCT doc_id) AS n FROM pairs GROUP BY a, b HAVING count(DISTINCT doc_id) >= 3"
SURPRISAL = "SELECT w.doc_id, w.sent, avg(-ln(c.n / t.total)) AS s FROM sentence_words w JOIN (SELECT w, CAST(count(*) AS DOUBLE) AS n FROM sentence_words GROUP BY w) c ON w.w = c.w CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS total FROM sentence_words) t GROUP BY w.doc_id, w.sent"


def bins(q: Dialect) -> str:
    """Documents by the deviation of their sentences' lengths. Spark compares squares in whole numbers, so a deviation of 4 or 8 is never taken for less; the oracle's floats are, depending on the order of rows."""
    if q.name == "spark":
        squares = "SELECT count(*) * sum(n * n) - sum(n) * sum(n) AS d, count(*) * count(*) AS kk FROM sentence_lengths GROUP BY doc_id, source"
        return f"SELECT CASE WHEN d < 16 * kk THEN 'even' WHEN d < 64 * kk THEN 'middle' ELSE 'varied' END AS bin, count(*) AS n FROM ({squares}) d GROUP BY 1"
    return f"SELECT CASE WHEN sd < 4 THEN 'even' WHEN sd < 8 THEN 'middle' ELSE 'varied' END AS bin, count(*) AS n FROM ({DOC}) d GROUP BY 1"


QUERIES = {
    "g6_paragraphs": lambda q: "SELECT doc_id, count(*) AS n_paragraphs, CAST(max(length(s)) AS BIGINT) AS longest FROM lines WHERE trim(s) <> '' GROUP BY doc_id",
    "g7_w9_section_units": lambda q: "SELECT doc_id, CAST(line AS BIGINT) AS line, CAST(max(CASE WHEN n_words BETWEEN 1 AND 3 THEN line END) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS heading FROM line_features",
    "g13_section_records": lambda q: "SELECT d.source, d.lang, count(*) AS n, CAST(sum(f.n_words) AS BIGINT) AS n_words FROM documents d JOIN line_features f ON d.doc_id = f.doc_id WHERE d.source IS NOT NULL GROUP BY d.source, d.lang",
    "f5_full_texts": lambda q: "SELECT doc_id, CAST(sum(n_words) AS BIGINT) AS n_words FROM line_features GROUP BY doc_id HAVING count(*) >= 3 AND sum(n_words) >= 1500",
    "f6_bare_ids": lambda q: f"SELECT bare, min(page_id) AS first_id, count(*) AS n FROM (SELECT page_id, replace({q.replace('url', r'v[0-9]+$', '')}, '/', '_') AS bare FROM pages) p GROUP BY bare",
    "f10_first_prose_lines": lambda q: f"SELECT doc_id, block, CAST(min(line) AS BIGINT) AS line FROM (SELECT doc_id, line, s, CAST(sum(CASE WHEN trim(s) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS block FROM lines) b WHERE {q.match('s', '[A-Za-z]')} GROUP BY doc_id, block",
    "f15_tail_floor": lambda q: f"SELECT CAST(i AS BIGINT) AS percent, CAST(ceil(round(100.0 / least(i, 100 - i), 6)) AS BIGINT) AS n FROM ({q.series(99)}) s WHERE i > 0",
    "f16_conformal_power": lambda q: f"SELECT lang, count(*) AS n, 1.0 / (count(*) + 1) > 0.05 / 3 AS skipped FROM ({LABELLED}) l GROUP BY lang",
    "x6_jaccard_coverage": lambda q: f"SELECT doc_id, CAST(sent AS BIGINT) AS sent, round(coverage, 6) AS coverage, round(jaccard, 6) AS jaccard FROM ({OVERLAP}) o",
    "w18_adjacent_overlap": lambda q: f"SELECT doc_id, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY jaccard), 6) AS median FROM ({OVERLAP}) o GROUP BY doc_id",
    "x8_log_ratio": lambda q: f"SELECT d.doc_id, round(greatest(least(ln((d.m + 0.000000001) / (r.m + 0.000000001)), 6), -6), 6) AS v FROM ({DOC}) d JOIN (SELECT source, CAST(avg(n) AS DOUBLE) AS m FROM sentence_lengths GROUP BY source) r ON d.source = r.source",
    "x11_add_one_percentile": lambda q: "SELECT d.doc_id, round((1.0 + r.upto) / (r.n + 1.0), 6) AS p FROM documents d JOIN (SELECT source, n_chars, CAST(sum(c) OVER (PARTITION BY source ORDER BY n_chars ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto, CAST(sum(c) OVER (PARTITION BY source) AS BIGINT) AS n FROM (SELECT source, n_chars, count(*) AS c FROM documents GROUP BY source, n_chars) g) r ON d.source IS NOT DISTINCT FROM r.source AND d.n_chars IS NOT DISTINCT FROM r.n_chars",
    "x15_bins": bins,
    "x18_confidence": lambda q: f"SELECT doc_id, section, rule, round(least(greatest(hits / 4.0, 0), CASE WHEN kind = 'advisory' THEN 0.5 ELSE 1.0 END), 6) AS confidence FROM (SELECT doc_id, section, rule, kind, count(*) AS hits FROM ({lexical(q)}) f GROUP BY doc_id, section, rule, kind) k",
    "x20_length_target": lambda q: "SELECT doc_id, CAST(ceil(round(sum(n_words) * 0.3, 6)) AS BIGINT) AS remove FROM line_features GROUP BY doc_id",
    "x21_o3_ranked_candidates": lambda q: f"SELECT doc_id, quality = 1 AS eligible, round(0.6 * quality + 0.3 * (1 - toxic) + 0.1 * least(n_chars / 4000.0, 1), 6) AS combined FROM ({LABELLED}) l ORDER BY eligible DESC, combined DESC, doc_id",
    "a25_w8_information_density": lambda q: f"SELECT doc_id, round(avg(s), 4) AS mean, round(stddev_pop(s), 4) AS sd, round(avg(abs(s - before_)), 4) AS delta FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY sent) AS before_ FROM ({SURPRISAL}) u) v GROUP BY doc_id",
    "a32_repeated_splits": lambda q: f"SELECT lang, count(*) AS splits, round(avg(rate), 6) AS mean, round(stddev_pop(rate), 6) AS sd, round(min(rate), 6) AS least_, round(max(rate), 6) AS most FROM (SELECT lang, substr({q.md5('doc_id')}, 1, 1) AS split, avg(toxic) AS rate FROM ({LABELLED}) l GROUP BY 1, 2) r GROUP BY lang",
    "a34_gate_transfer": lambda q: f"SELECT source, round(avg(CASE WHEN m > 30 OR sd > 12 OR longest > 60 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(1 - power(0.9, 3), 6) AS expected FROM ({DOC}) d GROUP BY source",
    "a36_precision": lambda q: f"SELECT source, lang, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(avg(quality), 6) END AS precision_ FROM ({LABELLED}) l GROUP BY source, lang",
    "a39_section_word_counts": lambda q: f"SELECT conv_id, role, count(*) AS turns, CAST(sum({q.count('text', r'[^\x20\x09-\x0D]+')}) AS BIGINT) AS n_words FROM conversations GROUP BY conv_id, role",
    "a47_normalized_scores": lambda q: f"SELECT d.doc_id, round((d.m - CASE WHEN r.k >= 5 THEN r.m ELSE t.m END) / nullif(CASE WHEN r.k >= 5 THEN r.sd ELSE t.sd END, 0), 6) AS z FROM ({DOC}) d JOIN (SELECT source, count(*) AS k, avg(m) AS m, stddev_pop(m) AS sd FROM ({DOC}) x GROUP BY source) r ON d.source = r.source CROSS JOIN (SELECT avg(m) AS m, stddev_pop(m) AS sd FROM ({DOC}) y) t",
    "a48_split_centroid_cosine": lambda q: f"SELECT vec_id, round(sum(e.v * c.v) / sqrt(sum(e.v * e.v)) / sqrt(sum(c.v * c.v)), 4) AS cosine FROM ({q.vec('dim', 'v')}) e JOIN (SELECT label AS l, dim AS d, avg(v) AS v FROM ({q.vec('dim', 'v')}) z WHERE vec_id % 5 <> 0 GROUP BY label, dim) c ON e.label = c.l AND e.dim = c.d GROUP BY vec_id",
    "w12_arc": lambda q: "SELECT doc_id, max_by(n, sent) - min_by(n, sent) AS arc FROM sentence_lengths GROUP BY doc_id",
    "j3_pair_lookup": lambda q: f"SELECT p.doc_id, count(*) AS n, CAST(sum(CASE WHEN coalesce(d.n, 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS unknown FROM (SELECT DISTINCT doc_id, a, b FROM pairs) p LEFT JOIN ({BANK}) d ON p.a = d.a AND p.b = d.b GROUP BY p.doc_id",
    "j16_labels_of_rows": lambda q: "SELECT d.lang, count(*) AS n, count(l.doc_id) AS labelled, count(l.quality) AS judged FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang",
    "j17_exclude_known": lambda q: "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text)",
    "j21_stratum_else_pooled": lambda q: f"SELECT d.doc_id, round(coalesce(s.rate, p.rate), 6) AS rate FROM documents d LEFT JOIN (SELECT source, lang, avg(toxic) AS rate FROM ({LABELLED}) l GROUP BY source, lang HAVING count(*) >= 30) s ON d.source = s.source AND d.lang = s.lang CROSS JOIN (SELECT avg(toxic) AS rate FROM ({LABELLED}) m) p",
    "j22_class_reference": lambda q: "SELECT d.doc_id, d.n_chars > r.median AS above FROM documents d JOIN (SELECT lang, percentile_cont(0.5) WITHIN GROUP (ORDER BY n_chars) AS median FROM documents GROUP BY lang) r ON d.lang = r.lang",
    "u5_overlay": lambda q: "SELECT t, CAST(sum(n) AS BIGINT) AS n FROM (SELECT t, n FROM df UNION ALL SELECT t, count(*) AS n FROM terms WHERE source = 'src0' GROUP BY t) u GROUP BY t",
}
