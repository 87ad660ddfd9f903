"""Calibration and evaluation aggregates."""

from __future__ import annotations

FEATURES = "SELECT doc_id, source, avg(n) AS mean_len, stddev_pop(n) AS sd_len, count(*) AS n_sent FROM sentence_lengths GROUP BY doc_id, source"
LABELLED = "SELECT d.doc_id, d.source, d.lang, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id"

QUERIES = {
    "a1_sentence_stats": lambda q: "SELECT source, count(*) AS n, round(avg(n), 6) AS mean, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY n), 6) AS median, round(stddev_pop(n), 6) AS sd, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY n), 6) AS p25, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY n), 6) AS p95 FROM sentence_lengths GROUP BY source",
    "a2_dash_rate": lambda q: f"SELECT source, round(1000.0 * sum({q.count('text', '—|---')}) / nullif(sum({q.count('text', r'[^\x20\x09-\x0D]+')}), 0), 6) AS per_1000 FROM corpus GROUP BY source",
    "a9_interpolated_quantile": lambda q: "SELECT source, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY n_words), 6) AS p90 FROM line_features GROUP BY source",
    "x1_length_cv": lambda q: "SELECT doc_id, round(CASE WHEN avg(n) = 0 THEN 0 ELSE stddev_pop(n) / avg(n) END, 6) AS cv FROM sentence_lengths GROUP BY doc_id HAVING count(*) >= 5",
    "d27_burstiness": lambda q: f"SELECT f.doc_id, round(f.sd_len / f.mean_len / nullif(s.cv, 0), 6) AS ratio FROM ({FEATURES}) f JOIN (SELECT source, stddev_pop(n) / avg(n) AS cv FROM sentence_lengths GROUP BY source) s ON f.source = s.source WHERE f.n_sent >= 5 AND f.sd_len / f.mean_len / nullif(s.cv, 0) < 0.6",
    "a14_eta_squared": lambda q: "SELECT round((between_ - total * total / n) / nullif(squares - total * total / n, 0), 6) AS eta2 FROM (SELECT sum(s * s / c) AS between_, sum(s) AS total, sum(ss) AS squares, sum(c) AS n FROM (SELECT source, CAST(sum(n_chars) AS DOUBLE) AS s, CAST(sum(n_chars * n_chars) AS DOUBLE) AS ss, CAST(count(*) AS DOUBLE) AS c FROM documents GROUP BY source) g) t",
    "a16_covariance": lambda q: f"SELECT round(avg(mean_len), 5) AS m1, round(avg(sd_len), 5) AS m2, round(covar_samp(mean_len, sd_len), 4) AS c12, round(covar_samp(mean_len, mean_len), 4) AS c11, round(covar_samp(sd_len, sd_len), 4) AS c22 FROM ({FEATURES}) f",
    "a26_rollup": lambda q: "SELECT source, lang, count(*) AS n, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 4) AS sd FROM documents GROUP BY ROLLUP (source, lang)",
    "a28_binary_metrics": lambda q: f"SELECT tp, fp, fn, tn, round(tp / nullif(tp + fn, 0), 6) AS tpr, round(fp / nullif(fp + tn, 0), 6) AS fpr, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((CAST(tp AS DOUBLE) / nullif(tp + fn, 0) + CAST(tn AS DOUBLE) / nullif(fp + tn, 0)) / 2, 6) AS bacc FROM (SELECT CAST(sum(CASE WHEN n_chars > 1500 AND quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN n_chars > 1500 AND quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN n_chars <= 1500 AND quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN n_chars <= 1500 AND quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM ({LABELLED}) l) c",
    "a29_breakdown": lambda q: f"SELECT source, lang, quality, count(*) AS n, round(avg(toxic), 6) AS rate FROM ({LABELLED}) l GROUP BY GROUPING SETS ((source), (lang), (quality), (lang, quality), ())",
    "a30_w14_rank_auc": lambda q: f"SELECT round((sum(p * mid) - max(pos) * (max(pos) + 1) / 2.0) / nullif(max(pos) * (max(n) - max(pos)), 0), 6) AS auc FROM (SELECT p, CAST(sum(c) OVER (ORDER BY n_chars ROWS UNBOUNDED PRECEDING) AS DOUBLE) - c + (c + 1) / 2.0 AS mid, CAST(sum(p) OVER () AS DOUBLE) AS pos, CAST(sum(c) OVER () AS DOUBLE) AS n FROM (SELECT n_chars, CAST(count(*) AS DOUBLE) AS c, CAST(sum(quality) AS DOUBLE) AS p FROM ({LABELLED}) l GROUP BY n_chars) g) r",
    "a33_population_rates": lambda q: f"SELECT source, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(avg(toxic), 6) END AS rate, CASE WHEN count(*) >= 20 THEN 'measured' ELSE 'unmeasured' END AS status FROM ({LABELLED}) l GROUP BY source",
    "a35_j13_leakage": lambda q: "SELECT o.source, count(*) AS n_terms, CAST(sum(CASE WHEN l.n = o.n THEN 1 ELSE 0 END) AS BIGINT) AS own_only, round(avg(CAST(l.n AS DOUBLE) / d.n), 6) AS with_own, round(avg(CAST(l.n - o.n AS DOUBLE) / nullif(d.n - s.n, 0)), 6) AS without_own FROM (SELECT source, t, count(*) AS n FROM terms GROUP BY source, t) o FULL OUTER JOIN (SELECT t, count(*) AS n FROM terms GROUP BY t) l ON o.t = l.t JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) s ON o.source = s.source CROSS JOIN (SELECT count(*) AS n FROM documents) d GROUP BY o.source",
    "a37_kappa": lambda q: f"SELECT round((po - pe) / nullif(1 - pe, 0), 6) AS kappa FROM (SELECT avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, avg(CAST(a AS DOUBLE)) * avg(CAST(b AS DOUBLE)) + (1 - avg(CAST(a AS DOUBLE))) * (1 - avg(CAST(b AS DOUBLE))) AS pe FROM (SELECT quality AS a, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS b FROM ({LABELLED}) l) p) k",
    "a45_x16_log_odds": lambda q: "SELECT source, t, log_odds FROM (SELECT source, t, log_odds, row_number() OVER (PARTITION BY source ORDER BY log_odds DESC, t) AS place FROM (SELECT c.source, c.t, round(ln((c.x + 0.5) / (s.n - c.x + 0.5)) - ln((w.n - c.x + 0.5) / (d.n - s.n - w.n + c.x + 0.5)), 6) AS log_odds FROM (SELECT source, t, count(*) AS x FROM terms GROUP BY source, t) c JOIN (SELECT t, count(*) AS n FROM terms GROUP BY t HAVING count(DISTINCT source) >= 3) w ON c.t = w.t JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) s ON c.source = s.source CROSS JOIN (SELECT count(*) AS n FROM documents) d) o WHERE log_odds >= 1.0) r WHERE place <= 256",
    "a46_centroid": lambda q: f"SELECT label, CAST(dim AS BIGINT) AS dim, round(avg(v), 5) AS v FROM ({q.vec('dim', 'v')}) e GROUP BY label, dim",
    "a49_fingerprints": lambda q: f"SELECT source, count(*) AS n, {q.bag_hash('text')} AS fingerprint FROM documents GROUP BY source",
    "x14_length_strata": lambda q: "SELECT CASE WHEN n_sentences <= 8 THEN 'short' WHEN n_sentences <= 30 THEN 'middle' ELSE 'long' END AS stratum, count(*) AS n FROM (SELECT doc_id, count(*) AS n_sentences FROM sentences GROUP BY doc_id) s GROUP BY 1",
}
