"""Cutting text into units and projecting it: one query an operator, for either dialect."""

from __future__ import annotations

#: Word shapes and the prose limits.
REGISTER_WORD = r"[A-Za-z][A-Za-z\x27-]{2,}"
DISCOURSE_WORD = r"[A-Za-z][A-Za-z-]+"
MIN_WORDS, MAX_WORDS, MIN_ALPHA, MAX_DIGITS = 30, 400, 0.6, 0.15

QUERIES = {
    "g1_sentences": lambda q: "SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM sentences GROUP BY doc_id",
    "g2_words": lambda q: "SELECT doc_id, count(*) AS n_words, count(DISTINCT lower(w)) AS n_distinct FROM words GROUP BY doc_id",
    "g3_register_words": lambda q: f"SELECT doc_id, {q.count('text', REGISTER_WORD)} AS n FROM documents",
    "g4_discourse_words": lambda q: f"SELECT doc_id, {q.count('text', DISCOURSE_WORD)} AS n FROM documents",
    "g5_paragraph_line_ranges": lambda q: "SELECT doc_id, block, CAST(min(line) + 1 AS BIGINT) AS first_line, CAST(max(line) + 1 AS BIGINT) AS last_line FROM (SELECT doc_id, line, s, CAST(sum(CASE WHEN trim(s) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS block FROM lines) b WHERE trim(s) <> '' GROUP BY doc_id, block",
    "g14_bank_admission": lambda q: f"SELECT doc_id, line, n_words FROM (SELECT doc_id, CAST(line AS BIGINT) AS line, n_words FROM line_features) f WHERE n_words BETWEEN {MIN_WORDS} AND {MAX_WORDS}",
    "p12_normal_terms": lambda q: f"SELECT term, count(*) AS n FROM (SELECT {q.replace(q.replace('lower(w)', r'\x27s$', ''), r'^[\x27-]+|[\x27-]+$', '')} AS term FROM words) t WHERE term <> '' GROUP BY term",
    "f1_is_prose": lambda q: f"SELECT doc_id, n_words BETWEEN {MIN_WORDS} AND {MAX_WORDS} AND alpha >= {MIN_ALPHA} * chars AND digits <= {MAX_DIGITS} * chars AS is_prose FROM (SELECT doc_id, length(text) AS chars, {q.count('text', r'[^\x20\x09-\x0D]+')} AS n_words, {q.count('text', r'\p{L}')} AS alpha, {q.count('text', r'[0-9]')} AS digits FROM documents) d",
    "f20_source_family": lambda q: f"SELECT {q.replace('source', r'[0-9]+$', '')} AS family, count(*) AS n FROM documents GROUP BY 1",
    "x19_stable_ids": lambda q: f"SELECT doc_id, substr({q.md5("concat(coalesce(source, ''), '|', coalesce(lang, ''), '|', doc_id)")}, 1, 16) AS finding_id FROM documents",
}
