"""DuckDB SQL for the results that SQL can express, written apart from the operators: brute force over whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50) x),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT win.doc_id, i, unnest(range(50)) AS j FROM win JOIN least USING (k) WHERE m < win.doc_id) c),
kept AS (SELECT doc_id, count(*) AS n, string_agg(v, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS v FROM d) x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP10 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS k FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100) x),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
bad AS (SELECT win.doc_id, i FROM win JOIN least USING (k) WHERE m < win.doc_id),
runs AS (SELECT doc_id, i, sum(CASE WHEN i - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM bad) b),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, g),
cut AS (SELECT d.doc_id, h, a, b, coalesce(lag(b) OVER (PARTITION BY d.doc_id ORDER BY a), 0) AS from_ FROM d JOIN spans USING (doc_id)),
kept AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS x FROM cut GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(x, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP7 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, w[i] || ' ' || w[i + 1] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d) x UNION ALL SELECT doc_id, w[1] FROM d WHERE len(w) = 1) y),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id) p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * c >= 80 * (u.n + v.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, m.c = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id) m USING (doc_id)
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
lines AS (SELECT doc_id, count(*) - count(DISTINCT v) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS v FROM d) x WHERE regexp_matches(v, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8) x),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest(range(8)) AS p FROM win JOIN (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1) r USING (doc_id, k)) c GROUP BY doc_id),
m AS (SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
hosts AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed) AS DOUBLE) AS x FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT (sum(x) + 0.5) / (sum(n) + 1) AS mean, greatest(sum(x * x / n) / sum(n) - (sum(x) / sum(n)) ** 2, 0) AS raw, sum(n) / count(*) AS typical FROM hosts),
q AS (SELECT mean, mean * (1 - mean) AS spread, greatest((raw - mean * (1 - mean) / typical) / (1 - 1 / greatest(typical, 2)), mean * (1 - mean) / 1000) AS var FROM p),
v AS (SELECT source, (x + mean * greatest(spread / var - 1, 1)) / (n + greatest(spread / var - 1, 1)) AS rate, greatest(0.5, least(0.9, mean + 2 * sqrt(var))) AS most FROM hosts CROSS JOIN q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rate >= most, false) AS kept, round(rate, 9) AS host_rate FROM f LEFT JOIN v USING (source)
"""


def spans(kind: int, pattern: str) -> str:
    """doc_id, kind, start, hit and its groups' text of the leftmost non-overlapping matches: starts from the lengths of what stands between."""
    return f"SELECT doc_id, {kind} AS kind, hits[i] AS hit, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM d) x) y"


def digest(kinds: tuple[str, ...], found: str) -> str:
    names = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds))
    counts = ", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in kinds)
    sums = ", ".join(f"count(*) FILTER (WHERE kind = {i}) AS n_{k}" for i, k in enumerate(kinds))
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ({found}), per AS (SELECT doc_id, {sums}, string_agg((CASE kind {names} END) || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + length(hit) AS BIGINT) AS VARCHAR), ',' ORDER BY a, kind) AS t FROM found GROUP BY doc_id) SELECT d.doc_id, {counts}, sha256(coalesce(t, '')) AS base_sha256 FROM d LEFT JOIN per USING (doc_id)"


LUHN = "list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN (length(g) - i) % 2 = 0 THEN CAST(substr(g, i, 1) AS INT) ELSE 2 * CAST(substr(g, i, 1) AS INT) - CASE WHEN CAST(substr(g, i, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
PII = digest(
    ("email", "ip", "card", "phone"),
    f"SELECT doc_id, kind, hit, a FROM ({spans(0, r'[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')}) e "
    f"UNION ALL SELECT doc_id, kind, hit, a FROM ({spans(1, r'[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)')}) i WHERE len(list_filter(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) > 3 OR CAST('0' || right(ltrim(x, '0'), 3) AS INT) > 255)) = 0 "
    f"UNION ALL SELECT doc_id, kind, hit, a FROM (SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS g FROM ({spans(2, r'[0-9](?:[\x20-]?[0-9])+')}) c) l WHERE length(g) BETWEEN 12 AND 19 AND {LUHN} "
    f"UNION ALL SELECT doc_id, kind, hit, a FROM ({spans(3, r'\+[0-9][\x20().0-9-]+[0-9]')}) p WHERE length(regexp_replace(hit, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
)
ASSIGN = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?"
SECRETS = digest(
    ("assign", "access", "hex"),
    f"SELECT doc_id, kind, hit, a FROM ({spans(0, ASSIGN + '[A-Za-z0-9+/_.=-]+')}) s WHERE length(regexp_extract(hit, '^{ASSIGN}([A-Za-z0-9+/_.=-]+)$', 1)) >= 12 "
    f"UNION ALL SELECT doc_id, kind, hit, a FROM ({spans(1, 'AKIA[A-Z0-9]+')}) k WHERE length(hit) >= 18 "
    f"UNION ALL SELECT doc_id, kind, hit, a FROM ({spans(2, '[0-9a-f]+')}) h WHERE length(hit) >= 16",
)

CRC = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(i) + 1), lambda p: CAST(ascii(substr(i, p, 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, n: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
LM = rf"""
WITH d AS (SELECT doc_id, {CRC} % 10 = 0 AS held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM (SELECT doc_id, text, CAST(doc_id AS VARCHAR) AS i FROM documents) x),
t AS (SELECT doc_id, held_out, unnest(w) AS k FROM d UNION ALL SELECT doc_id, held_out, NULL FROM d),
c AS (SELECT k, count(*) AS c FROM t WHERE NOT held_out GROUP BY k),
s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.1) / (n + 0.1 * (v + 1)))), 6) AS base_score FROM t LEFT JOIN c ON t.k IS NOT DISTINCT FROM c.k CROSS JOIN s GROUP BY doc_id
"""

ORACLE_SQL = {"op5_substring_dedup": OP5, "op7_near_dedup": OP7, "op8_quality_rules": OP8, "op10_suffix_dedup": OP10, "base_columns_of_pii": PII, "base_columns_of_secrets": SECRETS, "base_columns_of_lm": LM}
