"""Manuscripts: projections, sections, units and what stands in them."""

from __future__ import annotations

from ..functions.dialect import Dialect
from ..functions.tex import CITE, DEFINITION, DISPLAY, HEADING, INLINE, LABEL_REF, NUMBER_BODY, SILENT, blanked, bucket, definitions, markdown, numeral_text, plain, prose_words

# What the detectors on labels look for.
LABEL = r"\\(?:chapter|section|subsection|subsubsection|paragraph|caption)\*?\s*(?:\[[^\]]*\])?\s*\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
NEGATION = r"(?i)\b(?:no|non|not|without|excluding|neither|nor|absent|minus|free of|lacking)\b[-\s]*(.+)$"
NEGATION_EDGE = r"(?i)[,;:.!?()]|\s(?:and|or|with|versus|vs)\b"
LABEL_STOPWORDS = """the a an of in on at to for from by with and or but
as is are was were be been that this these those it its any all each some
same other such only""".split()
ATE_FAMILY = ("ations", "ation", "ating", "ated", "ates", "ate")
STEM_SUFFIXES = ("ations", "ation", "ities", "ity", "ness", "ments", "ment", "ingly", "ing", "edly", "ed", "ies", "ally", "al", "ly", "ers", "er", "es", "s")
BIBLIOGRAPHY = r"(?s)\\begin\{thebibliography\}.*?\\end\{thebibliography\}"
REGISTER_WORD = r"[A-Za-z][A-Za-z\x27\-]{2,}"
MACRO = r"\\(?:newcommand|renewcommand|providecommand|def)\s*\{?\\([A-Za-z]+)\}?\s*\{([^{}]*)\}"
NUMERAL = r"[-+]?\d[\d,]*(?:\.\d+)?"


def listed(words) -> str:  # noqa: ANN001
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def stem(q: Dialect, word: str) -> str:
    """One suffix off, if three letters stay; the -ate family first."""
    return "CASE " + " ".join(f"WHEN {word} LIKE '%{s}' AND length({word}) >= {len(s) + 3} THEN substr({word}, 1, length({word}) - {len(s)})" for s in (*ATE_FAMILY, *STEM_SUFFIXES)) + f" ELSE {word} END"


def normal(q: Dialect, word: str) -> str:
    """Lower case, without a possessive and outer hyphens and apostrophes."""
    return q.t.sub(q.t.sub(f"lower({word})", r"\x27s$", ""), r"^[-\x27]+|[-\x27]+$", "")


def body_only(q: Dialect, x: str) -> str:
    """A text in which only prose of the body is left, at the same places."""
    t = q.t
    maths = [r"\\begin\{" + e + r"\*?\}.*?\\end\{" + e + r"\*?\}" for e in DISPLAY]
    return blanked(t, t.comments_gone(x), t.floats, *maths, r"\\\[.*?\\\]", r"\$\$.*?\$\$", INLINE, BIBLIOGRAPHY, r"\\(?:texttt|lstinline|url|path|href)\s*\{[^{}]*\}", HEADING, SILENT, CITE, LABEL_REF)


def numeric(q: Dialect, hit: str) -> str:
    """Whether a macro definition takes no argument and is a bare number."""
    return f"{q.t.first(hit, DEFINITION, 2)} = '' AND {q.t.like(f'trim({q.t.first(hit, DEFINITION, 3)})', NUMBER_BODY)}"


def expanded(q: Dialect) -> str:
    """live with numeric definitions blanked and their uses replaced; the last definition of a name wins."""
    t = q.t
    x = t.each("live", DEFINITION, lambda hit: f"CASE WHEN {numeric(q, hit)} THEN {t.sub(hit, r'[^\n]', ' ')} ELSE {hit} END")
    return t.each(x, r"\\[A-Za-z]+(?:\s*\{\})?", lambda hit: f"coalesce({t.last_of('defs', t.first(hit, '[A-Za-z]+'))}, {hit})")


BLANK_LINE, WHITE = r"\n\s*\n", r"\s+"


ACRONYM_DEFINITION = r"\(([A-Z][A-Za-z0-9]{1,9})s?\)"
DEFINING = r"(?i)\b(?:we (?:define|call|term|name|introduce|refer to)|hereafter|henceforth|denoted?|which we call)\b"
OBJECT_EDGE = r"(?i)[,;:.()]|\b(?:using|with|by|from|in|for|and|or|to|via|through|that|which|where|when|whose|as)\b.*$"
FRONT_MATTER = r"(?s)\A---\n.*?\n---[ \t]*(?:\n|\z)"
# Limits of a printed heading.
MAX_HEADING_WORDS, MIN_HEADING_WORDS, MIN_LETTERS, LETTER_SHARE, CAPITAL_SHARE = 12, 2, 4, 0.75, 0.6


def printed_headings(q: Dialect) -> str:
    """Lines that look like headings of a printed page: numbered short titles, or short lines mostly in capitals, with their roles."""
    t = q.t
    lines = q.explode("doc_id", "line", "s", t.split("text", r"\n"), "tex")
    body = t.sub("trim(s)", r"^\d+(?:\.\d+)*\.?\s+")
    words, letters, capitals, dense = (t.count("body", p) for p in (r"\S+", r"[A-Za-z]", r"[A-Z]", r"\S"))
    ok = f"words BETWEEN {MIN_HEADING_WORDS} AND 10 AND letters >= {MIN_LETTERS}"
    numbered = f"numbered AND {ok} AND NOT {t.like('body', r'[.!?]\s*$')}"
    capital = f"{ok} AND letters >= {LETTER_SHARE} * dense AND capitals >= {CAPITAL_SHARE} * letters"
    base = f"SELECT doc_id, line, body, numbered, {words} AS words, {letters} AS letters, {capitals} AS capitals, {dense} AS dense FROM (SELECT doc_id, line, {body} AS body, {t.like('trim(s)', r'^\d+(?:\.\d+)*\.?\s+')} AS numbered FROM ({lines}) l WHERE NOT {t.like('s', '[,;?]')}) b"
    return f"SELECT doc_id, CAST(line AS BIGINT) AS line, body AS title, coalesce({bucket(t, 'body')}, 'unknown') AS bucket FROM ({base}) x WHERE words <= {MAX_HEADING_WORDS} AND ({numbered} OR {capital})"


def definitions_in(q: Dialect) -> str:
    """Terms that a manuscript defines: acronyms in parentheses, and the words behind a defining phrase up to the next clause."""
    acronyms = q.explode("doc_id", "k", "v", q.t.all("plain", ACRONYM_DEFINITION, 1), "tex_units")
    tails = f"SELECT doc_id, {q.t.sub(q.t.sub('s', '(?i)^.*?' + DEFINING[4:]), OBJECT_EDGE)} AS object FROM tex_sentences WHERE {q.t.like('s', DEFINING)}"
    words = q.explode("doc_id", "k", "v", q.t.all("object", REGISTER_WORD), f"({tails}) o")
    return f"SELECT DISTINCT doc_id, 'acronym' AS kind, {normal(q, 'v')} AS term FROM ({acronyms}) a UNION ALL SELECT DISTINCT doc_id, 'defined', {normal(q, 'v')} FROM ({words}) w"


def names(q: Dialect) -> str:
    """Words that stand with a capital wherever they stand inside a sentence, and never without."""
    words = q.explode("doc_id, section, unit, sent", "k", "v", q.t.all("s", REGISTER_WORD), "tex_sentences")
    return f"SELECT doc_id, {normal(q, 'v')} AS term, count(*) AS n FROM ({words}) w WHERE k > 0 GROUP BY doc_id, {normal(q, 'v')} HAVING sum(CASE WHEN {q.t.like('v', '^[A-Z]')} THEN 0 ELSE 1 END) = 0"


QUERIES = {
    "p10_document_source": lambda q: f"SELECT doc_id, CASE WHEN {q.t.like('text', r'\\(?:documentclass|section|begin)')} THEN {q.t.comments_gone('text')} ELSE {q.t.sub('text', FRONT_MATTER)} END AS source FROM tex",
    "p18_printed_headings": printed_headings,
    "g9_printed_sections": lambda q: f"SELECT doc_id, bucket, count(*) AS n_headings, min(line) AS first_line FROM ({printed_headings(q)}) h WHERE bucket <> 'unknown' GROUP BY doc_id, bucket",
    "f9_sentence_start_lines": lambda q: f"SELECT doc_id, CAST(line AS BIGINT) AS line FROM (SELECT doc_id, line, s, lag(s) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM ({q.explode('doc_id', 'line', 's', q.t.split('text', chr(92) + 'n'), 'tex')}) l WHERE trim(s) <> '') p WHERE before IS NULL OR {q.t.like('before', r'[.!?:}]\s*$')}",
    "f17_numeric_macros": lambda q: f"SELECT doc_id, d.name AS name, d.body AS body FROM ({q.explode('doc_id', 'k', 'd', definitions(q.t, q.t.comments_gone('text')), 'tex')}) x",
    "d24_definitions": definitions_in,
    "d24_capitalised_names": names,
    "p1_latex_to_plain": lambda q: f"SELECT doc_id, {plain(q.t, 'text')} AS plain FROM tex",
    "p2_numeral_text": lambda q: f"SELECT doc_id, {numeral_text(q.t, 'text')} AS plain FROM tex",
    "p3_paired_paragraphs": lambda q: f"SELECT doc_id, CAST({q.size('a')} AS BIGINT) AS n_plain, CAST({q.size('b')} AS BIGINT) AS n_numeral, {q.size('a')} = {q.size('b')} AS paired FROM (SELECT doc_id, {q.t.split(plain(q.t, 'text'), BLANK_LINE)} AS a, {q.t.split(numeral_text(q.t, 'text'), BLANK_LINE)} AS b FROM tex) p",
    "p4_blank_preserving": lambda q: f"SELECT doc_id, length(b) = length(text) AS same_length, b AS blanked FROM (SELECT doc_id, text, {blanked(q.t, 'text', CITE, LABEL_REF)} AS b FROM tex) x",
    "p5_prose_words": lambda q: f"SELECT doc_id, CAST({q.size(prose_words(q.t, plain(q.t, 'text')))} AS BIGINT) AS n_words FROM tex",
    "p6_clean_heading": lambda q: "SELECT doc_id, section, title, bucket FROM tex_sections WHERE section > 0",
    "p7_expand_numeric": lambda q: f"SELECT doc_id, {expanded(q)} AS expanded FROM (SELECT doc_id, live, {definitions(q.t, 'live')} AS defs FROM (SELECT doc_id, {q.t.comments_gone('text')} AS live FROM tex) l) d",
    "p8_body_only": lambda q: f"SELECT doc_id, section, {body_only(q, 'part')} AS body FROM tex_sections WHERE bucket NOT IN ('preamble', 'skip')",
    "p9_without_headings": lambda q: f"SELECT doc_id, section, {blanked(q.t, 'part', q.t.floats, HEADING)} AS body FROM tex_sections",
    "p11_strip_markdown": lambda q: f"SELECT doc_id, {markdown(q.t, 'text')} AS plain FROM tex",
    "p14_residue_stems": lambda q: f"SELECT t, {stem(q, 't')} AS stem FROM (SELECT DISTINCT lower(w) AS t FROM words WHERE length(w) >= 3) w",
    "p16_normal_tokens": lambda q: f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, replace(lower({q.t.sub('v', WHITE, '')}), '−', '-') AS token FROM ({q.explode('doc_id', 'pos', 'v', q.t.all('text', r'[-+−]?[0-9][0-9., ]*'), 'tex')}) n",
    "p17_macro_terms": lambda q: f"SELECT doc_id, name, min(word) AS word FROM (SELECT doc_id, {q.t.first('v', MACRO, 1)} AS name, {q.t.first(q.t.first('v', MACRO, 2), REGISTER_WORD)} AS word FROM ({q.explode('doc_id', 'pos', 'v', q.t.all('text', MACRO), 'tex')}) m) x WHERE word <> '' GROUP BY doc_id, name",
    "g8_bucket_texts": lambda q: f"SELECT doc_id, bucket, count(*) AS n_sections, CAST(sum(length(body)) AS BIGINT) AS n_chars FROM tex_blocks GROUP BY doc_id, bucket",
    "g10_abstracts": lambda q: "SELECT doc_id, section, body FROM tex_blocks WHERE bucket = 'abstract' AND doc_id < 0",
    "g11_paragraph_units": lambda q: f"SELECT doc_id, section, bucket, unit, CAST({q.size(prose_words(q.t, 'plain'))} AS BIGINT) AS n_words FROM tex_units",
    "g12_section_sweep": lambda q: f"SELECT doc_id, bucket, count(*) AS n_units, CAST(sum({q.size(prose_words(q.t, 'plain'))}) AS BIGINT) AS n_words FROM tex_units GROUP BY doc_id, bucket",
    "g19_labels": lambda q: f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, {plain(q.t, q.t.first('v', LABEL, 1))} AS label FROM ({q.explode('doc_id', 'pos', 'v', q.t.all('text', LABEL), 'tex')}) l",
    "g20_negated_objects": lambda q: negated(q),
    "g21_cited_keys": lambda q: f"SELECT doc_id, trim(key) AS key, CAST(min(line) + 1 AS BIGINT) AS line FROM ({q.explode('doc_id, line', 'k', 'key', q.t.split(q.t.first('v', r'\{([^{}]*)\}$', 1), ','), f'({cites(q)}) c')}) x WHERE trim(key) <> '' GROUP BY doc_id, trim(key)",
    "g23_markdown_chunks": lambda q: f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, chunk FROM (SELECT doc_id, pos, trim({q.t.sub('v', WHITE, ' ')}) AS chunk FROM ({q.explode('doc_id', 'pos', 'v', q.t.split(markdown(q.t, 'text'), BLANK_LINE), 'tex')}) m) c WHERE chunk <> ''",
    "s2_include_targets": lambda q: f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, v AS target FROM ({q.explode('doc_id', 'pos', 'v', q.t.all(q.t.comments_gone('text'), r'\\(?:include|input)\s*\{\s*([^}\s\\]+)\s*\}', 1), 'tex')}) i",
    "d17_negative_labels": lambda q: f"SELECT n.doc_id, n.pos, n.stem FROM ({negated(q)}) n JOIN (SELECT doc_id, sum({q.size(prose_words(q.t, 'plain'))}) AS n FROM tex_units GROUP BY doc_id) d ON n.doc_id = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id, {stem(q, 't')} AS stem FROM ({q.explode('doc_id', 'p', 't', q.t.all('lower(plain)', REGISTER_WORD), 'tex_units')}) w) b ON n.doc_id = b.doc_id AND n.stem = b.stem WHERE d.n >= 40 AND b.stem IS NULL",
}


def negated(q: Dialect) -> str:
    """doc_id, pos of the label, the object and the stem of each of its first three words, of every negation in a label."""
    t = q.t
    labels = q.explode("doc_id", "pos", "v", t.all("text", LABEL), "tex")
    clauses = q.explode("doc_id, pos", "k", "clause", t.split("plain", NEGATION_EDGE), f"(SELECT doc_id, pos, {plain(t, t.first('v', LABEL, 1))} AS plain FROM ({labels}) l) p")
    objects = f"SELECT doc_id, pos, k, trim({t.first('clause', NEGATION, 1)}) AS object FROM ({clauses}) h WHERE {t.like('clause', NEGATION)}"
    kept = t.keep(t.all("lower(object)", REGISTER_WORD), f"v NOT IN {listed(LABEL_STOPWORDS)}")
    words = q.explode("doc_id, pos, k, object", "w", "word", q.firsts(kept, 3), f"({objects}) o")
    return f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, object, CAST(w AS BIGINT) AS place, {stem(q, 'word')} AS stem FROM ({words}) x"


def cites(q: Dialect) -> str:
    lines = q.explode("doc_id", "line", "s", q.t.split(q.t.comments_gone("text"), r"\n"), "tex")
    return q.explode("doc_id, line", "p", "v", q.t.all("s", CITE), f"({lines}) l")
