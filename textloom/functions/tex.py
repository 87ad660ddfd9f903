"""LaTeX and Markdown projections as SQL over a text column: for Spark in Java's regular expressions, for the oracle in RE2's.

RE2 has neither look-around nor back-references, so the oracle's patterns name each environment and keep a boundary
character in a group; the two sides are written separately and meet only in their results.
"""

from __future__ import annotations

import re

# Environments, commands and marks of the projections.
DISPLAY = ("equation", "align", "gather", "eqnarray", "displaymath", "multline", "subequations")
FLOATS = ("figure", "table", "deluxetable", "longtable", "tabular")
SILENT = r"\\(?:nocite[a-z]*|defcitealias|citestyle|setcitestyle|newcites|shortcites|mciteSet[A-Za-z]*)\*?(?:\s*\[[^\]]*\])*(?:\s*\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})+"
CITE_TEXT = r"\\citetext\*?\s*\{"
CITE = r"\\[A-Za-z]*[Cc]ite[A-Za-z]*\*?(?:\s*\[[^\]]*\])*\s*\{[^{}]*\}"
LABEL_REF = r"\\(?:label|ref|eqref|cref|Cref)\{[^}]*\}"
GRAPHICS = r"\\includegraphics(?:\[[^\]]*\])?\{[^}]*\}"
BEGIN_END = r"\\(?:begin|end)\{[^}]*\}"
COMMAND = r"\\[a-zA-Z]+\*?(\[[^\]]*\])?(\{([^{}]*)\})?"
INLINE = r"(?s)\$[^$]+\$|\\\(.+?\\\)"
HEADING = r"\\(?:chapter|section|subsection|subsubsection|paragraph)\*?\s*(?:\[[^\]]*\])?\s*\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\}"
TITLE = r"\\(?:section|subsection|chapter)\*?\s*(?:\[[^\]]*\])?\s*\{([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}"
ABSTRACT = r"(?is)\\begin\{abstract\}(.*?)\\end\{abstract\}"
PLACEHOLDER = r"^\[[A-Za-z\-]+\]$"
DROP_ARGUMENT = r"\\(?:label|ref|eqref|cref|Cref|hspace|vspace|protect|thanks|footnote)\*?\s*\{[^{}]*\}"
DEFINITION = r"\\(?:(?:new|renew|provide)command\s*\*?\s*\{?|def\s*)\\([A-Za-z]+)\}?(?:\[(\d+)\])?\s*\{([^{}]*)\}"
NUMBER_BODY = r"^[^A-Za-z\\]*\d[^A-Za-z\\]*$"
# Section roles by words of their titles, in the order in which they are tried.
BUCKETS = (
    ("skip", r"(?i)\b(?:acknowledg\w*|bibliograph\w*|appendi(?:x|ces)|references?|literature\s+cited|disclosures?|affiliations?|author\s+information)\b"),
    ("abstract", r"(?i)\babstract\b"),
    ("discussion", r"(?i)\b(?:discussions?|caveats?|limitations?|systematics?|implications?|comparisons?|validations?|robustness|null\s+tests?|consistency\s+(?:tests?|checks?)|numerical\s+convergence)\b"),
    ("conclusion", r"(?i)\b(?:conclusions?|outlooks?|summar(?:y|ies))\b"),
    ("intro", r"(?i)\b(?:introductions?|motivations?)\b"),
    ("results", r"(?i)\b(?:results?|detected|shear-selected|catalogs?\s+of|constraints?|forecasts?)\b"),
    ("data", r"(?i)\b(?:data|datasets?|observations?|imaging|photometry|photometric\s+redshifts?|spectroscopy|surveys?|samples?)\b"),
    ("method", r"(?i)\b(?:methods?|methodology|formalism|approach(?:es)?|algorithms?|pipelines?|techniques?|models?|modell?ing|theor(?:y|etical)|simulations?|analys(?:is|es)|covariances?|likelihoods?|estimators?|reconstructions?|calibrations?|blinding|frameworks?)\b"),
)
# Markdown marks, in the order in which they are dropped, and what stays of them.
MARKDOWN = (
    (r"(?s)```.*?```", ""),
    (r"(?m)^#{1,6}\s.*$", ""),
    (r"(?m)^>.*$", ""),
    (r"(?m)^[-=_*]{3,}\s*$", ""),
    (r"(?m)^\s*\|.*\|.*$", ""),
    (r"(?m)^\s*(?:[-*+]|\d+\.)\s.*$", ""),
    (r"!\[[^\]]*\]\([^)]+\)", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "1"),
    (r"\*\*([^*]+)\*\*", "1"),
    (r"\*([^*]+)\*", "1"),
    (r"`[^`\n]+`", " "),
)


class SparkTex:
    """Spark's side."""

    comment, comment_to = r"(?<!\\)%[^\n]*", ""
    display = r"(?s)\\begin\{(" + "|".join(DISPLAY) + r")\*?\}.*?\\end\{\1\*?\}|\\\[.*?\\\]|\$\$.*?\$\$"
    floats = r"(?s)\\begin\{((?:" + "|".join(FLOATS) + r")\*?)\}.*?\\end\{\1\}"

    def sub(self, x: str, p: str, to: str = "", group: int = 0) -> str:
        return f"regexp_replace({x}, r'{p}', '{f'${group}' if group else to}')"

    def all(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, r'{p}', {group})"

    def first(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({x}, r'{p}', {group})"

    def split(self, x: str, p: str) -> str:
        return f"split({x}, r'{p}')"

    def like(self, x: str, p: str) -> str:
        return f"{x} RLIKE r'{p}'"

    def count(self, x: str, p: str) -> str:
        return f"CAST(regexp_count({x}, r'{p}') AS BIGINT)"

    def tilde(self, x: str) -> str:
        return self.sub(x, r"(?<!\\)~", " ")

    def each(self, x: str, p: str, to) -> str:  # noqa: ANN001  a function of SQL
        """x with every match of p through `to`: what stands between matches and the matches, put together again."""
        return f"array_join(zip_with(split({x}, r'{p}'), {self.all(x, p)}, (gap, hit) -> concat(gap, coalesce({to('hit')}, ''))), '')"

    def map(self, x: str, to: str) -> str:
        return f"transform({x}, v -> {to})"

    def keep(self, x: str, where: str) -> str:
        return f"filter({x}, v -> {where})"

    def comments_gone(self, x: str) -> str:
        return self.only_with(x, "%", self.sub(x, self.comment), x)

    def only_with(self, x: str, mark: str, full: str, bare: str) -> str:
        """full where the column x holds the mark; elsewhere bare, which must be what full comes to there. Most texts hold no mark, and a search for one costs far less than the patterns. An expression would be made once more, so it is left to full."""
        return f"IF(contains({x}, r'{mark}'), {full}, {bare})" if re.fullmatch(r"[A-Za-z_.]+", x) else full

    def marks(self, x: str) -> str:
        return f"{x} RLIKE r'[\\\\%$~{{}}]'"

    def only_marked(self, x: str, full: str) -> str:
        """full where the column x holds any character with which a pattern of the projections begins, else x."""
        return f"IF({self.marks(x)}, {full}, {x})" if re.fullmatch(r"[A-Za-z_.]+", x) else full

    def pair(self, name: str, body: str) -> str:
        return f"named_struct('name', {name}, 'body', {body})"

    def last_of(self, pairs: str, name: str) -> str:
        """The body of the last pair of that name, or null."""
        return f"get(reverse(filter({pairs}, d -> d.name = {name})), 0).body"


class DuckTex(SparkTex):
    """The oracle's side."""

    comment = r"(?m)(^|[^\\])%[^\n]*"
    display = "(?s)" + "|".join(rf"\\begin\{{{e}\*?\}}.*?\\end\{{{e}\*?\}}" for e in DISPLAY) + r"|\\\[.*?\\\]|\$\$.*?\$\$"
    floats = "(?s)" + "|".join(rf"\\begin\{{{e}\}}.*?\\end\{{{e}\}}" for f in FLOATS for e in (f, f + r"\*"))

    def sub(self, x: str, p: str, to: str = "", group: int = 0) -> str:
        return f"regexp_replace({x}, '{p}', '{f'{chr(92)}{group}' if group else to}', 'g')"

    def all(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, '{p}', {group})"

    def first(self, x: str, p: str, group: int = 0) -> str:
        return f"regexp_extract({x}, '{p}', {group})"

    def split(self, x: str, p: str) -> str:
        return f"string_split_regex({x}, '{p}')"

    def like(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, '{p}')"

    def count(self, x: str, p: str) -> str:
        return f"CAST(len(regexp_extract_all({x}, '{p}')) AS BIGINT)"

    def tilde(self, x: str) -> str:
        once = f"regexp_replace({x}, '(^|[^\\\\])~', '\\1 ', 'g')"
        return f"regexp_replace({once}, '(^|[^\\\\])~', '\\1 ', 'g')"

    def each(self, x: str, p: str, to) -> str:  # noqa: ANN001
        gaps, hits = f"string_split_regex({x}, '{p}')", f"regexp_extract_all({x}, '{p}')"
        return f"array_to_string(list_transform(range(1, len({gaps}) + 1), lambda i: ({gaps})[i] || coalesce({to(f'({hits})[i]')}, '')), '')"

    def map(self, x: str, to: str) -> str:
        return f"list_transform({x}, lambda v: {to})"

    def keep(self, x: str, where: str) -> str:
        return f"list_filter({x}, lambda v: {where})"

    def comments_gone(self, x: str) -> str:
        return f"regexp_replace({x}, '{self.comment}', '\\1', 'g')"

    def only_with(self, x: str, mark: str, full: str, bare: str) -> str:
        return full

    def only_marked(self, x: str, full: str) -> str:
        return full

    def pair(self, name: str, body: str) -> str:
        return f"{{'name': {name}, 'body': {body}}}"

    def last_of(self, pairs: str, name: str) -> str:
        return f"list_filter({pairs}, lambda d: d.name = {name})[-1].body"


def projected(t: SparkTex, x: str, inline, display: str, figure: str, cite: str) -> str:  # noqa: ANN001
    """The reduction that both projections share; they differ in what maths, floats and citations become."""
    whole, x = x, t.sub(t.comments_gone(x), t.display, display)
    x = t.each(x, INLINE, inline) if inline else t.sub(x, INLINE, " [math] ")
    for p, to in ((t.floats, figure), (SILENT, " "), (CITE_TEXT, " "), (CITE, cite), (LABEL_REF, ""), (GRAPHICS, ""), (BEGIN_END, "")):
        x = t.sub(x, p, to)
    return t.only_marked(whole, t.tilde(t.sub(t.sub(x, COMMAND, group=3), "[{}]")))


def plain(t: SparkTex, x: str) -> str:
    return projected(t, x, None, " [MATH] ", " [FIGURE-OR-TABLE] ", " [CITE] ")


def numerals(t: SparkTex):
    """A maths span reduced to its numerals and operators, on one line."""

    def of(span: str) -> str:
        x = t.sub(t.sub(t.sub(span, r"\{\s*,\s*\}", ","), r"\\[a-zA-Z]+\*?", " "), "[{}$]", " ")
        return f"(' ' || trim({t.sub(x, r'\s+', ' ')}) || ' ')"

    return of


def numeral_text(t: SparkTex, x: str) -> str:
    return t.sub(projected(t, x, numerals(t), " ", " ", " "), "[ \\t]+", " ")


def blanked(t: SparkTex, x: str, *patterns: str) -> str:
    """Matches turned to spaces of the same length, line breaks kept. A pattern with a back-reference stands first."""
    joined = "(?s)" + "|".join(p.replace("(?s)", "") for p in patterns)
    return t.each(x, joined, lambda hit: t.sub(hit, r"[^\n]", " "))


def definitions(t: SparkTex, x: str) -> str:
    """Numeric macros of a text without comments, as (name, body), in order."""
    hits = t.keep(t.all(x, DEFINITION), f"{t.first('v', DEFINITION, 2)} = '' AND {t.like(f'trim({t.first('v', DEFINITION, 3)})', NUMBER_BODY)}")
    return t.map(hits, t.pair(t.first("v", DEFINITION, 1), f"trim({t.first('v', DEFINITION, 3)})"))


def heading(t: SparkTex, x: str) -> str:
    """A title without markup."""
    x = t.sub(x, r"\\texorpdfstring\s*\{(.*?)\}\s*\{[^{}]*\}", group=1)
    for p in (DROP_ARGUMENT, r"\$[^$]*\$", r"\\[a-zA-Z]+\*?", "[{}]"):
        x = t.sub(x, p, " ")
    return f"trim({t.sub(x, r'\s+', ' ')})"


def markdown(t: SparkTex, x: str) -> str:
    for p, to in MARKDOWN:
        x = t.sub(x, p, group=1) if to == "1" else t.sub(x, p, to)
    return x


def prose_words(t: SparkTex, x: str) -> str:
    """The words of a plain projection: split at white space, without placeholders."""
    return t.keep(t.split(f"trim({t.sub(x, r'\s+', ' ')})", " "), f"v <> '' AND NOT {t.like('v', PLACEHOLDER)}")


def bucket(t: SparkTex, title: str) -> str:
    """The role of a clean title, null where no word names one."""
    return "CASE " + " ".join(f"WHEN {t.like(title, p)} THEN '{name}'" for name, p in BUCKETS) + " END"
