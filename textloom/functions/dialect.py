"""Text relations and functions in Spark SQL, and their twins in the oracle's SQL.

A query is written once over relations (words, sentences, lines, runs ...) that each engine defines for itself; what differs is
how text is cut up and matched, which is what the twin checks.
"""

from __future__ import annotations

import re

from ..sources.manuscripts import MANUSCRIPTS
from .tex import ABSTRACT, HEADING, TITLE, DuckTex, SparkTex, blanked, bucket, heading, plain

WORD = r"\p{L}[\p{L}\x27\-]*"
PLAIN_WORD = r"[A-Za-z][A-Za-z\x27-]*"
RUN_BREAK = r"[.,;:!?()\[\]|\x22\n]+"

MARK = chr(92)  # every LaTeX command begins with it

SECTION_START = r"(\\(?:section|subsection|chapter)\*?\s*(?:\[[^\]]*\])?\s*\{)"

#: Texts in which the lexical rules fire, beside the documents, which are invented prose.
FIXTURES = (
    "We delve into the tapestry of methods --- a testament to care. Notably, it works. Moreover, moreover it is robust.",
    "In order to test this, we make use of data, highlighting the trend. It is worth noting that prior to 1990 nothing was known.",
    "Not only fast but also small and cheap. These three parts together form the basis. However, the rule: that a line ends.",
    "Furthermore, additionally, the method is robust and comprehensive. It may possibly fail rather than hold. TODO fix this.",
    "The rate is 5 than 3 [CITE]. We tried a previous version; it no longer holds. The number of cases is large. However we stop.",
)


class Dialect:
    name = ""

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def corpus(self) -> str:
        rows = " UNION ALL ".join(f"SELECT CAST({-1 - i} AS BIGINT), {self.text(t)}, 'fixture'" for i, t in enumerate(FIXTURES))
        return f"SELECT doc_id, text, source FROM documents UNION ALL {rows}"

    def tex(self) -> str:
        """Documents, whose lines are paragraphs, and the manuscripts."""
        rows = " UNION ALL ".join(f"SELECT CAST({-100 - i} AS BIGINT), {self.text(x)}" for i, x in enumerate(MANUSCRIPTS))
        return f"SELECT doc_id, replace(text, {self.newline}, concat({self.newline}, {self.newline})) AS text FROM documents UNION ALL {rows}"

    def relations(self) -> dict[str, str]:
        return self.words_relations() | self.tex_relations()

    def tex_relations(self) -> dict[str, str]:
        """Sections by heading with their roles, paragraphs below them, and sentences of their plain text. All of it is made within a document's row: nothing is shuffled."""
        t = self.t
        title = heading(t, t.first("v", TITLE, 1))
        parts = self.exploded("doc_id", "section", "x", f"SELECT doc_id, {self.zipped('parts', 'inherited')} AS a_ FROM (SELECT doc_id, parts, {self.filled('roles')} AS inherited FROM (SELECT doc_id, parts, {t.map('parts', t.only_with('v', MARK, bucket(t, title), 'NULL'))} AS roles FROM (SELECT doc_id, {t.only_with('text', MARK, t.split(self.marked('text'), chr(92) + 'x01'), 'split(text, r"\x01")')} AS parts FROM tex) p) r) i")
        name = f"CASE WHEN section > 0 THEN coalesce(x.role, 'unknown') WHEN {t.only_with('x.part', MARK, t.like('x.part', r'\\documentclass|\\begin\{document\}'), 'false')} THEN 'preamble' ELSE 'document' END"
        body = t.only_with("part", MARK, blanked(t, t.comments_gone("part"), t.floats, HEADING, r"\\begin\{abstract\}.*?\\end\{abstract\}"), t.comments_gone("part"))
        titled = t.only_with("x.part", MARK, heading(t, t.first("x.part", TITLE, 1)), "''")
        return {
            "tex": self.tex(),
            "tex_sections": f"SELECT doc_id, CAST(section AS BIGINT) AS section, {name} AS bucket, {titled} AS title, x.part AS part FROM ({parts}) s",
            "tex_blocks": f"SELECT doc_id, section, bucket, {body} AS body FROM tex_sections WHERE bucket NOT IN ('preamble', 'skip') UNION ALL SELECT doc_id, section, 'abstract', {t.first('part', ABSTRACT, 1)} FROM tex_sections WHERE {t.like('part', ABSTRACT)}",
            "tex_units": f"SELECT doc_id, section, bucket, CAST(unit AS BIGINT) AS unit, block, {plain(t, 'block')} AS plain FROM ({self.explode('doc_id, section, bucket', 'unit', 'block', t.split('body', chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n'), 'tex_blocks')}) u WHERE trim({plain(t, 'block')}) <> ''",
            "tex_sentences": f"SELECT * FROM ({self.explode('doc_id, section, bucket, unit', 'sent', 's', self.sentences_of('plain'), 'tex_units')}) q WHERE trim(s) <> ''",
        }

    def words_relations(self) -> dict[str, str]:
        w, s = self.explode, self.sentences_of("text")
        return {
            "corpus": self.corpus(),
            "words": w("doc_id, source", "pos", "w", self.all("text", WORD), "documents"),
            "lines": w("doc_id, source", "line", "s", self.split("text", "\n"), "documents"),
            "sentences": f"SELECT * FROM ({w('doc_id, source', 'sent', 's', s, 'documents')}) q WHERE s <> ''",
            "corpus_sentences": f"SELECT * FROM ({w('doc_id, source', 'sent', 's', s, 'corpus')}) q WHERE s <> ''",
            "sentence_words": w("doc_id, source, sent", "pos", "w", self.all("lower(s)", WORD), "sentences"),
            "runs": w("doc_id", "run", "s", self.split("text", RUN_BREAK, True), "documents"),
            "run_words": w("doc_id, run", "pos", "w", self.all("lower(s)", PLAIN_WORD), "runs"),
            "pairs": "SELECT * FROM (SELECT doc_id, run, pos, w AS a, lead(w) OVER (PARTITION BY doc_id, run ORDER BY pos) AS b FROM run_words) q WHERE b IS NOT NULL AND length(a) >= 3 AND length(b) >= 3",
            "terms": "SELECT DISTINCT doc_id, source, lower(w) AS t FROM words WHERE length(w) >= 3",
            "df": "SELECT t, count(*) AS n FROM terms GROUP BY t",
            "sentence_lengths": "SELECT doc_id, source, sent, count(*) AS n FROM sentence_words GROUP BY doc_id, source, sent",
            "line_features": f"SELECT doc_id, source, line, length(s) AS chars, {self.count('s', WORD)} AS n_words, {self.count('s', r'[,;]')} AS n_commas, {self.count('s', r'[0-9]')} AS n_digits FROM lines",
        }

    def sql(self, body: str) -> str:
        """body with the relations that it and they use, in order."""
        have, need = self.relations(), []

        def add(text: str) -> None:
            for r in have:
                if re.search(rf"\b(?:FROM|JOIN)\s+{r}\b", text) and r not in need:
                    add(have[r])
                    need.append(r)

        add(body)
        if not need:
            return body
        own = ", ".join(f"{r} AS ({have[r]})" for r in need)
        return f"WITH {own}, {body[5:]}" if body.startswith("WITH ") else f"WITH {own} {body}"


class Spark(Dialect):
    name = "spark"
    t = SparkTex()
    newline = r"'\n'"

    def tex_relations(self) -> dict[str, str]:
        """The projection of a unit's block is exploded out of an array of one, so that the filter on it stays above and it is made once."""
        blocks = self.explode("doc_id, section, bucket", "unit", "block", self.t.split("body", chr(92) + "n" + chr(92) + "s*" + chr(92) + "n"), "tex_blocks")
        units = f"SELECT doc_id, section, bucket, CAST(unit AS BIGINT) AS unit, block, plain FROM ({blocks}) u LATERAL VIEW explode(array({plain(self.t, 'block')})) x_ AS plain WHERE trim(plain) <> ''"
        have, t = super().tex_relations(), self.t
        own, _, abstract = have["tex_blocks"].partition(" UNION ALL ")
        body = re.search(r"bucket, (.*) AS body FROM tex_sections", own)[1]
        found = f"IF({t.only_with('part', MARK, t.like('part', ABSTRACT), 'false')}, named_struct('bucket', 'abstract', 'body', {t.first('part', ABSTRACT, 1)}), NULL)"
        both = f"array(IF(bucket NOT IN ('preamble', 'skip'), named_struct('bucket', bucket, 'body', {body}), NULL), {found})"
        blocks = f"SELECT doc_id, section, b_.bucket AS bucket, b_.body AS body FROM tex_sections LATERAL VIEW explode(filter({both}, b -> b IS NOT NULL)) x_ AS b_"
        return have | {"tex_units": units, "tex_blocks": blocks}

    def marked(self, x: str, start: str = SECTION_START) -> str:
        return f"regexp_replace({x}, r'{start}', '\\u0001$1')"

    def joined(self, x: str, by: str) -> str:
        return f"array_join({x}, '{by}')"

    def zipped(self, parts: str, roles: str) -> str:
        return f"transform({parts}, (v, i) -> named_struct('part', v, 'role', {roles}[i]))"

    def filled(self, x: str) -> str:
        """Each value, or the last one before it that isn't null."""
        return f"transform({x}, (v, i) -> get(reverse(filter(slice({x}, 1, i + 1), r -> r IS NOT NULL)), 0))"

    def size(self, x: str) -> str:
        return f"size({x})"

    def firsts(self, x: str, n: int) -> str:
        return f"slice({x}, 1, {n})"

    def exploded(self, keep: str, pos: str, value: str, source: str) -> str:
        """The whole slice, since of a plain column the optimizer would infer a filter on its size and push it below, where the column is made a second time."""
        return f"SELECT {keep}, {pos}, {value} FROM ({source}) q LATERAL VIEW posexplode(slice(a_, 1, 2147483647)) y AS {pos}, {value}"

    def text(self, s: str) -> str:
        return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'

    def sql(self, body: str) -> str:
        """Numbers with a point are doubles, not decimals; strings are left as they are."""
        return re.sub(r"""(r'[^']*'|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?<![\w.'])(\d+\.\d+)(?![\w.'])""", lambda m: m[1] or f"{m[2]}D", super().sql(body))

    def re(self, p: str) -> str:
        return f"r'{p}'"

    def all(self, col: str, p: str) -> str:
        return f"regexp_extract_all({col}, {self.re(p)}, 0)"

    def count(self, col: str, p: str) -> str:
        return f"CAST(regexp_count({col}, {self.re(p)}) AS BIGINT)"

    def match(self, col: str, p: str) -> str:
        return f"regexp_like({col}, {self.re(p)})"

    def replace(self, col: str, p: str, to: str) -> str:
        return f"regexp_replace({col}, {self.re(p)}, '{to}')"

    def split(self, col: str, p: str, regex: bool = False) -> str:
        return f"split({col}, {self.re(p if regex else re.escape(p).replace(chr(10), 'n'))})"

    def sentences_of(self, col: str) -> str:
        return f"split(trim(regexp_replace({col}, r'\\s+', ' ')), r'(?<=[.!?])\\s+(?=[A-Z(])')"

    def explode(self, keep: str, pos: str, value: str, array: str, source: str) -> str:
        return f"SELECT {keep}, {pos}, {value} FROM {source} LATERAL VIEW posexplode({array}) x AS {pos}, {value}"

    def vec(self, dim: str, value: str) -> str:
        return f"SELECT vec_id, label, {dim}, CAST({value} AS DOUBLE) AS {value} FROM embeddings LATERAL VIEW posexplode(embedding) x AS {dim}, {value}"

    def dot(self, a: str, b: str) -> str:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)"

    def md5(self, x: str) -> str:
        return f"md5(CAST({x} AS STRING))"

    def bag_hash(self, x: str) -> str:
        """A hash of a bag of texts, whatever their order: the sum of their digests' first 15 hexadecimal digits."""
        return f"CAST(sum(CAST(conv(substr(md5({x}), 1, 15), 16, 10) AS DECIMAL(38, 0))) AS STRING)"

    def series(self, n: int) -> str:
        return f"SELECT explode(sequence(0, {n})) AS i"


class Duck(Dialect):
    name = "duckdb"
    t = DuckTex()
    newline = "chr(10)"

    def marked(self, x: str, start: str = SECTION_START) -> str:
        return f"regexp_replace({x}, '{start}', chr(1) || '\\1', 'g')"

    def joined(self, x: str, by: str) -> str:
        return f"array_to_string({x}, '{by}')"

    def zipped(self, parts: str, roles: str) -> str:
        return f"list_transform(range(1, len({parts}) + 1), lambda i: {{'part': ({parts})[i], 'role': ({roles})[i]}})"

    def filled(self, x: str) -> str:
        return f"list_transform(range(1, len({x}) + 1), lambda i: list_filter(({x})[1:i], lambda r: r IS NOT NULL)[-1])"

    def size(self, x: str) -> str:
        return f"len({x})"

    def firsts(self, x: str, n: int) -> str:
        return f"({x})[1:{n}]"

    def exploded(self, keep: str, pos: str, value: str, source: str) -> str:
        return f"SELECT {keep}, unnest(range(len(a_))) AS {pos}, unnest(a_) AS {value} FROM ({source}) q"

    def re(self, p: str) -> str:
        return f"'{p}'"

    def all(self, col: str, p: str) -> str:
        return f"regexp_extract_all({col}, {self.re(p)})"

    def count(self, col: str, p: str) -> str:
        return f"CAST(len(regexp_extract_all({col}, {self.re(p)})) AS BIGINT)"

    def match(self, col: str, p: str) -> str:
        return f"regexp_matches({col}, {self.re(p)})"

    def replace(self, col: str, p: str, to: str) -> str:
        return f"regexp_replace({col}, {self.re(p)}, '{to}', 'g')"

    def split(self, col: str, p: str, regex: bool = False) -> str:
        return f"string_split_regex({col}, {self.re(p)})" if regex else f"string_split({col}, chr({ord(p)}))"

    def sentences_of(self, col: str) -> str:
        flat = f"trim(regexp_replace({col}, '\\s+', ' ', 'g'))"
        return f"string_split(regexp_replace({flat}, '([.!?])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"

    def explode(self, keep: str, pos: str, value: str, array: str, source: str) -> str:
        return f"SELECT {keep}, unnest(range(len(a_))) AS {pos}, unnest(a_) AS {value} FROM (SELECT *, {array} AS a_ FROM {source}) q"

    def vec(self, dim: str, value: str) -> str:
        return f"SELECT vec_id, label, unnest(range(len(embedding))) AS {dim}, CAST(unnest(embedding) AS DOUBLE) AS {value} FROM embeddings"

    def dot(self, a: str, b: str) -> str:
        return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"

    def md5(self, x: str) -> str:
        return f"md5(CAST({x} AS VARCHAR))"

    def bag_hash(self, x: str) -> str:
        return f"CAST(sum(CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)) AS VARCHAR)"

    def series(self, n: int) -> str:
        return f"SELECT unnest(range({n + 1})) AS i"
