"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and identifier cues. Each anchor is
handed to a local, deterministic parser that expands it to both sides and validates the whole value. The parsers for
email, ip, card and phone give exactly the leftmost non-overlapping matches of their patterns, since each pattern's
matches are bounded by characters outside its classes; a match that fails validation is used up and dropped.

Added by the method: `url` (a scheme whose address has user information, an IP host or personal query fields),
`account` (a cue such as "account no" or "passport" followed by an identifier with digits), `iban` (country, check
digits and mod-97 sum) and `ssn` (cue or the 3-2-4 form in valid ranges).

Null text counts as empty: no spans. Repeated rows each get their row. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents
from .spans import joined, sha

KINDS = ("email", "ip", "card", "phone", "url", "account", "iban", "ssn")
N_BASE = 4

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ACCOUNT = re.compile(r"(?: ?(?:no|nr|num|number|id|#)\b\.?)? ?[:#=]? ?([A-Z]{0,3}[0-9][A-Z0-9-]{4,22}[0-9])(?![A-Za-z0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
URL = re.compile(r"[^\s\"'<>]+")
PERSONAL_URL = re.compile(r"[^/@\s:]{1,256}:[^/@\s]{1,256}@|[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])")
PERSONAL_FIELD = re.compile(r"[?&](?:email|user|phone|ssn|token|password)=")

#: What an anchor is for.
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "IBAN", "iban", "passport", "Passport", "SSN", "ssn", "license no", "License No", "customer id", "Customer ID", "tax id", "Tax ID")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    for s in SCHEMES:
        a.add_word(s, ("scheme", len(s)))
    for c in CUES:
        a.add_word(c, ("cue", len(c)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, number of kind, end) of every span."""
    out: list[tuple[int, int, int]] = []
    email = ip = card = phone = added = url = 0  # up to where each parser has used the text
    field = -1
    for last, (what, size) in automaton().iter(text):
        at = last - size + 1
        if what == "digit":
            if at >= ip and (at == ip or not "0" <= text[at - 1] <= "9"):
                if m := IP.match(text, at):
                    ip = m.end()
                    if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split(".")):
                        out.append((at, 1, ip))
            if at >= card:
                if m := CARD.match(text, at):
                    card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, 2, card))
                    elif len(digits) == 9 and at >= added and (s := SSN.match(text, at)) and s.end() == card:
                        out.append((at, 7, card))
                        added = card
                else:
                    card = at + 1
        elif what == "@":
            low = at
            while low > email and text[low - 1] in LOCAL_CHARS:
                low -= 1
            if low < at and (m := DOMAIN.match(text, at)):
                email = m.end()
                out.append((low, 0, email))
        elif what == "+":
            if at >= phone and (m := PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((at, 3, phone))
        elif what == "scheme":
            if at >= added and last + 1 >= url and (m := URL.match(text, last + 1)):
                url = m.end()  # schemes within one run of address characters share its end and fields
                field = max((f.start() for f in PERSONAL_FIELD.finditer(text, last + 1, url)), default=-1)
            if at >= added and last + 1 < url and (field > last or PERSONAL_URL.match(text, last + 1, url)):
                added = url
                out.append((at, 4, added))
        elif at >= added:
            if (m := ACCOUNT.match(text, last + 1)) and (at == 0 or not text[at - 1].isalnum()):
                value = m.start(1)
                kind = 5
                if (b := IBAN.match(text, value)) and iban_ok(b[0]):
                    kind, m_end = 6, b.end()
                else:
                    m_end = m.end(1)
                if sum("0" <= c <= "9" for c in text[value:m_end]) >= 5:
                    out.append((value, kind, m_end))
                    added = m_end
            elif b := IBAN.match(text, min(len(text), last + 2)):
                if iban_ok(b[0]):
                    out.append((b.start(), 6, b.end()))
                    added = b.end()
    return out


FOUND = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            found = find(t.as_py() or "")
            base = [f for f in found if f[1] < N_BASE]
            count = [sum(f[1] == k for f in base) for k in range(N_BASE)]
            for column, value in zip(out, (d, *count, sha(joined(base, KINDS)), joined(found, KINDS), len(found) - len(base)), strict=True):
                column.append(value)
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [x.split()[0] for x in FOUND.split(", ")])


def op2(docs: DataFrame) -> DataFrame:
    return documents(docs).mapInArrow(rows, FOUND)


def mask(text: str | None) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become one, named after the first."""
    if text is None:
        return None
    out, at = [], 0
    for s, k, e in sorted(find(text), key=lambda f: (f[0], -f[2])):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, column: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with personal data in `column` replaced by kind marks, and `length`, if there, counted anew; rows without any are untouched."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array((mask(t.as_py()) for t in texts), pa.string())

    out = docs.withColumn(column, masked(F.col(column)))
    if length and length in docs.columns:
        out = out.withColumn(length, F.length(column).cast(docs.schema[length].dataType))
    return out.select(*docs.columns)
