"""Secret scan with corpus-wide ownership frequency.

Every text is scanned once for candidates. The candidates' value hashes are counted over the whole corpus by distinct
owner (source) and repository (document): a value that many owners hold is a copied example, a value of one owner and
few repositories that looks random is live-looking. Counts are made from pairs (value, owner) reduced before they are shuffled, so a
value in a third of all documents costs one row a task; verdicts go back by a join on the value, which AQE may split.

Spans added to the base kinds: `token` (provider prefixes), `key` (PEM private key headers) and `url` (user:password
in an address). Null text counts as empty. A null source is one owner of its own. Repeated rows each get their row.
Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, staged
from .spans import joined, sha

KINDS = ("assign", "access", "hex", "token", "key", "url")
N_BASE = 3
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_CANDIDATE = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
TOKEN = re.compile(r"(?:ghp|gho|ghs|ghu)_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,}|xox[abprs]-[A-Za-z0-9-]{20,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")
URL = re.compile(r"[a-z][a-z0-9+]{1,12}://[^\s/:@]{1,80}:([^\s/@]{6,200})@")
#: Owners from which a value counts as a widely copied example, repositories from which one owner's value is shared, and bits a character from which it looks random.
WIDE_OWNERS, WIDE_REPOSITORIES, LIVE_BITS = 3, 20, 2.5


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, number of kind, end, value) of every span; a span covers its whole match."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX_CANDIDATE.finditer(text)]
    out += [(m.start(), 3, m.end(), m[0]) for m in TOKEN.finditer(text)]
    out += [(m.start(), 4, m.end(), m[0]) for m in KEY.finditer(text)]
    out += [(m.start(), 5, m.end(), m[1]) for m in URL.finditer(text)]
    return out


def bits(value: str) -> float:
    """Entropy of a value's characters, in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


SCANNED = "doc_id bigint, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, found array<struct<value: bigint, random: boolean>>"


def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("value", pa.int64()), ("random", pa.bool_())]))]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for d, o, t in zip(batch.column("doc_id").to_pylist(), batch.column("owner").to_pylist(), batch.column("text"), strict=True):
            found = find(t.as_py() or "")
            base = [f[:3] for f in found if f[1] < N_BASE]
            values = {f[3] for f in found}
            row = (d, o, *(sum(f[1] == k for f in base) for k in range(N_BASE)), sha(joined(base, KINDS)), joined([f[:3] for f in found], KINDS), [{"value": xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass")) - (1 << 63), "random": bits(v) >= LIVE_BITS} for v in sorted(values)])
            for column, value in zip(out, row, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)


def ownership(scanned: DataFrame) -> DataFrame:
    """value, distinct owners and repositories (documents, by id): every step reduces before it shuffles."""
    each = scanned.select("owner", "doc_id", F.explode("found.value").alias("value")).groupBy("value", "owner", "doc_id").agg(F.lit(1).alias("one"))
    pairs = each.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return pairs.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def secret_scan(docs: DataFrame, owner: str = "source") -> DataFrame:
    """The base columns and spans of each document, with its values' verdicts: live (one owner, few repositories, random), shared (few owners, or many repositories of one), example (widely copied or not random)."""
    base = documents(docs, owner) if owner in [c.lower() for c in docs.columns] else documents(docs).withColumn(owner, F.lit(None).cast("string"))
    scanned = staged(base.select("doc_id", F.col(owner).cast("string").alias("owner"), "text").mapInArrow(scan, SCANNED).withColumn("row", F.monotonically_increasing_id()), "secrets")
    hit = scanned.where("size(found) > 0").select("row", F.explode("found").alias("f")).select("row", "f.value", "f.random")
    verdict = (
        hit.join(ownership(scanned), "value")
        .withColumn("verdict", F.when((F.col("owners") >= WIDE_OWNERS) | ~F.col("random"), "example").when((F.col("owners") == 1) & (F.col("repositories") < WIDE_REPOSITORIES), "live").otherwise("shared"))
        .groupBy("row")
        .agg(*(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("live", "shared", "example")), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"))
    )
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_live", "n_shared", "n_example", "most_owners", "most_repositories")]
    return scanned.join(verdict, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", *counts)


op6 = secret_scan
