"""Near-duplicate detection by a chosen-path set-similarity join.

A document is its set of word shingles. Equal sets are one class. Class representatives walk down independent trees: at
each level a node branches by two minwise tokens, so a pair of similarity s shares each child with probability s, and
meets in a tree with at least 0.93 at s = 0.8; four trees miss a link with less than 2 in 100,000. Nodes are split until
they are small, small ones are compared exhaustively on sketches, and candidate pairs are confirmed on the full sets.

Large groups of near copies can't be split by tokens and must not be compared pair by pair. So representatives are
first linked to one chosen member of their nodes (the most similar one); members that this has joined are one component,
nodes of one component are dropped, and in the nodes left only members of different components are compared: on sketches,
and those with a likely partner on their full sets, within the node, which gives one link for two components. Nodes are
split further as long as they are large and no component fills half of them, down to DEPTH levels. One that stays large
is dealt out in blocks: groups of its largest component meet each group of other members, and these meet each other.

Null, empty and blank texts have empty sets: linked with nothing. Rows with a null doc_id are linked with nothing and
kept. Rows that share a doc_id are one node. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, mix, source_bytes, staged, trim
from .components import components
from .words import groups, hashed_words

TREES, DEPTH, BRANCH, SMALL = 4, 12, 2, 2048
#: Levels whose minwise tokens have 64 bits; below them a token is a byte of the sketch.
MARKED = 3
#: Rounds in which components are joined by their most similar members, before what is left is compared exhaustively.
MERGES = 2
#: Members of a group of a node that stays large; a block holds two groups.
BLOCK = 2048
#: Entries of a matrix of intersections that are held at once.
TILE = 1 << 22
SKETCH = 128
#: Links are looked for from this estimate on: five deviations of the sketch below 0.8.
MARGIN = 0.18
PART_BYTES = 4 << 20
#: Ids of up to so many candidate documents are broadcast (8 bytes each); more are joined.
BROADCAST_IDS = 2_000_000

_R = np.random.default_rng(20260726)
_MULT = _R.integers(1 << 62, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _R.integers(0, 1 << 63, SKETCH, dtype=np.uint64)


def sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(size of each text's set, 48-bit elements, sorted within each text)."""
    sizes, codes, hashes = hashed_words(texts)
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    word = mix(hashes.astype(np.uint64))[codes]
    n = max(0, len(word) - shingle + 1)
    h = word[:n].copy()
    for j in range(1, shingle):
        h = mix(h * np.uint64(31) + word[j : n + j])
    inside = doc[:n] == doc[shingle - 1 :]
    keys = (doc[:n][inside] << np.uint64(48)) | (h[inside] >> np.uint64(16))
    stops = np.cumsum(sizes)
    short = []
    for i in np.flatnonzero((sizes > 0) & (sizes < shingle)).tolist():  # the whole sequence is the one shingle
        x = np.uint64(sizes[i])
        for w in word[stops[i] - sizes[i] : stops[i]]:
            x = mix(np.array([x * np.uint64(31) + w], np.uint64))[0]
        short.append((np.uint64(i) << np.uint64(48)) | (x >> np.uint64(16)))
    keys = np.unique(np.concatenate([keys, np.array(short, np.uint64)]))
    return np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=len(sizes)), keys & np.uint64((1 << 48) - 1)


SETS = "doc_id bigint, n_shingles bigint, digest binary, sketch binary, marks array<bigint>"


def sketcher(shingle: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = TREES * MARKED * BRANCH
        with np.errstate(over="ignore"):
            for batch in batches:
                for ids, texts in groups(batch.column("doc_id").to_pylist(), batch.column("text"), PART_BYTES):
                    size, x = sets(texts, shingle)
                    full = np.flatnonzero(size)
                    start = (np.cumsum(size) - size)[full]
                    low = np.zeros((SKETCH, len(ids)), np.uint64)
                    if len(full):
                        for f in range(SKETCH):
                            low[f, full] = np.minimum.reduceat(x * _MULT[f] + _PLUS[f], start)
                        a, b = (np.add.reduceat(mix(x + np.uint64(s)), start) for s in (1, 2))
                    low = mix(low)
                    sketch = np.ascontiguousarray((low >> np.uint64(56)).astype(np.uint8).T)
                    marks = np.ascontiguousarray(low[:used].T).astype(np.int64)
                    digest: list[bytes | None] = [None] * len(ids)
                    for j, i in enumerate(full.tolist()):
                        digest[i] = a[j].tobytes() + b[j].tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), pa.array([s.tobytes() for s in sketch], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * used, pa.int32()), pa.array(marks.ravel()))],
                        ["doc_id", "n_shingles", "digest", "sketch", "marks"],
                    )
        trim()

    return run


def child(path: Column, tree: Column, level: int, j: int) -> Column:
    if level < MARKED:
        f = tree * (MARKED * BRANCH) + (level * BRANCH + j)
        token = F.element_at("marks", (f + 1).cast("int"))
    else:
        f = TREES * BRANCH * MARKED + (level - MARKED) * TREES * BRANCH + tree * BRANCH + j
        token = F.substr(F.col("sketch"), (f % SKETCH + 1).cast("int"), F.lit(1))
    return F.struct(tree.alias("tree"), F.xxhash64(path, tree, F.lit(level), F.lit(j), token).alias("path"))


def similar(least: float) -> Callable:
    """Rows a, b, x, y (sketches) to a, b and the share of equal sketch bytes, where it reaches `least`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("x", "y"))
            share = (x == y).mean(1) if len(x) else np.zeros(0)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share)], ["a", "b", "share"])
            yield out.filter(pa.array(share >= least))

    return run


def by_node(group: Callable, out: list[str]) -> Callable:
    """Rows of one node and block, which stand together, to group(node, block, columns)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and (rows := group(*now, *zip(*held, strict=True))):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], out)

        for batch in batches:
            for node, block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (node, block) != now:
                    yield from close()
                    now, held = (node, block), []
                held.append(row)
        yield from close()
        trim()

    return run


def involved(least: float) -> Callable:
    """Members of a node with a likely partner in another component."""

    def group(node: int, block: int, reps: tuple, comps: tuple, sketches: tuple) -> list[tuple]:
        comp, sketch = np.array(comps), np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, SKETCH)
        order = np.argsort(comp, kind="stable")
        comp, sketch = comp[order], sketch[order]
        stop = np.searchsorted(comp, comp, side="right").tolist()
        some = np.zeros(len(comp), bool)
        for i, j in enumerate(stop):
            if j < len(comp):
                hit = (sketch[j:] == sketch[i]).sum(1, dtype=np.int16) >= least * SKETCH
                if hit.any():
                    some[i] = True
                    some[j:] |= hit
        return [(node, block, reps[i], comps[i]) for i in order[some].tolist()]

    return by_node(group, ["path", "block", "rep", "comp"])


def linking(percent: int) -> Callable:
    """Links between components in a node, one for each two, by the exact intersections of all its members' sets."""

    def group(node: int, block: int, reps: tuple, comps: tuple, elements: tuple) -> list[tuple]:
        own = [unpacked(e) for e in elements]
        n = np.array([len(x) for x in own])
        row = np.repeat(np.arange(len(own)), n)
        _, column, uses = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        shared = uses > 1
        number = np.cumsum(shared) - 1
        row, column = row[shared[column]], number[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        comp, found = np.array(comps), []
        wide = max(64, TILE // len(own))  # columns, and rows, worked on at once
        for top in range(0, len(own), wide):
            both = np.zeros((min(wide, len(own) - top), len(own)), np.float32)
            for a in range(0, int(shared.sum()), wide):
                i, j = np.searchsorted(column, (a, a + wide))
                m = np.zeros((len(own), wide), np.float32)
                m[row[i:j], column[i:j] - a] = 1
                both += m[top : top + wide] @ m.T
            own_n, own_comp = n[top : top + wide, None], comp[top : top + wide, None]
            i, j = np.nonzero((both > 0) & (100 * both >= percent * (own_n + n[None, :] - both)) & (own_comp < comp[None, :]))
            if len(i):
                _, first = np.unique(np.stack([comp[i + top], comp[j]]), axis=1, return_index=True)
                found += [(comps[x + top], comps[y], reps[x + top], reps[y]) for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True)]
        return [x[2:] for x in {x[:2]: x for x in found}.values()]

    return by_node(group, ["a", "b"])


def blocks(rep: Column, in_main: Column, most: Column, rest: Column) -> Column:
    """The blocks of a node in which a member stands: each pair of a group of main members and one of others, and of two groups of others."""
    own, of = (F.ceil(x / BLOCK).cast("bigint") for x in (most, rest))
    i, j = F.pmod(F.xxhash64(rep), own), F.pmod(F.xxhash64(rep), of)
    among = F.filter(F.sequence(F.lit(0).cast("bigint"), of - 1), lambda x: x != j)
    pairs = F.transform(among, lambda x: own * of + F.least(x, j) * of + F.greatest(x, j))
    with_main = F.transform(F.sequence(F.lit(0).cast("bigint"), own - 1), lambda x: x * of + j)
    return F.when(in_main, F.sequence(i * of, i * of + of - 1)).otherwise(F.concat(with_main, pairs))


def full_sets(base: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """rep and its whole set, of the documents in ids (rep). A repeated doc_id gives one of its sets for each text."""
    sc = base.sparkSession.sparkContext
    n = ids.count()
    wanted = None
    if n <= BROADCAST_IDS:
        wanted = sc.broadcast(np.sort(ids.toPandas()["rep"].to_numpy(np.int64)))
    else:
        base = base.join(ids.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(np.isin(batch.column("doc_id").to_numpy(zero_copy_only=False), wanted.value)))
            for own, texts in groups(batch.column("doc_id").to_pylist(), batch.column("text"), PART_BYTES):
                size, x = sets(texts, shingle)
                stop = np.cumsum(size)
                raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6])
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([raw[b - n : b].tobytes() for n, b in zip(size, stop, strict=True)], pa.binary())], ["rep", "elements"])

    return base.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "rep bigint, elements binary")


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def confirm(percent: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                n, m = len(x) // 6, len(y) // 6
                ok = 100 * min(n, m) >= percent * max(n, m)
                if ok:
                    both = len(np.intersect1d(unpacked(x), unpacked(y), assume_unique=True))
                    ok = both > 0 and 100 * both >= percent * (n + m - both)
                keep.append(ok)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def confirmed(base: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs a, b whose full sets reach the similarity."""
    pairs = staged(pairs.select("a", "b").distinct(), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    own = staged(full_sets(base, ids, shingle), "sets")
    joined = pairs.join(own.select(F.col("rep").alias("a"), F.col("elements").alias("x")), "a").join(own.select(F.col("rep").alias("b"), F.col("elements").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(confirm(percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    base = documents(docs)
    least = percent / 100 - MARGIN
    sketched = staged(base.mapInArrow(sketcher(shingle), SETS), "sketches")
    classes = sketched.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("marks").alias("marks"))
    # a representative can stand for several classes if its doc_id is on several rows
    reps = staged(classes.select("rep", "sketch", "marks"), "reps")
    tree = F.explode(F.array(*(child(F.lit(0).cast("bigint"), F.lit(t), 0, j) for t in range(TREES) for j in range(BRANCH)))).alias("n")
    rows = staged(reps.select("rep", tree).select("rep", "n.tree", "n.path").distinct(), "nodes")
    sketch = reps.select("rep", "sketch")

    def stars(rows: DataFrame, seed: int) -> DataFrame:
        """a, b and share: members of nodes and the chosen member of another component, where similar."""
        chosen = rows.groupBy("path").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("rep", "comp"), F.xxhash64("rep", "path", F.lit(seed))).alias("to")).where("lo < hi").select("path", "to")
        pairs = rows.join(chosen, "path").where("comp <> to.comp").select(F.col("rep").alias("a"), F.col("to.rep").alias("b"))
        both = pairs.select("a", "b").distinct().join(sketch.select(F.col("rep").alias("a"), F.col("sketch").alias("x")), "a").join(sketch.select(F.col("rep").alias("b"), F.col("sketch").alias("y")), "b")
        near = both.select("a", "b", "x", "y").mapInArrow(similar(least), "a bigint, b bigint, share double")
        return staged(near, "stars")

    # first each representative with the most similar chosen member of its nodes
    near = stars(rows.withColumn("comp", F.col("rep")), 0)
    ends = near.select("a", "b", "share", F.explode(F.array("a", "b")).alias("rep"))
    best = ends.groupBy("rep").agg(F.max_by(F.struct("a", "b"), F.struct("share", "a", "b")).alias("p")).select("p.a", "p.b")
    links = staged(confirmed(base, best, shingle, percent), "links")
    joined = components(links)
    # then components with components, by their most similar members, so that a large group becomes one
    for seed in range(1, MERGES + 1):
        linked = rows.join(joined.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "rep")
        of = joined.select("node", "component")
        near = stars(linked, seed).join(of.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(of.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
        best = near.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.max_by(F.struct("a", "b"), F.struct("share", "a", "b")).alias("p")).select("p.a", "p.b")
        links = staged(links.unionAll(confirmed(base, best, shingle, percent)), "links")
        joined = components(links)
    # what is left: nodes with members of several components
    labelled = reps.join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left").select("rep", "sketch", "marks", F.coalesce("component", "rep").alias("comp"))
    rows = labelled.select("rep", "comp", "sketch", tree).select("rep", "n.tree", "n.path", "comp", "sketch")
    leaves = []
    rows = staged(rows, "nodes")
    for level in range(1, DEPTH + 1):
        own = rows.groupBy("path", "comp").agg(F.count("*").alias("c"))
        size = own.groupBy("path").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("comp", F.struct("c", "comp")).alias("main")).where("most < n")
        rows = rows.join(size, "path")
        # tokens don't part a node that one component fills by half
        done = F.lit(level == DEPTH) | (F.col("n") <= SMALL) | (2 * F.col("most") >= F.col("n"))
        leaves.append(rows.where(done).select("path", "n", "most", "main", "rep", "comp", "sketch"))
        rows = rows.where(~done).select("rep", "tree", "path", "comp", "sketch")
        if level < MARKED:
            rows = rows.join(reps.select("rep", "marks"), "rep")
        below = F.explode(F.array(*(child(F.col("path"), F.col("tree"), level, j) for j in range(BRANCH)))).alias("x")
        rows = staged(rows.select("rep", "comp", "sketch", below).select("rep", "x.tree", "x.path", "comp", "sketch").distinct(), "nodes")
        if level == DEPTH or rows.isEmpty():
            break
    leaf = leaves[0]
    for x in leaves[1:]:
        leaf = leaf.unionAll(x)
    dealt = leaf.select("path", F.explode(blocks(F.col("rep"), F.col("comp") == F.col("main"), F.col("most"), F.col("n") - F.col("most"))).alias("block"), "rep", "comp", "sketch")
    parts = max(12, -(-source_bytes(docs) // (8 << 20)))

    def together(rows: DataFrame, last: str) -> DataFrame:
        return rows.select("path", "block", "rep", "comp", last).repartition(parts, "path", "block").sortWithinPartitions("path", "block")

    some = staged(together(dealt, "sketch").mapInArrow(involved(least), "path bigint, block bigint, rep bigint, comp bigint").distinct(), "involved")
    own = staged(full_sets(base, some.select("rep").distinct(), shingle), "sets")
    links = links.unionAll(together(some.join(own, "rep"), "elements").mapInArrow(linking(percent), "a bigint, b bigint"))
    joined = staged(components(links), "components")
    class_of = classes.select("digest", "rep").join(joined, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = sketched.select("doc_id", "n_shingles", "digest").join(class_of, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op7(docs: DataFrame, shingle: int = 2) -> DataFrame:
    return near_duplicates(docs, shingle).withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The rows of docs that stand first in their component, all their columns as they are."""
    gone = staged(op7(docs, shingle).where("not kept").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    names = {c.lower(): c for c in docs.columns}
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col(f"`{names['doc_id']}`").cast("bigint") == F.col("_gone"), "left_anti")
