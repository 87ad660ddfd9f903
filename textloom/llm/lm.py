"""Language-model scoring: a gated recurrent model beside a unigram base, over whole documents.

Word counts come from every training document (crc32 of the id mod 10 is not 0). The recurrent model's vocabulary is the
4094 most frequent words, the end and an unknown word; an unknown word's probability is the model's for "unknown" times
the smoothed share of that word among the unknown ones, so the score is a probability of the text itself. Each partition
numbers its words once, in two bytes each, and trains the model on its whole training documents, with the state carried from window to window; the partitions' weights
are averaged in a tree.

Counts of the 2^20 most frequent words are broadcast (a fixed bound); the rest are joined. Null text counts as empty (one
token, the end); a null id counts as the empty string for the held-out rule. Repeated rows each count and get their row.
Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, staged, trim
from .gru import END, UNK, Model
from .words import groups, hashed_words

VOCABULARY, FREQUENT = 4096, 1 << 20
#: Tokens that a task gathers before it trains on them, so that lanes come out about equally long.
HELD = 2_200_000
#: Bytes of text taken apart at once, and rows of a batch of counts.
PART_BYTES, ROWS = 4 << 20, 100_000
BLOCK = 4096


def held_out(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i in ids], bool)


def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of word hashes in training documents, one row a word and flush; the null hash counts the ends."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    ends = size = 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        if not held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return h, np.bincount(at, np.concatenate([x[1] for x in held]), len(h)).astype(np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        h, c = summed()
        for i in range(0, len(h), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + ROWS]), pa.array(c[i : i + ROWS])], ["h", "c"])

    for batch in batches:
        for ids, texts in groups(batch.column("doc_id").to_pylist(), batch.column("text"), PART_BYTES):
            sizes, codes, hashes = hashed_words(texts)
            train = ~held_out(ids)
            ends += int(train.sum())
            n = np.bincount(codes[np.repeat(train, sizes)], minlength=len(hashes))
            held.append((hashes[n > 0], n[n > 0]))
            size += len(held[-1][0])
            if size > 1_000_000:
                held = [summed()]
                size = len(held[0][0])
                if size > 500_000:
                    yield from flush()
                    held, size = [], 0
    yield from flush()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([ends], pa.int64())], ["h", "c"])
    trim()


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows h, c as two packed columns, one row a batch."""
    for batch in batches:
        h, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array([h.astype("<i8").tobytes()], pa.binary()), pa.array([c.astype("<i8").tobytes()], pa.binary())], ["h", "c"])


class Table:
    """Counts of the most frequent words by hash, and their place in the vocabulary."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, vocabulary: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.number = np.full(len(hashes), UNK, np.int32)
        self.number[np.searchsorted(self.hashes, vocabulary)] = np.arange(2, 2 + len(vocabulary))

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or -1, vocabulary number) of each hash."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64), np.full(len(hashes), UNK, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        return np.where(known, self.counts[at], -1), np.where(known, self.number[at], UNK)


def with_end(sizes: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
    """Word numbers of each document, with the end."""
    stops = np.cumsum(sizes)
    return np.split(np.insert(numbers, stops, END), (stops + np.arange(1, len(sizes) + 1))[:-1]) if len(sizes) else []


COUNTED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, n_unk bigint, base_log double, unk_log double, rare array<struct<h: bigint, n: bigint>>, numbers binary"
WEIGHTS = "block int, task bigint, w double, vec binary"
_RARE = pa.struct([("h", pa.int64()), ("n", pa.int64())])
_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(_RARE), pa.binary(), pa.int32(), pa.int64(), pa.float64(), pa.binary()]
_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "n_unk", "base_log", "unk_log", "rare", "numbers", "block", "task", "w", "vec"]


def filled(columns: list[pa.Array], first: int) -> pa.RecordBatch:
    """A batch of documents or of weights: the other one's columns are null."""
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([columns[i - first].cast(t) if 0 <= i - first < len(columns) else pa.nulls(n, t) for i, t in enumerate(_TYPES)], _NAMES)


def counted(table: Table, ids: list, sizes: np.ndarray, codes: np.ndarray, hashes: np.ndarray) -> tuple[list[pa.Array], np.ndarray]:
    """The columns of documents that need no model, without their word numbers, and these numbers, end to end."""
    c, number = table.of(hashes)
    n = len(ids)
    doc = np.repeat(np.arange(n), sizes)
    ln = np.log10(np.maximum(c, 0) + 0.1)
    here, unk = (c >= 0)[codes], (number == UNK)[codes]
    total = lambda keep, w=None: np.bincount(doc[keep], None if w is None else w[codes[keep]], n)
    pair = np.unique(doc[~here].astype(np.int64) * len(hashes) + codes[~here], return_counts=True)
    rare = pa.StructArray.from_arrays([pa.array(hashes[pair[0] % max(1, len(hashes))]), pa.array(pair[1])], fields=list(_RARE))
    offsets = np.searchsorted(pair[0] // max(1, len(hashes)), np.arange(n + 1)).astype(np.int32)
    columns = [pa.array(ids, pa.int64()), pa.array(held_out(ids)), pa.array(sizes + 1, pa.int64()), pa.array(total(here & (c > 0)[codes]), pa.int64()), pa.array(total(unk), pa.int64())]
    columns += [pa.array(x.astype(np.float64)) for x in (total(here, ln), total(here & unk, ln))] + [pa.ListArray.from_arrays(pa.array(offsets), rare)]
    return columns, number[codes]


def learner(table, model) -> Callable:  # noqa: ANN001  broadcasts
    """Documents counted and numbered, and the weights that the partition's training documents give the model."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model.__new__(Model)
        m.__dict__.update({k: v.copy() if isinstance(v, np.ndarray) else v for k, v in model.value.__dict__.items()})
        state, held, waiting, tokens = None, [], 0, 0
        for batch in batches:
            for ids, texts in groups(batch.column("doc_id").to_pylist(), batch.column("text"), PART_BYTES):
                sizes, codes, hashes = hashed_words(texts)
                columns, numbers = counted(table.value, ids, sizes, codes, hashes)
                docs = with_end(sizes, numbers)
                yield filled([*columns, pa.array([d.astype("<u2").tobytes() for d in docs], pa.binary())], 0)
                for out, doc in zip(held_out(ids), docs, strict=True):
                    if not out:
                        held.append(doc)
                        waiting += len(doc)
                if waiting > HELD:
                    state, held, waiting, tokens = m.train(held, state=state), [], 0, tokens + waiting
        if held:
            m.train(held, state=state)
            tokens += waiting
        trim()
        if tokens:
            flat = m.flat()
            parts = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
            task = TaskContext.get().partitionId()
            yield filled([pa.array(range(len(parts)), pa.int32()), pa.array([task] * len(parts), pa.int64()), pa.array([float(tokens)] * len(parts)), pa.array([(p.astype(np.float64) * tokens).tobytes() for p in parts], pa.binary())], 9)

    return run


def added(keys: tuple, table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(v, np.float64) for v in table.column("vec").to_pylist()], axis=0)
    return pa.table({"block": pa.array([keys[0].as_py()], pa.int32()), "task": pa.array([keys[1].as_py() if len(keys) > 1 else 0], pa.int64()), "w": [float(sum(table.column("w").to_pylist()))], "vec": pa.array([total.tobytes()], pa.binary())})


def averaged(weights: DataFrame, partitions: int) -> np.ndarray | None:
    """The mean weights by trained tokens, summed in groups of about the root of the number of tasks, then all."""
    few = max(1, math.isqrt(partitions))
    part = weights.withColumn("task", F.col("task") % few).groupBy("block", "task").applyInArrow(added, WEIGHTS)
    rows = sorted(part.groupBy("block").applyInArrow(added, WEIGHTS).collect())
    return np.concatenate([np.frombuffer(r.vec, np.float64) / r.w for r in rows]) if rows else None


def scorer(model) -> Callable:  # noqa: ANN001  a broadcast
    """Counted documents with the model's log10 probability in place of their numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, list[np.ndarray]]] = []
        waiting = 0

        def flush() -> Iterator[pa.RecordBatch]:
            scores = model.value.score([d for _, docs in held for d in docs]) / math.log(10)
            at = 0
            for batch, docs in held:
                yield batch.append_column("model_log", pa.array(scores[at : at + len(docs)]))
                at += len(docs)
            held.clear()

        for batch in batches:
            docs = [np.frombuffer(x, "<u2") for x in batch.column("numbers").to_pylist()]
            held.append((batch.drop_columns(["numbers"]), docs))
            waiting += sum(map(len, docs))
            if waiting > HELD:
                yield from flush()
                waiting = 0
        yield from flush()
        trim()

    return run


def frequent_words(words: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(the count from which words are frequent, their hashes, their counts): as many as keep within FREQUENT, in packed blocks of some 16 bytes a word."""
    least, running = 1 << 62, 0
    for c, n in words.groupBy("c").count().orderBy(F.desc("c")).limit(FREQUENT).toLocalIterator():
        running += n
        if running > FREQUENT:
            break
        least = c
    rows = words.where(F.col("c") >= least).select("h", "c").mapInArrow(blocks, "h binary, c binary").collect()
    return least, *(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[i], "<i8") for r in rows)]) for i in (0, 1))


def lm_score(docs: DataFrame) -> DataFrame:
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    base = documents(docs)
    counts = staged(base.mapInArrow(count, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")), "counts")
    words = counts.where("h is not null")
    ends, n_words, v_words = counts.agg(F.sum(F.expr("if(h is null, c, 0)")), F.sum(F.expr("if(h is null, 0, c)")), F.count("h")).first()
    ends, n_words = ends or 0, n_words or 0
    n_all, v_all = n_words + ends, v_words + (ends > 0)
    least, hashes, n_of = frequent_words(words)
    top = np.lexsort((hashes, -n_of))[: VOCABULARY - 2]
    n_unk, v_unk = n_words - int(n_of[top].sum()), v_words - len(top)
    unk_mass = n_unk + 0.1 * (v_unk + 1)
    table = sc.broadcast(Table(hashes, n_of, hashes[top]))
    model = Model(np.concatenate([[ends + 0.1, unk_mass], n_of[top].astype(float)]))
    del hashes, n_of
    learned = base.mapInArrow(learner(table, sc.broadcast(model)), f"{COUNTED}, {WEIGHTS}").withColumn("row", F.monotonically_increasing_id())
    parts = base.rdd.getNumPartitions()
    learned = staged(learned, "learned")
    if (flat := averaged(learned.where("block is not null").select("block", "task", "w", "vec"), parts)) is not None:
        model.load(flat)
    numbered = learned.where("block is null").drop("block", "task", "w", "vec")
    scored = staged(numbered.mapInArrow(scorer(sc.broadcast(model)), f"{COUNTED.replace(', numbers binary', '')}, row bigint, model_log double"), "scores")
    rare = scored.where("size(rare) > 0").select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.n")
    rare = rare.join(words.where(F.col("c") < least), "h", "left").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("rare_log"), F.sum(F.expr("if(c > 0, n, 0)")).alias("rare_known"))
    got = scored.join(rare, "row", "left").withColumns({"rare_log": F.coalesce("rare_log", F.lit(0.0)), "rare_known": F.coalesce("rare_known", F.lit(0))})
    whole = math.log10(n_all + 0.1 * (v_all + 1))
    return got.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("rare_known") + (1 if ends else 0)).alias("n_known"),
        F.lit(n_all).cast("bigint").alias("train_tokens"),
        (F.col("base_log") + F.col("rare_log") + math.log10(ends + 0.1) - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("model_log") + F.col("unk_log") + F.col("rare_log") - F.col("n_unk") * math.log10(unk_mass)).alias("score"),
    )


op3 = lm_score
