"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Words are runs of letters, digits or marks, told apart by shape (lower, Title, UPPER, digits, marks) and lower-cased bytes.
Random indexing: every word has a fixed sparse +1/-1 index vector from its 64-bit hash, and its context vector is the sum
of the index vectors of all its neighbours over all documents. A word that is at least one in COMMON of all words of the
corpus has a context vector of its own, so there are COMMON of them at most, at every size; rarer words share the context
vector of their shape and length, which is summed over all of them. A document is the mean and the spread of its words'
context vectors and the mean product of neighbouring words' vectors. The network (one hidden layer) is fitted with numpy
on at most `sample` labelled documents of the learning folds, the first by a hash of their id, and its logits are divided by
a temperature fitted on every fifth of them.

Null and empty texts pool to zeros and are scored like any other. Documents without a label are scored, never learned;
of a document with several labels the largest counts. Without labelled documents, or with one class alone, every
score is that class's share (0.5 if there is none). Labels, lang, source and doc_id are never inputs of a score. Rows that
repeat count each time. Very long texts are read whole. Other columns play no part. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .frames import cut, fold, table

SHAPES, LENGTHS, DIM = 5, 8, 48
#: Vectors that rarer words share, after those of the common words.
SHARED = SHAPES * LENGTHS
COMMON = 10_000
#: Distinct words that a task holds before it hands their counts on.
HELD = 1 << 18
#: Length of a document's vector.
POOLED = 3 * DIM
#: Rows of the context matrix in one shuffled record, and parts in which records of the same rows are first summed.
PACK, SALTS = 256, 256
#: Labelled documents that the network is fitted on, at most.
SAMPLE = 6000
#: 0 white space, 1 letters (and any byte of a longer character), 2 digits, 3 marks.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[K.SPACE] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
#: 1 for A-Z, 2 for a-z.
_CASE = np.zeros(256, np.uint8)
_CASE[65:91] = 1
_CASE[97:123] = 2
#: Shape by class and the cases that a word has: 0 lower, 1 Title, 2 UPPER, 3 digits, 4 marks.
_SHAPE = np.array([[0] * 4, [0, 2, 0, 1], [3] * 4, [4] * 4], np.int64)


def index_vectors(vocabulary: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Two places and two signs for each word of the vocabulary and each shared vector, from their hashes alone."""
    keys = np.concatenate((vocabulary, np.arange(SHARED, dtype=np.uint64)))
    h = [K.mix(keys ^ np.uint64(salt)) for salt in (0x51ED270B, 0xA24BAED4)]
    return [(x % np.uint64(DIM)).astype(np.int64) for x in h], [np.where(x >> np.uint64(63), 1.0, -1.0) for x in h]


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash, number of the shared vector and text number of every word."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none.view(np.uint64), none, none
    kind = _CLASS[data]
    new = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[at[:-1][at[:-1] < len(data)]] = True
    starts = np.flatnonzero(new)
    cases = np.bitwise_or.reduceat(_CASE[data], starts)
    good = np.flatnonzero(kind[starts] != 0)
    ends = np.append(starts[1:], len(data))[good]
    starts = starts[good]
    n = ends - starts
    shape = _SHAPE[kind[starts], cases[good]]
    shape -= (shape == 2) & (n == 1)
    words = K.span_hashes(K.lower_ascii(data), starts, ends)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(starts, at)))
    return K.mix(words ^ shape.view(np.uint64)), shape * LENGTHS + np.minimum(n, LENGTHS) - 1, owner


class Vocabulary:
    """Word hashes in order, found by their upper bits: a table says where the words of each beginning start."""

    BITS = 17

    def __init__(self, words: np.ndarray):
        self.words = words
        starts = np.searchsorted(words >> np.uint64(64 - self.BITS), np.arange((1 << self.BITS) + 1, dtype=np.uint64))
        self.starts, self.most = starts[:-1].astype(np.int32), int(np.diff(starts).max())

    def rows(self, words: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """The row of the context matrix of each word."""
        out = len(self.words) + shared
        start = self.starts[words >> np.uint64(64 - self.BITS)]
        for k in range(self.most):
            at = np.minimum(start + k, len(self.words) - 1)
            hit = np.flatnonzero(self.words[at] == words)
            out[hit] = at[hit]
        return out


def common_words(docs: DataFrame, common: int = COMMON) -> np.ndarray:
    """The hashes, sorted, of the words that are one in `common` of all words or more; these alone come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(words)
            words = words[order]
            first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
            return words[first], np.add.reduceat(n[order], first)

        def rows(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            data, at = K.utf8(batch.column(0))
            for i, j in K.blocks(at):
                words = np.sort(tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])[0])
                if not len(words):
                    continue
                first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
                held.append((words[first], np.diff(np.append(first, len(words)))))
                size += len(first)
                if size > 4 * HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD:
                        yield rows(*held[0])
                        held, size = [], 0
        if held:
            yield rows(*merged())

    counted = cut(docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n").alias("n")).first()["n"] or 0
    found = counted.where(F.col("n") * common >= total).select("word").collect()
    return np.sort(np.array([r["word"] for r in found], np.int64).view(np.uint64))


class Contexts(NamedTuple):
    vocabulary: Vocabulary
    matrix: np.ndarray


def contexts(docs: DataFrame, common: int = COMMON) -> Contexts:
    """The common words and the context vectors, of unit length, of them and of the shared rows, from all texts.

    Sums of the same rows are first added up in SALTS parts, then over the parts; the matrix is all that is gathered.
    """
    vocabulary = Vocabulary(common_words(docs, common))
    size = len(vocabulary.words) + SHARED
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors(held.value.words)
        sums = np.zeros(size * DIM)
        for batch in batches:
            data, at = K.utf8(batch.column(0))
            for i, j in K.blocks(at):
                words, shared, owner = tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
                row = held.value.rows(words, shared)
                near = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) > 1 else np.zeros(0, np.int64)
                for a, b in ((row[near], row[near + 1]), (row[near + 1], row[near])):
                    for c in range(2):
                        sums += np.bincount(a * DIM + place[c][b], weights=sign[c][b], minlength=size * DIM)
        whole = np.zeros(-(-size // PACK) * PACK * DIM)
        whole[: size * DIM] = sums
        packed = [(k, x) for k, x in enumerate(whole.reshape(-1, PACK * DIM)) if x.any()]
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in packed], pa.int32()), pa.array([salt] * len(packed), pa.int32()), pa.array([_summed(x) for _, x in packed], pa.binary())], ["pack", "salt", "sums"])

    def add(key: tuple[pa.Scalar, ...], group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PACK * DIM)
        for batch in group:
            for x in batch.column("sums"):
                total += np.frombuffer(x.as_buffer(), np.int64 if len(x.as_buffer()) == 8 * len(total) else np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([_summed(total)], pa.binary())], ["pack", "sums"])

    parts = docs.select("text").mapInArrow(count, "pack int, salt int, sums binary").groupBy("pack", "salt").applyInArrow(add, "pack int, sums binary")
    out = np.zeros((-(-size // PACK), PACK * DIM))
    for r in parts.groupBy("pack").applyInArrow(add, "pack int, sums binary").collect():
        out[r["pack"]] = np.frombuffer(r["sums"], np.int64 if len(r["sums"]) == 8 * PACK * DIM else np.int32)
    out = out.reshape(-1, DIM)[:size]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return Contexts(vocabulary, np.divide(out, norm, out=np.zeros_like(out), where=norm > 0).astype(np.float32))


def _summed(sums: np.ndarray) -> bytes:
    """Whole numbers in 32 bits where they fit."""
    return sums.astype(np.int32 if np.abs(sums).max() < 2**31 else np.int64).tobytes()


def pooled(column: pa.Array, learned: Contexts) -> np.ndarray:
    """Mean and spread of the context vectors of each text's tokens, and the mean product of neighbours' vectors."""
    data, at = K.utf8(column)
    out = np.zeros((len(at) - 1, POOLED), np.float32)
    for i, j in K.blocks(at, 1 << 19):
        words, shared, owner = tokens(data[at[i] : at[j]], at[i : j + 1] - at[i])
        if not len(words):
            continue
        vectors = learned.matrix[learned.vocabulary.rows(words, shared)]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        n = np.diff(np.append(first, len(owner)))[:, None]
        mean = np.add.reduceat(vectors, first, axis=0) / n
        square = np.add.reduceat(vectors * vectors, first, axis=0) / n
        out[i + owner[first], :DIM] = mean
        out[i + owner[first], DIM : 2 * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
        near = np.zeros_like(vectors)
        near[1:] = vectors[1:] * vectors[:-1]
        near[first] = 0
        out[i + owner[first], 2 * DIM :] = np.add.reduceat(near, first, axis=0) / n
    return out


class Network:
    """tanh hidden layer, one logit, temperature; fitted by Adam on the cross entropy."""

    def __init__(self, hidden: int = 24, seed: int = 3):
        self.hidden, self.seed, self.t, self.constant = hidden, seed, 1.0, 0.5

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.01) -> Network:
        self.w = None
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        held = np.arange(len(y)) % 5 == 4
        if held.sum() < 20 or len(set(y[~held])) < 2:
            held[:] = False
        self.mu, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-6
        rng = np.random.Generator(np.random.PCG64(self.seed))
        d = x.shape[1]
        self.w = [rng.normal(0, d**-0.5, (d, self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.zeros(1)]
        z, t = (x[~held] - self.mu) / self.sd, y[~held].astype(float)
        first, second = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, rounds + 1):
            a = np.tanh(z @ self.w[0] + self.w[1])
            g = (1 / (1 + np.exp(-np.clip(a @ self.w[2] + self.w[3], -30, 30))) - t) / len(t)
            back = np.outer(g, self.w[2]) * (1 - a * a)
            grads = [z.T @ back + 1e-4 * self.w[0], back.sum(axis=0), a.T @ g + 1e-4 * self.w[2], np.array([g.sum()])]
            for w, m, v, g_ in zip(self.w, first, second, grads, strict=True):
                m += 0.1 * (g_ - m)
                v += 0.001 * (g_ * g_ - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if held.any():
            logit, t, grid = self.logits(x[held]), y[held], np.geomspace(0.25, 8, 41)
            loss = [float(np.logaddexp(0, np.where(t == 1, -logit, logit) / k).mean()) for k in grid]
            self.t = float(grid[int(np.argmin(loss))])
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mu) / self.sd) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.t, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> tuple[Contexts, Network]:
    """The context vectors and the fitted network. At most `sample` rows of (doc_id, quality) come to the driver."""
    learned = contexts(docs)
    chosen = labels.where(learn & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = {r["doc_id"]: r["quality"] for r in chosen.collect()}
    if not known:
        return learned, Network().fit(np.zeros((0, POOLED)), np.zeros(0))
    held = docs.sparkSession.sparkContext.broadcast(learned)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(1), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "x"])

    ids = docs.sparkSession.createDataFrame([(k,) for k in known], "doc_id long")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(pool, "doc_id long, x binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["x"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(len(rows), POOLED)
    return learned, Network().fit(x.astype(float), np.array([known[r["doc_id"]] for r in rows]))


def score(docs: DataFrame, learned: Contexts, network: Network) -> DataFrame:
    """doc_id, score of every row of docs."""
    held = docs.sparkSession.sparkContext.broadcast((learned, network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, network = held.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(network.scores(pooled(batch.column(1), learned).astype(float)), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    found = score(docs, *fit(docs, table(spark, sf_dir, "labels"), ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
