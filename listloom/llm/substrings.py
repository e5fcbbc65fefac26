"""Substring dedup by level-wise doubling: runs of words that repeat across documents, found from short to long.

Windows of BASE words that occur in two or more documents are the candidates of the first level. A window of twice the
length is looked at only if both its halves repeated, and so on; the last level joins two overlapping windows into one
of exactly `length` words. Windows below the last level are compared by 24 bits within a bucket, which can only let
too many through; the last level compares 96 bits. At that level each window gets the smallest doc_id that has it, and
every word under a window that also starts in a document with a smaller doc_id is removed. Windows are judged on the
input, not on what is left.

Words are runs of anything but \\x20 and \\x09-\\x0D, unchanged. Null and empty texts have no words and keep an empty
text; documents of fewer than `length` words lose nothing. Rows that repeat a doc_id count as one document and each
gives its own row; a null doc_id counts as larger than all others; both spread over the chunks by their text and the
piece of the file they stand in. Very long texts are read whole, in one chunk.
Other columns play no part. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from .frames import table

LENGTH = 13
BASE = 4
_LAST = np.dtype([("a", np.uint64), ("b", np.uint32), ("doc", np.int64)])
_LAST_KIND = X.quotient(_LAST)
_NO_ID = np.iinfo(np.int64).max


def levels(length: int, base: int = BASE) -> list[int]:
    """Window lengths: base, doubled while they fit, then `length` itself."""
    out = []
    while base < length:
        out.append(base)
        base *= 2
    return [*out, length]


class _Chunk:
    """Word hashes and document ids of a chunk."""

    def __init__(self, docs: pa.Table):
        self.ids = np.array(docs.column("doc_id").fill_null(_NO_ID).to_numpy())
        self.data, self.at = K.utf8(docs.column("text"))
        starts, ends, self.owner = K.words(self.data, self.at)
        self.words = K.span_hashes(self.data, starts, ends)
        self.doc = self.ids[self.owner]

    def windows(self, length: int, which: int = 0) -> np.ndarray:
        return K.window_hashes(self.words, length, which)

    def whole(self, length: int) -> np.ndarray:
        return K.whole_windows(self.owner, length)

    def repeats(self, length: int, answered: np.ndarray, plan: X.Plan) -> np.ndarray:
        """Which windows occur in another chunk (as answered) or in two documents of this one; a superset."""
        keys, whole = X.low_keys(self.windows(length), plan), self.whole(length)
        local = X.several(keys[whole], self.doc[: len(keys)][whole])
        return whole & (X.among(keys, answered) | X.among(keys, local))

    def candidates(self, length: int, below: int, answered: np.ndarray, plan: X.Plan) -> np.ndarray:
        """Which windows of `length` words have both their first and last `below` words repeated."""
        good, n = self.repeats(below, answered, plan), len(self.words) - length + 1
        if n <= 0:
            return np.zeros(0, bool)
        both = good[:n] & good[length - below : length - below + n]
        for at in range(below, length - below, below):
            both &= good[at : at + n]
        return both & self.whole(length)


def _last(chunk: int, c: _Chunk, candidates: np.ndarray, length: int, plan: X.Plan) -> pa.Table:
    """The distinct windows of a chunk with the smallest doc_id that has each."""
    where = np.flatnonzero(candidates)
    a, b, doc = c.windows(length)[where], (c.windows(length, 1)[where] >> K.U64(32)).astype(np.uint32), c.doc[where]
    order = np.lexsort((doc, b, a))
    a, b, doc = a[order], b[order], doc[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    rows = np.zeros(int(first.sum()), _LAST)
    rows["a"], rows["b"], rows["doc"] = a[first], b[first], doc[first]
    return X.sent(chunk, rows, _LAST_KIND, plan)


def _older(values: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows that another chunk has in a document with a smaller doc_id."""
    order = np.lexsort((values["doc"], values["b"], values["a"]))
    v = values[order]
    first = np.ones(len(v), bool)
    first[1:] = (v["a"][1:] != v["a"][:-1]) | (v["b"][1:] != v["b"][:-1])
    least = v["doc"][np.flatnonzero(first)][np.cumsum(first) - 1]
    keep = np.sort(order[v["doc"] > least])
    return keep, values["a"][keep]


KEPT = "doc_id long, n_words long, n_removed long, kept string, times long"


def dedup(docs: DataFrame, length: int = LENGTH, base: int = BASE) -> DataFrame:
    """One row a document: doc_id, n_words, n_removed and the kept words joined by one space.

    The chunks' texts are shuffled once and read again at each level; only packed hashes move between levels.
    """
    chunks, plan = X.chunked(docs)
    steps = levels(length, base)
    by_chunk = chunks.groupBy("chunk")

    def first(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        c = _Chunk(rows)
        if len(steps) == 1:
            return _last(key[0].as_py(), c, c.whole(length), length, plan)
        return X.sent(key[0].as_py(), np.unique(X.low_keys(c.windows(steps[0])[c.whole(steps[0])], plan)), X.LOW_KIND, plan)

    sent = by_chunk.applyInArrow(first, X.SENT)
    for below, step in zip(steps[:-1], steps[1:], strict=True):

        def extend(key: tuple[pa.Scalar, ...], rows: pa.Table, answered: pa.Table, below=below, step=step) -> pa.Table:
            c = _Chunk(rows)
            good = c.candidates(step, below, X.received(answered, X.LOW_KIND, plan), plan)
            if step == length:
                return _last(key[0].as_py(), c, good, length, plan)
            return X.sent(key[0].as_py(), np.unique(X.low_keys(c.windows(step)[good], plan)), X.LOW_KIND, plan)

        sent = by_chunk.cogroup(X.shared(sent, plan).groupBy("chunk")).applyInArrow(_three(extend), X.SENT)

    def remove(key: tuple[pa.Scalar, ...], rows: pa.Table, answered: pa.Table) -> pa.Table:
        c = _Chunk(rows)
        a, whole = c.windows(length), c.whole(length)
        older = X.among(a, X.received(answered, X.HASH_KIND, plan))
        order = np.lexsort((c.doc[: len(a)], a))
        new = np.ones(len(a), bool)
        new[1:] = a[order][1:] != a[order][:-1]
        b = c.windows(length, 1)[order]
        new[1:] |= b[1:] != b[:-1]
        ok = whole[order]
        # The smallest doc_id among this chunk's own whole windows with the same words.
        doc = np.where(ok, c.doc[: len(a)][order], _NO_ID)
        least = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1] if len(a) else doc
        local = np.zeros(len(a), bool)
        local[order] = ok & (doc > least)
        gone = K.covered(np.flatnonzero(whole & (older | local)), length, len(c.words))
        cuts = np.searchsorted(c.owner, np.arange(len(c.ids) + 1))
        removed = np.concatenate(([0], np.cumsum(gone)))
        n_removed = removed[cuts[1:]] - removed[cuts[:-1]]
        kept = []
        for k in range(len(c.ids)):
            words = c.data[c.at[k] : c.at[k + 1]].tobytes().split()
            if n_removed[k]:
                words = [w for w, g in zip(words, gone[cuts[k] : cuts[k + 1]], strict=True) if not g]
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return pa.table({"doc_id": rows.column("doc_id"), "n_words": pa.array(np.diff(cuts), pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string()), "times": rows.column("times")})

    return X.repeated(by_chunk.cogroup(X.exchanged(sent, plan, _LAST_KIND, _older, X.HASH_KIND).groupBy("chunk")).applyInArrow(remove, KEPT))


def _three(f):
    """f with its three first parameters alone, as cogroup counts them."""

    def g(key, rows, answered):
        return f(key, rows, answered)

    return g


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
