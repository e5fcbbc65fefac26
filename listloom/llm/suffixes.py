"""Suffix-array dedup: bytes under strings of LENGTH bytes that start at two or more places of the corpus.

The suffix array is built by linear grouping: suffixes start in groups by their first symbol; groups are taken in
descending order, the previous-smaller pointer of each member is found, and the suffixes pointed at move to a group
just above their old one, by how often they are pointed at. When all groups are done they hold the suffixes by their
longest Lyndon prefix, in order; one ascending pass along the same pointers then emits each group's order, without any
renaming or recursion.

Built over every byte this costs about 8 microseconds a byte, so it is built over symbols that stand for pieces of text:

1. Each string of LENGTH bytes has an anchor, its least 64-byte gram by hash; equal strings have equal anchors at the
   same offset. A run of strings with one anchor is a context: the bytes from its first string's start to its last
   string's end. Only anchors that occur twice anywhere can hold repeats.
2. Contexts become short strings of symbols (the part before the anchor, then pieces of 64 bytes). Buckets of contexts
   are sorted by suffix array; equal neighbours are repeats with all their strings.
3. Contexts that do not repeat as a whole (where a shared passage begins or ends) are checked exactly: their strings
   are compared one by one with each other and with those of one copy of each repeating context.

Between documents only packed hashes move; each chunk sends a value once however often it has it. Hashes decide: two
contexts are equal if all their five 64-bit hashes are, two strings of one chunk by 128 bits, of two chunks by 88. Texts are UTF-8 bytes;
matches never cross documents. Null and empty texts, and those shorter than LENGTH, lose nothing. Repeats within a
document count, overlapping or not. Repeated rows are documents of their own. Very long texts are read whole, in one
chunk. Other columns play no part. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import kernels as K
from .frames import table

LENGTH = 200
GRAM = 64
#: Symbols of a context: what is before the anchor, and pieces of GRAM bytes from the anchor on.
PIECES = 5
_CONTEXT = np.dtype([("s", np.uint64, PIECES)])
#: A string between chunks: 64 bits of one hash and 24 of another, which decide whether two strings are equal.
_STRING = np.dtype([("a", np.uint64), ("b", np.uint32)])


def suffix_array(symbols: np.ndarray) -> list[int]:
    """The suffixes of a sequence of integers in order; a suffix comes before those that it is a prefix of."""
    n = len(symbols)
    if not n:
        return []
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    at = np.repeat(starts, np.diff(np.append(starts, n)))
    sa = order.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group = np.empty(n, np.int64)
    group[order] = at
    place, group = place.tolist(), group.tolist()  # a suffix's place in sa, and where its group begins
    end = dict(zip(starts.tolist(), np.append(starts[1:], n).tolist(), strict=True))
    before = [-1] * n  # previous-smaller pointers
    high = n
    while high:
        low = group[sa[high - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(sa[low:high]) if high - low > 1 else sa[low:high]:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        high = low
        if not pointed:
            continue
        by_count: dict[int, list[int]] = {}
        for j, count in pointed.items():
            by_count.setdefault(count, []).append(j)
        for count in sorted(by_count, reverse=True):
            tails: dict[int, list[int]] = {}
            for j in by_count[count]:
                tails.setdefault(group[j], []).append(j)
            for old, moved in tails.items():
                stop = end[old]
                first = stop - len(moved)
                if first == old:  # the whole group moves: it stays where it is
                    continue
                at_ = stop
                for j in moved:  # to the end of the old group, which becomes a group of its own
                    at_ -= 1
                    other, spot = sa[at_], place[j]
                    sa[spot], place[other] = other, spot
                    sa[at_], place[j] = j, at_
                    group[j] = first
                end[first], end[old] = stop, first
    free = dict.fromkeys(group)
    for g in free:
        free[g] = g
    out, placed = [0] * n, bytearray(n)
    for k in range(-1, n):
        j = (n if k < 0 else out[k]) - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    n = len(x)
    padded = np.concatenate((x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


class _Chunk:
    """The strings of a chunk's documents: where they start, their anchors and the runs with one anchor."""

    def __init__(self, docs: pa.Table, length: int):
        self.data, self.at = K.utf8(docs.column("text"))
        self.length, n = length, len(self.data)
        gram = min(GRAM, length)
        self.starts = self.first = self.last = self.anchor = np.zeros(0, np.int64)
        self.gram_hash = np.zeros(0, np.uint64)
        if n < length:
            return
        self.sums = K.byte_sums(self.data)
        hashes = self.sums.windows(gram)
        bits = np.uint64(n.bit_length())
        least = sliding_min(((hashes >> bits) << bits) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
        ends = np.repeat(self.at[1:], np.diff(self.at))
        self.starts = np.flatnonzero(ends[: n - length + 1] >= np.arange(length, n + 1))
        if not len(self.starts):
            return
        anchor = (least[self.starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (self.starts[1:] != self.starts[:-1] + 1)
        run = np.flatnonzero(new)
        self.first, self.last = self.starts[run], self.starts[np.append(run[1:], len(anchor)) - 1]
        self.anchor = anchor[run]
        self.gram_hash = hashes[self.anchor]

    def keys(self, plan: X.Plan) -> np.ndarray:
        return X.low_keys(self.gram_hash, plan)

    def symbols(self) -> np.ndarray:
        """The symbols of every context (rows)."""
        out = np.empty((len(self.first), PIECES), np.uint64)
        if not len(self.first):
            return out
        stop = self.last + self.length
        out[:, 0] = self.sums.spans(self.first, self.anchor)
        size = max(GRAM, -(-self.length // (PIECES - 1)))
        for k in range(PIECES - 1):
            out[:, k + 1] = self.sums.spans(np.minimum(self.anchor + k * size, stop), stop if k == PIECES - 2 else np.minimum(self.anchor + (k + 1) * size, stop))
        return out

    def strings(self, runs: np.ndarray) -> np.ndarray:
        """Starts of all strings of some runs."""
        first, n = self.first[runs], self.last[runs] - self.first[runs] + 1
        return np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))

    def string_hashes(self, starts: np.ndarray, which: int = 0) -> np.ndarray:
        sums = self.sums if not which else K.byte_sums(self.data, which)
        return sums.spans(starts, starts + self.length)

    def repeated(self, starts: np.ndarray) -> np.ndarray:
        """The strings that stand at two or more of these starts."""
        starts = starts[twice(self.string_hashes(starts))]
        return starts[twice_both(self.string_hashes(starts), self.string_hashes(starts, 1))] if len(starts) else starts

    def sent_strings(self, starts: np.ndarray) -> np.ndarray:
        """The distinct strings at these starts as they are sent."""
        if not len(starts):
            return np.zeros(0, _STRING)
        a, b = self.string_hashes(starts), (self.string_hashes(starts, 1) >> np.uint64(40)).astype(np.uint32)
        order = both_sorted(a, b)
        a, b = a[order], b[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        out = np.zeros(int(new.sum()), _STRING)
        out["a"], out["b"] = a[new], b[new]
        return out


#: Answers about contexts: 62 bits of the hash, and 0 once in the corpus, 1 repeats, 2 repeats and this chunk speaks for it.
_CODE = np.uint64(3)


_CONTEXT_KIND = X.Kind(_CONTEXT, lambda v, buckets: context_hashes(np.ascontiguousarray(v["s"]).reshape(-1, PIECES)) % np.uint64(buckets))
_CODE_KIND = X.Kind(np.uint64)
_STRING_KIND = X.quotient(_STRING)


def context_hashes(symbols: np.ndarray) -> np.ndarray:
    h = np.zeros(len(symbols), np.uint64)
    for k in range(PIECES):
        h = K.mix(h * np.uint64(31) ^ symbols[:, k])
    return h & ~_CODE


def both_sorted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An order by a, then b; that by a alone serves unless hashes a collide."""
    order = np.argsort(a, kind="stable")
    same = a[order][1:] == a[order][:-1]
    return np.lexsort((b, a)) if (b[order][1:][same] != b[order][:-1][same]).any() else order


def _with_equal_neighbour(order: np.ndarray, same: np.ndarray) -> np.ndarray:
    twin = np.zeros(len(order), bool)
    twin[1:] |= same
    twin[:-1] |= same
    out = np.zeros(len(order), bool)
    out[order] = twin
    return out


def twice(values: np.ndarray) -> np.ndarray:
    """Which entries have an equal one."""
    order = np.argsort(values, kind="stable")
    return _with_equal_neighbour(order, values[order][1:] == values[order][:-1])


def twice_both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries have one that is equal in a and b."""
    order = both_sorted(a, b)
    return _with_equal_neighbour(order, (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1]))


def _sorted_contexts(values: np.ndarray, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each context of a bucket, from a suffix array of all of them."""
    symbols = np.ascontiguousarray(values["s"]).reshape(-1, PIECES)
    _, ranks = np.unique(symbols, return_inverse=True)
    text = np.zeros((len(symbols), PIECES + 1), np.int64)  # a 0 ends each context
    text[:, :PIECES] = ranks.reshape(symbols.shape) + 1
    order = np.array(suffix_array(text.ravel()), np.int64)
    order = order[order % (PIECES + 1) == 0] // (PIECES + 1)
    same = (symbols[order][1:] == symbols[order][:-1]).all(axis=1)
    group = np.concatenate(([0], np.cumsum(~same)))
    size = np.bincount(group)
    who = chunks[order]
    least = np.full(len(size), np.iinfo(np.int64).max)
    np.minimum.at(least, group, who)
    code = np.where(size[group] < 2, 0, np.where(who == least[group], 2, 1)).astype(np.uint64)
    out = np.empty(len(symbols), np.uint64)
    out[order] = context_hashes(symbols)[order] | code
    return np.arange(len(symbols)), out


def _shared_strings(values: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings that another chunk has too."""
    keep = np.flatnonzero(twice_both(np.ascontiguousarray(values["a"]), values["b"]))
    return keep, values["a"][keep]


KEPT = "doc_id long, n_bytes long, n_removed long, first array<long>, last array<long>, kept binary, times long"


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row a document: doc_id, bytes, bytes removed, the removed runs (end exclusive) and the remaining bytes."""
    chunks, plan = X.chunked(docs)
    by_chunk = chunks.groupBy("chunk")

    def anchors(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return X.sent(key[0].as_py(), np.unique(_Chunk(rows, length).keys(plan)), X.LOW_KIND, plan)

    def contexts(key, rows, answered):
        c = _Chunk(rows, length)
        keys = c.keys(plan)
        symbols = c.symbols()[X.among(keys, X.received(answered, X.LOW_KIND, plan)) | twice(keys)] if len(keys) else np.zeros((0, PIECES), np.uint64)
        _, first = np.unique(context_hashes(symbols), return_index=True)
        return X.sent(key[0].as_py(), np.ascontiguousarray(symbols[first]).view(_CONTEXT).ravel(), _CONTEXT_KIND, plan)

    def looked_up(c: _Chunk, answered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hash of every run's context, which have an answer, and the code in it."""
        h = context_hashes(c.symbols())
        if not len(answered):
            return h, np.zeros(len(h), bool), np.zeros(len(h), np.uint64)
        known = answered[np.minimum(np.searchsorted(answered, h), len(answered) - 1)]
        return h, (known & ~_CODE) == h, known & _CODE

    def strings(key, rows, answered):
        c, chunk = _Chunk(rows, length), key[0].as_py()
        h, asked, code = looked_up(c, X.received(answered, _CODE_KIND, plan))
        code = np.where(asked & (code == 0) & twice(h), np.uint64(2), code)
        some = c.sent_strings(c.strings(np.flatnonzero(asked & (code != 1))) if asked.any() else np.zeros(0, np.int64))
        return pa.concat_tables([X.sent(chunk, some, _STRING_KIND, plan), X.note(chunk, X.pack(np.unique(h[asked] | code[asked])))])

    def remove(key, rows, answered):
        c = _Chunk(rows, length)
        gone = np.zeros(len(c.data), bool)
        if len(c.first):
            told = X.notes(answered)
            _, asked, code = looked_up(c, X.unpack(told[0], np.uint64) if told else np.zeros(0, np.uint64))
            single = c.strings(np.flatnonzero(asked & (code == 0)))
            near = c.strings(np.flatnonzero(twice(c.gram_hash)))  # equal strings of this chunk have equal anchors
            starts = [c.strings(np.flatnonzero(asked & (code > 0))), single[X.among(c.string_hashes(single), X.received(answered, X.HASH_KIND, plan))], c.repeated(near)]
            gone = K.covered(np.unique(np.concatenate(starts)), length, len(c.data))
        kept, firsts, lasts, removed = [], [], [], []
        for a, b, times in zip(c.at[:-1], c.at[1:], rows.column("times").to_pylist(), strict=True):
            mine = gone[a:b]
            if times > 1 and len(mine) >= length:  # every string of it is in its equals too
                mine[:] = True
            edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
            firsts.append(edge[::2])
            lasts.append(edge[1::2])
            removed.append(int(mine.sum()))
            kept.append(c.data[a:b][~mine].tobytes())
        return pa.table({
            "doc_id": rows.column("doc_id"), "n_bytes": pa.array(np.diff(c.at), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "first": pa.array(firsts, pa.list_(pa.int64())), "last": pa.array(lasts, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary()), "times": rows.column("times"),
        })

    asked = X.shared(by_chunk.applyInArrow(anchors, X.SENT), plan)
    sent = by_chunk.cogroup(asked.groupBy("chunk")).applyInArrow(contexts, X.SENT)
    sent = by_chunk.cogroup(X.exchanged(sent, plan, _CONTEXT_KIND, _sorted_contexts, _CODE_KIND).groupBy("chunk")).applyInArrow(strings, X.SENT)
    return X.repeated(by_chunk.cogroup(X.exchanged(sent, plan, _STRING_KIND, _shared_strings, X.HASH_KIND).groupBy("chunk")).applyInArrow(remove, KEPT))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("first").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
