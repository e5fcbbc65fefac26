"""Benchmark decontamination: CGK random-walk embedding, bit-sampling LSH over item-sized windows, exact edit check.

Words are runs of ASCII letters and digits or bytes of longer characters, A-Z lower-cased. An item of n words is found
in a text if some window of n words, or of up to `floor(EDITS * n)` words less at the text's start or end, is within
`floor(EDITS * n)` word edits of it; so a text somewhat shorter than the item can match too. Of equally near windows the
first counts, then the longest.

Only windows that can match are keyed. k edits leave one of k + 1 segments of an item untouched, so an item is cut into as
many segments as possible, and an index leads from the words at a segment's start to the item and the segment's place in
it (of all ways to lay the segments those rarest in the benchmark). A hit gives the windows of that one item that begin
within k words of where the hit says; this loses nothing, and its cost follows the hits, not the size of the benchmark or
the words it has. Where windows are short enough to count, those with less than n - k words of the item go too.

The CGK walk reads a word string with a pointer that a random bit of (step, word) moves or holds, so that few edits give few
differing steps; each repetition has its own walk and keys a window by some of its steps, and a window that shares a key
with its item is checked by the exact banded edit distance. Repetitions follow from the target recall, for each class of
lengths: they are added until the share of items at exactly floor(EDITS * n) edits that meet in no key, measured on DRAWS
copies with substitutions only and DRAWS with as many indels as that distance has room for, is at most 1 - RECALL for both.
A key has SAMPLED steps, or fewer where MOST_REPEATS repetitions don't reach that: walks over long items drift further
apart. If one step is too many, and for windows that the end of a text cuts (they differ from a whole item by more steps
than the limit stands for), the windows of a hit are checked without keys.

The benchmark is a stated query set: it is read to the driver and sent to the tasks in blocks of at most BLOCK_WORDS words,
and documents are read once for each block and never shuffled, so no key, source or group of copies can load one task. A task
holds at most CELLS words of windows at once, however long the items are.

Null and empty texts, and items without a word, match nothing. Items with equal words are all reported. Repeated
document rows give repeated result rows. Very long texts are read whole. Other columns play no part (a stage
passes them through). Empty tables give an empty table.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .frames import small_batches, table

#: Word edits allowed for each word of an item: similarity 0.8 or more.
EDITS = 0.2
RECALL = 0.99
SAMPLED = 3
MOST_REPEATS = 64
#: Lengths of items in one class are at most so many times apart.
CLASS = 1.15
#: Numbers in the arrays of one step of a task, and the longest windows whose words are counted before they are keyed.
CELLS, COUNTED = 1 << 21, 20
#: Bits of the table that most words of a text fail before the index is searched.
FLAGS = 22
#: Edited copies of each kind and item length on which the recall is measured.
DRAWS = 200
BLOCK_WORDS = 1_000_000
#: Bytes of text that a task looks at together; a longer text is looked at alone.
BLOCK_BYTES = 1 << 20
_MARKS = np.ones(256, bool)
_MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word."""
    spaced = np.where(_MARKS[data], np.uint8(32), K.lower_ascii(data))
    starts, ends, owner = K.words(spaced, at)
    return K.span_hashes(spaced, starts, ends), owner


@functools.lru_cache(64)
def _walks(n: int, seeds: tuple[int, ...], sampled: int) -> tuple[np.ndarray, np.ndarray]:
    """Random words of the steps of each walk, and which steps its key has."""
    salt, sampled_at = np.zeros((len(seeds), 2 * n), np.uint64), np.zeros((len(seeds), 2 * n), bool)
    for k, seed in enumerate(seeds):
        rng = np.random.Generator(np.random.PCG64(seed))
        # The pointer is past the end after about 2n of the 3n steps; later steps are padding and tell nothing.
        sampled_at[k, rng.choice(2 * n, min(sampled, 2 * n), replace=False)] = True
        salt[k] = rng.integers(1, 2**63, 2 * n, dtype=np.uint64)
    return salt, sampled_at


def walk_keys(strings: np.ndarray, n: int, seeds: list[int], sampled: int = SAMPLED) -> np.ndarray:
    """Keys (repetitions x rows) of rows of n word hashes (rows x n)."""
    rows = np.arange(len(strings))
    padded = np.concatenate((strings, np.zeros((len(strings), 1), np.uint64)), axis=1)
    salt, sampled_at = _walks(n, tuple(seeds), sampled)
    at = np.zeros((len(seeds), len(strings)), np.int64)
    key = np.repeat(np.array(seeds, np.uint64)[:, None], len(strings), axis=1)
    for j in range(int(sampled_at.any(0).nonzero()[0].max()) + 1 if sampled_at.any() else 0):
        mixed = K.mix(padded[rows, at] ^ salt[:, j, None])
        own = np.flatnonzero(sampled_at[:, j])
        if len(own):
            key[own] = K.mix(key[own] ^ mixed[own])
        at = np.minimum(at + (mixed >> np.uint64(63)).astype(np.int64), n)
    return key


def edit_distances(a: np.ndarray, b: np.ndarray, most: int, sizes: np.ndarray | int) -> np.ndarray:
    """Word edit distances of the rows of a and the first sizes (n - most to n) words of the rows of b (rows x n) if at
    most `most`; larger ones come out larger than that."""
    n, band = a.shape[1], np.arange(2 * most + 1)  # place p of row i stands for column i + p - most
    far = 4 * n + len(band)
    row = np.tile(np.where(band >= most, band - most, far), (len(a), 1))
    for i in range(1, n + 1):
        column = i + band - most
        new = row + (b[:, np.clip(column - 1, 0, n - 1)] != a[:, i - 1, None])
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new[:, (column < 0) | (column > n)] = far
        new[:, column == 0] = i
        row = np.minimum.accumulate(new - band, axis=1) + band  # insertions
    return row[np.arange(len(a)), most + sizes - n]


class Index:
    """Where each run of q words stands in items: the way from a text's words to the items that may be there."""

    def __init__(self, q: int, grams: np.ndarray, items: np.ndarray, offsets: np.ndarray):
        order = np.argsort(grams, kind="stable")
        self.q, self.items, self.offsets = q, items[order], offsets[order]
        self.grams, self.begins = np.unique(grams[order], return_index=True)
        self.ends = np.append(self.begins[1:], len(grams))
        self.flags = np.zeros(1 << FLAGS, bool)
        self.flags[self.grams >> np.uint64(64 - FLAGS)] = True

    def hits(self, hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, where each would begin, and the text, for every run of words that is in the index."""
        grams = K.window_hashes(hashes, self.q)
        at = np.flatnonzero(self.flags[grams >> np.uint64(64 - FLAGS)])
        at = at[owner[at] == owner[at + self.q - 1]]
        place = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        own = self.grams[place] == grams[at]
        at, place = at[own], place[own]
        many = self.ends[place] - self.begins[place]
        entry = np.repeat(self.begins[place] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return self.items[entry], np.repeat(at, many) - self.offsets[entry], np.repeat(owner[at], many)


class Block:
    """A block of items with what a task needs to find them."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS, recall: float = RECALL):
        text = pa.array([t or "" for _, t in items], pa.string())
        hashes, owner = word_hashes(*K.utf8(text))
        cuts = np.searchsorted(owner, np.arange(len(items) + 1))
        same: dict[bytes, list[int]] = {}
        for k, (item_id, _) in enumerate(items):
            if cuts[k + 1] > cuts[k]:
                same.setdefault(hashes[cuts[k] : cuts[k + 1]].tobytes(), []).append(item_id)
        self.edits, self.ids, self.words = edits, list(same.values()), [np.frombuffer(w, np.uint64) for w in same]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for k, words in enumerate(self.words):
            self.by_length[len(words)].append(k)
        self.indexes = self._indexes()
        #: By length of items; 0 repeats where no number of steps in MOST_REPEATS keys is enough.
        self.repeats, self.sampled = {}, {}
        for lengths in self._classes():
            sampled, repeats = self._repeats(lengths, recall)
            for n in lengths:
                self.repeats[n], self.sampled[n] = (1 if repeats and not self.most(n) else repeats), sampled
        self._keys: dict[int, np.ndarray] = {}
        self._nth = np.zeros(len(self.words), np.int64)  # of an item among those of its length
        for own in self.by_length.values():
            self._nth[own] = np.arange(len(own))

    def most(self, n: int) -> int:
        """Edits that an item of n words allows."""
        return int(self.edits * n)

    def _indexes(self) -> list[Index]:
        """An index for each segment length; segments may begin some words later where the item has words left over."""
        by_size: dict[int, list[int]] = defaultdict(list)
        for k, n in enumerate(self.lengths.tolist()):
            by_size[n // (self.most(n) + 1)].append(k)
        found = []
        for q, own in sorted(by_size.items()):
            runs = [K.window_hashes(self.words[k], q) for k in own]
            values, times = np.unique(np.concatenate(runs), return_counts=True)
            grams, items, offsets = [], [], []
            for k, run in zip(own, runs, strict=True):
                parts = self.most(len(self.words[k])) + 1
                often = times[np.searchsorted(values, run)]
                spare = len(self.words[k]) - parts * q
                first = np.arange(parts) * q
                shift = min(range(spare + 1), key=lambda s, often=often, first=first: int(often[first + s].sum()))
                grams.append(run[first + shift])
                items.append(np.full(parts, k))
                offsets.append(first + shift)
            found.append(Index(q, np.concatenate(grams), np.concatenate(items), np.concatenate(offsets)))
        return found

    def _classes(self) -> list[list[int]]:
        out: list[list[int]] = []
        for n in sorted(self.by_length):
            if out and n <= CLASS * out[-1][0] and self.most(n) and self.most(out[-1][0]):
                out[-1].append(n)
            else:
                out.append([n])
        return out

    def _edited(self, strings: np.ndarray, indels: int, rng) -> np.ndarray:
        """Copies (rows x n) at exactly the edit limit: an indel moves the words after it and costs two, for the window stays
        n words long; substitutions make up the rest. New words are in no text. Rows that came out nearer are substituted
        only, unless telling them would take more than CELLS numbers."""
        n = strings.shape[1]
        most = self.most(n)
        fresh = lambda k: rng.integers(1, 2**63, k, dtype=np.uint64)
        out = strings.copy()
        for own, words in zip(out, strings, strict=True):
            some = words.copy()
            some[rng.choice(n, most - 2 * indels, replace=False)] = fresh(most - 2 * indels)
            gone = np.zeros(n, np.int64)
            more = rng.integers(0, 2, indels).sum()
            gone[rng.choice(n, indels - more, replace=False)] = 1
            some = np.insert(some[gone == 0], rng.integers(0, n - (indels - more) + 1, more), fresh(more))[:n]
            own[:] = np.concatenate((some, fresh(n - len(some))))
        if n * (2 * most + 1) * 8 <= CELLS:
            for row in np.flatnonzero(edit_distances(strings, out, most, n) != most):
                out[row] = strings[row]
                out[row, rng.choice(n, most, replace=False)] = fresh(most)
        return out

    def _repeats(self, lengths: list[int], recall: float) -> tuple[int, int]:
        """Steps in a key and keys, measured on the longest items of a class of lengths."""
        n = lengths[-1]
        most, own = self.most(n), self.by_length[n]
        if not most:
            return SAMPLED, 1  # equal strings have equal keys
        rng = np.random.Generator(np.random.PCG64(17 + n))
        draws = max(16, min(DRAWS, CELLS // n))
        strings = np.stack([self.words[own[k * len(own) // draws if len(own) > draws else k % len(own)]] for k in range(draws)])
        copies = [self._edited(strings, indels, rng) for indels in sorted({0, most // 2})]
        for sampled in range(SAMPLED, 0, -1):
            needed = [self._needed(strings, c, n, sampled, recall) for c in copies]
            if all(needed):
                return sampled, max(needed)
        return 1, 0

    def _needed(self, here: np.ndarray, there: np.ndarray, n: int, sampled: int, recall: float) -> int:
        draws, met = len(here), 0
        for r in range(0, MOST_REPEATS, 8):
            seeds = list(range(r, min(r + 8, MOST_REPEATS)))
            found = np.logical_or.accumulate(walk_keys(here, n, seeds, sampled) == walk_keys(there, n, seeds, sampled), axis=0)
            enough = np.flatnonzero(met + found.sum(axis=1) >= recall * draws)
            if len(enough):
                return r + int(enough[0]) + 1
            met += int(found[-1].sum())
            if r >= 8 and met < 0.05 * draws:
                return 0  # the other keys would not get far
            here, there = here[~found[-1]], there[~found[-1]]
        return 0

    def _walked(self, strings: np.ndarray, n: int) -> np.ndarray:
        return walk_keys(strings, n, list(range(self.repeats[n])), self.sampled[n])

    def keys(self, n: int, items: np.ndarray) -> np.ndarray:
        """Keys (repetitions x items) of items of n words; kept while they are few."""
        own = self.by_length[n]
        if len(own) * n > CELLS:
            return self._walked(np.stack([self.words[k] for k in items]), n)
        if n not in self._keys:
            self._keys[n] = self._walked(np.stack([self.words[k] for k in own]), n)
        return self._keys[n][:, self._nth[items]]

    def _alike(self, windows: np.ndarray, items: np.ndarray, n: int) -> np.ndarray:
        """Which windows of n words are to be checked: they share a key with their item, and words enough where these are counted."""
        good = np.ones(len(items), bool)
        if 1 < n <= COUNTED:
            words = np.stack([self.words[k] for k in items])
            good = (windows[:, :, None] == words[:, None, :]).any(2).sum(1) >= n - self.most(n)
        own = np.flatnonzero(good)
        if len(own) and self.repeats[n]:
            some, which = np.unique(items[own], return_inverse=True)
            good[own] = (self._walked(windows[own], n) == self.keys(n, some)[:, which]).any(0)
        return good

    def find(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text number, item id, first word, words, distance): the nearest window of each item found in each text."""
        hashes, owner = word_hashes(data, at)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if not len(hashes) or not self.words:
            return []
        first = np.searchsorted(owner, np.arange(len(at)))
        hits = []
        for index in self.indexes:
            if len(hashes) >= index.q:
                items, begins, texts = index.hits(hashes, owner)
                hits.append((items, begins, texts))
        if not sum(len(h[0]) for h in hits):
            return []
        items, begins, texts = map(np.concatenate, zip(*hits, strict=True))
        # Once an item, text and beginning, however many segments say so.
        widest = int(self.lengths.max())
        place = (items * (len(hashes) + 2 * widest) + begins + widest) * len(at) + texts
        _, once = np.unique(place, return_index=True)
        items, begins, texts = items[once], begins[once], texts[once]
        for n in np.unique(self.lengths[items]).tolist():
            mine = self.lengths[items] == n
            for own, start, size in self._windows(n, items[mine], begins[mine], first[texts[mine]], first[texts[mine] + 1]):
                self._judge(n, own, start, size, hashes, owner, first, best)
        return [(doc, item_id, start, -size, d) for (doc, k), (d, start, size) in sorted(best.items()) for item_id in self.ids[k]]

    def _windows(self, n: int, items: np.ndarray, begins: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Items, starts and sizes of the windows of hits, at most CELLS words at once, each once in a piece."""
        most = self.most(n)
        step = max(1, CELLS // (n * (2 * most + 1)))
        for a in range(0, len(items), step):
            own, begin, low, high = items[a : a + step], begins[a : a + step], first[a : a + step], last[a : a + step]
            moves = np.arange(-most, most + 1)
            start = (begin[:, None] + moves).ravel()
            fits = (start >= np.repeat(low, len(moves))) & (start + n <= np.repeat(high, len(moves)))
            yield from self._pieces(n, np.repeat(own, len(moves))[fits], start[fits], np.full(int(fits.sum()), n))
            if not most:
                continue
            sizes = np.arange(n - most, n)
            room = (high - low)[:, None]
            head = (np.abs(begin - low) <= most)[:, None] & (sizes <= room)
            tail = (np.abs(begin + n - high) <= most)[:, None] & (sizes < room) | (np.abs(begin + n - high) <= most)[:, None] & (sizes == room) & ~head
            for some, start in ((head, np.broadcast_to(low[:, None], head.shape)), (tail, high[:, None] - sizes)):
                row, column = np.nonzero(some)
                yield from self._pieces(n, own[row], start[row, column], sizes[column])

    def _pieces(self, n: int, own: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if not len(own):
            return
        _, once = np.unique((own * (int(start.max()) + 1) + start) * (n + 1) + size, return_index=True)
        step = max(1, CELLS // max(n, 2 * self.most(n) + 1))
        for a in range(0, len(once), step):
            k = once[a : a + step]
            yield own[k], start[k], size[k]

    def _judge(self, n: int, own, start, size, hashes, owner, first, best: dict) -> None:
        """Takes the nearest windows into `best`."""
        most, places = self.most(n), np.arange(n)
        windows = hashes[np.minimum(start[:, None] + places, len(hashes) - 1)]
        windows[places >= size[:, None]] = 0
        cut = size < n
        good = cut.copy()
        good[~cut] = self._alike(windows[~cut], own[~cut], n) if (~cut).any() else False
        own, start, size, windows = own[good], start[good], size[good], windows[good]
        if not len(own):
            return
        distances = edit_distances(np.stack([self.words[k] for k in own]), windows, most, size)
        for x in np.flatnonzero(distances <= most):
            doc, item = int(owner[start[x]]), int(own[x])
            spot = (int(distances[x]), int(start[x] - first[doc]), -int(size[x]))
            if spot < best.get((doc, item), (most + 1, 0, 0)):
                best[doc, item] = spot


def blocks_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks; one block at a time is on the driver."""
    some, size = [], 0
    for r in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).orderBy("i", "t").toLocalIterator():
        some.append((r["i"], r["t"]))
        size += len((r["t"] or "").split())
        if size >= words:
            yield Block(some)
            some, size = [], 0
    if some:
        yield Block(some)


MATCHES = "doc_id long, item_id long, first_word long, n_words long, edits long"


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item found in it: the nearest window's first word, length and word edits."""
    spark = docs.sparkSession
    found = []
    for block in blocks_of(benchmark):
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches):
                ids = batch.column(0).to_pylist()
                data, at = K.utf8(batch.column(1))
                rows = []
                for i, j in K.blocks(at, BLOCK_BYTES):
                    rows += [(ids[i + doc], *rest) for doc, *rest in held.value.find(data[at[i] : at[j]], at[i : j + 1] - at[i])]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["doc_id", "item_id", "first_word", "n_words", "edits"])

        found.append(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, MATCHES))
    return functools.reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], MATCHES)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drops documents in which a benchmark item is found; all others stay as they are."""
    at, columns = docs.columns.index("text"), docs
    for block in blocks_of(table(spark, sf_dir, "benchmark")):
        held = spark.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches):
                data, where = K.utf8(batch.column(at))
                good = np.ones(batch.num_rows, bool)
                for i, j in K.blocks(where, BLOCK_BYTES):
                    for doc, *_ in held.value.find(data[where[i] : where[j]], where[i : j + 1] - where[i]):
                        good[i + doc] = False
                yield batch.filter(pa.array(good))

        columns = columns.mapInArrow(keep, docs.schema)
    return columns
