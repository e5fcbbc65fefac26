"""Array helpers that run inside Spark tasks: UTF-8 buffers of an Arrow column, word spans and rolling 64-bit hashes.

A polynomial hash of a span is (P[end] - P[start]) * B**-start mod 2**64, where P is the running sum of
value * B**position, so every window of any length costs a few array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: The white space of the word rule [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_VALUES = [np.random.Generator(np.random.PCG64(s)).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1) for s in (11, 23)]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (a multiply-xorshift finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i mod 2**64 for i below n."""
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASE[which]
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            both = []
            for b in (base, inverse):
                step = np.full(size, b, U64)
                step[0] = 1
                both.append(np.multiply.accumulate(step))
        _POWERS[which] = have = (both[0], both[1])
    return have[0][:n], have[1][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its values; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def blocks(at: np.ndarray, limit: int = 1 << 21):
    """Consecutive ranges of texts with about `limit` bytes each; a longer text makes a range of its own."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; all other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and text number of every word; words never cross texts."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


class Sums:
    """Running sums over a sequence, from which the hash of any span is read."""

    def __init__(self, values: np.ndarray, which: int = 0):
        with np.errstate(over="ignore"):
            up, self.down = powers(len(values) + 1, which)
            self.sums = np.zeros(len(values) + 1, U64)
            np.cumsum(values * up[:-1], out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """A 64-bit hash of every run of `length` values."""
        n = len(self.sums) - length
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span, its length included."""
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U64))


def byte_sums(data: np.ndarray, which: int = 0) -> Sums:
    return Sums(_VALUES[which][data], which)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    return byte_sums(data, which).spans(starts, ends)


def window_hashes(values: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of `length` consecutive 64-bit values."""
    return Sums(values, which).windows(length) if len(values) >= length else np.zeros(0, U64)


def whole_windows(owner: np.ndarray, length: int) -> np.ndarray:
    """Whether the run of `length` items that starts at each position lies in one text."""
    n = len(owner) - length + 1
    return owner[:n] == owner[length - 1 :] if n > 0 else np.zeros(0, bool)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions some run [start, start + length) covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:n]) > 0
