"""Bits of Bloom filters by numpy, inside tasks that Spark deals names and blocks over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Names whose bits are packed at a time, and the bits of a block.
AT_ONCE, BITS = 200_000, 8 * 4096
_BASIS, _PRIME = np.uint64(14695981039346656037), np.uint64(1099511628211)
PACKED, WHOLE = "list_id string, block long, offsets binary", "list_id string, block long, bits binary"


def fnv(names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """FNV-1a and FNV-1 of the bytes of texts. Longest first, so that those that still have a byte are always in front."""
    _, ends, data = names.cast(pa.large_binary()).buffers()
    ends = np.frombuffer(ends, np.int64)[names.offset : names.offset + len(names) + 1]
    data, size = np.frombuffer(data or b"", np.uint8), np.diff(ends)
    order = np.argsort(-size, kind="stable")
    start, size = ends[:-1][order], size[order]
    a, f = np.full(len(names), _BASIS), np.full(len(names), _BASIS)
    for k in range(size[0] if len(size) else 0):
        n = np.searchsorted(-size, -k)  # sizes above k
        byte = data[start[:n] + k].astype(np.uint64)
        a[:n] = (a[:n] ^ byte) * _PRIME
        f[:n] = (f[:n] * _PRIME) ^ byte
    back = np.argsort(order)
    return a[back], f[back]


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """list_id, name, bit_count, hash_count to list_id, block and the distinct places (two bytes each) that the names set in it."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= AT_ONCE:
            yield _pack(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield _pack(pa.Table.from_batches(held))


def _pack(names: pa.Table) -> pa.RecordBatch:
    a, f = fnv(names["name"].combine_chunks())
    lists = names["list_id"].combine_chunks().dictionary_encode()
    code = lists.indices.to_numpy().astype(np.uint64) << np.uint64(44)  # 200,000 lists and filters of 2**44 bits
    bits, hashes = names["bit_count"].to_numpy().astype(np.uint64), names["hash_count"].to_numpy()
    with_step = f | np.uint64(1)
    spots = [(code | ((a + np.uint64(i) * with_step) % bits))[hashes > i] for i in range(hashes.max())]
    spots = np.sort(np.concatenate(spots))
    spots = spots[np.r_[True, spots[1:] != spots[:-1]]]
    owner = spots // np.uint64(BITS)
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    places = (spots % np.uint64(BITS)).astype("<u2")
    cuts = (2 * np.r_[first, len(spots)]).astype(np.int32)
    ids = lists.dictionary.take(pa.array((spots[first] >> np.uint64(44)).astype(np.int64)))
    block = (spots[first] & np.uint64((1 << 44) - 1)) // np.uint64(BITS)
    offsets = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(places)])
    return pa.RecordBatch.from_arrays([ids, pa.array(block.astype(np.int64)), offsets], ["list_id", "block", "offsets"])


def whole(batches: Iterator[pa.RecordBatch], at_once: int = 1024) -> Iterator[pa.RecordBatch]:
    """list_id, block and all packs of a block to its bytes, the lowest bit of each byte first."""
    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            part = batch.slice(at, at_once)
            bits = []
            for packs in part["packs"]:
                mark = np.zeros(BITS, bool)
                for pack in packs:
                    mark[np.frombuffer(pack.as_buffer(), "<u2")] = True
                bits.append(np.packbits(mark, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([part["list_id"], part["block"], pa.array(bits, pa.binary())], ["list_id", "block", "bits"])
