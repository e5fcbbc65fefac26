"""Finding which hashes occur in more than one chunk of a corpus, by shuffles of packed arrays.

Rows are dealt into chunks of some CHUNK bytes of text. A chunk sends its distinct hashes to buckets (by the hash itself),
as one packed array for each bucket; a bucket answers each chunk with those that other chunks have too. A hash is sent
once by a chunk however often it occurs there, so a passage that all documents share adds one number a chunk, and buckets
are even. There are LEAST buckets for small inputs and as many buckets as chunks up to MOST. With more chunks arrays go
in two steps, by `fan` routers that each serve `fan` buckets: the chunks of a slab (`fan` in a row) send one array to each
router, the router's task for a slab sends one array to each of its buckets, and answers come back the same way. So a
chunk never sends more than MOST rows, whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .frames import cut

#: Bytes of text in a chunk, on average.
CHUNK = 2_000_000
LEAST, MOST = 512, 16_384
#: Bytes that a row counts beside its text.
ROW = 64
#: Bits of a hash that are sent beside its bucket while levels only thin out candidates: a few in a hundred of the hashes
#: that occur once are let through, whatever the size of the corpus, as a bucket holds some 300,000 hashes at most.
LOW_BITS = 24
LOW = np.uint64((1 << LOW_BITS) - 1)
SENT = "chunk int, bucket int, counts binary, hashes binary"


class Plan(NamedTuple):
    chunks: int
    buckets: int
    #: Routers, and buckets of each; 0 where chunks send straight to buckets.
    fan: int


def planned(chunks: int) -> Plan:
    if chunks <= MOST:
        return Plan(chunks, max(LEAST, chunks), 0)
    fan = math.isqrt(chunks - 1) + 1
    return Plan(chunks, fan * fan, fan)


def chunked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int | None = None) -> tuple[DataFrame, Plan]:
    """(chunk, doc_id, text, times) and the plan, by the bytes of all texts.

    The chunk follows from id, text and the piece of the file that a row was read from: rows that repeat an id or have none
    spread by their text, and equal rows by where they stand. It is the same whenever a row is read again. Rows that are
    equal in id and text and have together more bytes than a chunk, or than a millionth of the corpus, stand there once
    with the number of `times` that they are there; see `repeated`. There are at most a million of these.
    """
    size = size or CHUNK
    total = docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0
    plan = planned(max(1, math.ceil(total / size)))
    id_, one = F.col(doc_id).cast("long"), F.lit(1).cast("long")
    place = F.xxhash64(id_, F.col(text), F.input_file_name(), F.input_file_block_start())
    rows = docs.select(id_.alias("doc_id"), F.col(text).alias("text"), place.alias("place"))
    keyed = rows.withColumns({"h1": F.xxhash64("doc_id", "text"), "h2": F.xxhash64("text", F.lit(1), "doc_id")})
    same = keyed.groupBy("h1", "h2").agg(F.count("*").alias("times"), F.max(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW).alias("bytes"))
    many = cut(same.where((F.col("times") > 1) & (F.col("times") * F.col("bytes") > max(size, total // 1_000_000))).select("h1", "h2", "times"))
    if many.isEmpty():
        rows = rows.withColumn("times", one)
    else:
        known = F.broadcast(many)
        single = keyed.join(known, ["h1", "h2"]).groupBy("h1", "h2").agg(*(F.first(c).alias(c) for c in ("doc_id", "text", "place", "times")))
        rows = keyed.join(known, ["h1", "h2"], "left_anti").select("doc_id", "text", "place", one.alias("times")).unionAll(cut(single.select("doc_id", "text", "place", "times")))
    return rows.select(F.pmod("place", F.lit(plan.chunks)).cast("int").alias("chunk"), "doc_id", "text", "times"), plan


def repeated(results: DataFrame) -> DataFrame:
    """Each result as many times as its row stood in the input, without the column that says so."""
    return results.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).drop("times")


def _planes(values: np.ndarray, planes: int | None = None) -> np.ndarray:
    """The bytes of an array by planes (all first bytes, all second bytes, ...), a plane a row: planes of zeros or of sorted
    values shrink under the shuffle's own compression."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T[:planes])


def _from_planes(parts: list[bytes], dtype, planes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The values of packed arrays one after another, and how many each has."""
    dtype = np.dtype(dtype)
    stored = [np.frombuffer(p, np.uint8).reshape(planes or dtype.itemsize, -1) for p in parts]
    whole = np.concatenate(stored, axis=1)
    full = np.zeros((whole.shape[1], dtype.itemsize), np.uint8)
    full[:, : len(whole)] = whole.T
    return full.view(dtype).ravel(), np.array([p.shape[1] for p in stored])


def pack(values: np.ndarray) -> bytes:
    return _planes(values).tobytes()


def unpack(data: bytes, dtype) -> np.ndarray:
    return _from_planes([data], dtype)[0]


class Kind:
    """Values of one dtype: the bucket of each, and how they are stored in an array of one bucket."""

    planes: int | None = None

    def __init__(self, dtype, bucket: Callable[[np.ndarray, int], np.ndarray] | None = None):
        self.dtype, self.bucket = np.dtype(dtype), bucket
        self.stored = self.dtype

    def store(self, values: np.ndarray, buckets: int) -> np.ndarray:
        return values

    def restore(self, stored: np.ndarray, bucket: np.ndarray, buckets: int) -> np.ndarray:
        return stored


class _Low(Kind):
    """Keys (see low_keys) of which only the low bits are stored."""

    planes = LOW_BITS // 8

    def __init__(self):
        super().__init__(np.uint64, lambda keys, buckets: keys >> K.U64(32))
        self.stored = np.dtype(np.uint32)

    def store(self, values: np.ndarray, buckets: int) -> np.ndarray:
        return (values & LOW).astype(np.uint32)

    def restore(self, stored: np.ndarray, bucket: np.ndarray, buckets: int) -> np.ndarray:
        return (bucket.astype(np.uint64) << K.U64(32)) | stored.astype(np.uint64)


class _Quotient(Kind):
    """Hashes `a` (a field or the value itself) in the bucket of their remainder; the quotient is stored."""

    def __init__(self, dtype):
        super().__init__(dtype, lambda v, buckets: self.a(v) % K.U64(buckets))

    def a(self, values: np.ndarray) -> np.ndarray:
        return values["a"] if self.dtype.names else values

    def store(self, values: np.ndarray, buckets: int) -> np.ndarray:
        values = values.copy()
        self.a(values)[:] = self.a(values) // K.U64(buckets)
        return values

    def restore(self, stored: np.ndarray, bucket: np.ndarray, buckets: int) -> np.ndarray:
        self.a(stored)[:] = self.a(stored) * K.U64(buckets) + bucket.astype(np.uint64)
        return stored


LOW_KIND = _Low()
HASH_KIND = _Quotient(np.uint64)


def quotient(dtype) -> Kind:
    return _Quotient(dtype)


def low_keys(hashes: np.ndarray, plan: Plan) -> np.ndarray:
    """Bucket above the bits that are sent, in one number."""
    b = K.U64(plan.buckets)
    return ((hashes % b) << K.U64(32)) | ((hashes // b) & LOW)


def _table(chunk, bucket, counts: list | None, hashes: list[bytes]) -> pa.Table:
    n = len(hashes)
    return pa.table({
        "chunk": pa.array(np.broadcast_to(np.asarray(chunk, np.int32), n)), "bucket": pa.array(np.broadcast_to(np.asarray(bucket, np.int32), n)),
        "counts": pa.array(counts if counts is not None else [None] * n, pa.binary()), "hashes": pa.array(hashes, pa.binary()),
    })


def _cut(by: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """The distinct values of a sorted array and where each stands."""
    names, first = np.unique(by, return_index=True)
    return names, [slice(a, b) for a, b in zip(first, np.append(first, len(by))[1:], strict=True)]


def _packed(values: np.ndarray, cuts: list[slice], planes: int | None = None) -> list[bytes]:
    whole = _planes(values, planes)
    return [whole[:, c].tobytes() for c in cuts]


def _stored(values: np.ndarray, cuts: list[slice], kind: Kind, plan: Plan) -> list[bytes]:
    return _packed(kind.store(values, plan.buckets), cuts, kind.planes)


def _restored(rows: pa.Table, kind: Kind, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """All values of the arrays in rows, and how many each has."""
    stored, n = _from_planes(rows.column("hashes").to_pylist(), kind.stored, kind.planes)
    return kind.restore(stored, np.repeat(rows.column("bucket").to_numpy(), n), plan.buckets), n


def sent(chunk: int, values: np.ndarray, kind: Kind, plan: Plan) -> pa.Table:
    """A chunk's rows with its values, which are best sorted."""
    to = kind.bucket(values, plan.buckets).astype(np.int32)
    if plan.fan:
        to //= plan.fan
    order = np.argsort(to, kind="stable")
    values = values[order]
    names, cuts = _cut(to[order])
    return _table(chunk, names, None, _packed(values, cuts) if plan.fan else _stored(values, cuts, kind, plan))


def received(answers: pa.Table, kind: Kind, plan: Plan) -> np.ndarray:
    """All values in the answers to a chunk, sorted; rows of negative buckets are left out."""
    answers = answers.filter(pc.greater_equal(answers.column("bucket"), 0))
    if not answers.num_rows:
        return np.zeros(0, kind.dtype)
    return np.sort(_from_planes(answers.column("hashes").to_pylist(), kind.dtype)[0] if plan.fan else _restored(answers, kind, plan)[0])


def note(chunk: int, data: bytes) -> pa.Table:
    """A row that a chunk sends to itself; it comes back as it is."""
    return _table(chunk, [-1 - chunk], None, [data])


def notes(answers: pa.Table) -> list[bytes]:
    return [h for b, h in zip(answers.column("bucket").to_pylist(), answers.column("hashes").to_pylist(), strict=True) if b < 0]


#: From all values of a bucket and the chunk of each to the places of those that are answered, and the answers to them.
Answer = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def exchanged(rows: DataFrame, plan: Plan, kind: Kind, answer: Answer, reply: Kind) -> DataFrame:
    """The answers to each chunk, as `received` reads them."""
    fan = plan.fan

    def relay(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        router, slab = key[0].as_py(), key[1].as_py()
        if router < 0:
            return group
        values, n = _from_planes(group.column("hashes").to_pylist(), kind.dtype)
        who = np.repeat(group.column("chunk").to_numpy() - slab * fan, n)
        bucket = kind.bucket(values, plan.buckets).astype(np.int64)
        order = np.lexsort((who, bucket))
        values, who = values[order], who[order]
        names, cuts = _cut(bucket[order])
        return _table(slab, names, [np.bincount(who[c], minlength=fan).astype(np.uint32).tobytes() for c in cuts], _stored(values, cuts, kind, plan))

    def respond(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        if bucket < 0:
            return group
        values, n = _restored(group, kind, plan)
        row = np.repeat(np.arange(len(n)), n)
        chunk = group.column("chunk").to_numpy()
        if fan:
            each = [np.frombuffer(c, np.uint32) for c in group.column("counts").to_pylist()]
            who = np.concatenate([np.repeat(c * fan + np.arange(fan), x) for c, x in zip(chunk, each, strict=True)])
        else:
            who = chunk[row]
        keep, out = answer(values, who)
        order = np.argsort(keep, kind="stable")
        keep, out = keep[order], out[order]
        names, cuts = _cut(row[keep])
        counts = [np.bincount(who[keep[c]] - chunk[r] * fan, minlength=fan).astype(np.uint32).tobytes() for r, c in zip(names, cuts, strict=True)] if fan else None
        return _table(chunk[names], bucket, counts, _stored(out, cuts, reply, plan))

    def relay_back(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        router, slab = key[0].as_py(), key[1].as_py()
        if router < 0:
            return group
        values, _ = _restored(group, reply, plan)
        who = np.concatenate([np.repeat(slab * fan + np.arange(fan), np.frombuffer(c, np.uint32)) for c in group.column("counts").to_pylist()])
        order = np.argsort(who, kind="stable")
        values = values[order]
        names, cuts = _cut(who[order])
        return _table(names, router, None, _packed(values, cuts))

    if fan:
        own = F.col("bucket") < 0
        rows = rows.groupBy("bucket", F.floor(F.col("chunk") / fan).cast("int").alias("slab")).applyInArrow(relay, SENT)
        back = rows.groupBy("bucket").applyInArrow(respond, SENT)
        router = F.when(own, F.col("bucket")).otherwise(F.floor(F.col("bucket") / fan).cast("int"))
        return back.groupBy(router.alias("router"), F.col("chunk").alias("slab")).applyInArrow(relay_back, SENT)
    return rows.groupBy("bucket").applyInArrow(respond, SENT)


def _shared(values: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    twin = np.zeros(len(order), bool)
    twin[1:] |= same
    twin[:-1] |= same
    keep = np.sort(order[twin])
    return keep, values[keep]


def shared(rows: DataFrame, plan: Plan) -> DataFrame:
    """Answers to each chunk: those of its keys (of LOW_KIND) that another chunk has sent too."""
    return exchanged(rows, plan, LOW_KIND, _shared, LOW_KIND)


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def several(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The distinct values that occur with two or more owners, sorted."""
    order = np.lexsort((owner, values))
    v, o = values[order], owner[order]
    return np.unique(v[1:][(v[1:] == v[:-1]) & (o[1:] != o[:-1])])
