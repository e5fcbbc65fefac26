"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut where a space or line end follows a visible character: no match of the pre-tokenizer pattern
crosses such a place and its look-ahead never looks back, so the ids of the parts, joined, are the ids of the text.
A stretch without such a place stays whole. Null texts count as empty and give no ids. Rows keep their own ids, so
ties and repeated rows need no rule; an empty table gives an empty table. Other columns pass through or play no part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, StructField, StructType

from .frames import small_batches, table

#: Characters of a text that are encoded in one call, at least.
PART = 1 << 16
#: Rows that are encoded or decoded at once: ids take several times a text's memory while they are Python numbers.
ROWS = 256
#: A place between a visible character and a space or line end after it.
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")
_LOADED: dict[tuple[str, str], object] = {}


def encoding(ranks: str, pattern: str):
    """The tiktoken encoding of a rank file; read once in each worker."""
    import tiktoken

    if (ranks, pattern) not in _LOADED:
        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _LOADED[ranks, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _LOADED[ranks, pattern]


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in pieces of at least `size` characters, cut at safe places only."""
    first = 0
    while len(text) - first > size:
        found = _SAFE.search(text, first + size)
        if found is None:
            break
        yield text[first : found.start()]
        first = found.start()
    yield text[first:] if first else text


def encode_text(text: str, enc) -> list[int]:
    if len(text) <= PART:
        return enc.encode_ordinary(text)
    return [i for part in parts(text) for i in enc.encode_ordinary(part)]


def _default(ranks: str | None, pattern: str | None) -> tuple[str, str]:
    import public_tokenizers

    return ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN


def _lists(values: list[np.ndarray]) -> pa.Array:
    """A list array from arrays of ids."""
    ends = np.cumsum([0, *(len(v) for v in values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()))


def _with(schema: StructType, name: str, kind: DataType) -> StructType:
    return StructType([f for f in schema.fields if f.name != name] + [StructField(name, kind)])


def encode(docs: DataFrame, text: str = "text", ids: str = "ids", data: str | None = None, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with a column `ids` of token ids at the end, and if `data` names one a column of the bytes that they decode to.

    Columns of these names in docs are replaced.
    """
    ranks, pattern = _default(ranks, pattern)
    at, rest = docs.columns.index(text), [c for c in docs.columns if c not in (ids, data)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in small_batches(batches, ROWS):
            found, back = [], []
            for t in batch.column(at):
                own = encode_text(t.as_py() or "", enc)
                found.append(np.array(own, np.int32))
                if data is not None:
                    back.append(enc.decode_bytes(own))
            batch = batch.select(rest).append_column(ids, _lists(found))
            yield batch if data is None else batch.append_column(data, pa.array(back, pa.binary()))

    schema = _with(docs.select(rest).schema, ids, ArrayType(IntegerType()))
    return docs.mapInArrow(run, schema if data is None else _with(schema, data, BinaryType()))


def decode(docs: DataFrame, ids: str = "ids", data: str = "decoded", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs with a binary column `data` at the end, the raw bytes that the ids stand for; null ids give null."""
    ranks, pattern = _default(ranks, pattern)
    at, rest = docs.columns.index(ids), [c for c in docs.columns if c != data]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        for batch in small_batches(batches, ROWS):
            found = [enc.decode_bytes(x.values.to_pylist()) if x.is_valid else None for x in batch.column(at)]
            yield batch.select(rest).append_column(data, pa.array(found, pa.binary()))

    return docs.mapInArrow(run, _with(docs.schema, data, BinaryType()))


def round_trip(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row a document: doc_id, ids, decoded; both made in one pass over the texts."""
    ranks, pattern = _default(ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        names = [str(i) for i in range(enc.n_vocab + 1)]
        for batch in batches:
            counts, shas, backs = [], [], []
            for t in batch.column(1):
                ids = encode_text(t.as_py() or "", enc)
                counts.append(len(ids))
                shas.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                backs.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their token ids, and the text that the ids decode to."""
    return encode(docs, ids="ids", data="decoded")
