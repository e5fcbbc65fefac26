"""MinHash near-dedup with circulant permutations: sketches, banding, exact Jaccard check, connected components.

A text is lower-cased (A-Z only) and cut into words `[^\\x20\\x09-\\x0D]+`; its set is its distinct shingles of `words`
words, or the whole sequence as one shingle if it has fewer. Two permutations of the 64-bit hashes are used: the first
scatters the shingles, and coordinate k of the sketch is the least value of the second after shifting its argument by k.
Coordinates are banded; documents that share a band are candidates, and links are confirmed on the full sets:
den * intersection >= num * union.

Documents with equal sets are one class, stood for by its smallest doc_id, so copies cost nothing. Within a band's
group every member is first compared with the group's smallest member; then only members that are still in different
components are compared, in tiles of bounded size, and only those pairs whose sketches and shortened sets allow the
link are checked on the full sets. No pair that could join two components is left out, so the components are those of all
links found by any band. A link at the threshold is missed by all bands with probability (1 - t**4)**20: 7e-7 at the 0.85 of
op3 and 3e-5 at the 0.8 of the pipeline's stage; sketches of a linked pair agree too little (SLACK)
with a probability below 1e-5. Rows of a hot band are dealt over tasks.

Null and empty texts and texts without words have the empty set and link with nothing. Rows that repeat a doc_id are
one document. Very long texts are read whole. Other columns play no part (a stage passes them through). An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .frames import cut, small_batches, table
from .graph import SHARE, components, joined

BANDS, ROWS = 20, 4
#: Members of a band's group in one tile, on average.
TILE = 512
#: How far below the threshold the share of equal sketch coordinates may be: five standard deviations of 80 coordinates.
SLACK = 0.2


def shingles(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and the text number of each, by text."""
    data = K.lower_ascii(data)
    starts, ends, owner = K.words(data, at)
    h = K.span_hashes(data, starts, ends)
    n = np.bincount(owner, minlength=len(at) - 1)
    whole = K.whole_windows(owner, words)
    found, who = K.window_hashes(h, words)[whole], owner[: len(whole)][whole]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        first = np.searchsorted(owner, short)
        own = np.array([int(K.window_hashes(h[a : a + k], int(k), 1)[0]) for a, k in zip(first, n[short], strict=True)], np.uint64)
        found, who = np.concatenate((found, own)), np.concatenate((who, short))
    order = np.lexsort((found, who))
    found, who = found[order], who[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (who[1:] != who[:-1])
    return found[new], who[new]


def sketch(found: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """size coordinates (rows) of each set (columns): the sets start at `first` in found."""
    spread = K.mix(found ^ np.uint64(0xA5A5A5A5DEADBEEF))  # the first permutation
    out = np.empty((size, len(first)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out[k] = np.minimum.reduceat(K.mix((spread - np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)), first)  # the second, shifted by k
    return out


SKETCH = "doc_id long, n_shingles long, s1 long, s2 long, bands binary, coords binary"


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, set size, a 128-bit hash of the set, the band keys and 8 bits of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            data, at = K.utf8(batch.column(1))
            for i, j in K.blocks(at, 1 << 20):
                found, who = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], words)
                count = np.bincount(who, minlength=j - i)
                have = np.flatnonzero(count)
                sums = np.zeros((2, j - i), np.int64)
                bands, coords = [b""] * (j - i), [b""] * (j - i)
                if len(have):
                    first = np.searchsorted(who, have)
                    with np.errstate(over="ignore"):
                        sums[0, have] = np.add.reduceat(K.mix(found + np.uint64(1)), first).view(np.int64)
                        sums[1, have] = np.add.reduceat(K.mix(found ^ np.uint64(0x5555555555555555)), first).view(np.int64)
                    s = sketch(found, first, BANDS * ROWS)
                    keys = np.zeros((len(have), BANDS), np.uint64)
                    for b in range(BANDS):
                        for r in range(ROWS):
                            keys[:, b] = K.mix(keys[:, b] ^ s[b * ROWS + r])
                    small = np.ascontiguousarray((s.T >> np.uint64(56)).astype(np.uint8))
                    for k, doc in enumerate(have):
                        bands[doc], coords[doc] = keys[k].tobytes(), small[k].tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].cast(pa.int64()), pa.array(count, pa.int64()), pa.array(sums[0]), pa.array(sums[1]), pa.array(bands, pa.binary()), pa.array(coords, pa.binary())], ["doc_id", "n_shingles", "s1", "s2", "bands", "coords"])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCH)


def _banded(classes: DataFrame) -> DataFrame:
    """(key, rep) of every band; the band's number is part of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = K.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(-1, BANDS)
                yield pa.RecordBatch.from_arrays([pa.array((keys ^ salt).view(np.int64).ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "rep"])

    return classes.select("rep", "bands").mapInArrow(run, "key long, rep long")


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, sorted shingle hashes) of the documents named in ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            data, at = K.utf8(batch.column(1))
            for i, j in K.blocks(at, 1 << 20):
                found, who = shingles(data[at[i] : at[j]], at[i : j + 1] - at[i], words)
                cuts = np.searchsorted(who, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].cast(pa.int64()), pa.array([found[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["id", "items"])

    some = docs.select("doc_id", "text").join(ids.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    return some.mapInArrow(run, "id long, items binary").dropDuplicates(["id"])


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
                good.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(sets.withColumnsRenamed({"id": "a", "items": "x"}), "a")
    return left.join(sets.withColumnsRenamed({"id": "b", "items": "y"}), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _shares(sets: DataFrame) -> DataFrame:
    """(id, brief): 16 bits of each shingle hash, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            brief = [np.sort((np.frombuffer(x.as_buffer(), np.uint64) >> np.uint64(20)).astype(np.uint16)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(brief, pa.binary())], ["id", "brief"])

    return sets.select("id", "items").mapInArrow(run, "id long, brief binary")


def _open_pairs(members: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of one band's group that are in different components and may be linked.

    members: key, i, j, small, other, rep, component, bands, coords, brief. In a group (key, i, j) every row with `small`
    is compared with every row without; `other` marks rows that stand on the small side too. A pair may be linked if
    its sketches agree enough and the common 16-bit hashes, of which there are at least as many as common shingles,
    reach the threshold.
    """
    least = num / den - SLACK

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        small = rows.column("small").to_numpy(zero_copy_only=False)
        other = rows.column("other").to_numpy(zero_copy_only=False)
        rep, comp = rows.column("rep").to_numpy(), rows.column("component").to_numpy()
        bands = np.frombuffer(b"".join(rows.column("bands").to_pylist()), np.uint64).reshape(len(rep), BANDS)
        coords = np.frombuffer(b"".join(rows.column("coords").to_pylist()), np.uint8).reshape(len(rep), BANDS * ROWS)
        brief = [np.frombuffer(x, np.uint16) for x in rows.column("brief").to_pylist()]
        mine = int(np.flatnonzero((bands[0] ^ K.mix(np.arange(1, BANDS + 1, dtype=np.uint64))).view(np.int64) == key[0].as_py())[0])
        all_, out = np.flatnonzero(~small), []
        for x in np.flatnonzero(small):
            them = all_[(comp[all_] != comp[x]) & (~other[all_] | (rep[all_] > rep[x]))]
            them = them[(coords[them] == coords[x]).mean(axis=1) >= least]
            # A pair is given by the first of its shared bands alone.
            for y in them[(bands[them] == bands[x]).argmax(axis=1) == mine]:
                a, b = brief[x], brief[y]
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                if den * both >= num * (len(a) + len(b) - both):
                    out.append((min(rep[x], rep[y]), max(rep[x], rep[y])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return members.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _sides(labelled: DataFrame, details: DataFrame) -> DataFrame:
    """The members of every band's group with more than one component, dealt into tiles as _open_pairs takes them.

    A pair in different components has one member outside the group's largest component at least: those are the small
    side. Both sides are dealt into tiles of TILE members, and each tile of one side meets each of the other.
    """
    sizes = labelled.groupBy("key", "component").agg(F.count("*").alias("n"))
    groups = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("big"), F.max("n").alias("most"), F.sum("n").alias("all"))
    apart = groups.where("most < all and all > 2").select("key", "all", "big", F.ceil((F.col("all") - F.col("most")) / TILE).cast("int").alias("ts"), F.ceil(F.col("all") / TILE).cast("int").alias("ta"))
    apart, own = cut(apart), labelled.select("key", "rep", "component")
    # Members of hot bands (fewer than SHARE) meet their band where they are; the others are shuffled.
    hot = F.col("key").isin([r["key"] for r in apart.where(F.col("all") * SHARE > labelled.count()).select("key").collect()])
    rows = own.where(hot).join(F.broadcast(apart.where(hot)), "key").unionAll(own.where(~hot).join(apart.where(~hot), "key")).join(details, "rep").withColumn("other", F.col("component") != F.col("big"))
    tile = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ("other", "rep", "component", "bands", "coords", "brief")
    one = rows.where("other").select("key", tile("ts").alias("i"), every("ta").alias("j"), F.lit(True).alias("small"), *kept)
    two = rows.select("key", every("ts").alias("i"), tile("ta").alias("j"), F.lit(False).alias("small"), *kept)
    return one.unionByName(two)


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_ = cut(sketches(docs, words))
    classes = all_.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"), F.min("coords").alias("coords"))
    classes = cut(classes)
    banded = _banded(classes)
    groups = banded.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1")
    grouped = cut(joined(banded, groups, "key", classes.count() * BANDS, "inner"))
    sets = cut(_sets(docs, grouped.select("rep").distinct(), words))
    pairs = grouped.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    links = cut(_confirmed(pairs, sets, num, den))
    found = cut(components(links))
    # What is still apart in some band's group.
    labelled = grouped.join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    details = classes.select("rep", "bands", "coords").join(_shares(sets).withColumnRenamed("id", "rep"), "rep")
    more = _confirmed(_open_pairs(_sides(labelled, details), num, den), sets, num, den)
    found = cut(components(links.unionAll(more)))
    # Rows without a shingle stay alone; those of a class with very many copies are dealt.
    class_ = F.struct("s1", "s2", "n_shingles").alias("class")
    by_class = classes.join(found, F.col("rep") == F.col("node"), "left").select(class_, F.coalesce("component", "rep").alias("component_id"))
    some = all_.where("n_shingles > 0").select("doc_id", "n_shingles", class_)
    whole = joined(some, by_class, "class", all_.count())
    alone = all_.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return whole.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).unionAll(alone)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, num=85, den=100)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (five words, 0.8) the document with the smallest doc_id stays."""
    gone = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
