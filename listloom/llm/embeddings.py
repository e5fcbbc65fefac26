"""Embedding near-dedup with an inverted multi-index.

Unit vectors are cut into halves; a codebook for each half, fitted by k-means on at most SAMPLE vectors (the first by a
hash of their id), spans a grid of cells, and every vector is filed in the cell of its two nearest centroids. Codebooks
grow with the square root of the vectors, up to SAMPLE / 5 codes, so a cell keeps its size. A query visits cells by the
multi-sequence order (rising sum of its two squared centroid distances). How many cells it visits is measured twice, and the
larger depth is taken: PROBES sampled vectors are compared with all rows, and RECALL of their true links must lie in
visited cells; and each probe is turned by the angle of the threshold in random directions, and RECALL of the turned
vectors must meet it in a cell that one of the two visits. All vectors are queries and all are filed; what a visit
brings up is verified by the cosine in double precision.

Cells travel in regions: neighbouring codes of both halves, as many regions as give each about REGION vectors of a
label. A vector goes once to its own region and once to every other region that it visits a cell of, never once a cell,
and where one region holds a whole label no vector is copied. Regions with many members, or many visitors, are split into
tiles, and a tile returns counts and a spanning forest of its links, never all pairs.

Vectors link only within equal, non-null labels (and equal lengths). Null, empty and zero vectors and those with null
or non-finite components link with nothing. Equal vectors of one label are one class, stood for by its smallest id, so
copies cost nothing and every link to a class counts as many links as it has members. Rows that repeat an id count as one
vector each. Other columns play no part. An empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import cut, table
from .graph import components, joined

SAMPLE = 20_000
PROBES = 400
RECALL = 0.998
#: Members of one label in a region, on average.
REGION = 4096
#: Members, and visitors, of one tile of a region at most (on average).
TILE = 8192
#: Vectors whose distances to all codes a task holds at once.
STEP = 1024


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of the rows of x; rows drawn without replacement start it, empty clusters keep their centroid."""
    rng = np.random.Generator(np.random.PCG64(9))
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((c * c).sum(axis=1) - 2 * (some @ c.T)).argmin(axis=1) for some in np.array_split(x, len(x) // 1024 + 1)])
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, each computed alike wherever the row stands."""
    out = np.empty((len(x), len(c)))
    for k in range(len(c)):
        d = x - c[k]
        out[:, k] = (d * d).sum(axis=1)
    return out


class MultiIndex:
    def __init__(self, sample: np.ndarray, codes: int):
        self.dim = sample.shape[1]
        self.half = max(1, self.dim // 2)
        self.codes = [np.unique(k_means(x, codes), axis=0) for x in (sample[:, : self.half], sample[:, self.half :])]
        self.depth = 1
        #: The place of each code among the neighbours of its half, by the codebook's main direction.
        self.places = [np.argsort(np.argsort((c - c.mean(axis=0)) @ np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0], kind="stable")) for c in self.codes]

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.codes[0]), distances(x[:, self.half :], self.codes[1])

    def pair_sums(self, x: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The sum of the squared distances of each row to a pair of centroids, as `parts` has them."""
        d, e = x[:, : self.half] - self.codes[0][one], x[:, self.half :] - self.codes[1][two]
        return (d * d).sum(axis=1) + (e * e).sum(axis=1)

    def cells(self, d: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return d[0].argmin(axis=1) * len(self.codes[1]) + d[1].argmin(axis=1)

    def regions(self, cells: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The region of each cell if there are 2**level of them (less where codes are fewer)."""
        m, out = len(self.codes[1]), np.zeros(cells.shape, np.int64)
        for half, code, bits in ((0, cells // m, (level + 1) // 2), (1, cells % m, level // 2)):
            bits = np.minimum(bits, int(np.log2(len(self.codes[half]))))
            out = (out << bits) | ((self.places[half][code] << bits) // len(self.codes[half]))
        return out

    def visits(self, d: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The cells that each query visits in multi-sequence order (rows x depth), and the largest sum among them."""
        m = len(self.codes[1])
        # Of each half only the nearest `depth` centroids can take part in the first `depth` cells.
        o = [np.argsort(x, axis=1, kind="stable")[:, : self.depth] for x in d]
        near = [np.take_along_axis(x, y, axis=1) for x, y in zip(d, o, strict=True)]
        # Cell (r, s) of the sorted grid comes after (r + 1)(s + 1) - 1 others at least.
        r, s = zip(*((r, s) for r in range(near[0].shape[1]) for s in range(min(near[1].shape[1], self.depth // (r + 1)))), strict=True)
        r, s = np.array(r), np.array(s)
        sums = near[0][:, r] + near[1][:, s]
        first = np.argsort(sums, axis=1, kind="stable")[:, : self.depth]
        cells = np.take_along_axis(o[0][:, r] * m + o[1][:, s], first, axis=1)
        return cells, np.take_along_axis(sums, first[:, -1:], axis=1)[:, 0]


def _rank(d: tuple[np.ndarray, np.ndarray], cell: np.ndarray, m: int) -> np.ndarray:
    """How many cells come no later than a given one in the order of each query."""
    out = np.empty(len(cell), np.int64)
    for k in range(len(cell)):
        ordered = np.sort(d[1][k])
        at = d[0][k, cell[k] // m] + d[1][k, cell[k] % m]
        out[k] = np.searchsorted(ordered, at - d[0][k] + 1e-12, "right").sum()
    return np.maximum(out, 1)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision, filled up with zeros to `dim`."""
    out = np.zeros((len(column), dim))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(sizes) and (sizes == dim).all():
        out[:] = values.reshape(len(sizes), dim)
    else:
        at = np.concatenate(([0], np.cumsum(sizes)))
        for k in range(len(sizes)):
            out[k, : sizes[k]] = values[at[k] : at[k + 1]]
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def _usable() -> Column:
    """Whether a row has an id, a label and a finite vector that is not zero."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))


def _keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, key (label and length), v (as it is, or as doubles if it holds no floating numbers) of the usable rows."""
    key = F.concat_ws(":", F.col("label").cast("string"), F.size("embedding").cast("string"))
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    return vectors.where(_usable()).select("vec_id", key.alias("key"), v.alias("v"))


def _hashed(rows: DataFrame) -> DataFrame:
    """128 bits that stand for the vector where it needn't travel."""
    return rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit("second"), "v"))


def fit(classes: DataFrame, dim: int, total: int, threshold: float, recall: float = RECALL) -> MultiIndex:
    """Codebooks from a bounded sample, and the depth that reaches the recall for probes against all rows."""
    codes = int(min(SAMPLE // 5, max(2, (total / 64) ** 0.5)))
    rows = classes.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("rep", "key", "v").toArrow()
    sample = _unit(rows.column("v"), dim)
    index = MultiIndex(sample, codes)
    probes = sample[:PROBES]
    keys = np.array(rows.column("key").to_pylist()[:PROBES], object)
    ids = rows.column("rep").to_numpy()[:PROBES]
    d = index.parts(probes)
    m = len(index.codes[1])

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            x = _unit(batch.column(2), dim)
            cells = index.cells(index.parts(x))
            theirs = np.array(batch.column(1).to_pylist(), object)
            rep = batch.column(0).to_numpy()
            cos = x @ probes.T
            row, probe = np.nonzero((cos >= threshold) & (theirs[:, None] == keys) & (rep[:, None] != ids))
            seen.update(_rank((d[0][probe], d[1][probe]), cells[row], m).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["rank", "n"])

    counts = classes.select("rep", "key", "v").mapInArrow(ranks, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).orderBy("rank").collect()
    index.depth = _turned(index, probes, threshold, recall)
    share, all_ = 0, sum(r["n"] for r in counts)
    for r in counts:
        share += r["n"]
        index.depth = max(index.depth, int(r["rank"]))
        if share >= recall * all_:
            break
    return index


def _turned(index: MultiIndex, probes: np.ndarray, threshold: float, recall: float, turns: int = 5) -> int:
    """The depth at which `recall` of vectors turned by the threshold's angle meet their probe."""
    rng = np.random.Generator(np.random.PCG64(21))
    m, need = len(index.codes[1]), []
    for _ in range(turns):
        r = rng.normal(size=probes.shape)
        r -= (r * probes).sum(axis=1, keepdims=True) * probes
        r /= np.maximum(np.linalg.norm(r, axis=1, keepdims=True), 1e-12)
        turned = threshold * probes + (1 - threshold**2) ** 0.5 * r
        both = [index.parts(probes), index.parts(turned)]
        cells = [index.cells(d) for d in both]
        ranks = [_rank(d, cell, m) for d, cell in zip(both, cells[::-1], strict=True)]
        need.append(np.minimum(*ranks))
    return max(1, int(np.quantile(np.concatenate(need), recall, method="higher")))


ROUTED = "key string, region int, member boolean, rep long, n long, v {v}"


def _routed(classes: DataFrame, index: MultiIndex) -> DataFrame:
    """Each class (key, rep, n, v, level) once in its own region (as a member) and once in every other that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                d = index.parts(_unit(batch.column(3), index.dim))
                level = batch.column(4).to_numpy()
                own = index.regions(index.cells(d), level)
                visited = np.sort(index.regions(index.visits(d)[0], np.repeat(level[:, None], index.depth, axis=1)[:, : len(index.codes[0]) * len(index.codes[1])]), axis=1)
                new = visited != own[:, None]
                new[:, 1:] &= visited[:, 1:] != visited[:, :-1]
                row = np.concatenate((np.arange(len(own)), np.nonzero(new)[0]))
                rows = batch.take(pa.array(row))
                region = np.concatenate((own, visited[new])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(region), pa.array(np.arange(len(row)) < len(own)), rows.column(1), rows.column(2), rows.column(3)], ["key", "region", "member", "rep", "n", "v"])

    return classes.select("key", "rep", "n", "v", "level").mapInArrow(run, ROUTED.format(v=classes.schema["v"].dataType.simpleString()))


class _Forest:
    """The least row number that each of n rows reaches, as links come in."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _leveled(classes: DataFrame) -> DataFrame:
    """classes with the level of their label: 0 where one region is enough."""
    many = classes.groupBy("key").agg(F.count("*").alias("all")).where(F.col("all") > REGION)
    level = many.select("key", F.ceil(F.log2(F.col("all") / REGION)).cast("long").alias("level"))
    return classes.join(level, "key", "left").withColumn("level", F.coalesce("level", F.lit(0).cast("long")))


def _tiled(rows: DataFrame) -> DataFrame:
    """Routed rows dealt into tiles (i of members, j of visitors); a region of one tile takes a row once for both roles."""
    size = rows.groupBy("key", "region").agg(F.count_if("member").alias("members"), F.count("*").alias("visitors"))
    size = size.select("key", "region", F.ceil(F.col("members") / TILE).cast("int").alias("tm"), F.ceil(F.col("visitors") / TILE).cast("int").alias("tv")).where("tm > 1 or tv > 1")
    rows = rows.join(size, ["key", "region"], "left").withColumns({"tm": F.coalesce("tm", F.lit(1)), "tv": F.coalesce("tv", F.lit(1))})
    spot = lambda i, j, m, v: F.struct(i.alias("i"), j.alias("j"), m.alias("m"), v.alias("v"))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    yes, no = F.lit(True), F.lit(False)
    member = F.transform(to("tv"), lambda j: spot(own("tm"), j, yes, no))
    visitor = F.transform(F.when(F.col("tm") > 0, to("tm")).otherwise(F.array().cast("array<int>")), lambda i: spot(i, own("tv"), no, yes))
    many = F.when(F.col("member"), F.concat(member, visitor)).otherwise(visitor)
    at = F.when((F.col("tm") == 1) & (F.col("tv") == 1), F.array(spot(F.lit(0), F.lit(0), F.col("member"), yes))).otherwise(many)
    return rows.withColumn("at", F.explode(at)).select("key", "region", "at.i", "at.j", F.col("at.m").alias("member"), F.col("at.v").alias("visitor"), "rep", "n", "v")


def links(classes: DataFrame, index: MultiIndex, threshold: float) -> DataFrame:
    """(rep, n_links, other): linked members in other classes as counted in one tile, and a class of the same component."""
    m = len(index.codes[1])

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        rep, n = group.column("rep").to_numpy(), group.column("n").to_numpy()
        x = _unit(group.column("v"), index.dim)
        member, visitor = (np.flatnonzero(group.column(c).to_numpy(zero_copy_only=False)) for c in ("member", "visitor"))
        names = np.unique(rep)
        count, forest = np.zeros(len(names), np.int64), _Forest(len(names))
        if len(member) and len(visitor):
            at = np.searchsorted(names, rep)
            cell, last = np.zeros(len(x), np.int64), np.zeros(len(x))
            for some in np.array_split(np.arange(len(x)), len(x) // STEP + 1):
                d = index.parts(x[some])
                cell[some], last[some] = index.cells(d), index.visits(d)[1]
            member = member[np.argsort(cell[member], kind="stable")]
            cells, first = np.unique(cell[member], return_index=True)
            filed = np.split(member, first[1:])
            for some in np.array_split(visitor, len(visitor) // STEP + 1):
                d = index.parts(x[some])
                met = d[0][:, cells // m] + d[1][:, cells % m] <= last[some][:, None]
                for k, own in enumerate(filed):
                    who = some[met[:, k]]
                    a, b = np.nonzero(x[who] @ x[own].T >= threshold)
                    a, b = who[a], own[b]
                    # Where each visits the other's cell, the pair counts when the one with the smaller id visits.
                    back = index.pair_sums(x[b], cell[a] // m, cell[a] % m) <= last[b]
                    once = (rep[a] != rep[b]) & (~back | (rep[a] < rep[b]))
                    a, b = a[once], b[once]
                    np.add.at(count, at[a], n[b])
                    np.add.at(count, at[b], n[a])
                    forest.add(at[a], at[b])
        used = np.flatnonzero(count)
        return pa.table({"rep": pa.array(names[used], pa.int64()), "n_links": pa.array(count[used]), "other": pa.array(names[forest.root[used]], pa.int64())})

    return _tiled(_routed(_leveled(classes), index)).groupBy("key", "region", "i", "j").applyInArrow(run, "rep long, n_links long, other long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links and component_id of every row of vectors (vec_id, embedding, label)."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    good = _keyed(vectors)
    classes = cut(good.groupBy("key", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    total, dim = classes.agg(F.count("*"), F.max(F.size("v"))).first()
    if not total:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = cut(links(classes, fit(classes, dim, total, threshold, recall), threshold))
    counts = found.groupBy("rep").agg(F.sum("n_links").alias("n_links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    classes = classes.join(counts, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left")
    copy = F.struct("key", "h1", "h2").alias("copy")  # copies of one vector, however many, are dealt
    classes = _hashed(classes).select(copy, (F.col("n") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    own = joined(_hashed(good).select("vec_id", copy), classes, "copy", vectors.count(), "inner").select("vec_id", "n_links", "component_id")
    return own.unionAll(vectors.where(~_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))
