"""Centroid clustering of integer vectors by equal-average equal-variance nearest-neighbour search; all arithmetic is exact.

A vector x and a centroid c of d components with sums S and T and with deviations v = sqrt(d * sum(x**2) - S**2) hold
d * |x - c|**2 >= (S - T)**2 + (v_x - v_c)**2. Centroids are kept in order of their means; from a vector's own mean the scan
goes outward to both sides. It ends once the mean alone shows that nothing further out can win, passes over centroids that
the deviation rejects, and works out the distance to the others in integers. The bounds are strict, so that ties are seen and
go to the smaller number.

Each round is one job: tasks send sums of components by cluster, in limbs of 30 bits so that no sum overflows, whatever the
components; the driver holds the centroids (a number of them times the components) and nothing else. A lost task is done
again from the input.

Vectors that are null, have another number of components or a null or non-finite one are left out. A repeated row counts as
often as it stands; a null id stands for no start while there are others. With fewer rows than centroids there are fewer
centroids; an empty table gives an empty table. A distance or sum that no long holds is null. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import small_batches, table

#: Units of one, centroids, rounds and components of the registered query.
SCALE, CENTROIDS, ROUNDS, DIMENSIONS = 1024, 8, 10, 64
#: Rows that are compared at once.
ROWS = 4096
_LIMB, _LONG = 30, 2**63 - 1
_COUNT, _INERTIA = -1, -2


def kept(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, x: the vectors that are clustered, as doubles."""
    x = F.col(embedding).cast("array<double>")
    finite = F.forall("x", lambda v: F.coalesce((F.abs(v) < F.lit(float("inf"))) & ~F.isnan(v), F.lit(False)))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dimensions) & finite)


def first_centroids(vectors: DataFrame, n: int = CENTROIDS, seed: str = "3", scale: int = SCALE) -> list[list[int]]:
    """The n vectors with the smallest sha256 of `seed:<vec_id>`; equal ids go by their components."""
    sha: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(sha.asc_nulls_last(), "x").limit(n).collect()
    return [_integers(np.array([r["x"]]), scale)[0].tolist() for r in rows]


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as int64, or as Python's integers where some component is large."""
    if not len(x) or np.abs(x).max() * scale < 2**52:
        return np.floor(x * scale).astype(np.int64)
    whole = [[math.floor(v * scale) if abs(v) * scale < 2**52 else _floor(v, scale) for v in row] for row in x.tolist()]
    return np.array(whole, object)


def _floor(v: float, scale: int) -> int:
    above, below = v.as_integer_ratio()
    return above * scale // below


def _small(x: np.ndarray) -> bool:
    """Whether all products of the search stay in 63 bits."""
    return x.dtype != object and (not x.size or 4 * x.shape[1] ** 2 * int(np.abs(x).max()) ** 2 < 2**62)


class Search:
    """Nearest centroids; `tried` counts the distances that were worked out."""

    def __init__(self, centroids: list[list[int]]):
        self.c = np.array(centroids, object)
        self.small = bool(len(centroids)) and max(abs(v) for c in centroids for v in c) < 2**52 and _small(self.c.astype(np.int64))
        self.tried = 0
        if self.small:
            c = self.c.astype(np.int64)
            self.order = np.lexsort((np.arange(len(c)), c.sum(1)))
            self.sorted = c[self.order]
            self.sums, self.spread = self.sorted.sum(1), _spread(self.sorted)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row, and the squared distance."""
        if self.small and _small(x):
            return self._scan(x.astype(np.int64))
        self.tried += len(x) * len(self.c)
        each = [((x.astype(object) - c) ** 2).sum(1) for c in self.c]
        best = [min(range(len(each)), key=lambda k, i=i: (each[k][i], k)) for i in range(len(x))]
        return np.array(best, np.int64), np.array([each[k][i] for i, k in enumerate(best)], object)

    def _scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k, d = len(x), len(self.sums), x.shape[1] if x.ndim == 2 else 1
        total, spread = x.sum(1), _spread(x)
        above = np.searchsorted(self.sums, total)
        below = above - 1
        best, number = np.full(n, 2**62 // d), np.full(n, k)
        rows = np.arange(n)
        while len(rows):
            low, high = below[rows], above[rows]
            left = np.where(low >= 0, total[rows] - self.sums[np.maximum(low, 0)], 2**62)
            right = np.where(high < k, self.sums[np.minimum(high, k - 1)] - total[rows], 2**62)
            down = left <= right
            gap, at = np.where(down, left, right), np.where(down, low, high)
            # Beyond the nearer side's mean all others lie further out: what the mean rejects ends the scan.
            going = gap < 2**31
            going[going] = gap[going] ** 2 <= d * best[rows[going]]
            rows, gap, at, down = rows[going], gap[going], at[going], down[going]
            below[rows[down]] -= 1
            above[rows[~down]] += 1
            apart = np.abs(spread[rows] - self.spread[at])
            apart = np.maximum(apart - 1e-9 * (spread[rows] + self.spread[at]) - 1e-3, 0)  # more than doubles can be off
            near = (gap.astype(np.float64) ** 2 + apart**2) * (1 - 1e-9) <= d * best[rows].astype(np.float64)
            tried, at = rows[near], at[near]
            self.tried += len(tried)
            found = ((x[tried] - self.sorted[at]) ** 2).sum(1)
            name = self.order[at]
            better = (found < best[tried]) | ((found == best[tried]) & (name < number[tried]))
            best[tried[better]], number[tried[better]] = found[better], name[better]
        return number, best


def _spread(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x.shape[1] * (x**2).sum(1) - x.sum(1) ** 2).astype(np.float64))


def _rows(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with their vectors as integers; rows with large components come apart from the others."""
    for batch in small_batches(batches, ROWS):
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        large = (np.abs(x) * scale >= 2**24).any(1) if len(x) else np.zeros(0, bool)
        for part in (~large, large):
            if part.any():
                yield batch.filter(pa.array(part)), _integers(x[part], scale)


def _limbs(n: int) -> Iterator[tuple[int, int]]:
    """n as a sum of part * 2**(30 * place), each part within 31 bits."""
    place = 0
    while not -(1 << _LIMB) < n < 1 << _LIMB:
        yield place, n & ((1 << _LIMB) - 1)
        n, place = n >> _LIMB, place + 1
    if n:
        yield place, n


def sums(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> dict[tuple[int, int], int]:
    """For each cluster the sum of every component, the rows (_COUNT) and the distances (_INERTIA)."""
    search, k = Search(centroids), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}

        def add(key: tuple[int, int], n: int) -> None:
            total[key] = total.get(key, 0) + n

        for _, x in _rows(batches, scale):
            number, distance = search.nearest(x)
            for c in range(k):
                mine = number == c
                if mine.any():
                    add((c, _COUNT), int(mine.sum()))
                    add((c, _INERTIA), sum(distance[mine].tolist()))
                    for at, n in enumerate(x[mine].sum(0).tolist()):
                        add((c, at), n)
        rows = [(c, at, place, part) for (c, at), n in total.items() for place, part in _limbs(n)]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], ["cluster", "at", "place", "part"])

    parts = vectors.mapInArrow(run, "cluster long, at long, place long, part long").groupBy("cluster", "at", "place").agg(F.sum("part").alias("part"))
    found: dict[tuple[int, int], int] = {}
    for r in parts.collect():  # as many rows as centroids have components, times the limbs of a sum
        found[r["cluster"], r["at"]] = found.get((r["cluster"], r["at"]), 0) + (r["part"] << _LIMB * r["place"])
    return found


def clustered(vectors: DataFrame, centroids: list[list[int]], rounds: int = ROUNDS, scale: int = SCALE) -> list[list[int]]:
    """The centroids after some rounds; sooner once a round changes none, as then no later one does."""
    for _ in range(rounds):
        found = sums(vectors, centroids, scale)
        moved = [[found.get((c, at), 0) // found[c, _COUNT] for at in range(len(old))] if (c, _COUNT) in found else old for c, old in enumerate(centroids)]
        if moved == centroids:
            break
        centroids = moved
    return centroids


def assigned(vectors: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance of every vector (vec_id, x)."""
    search = Search(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _rows(batches, scale):
            number, distance = search.nearest(x)
            far = pa.array([v if v <= _LONG else None for v in distance.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), far], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = kept(table(spark, sf_dir, "embeddings"))
    centroids = clustered(vectors, first_centroids(vectors))
    found = sums(vectors, centroids)
    inertia = [found.get((c, _INERTIA), 0) for c in range(len(centroids))]
    fits = lambda n: n if n <= _LONG else None
    facts = [(c, fits(n), fits(sum(inertia)), digest(centroids[c])) for c, n in enumerate(inertia)]
    small = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned(vectors, centroids).join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The rounds written out one after another, for small tables: a row a vector and component."""
    near = """n{0} as materialized (select rid, cluster, d from (select rid, cluster, d, row_number() over (partition by rid order by d, cluster) as nth from (
        select rid, cluster, sum((x - c) * (x - c)) as d from v join c{0} using (nr) group by 1, 2)) where nth = 1)"""
    move = """c{1} as materialized (select cluster, nr, coalesce((s - ((s % m) + m) % m) // m, c) as c from c{0} left join (
        select cluster, nr, sum(x) as s, count(*) as m from v join n{0} using (rid) group by 1, 2) using (cluster, nr))"""
    steps = ", ".join([f"{near.format(k)}, {move.format(k, k + 1)}" for k in range(ROUNDS)] + [near.format(ROUNDS)])
    return f"""with e as (select vec_id, embedding::double[] as x from embeddings),
        r as materialized (select row_number() over () as rid, vec_id, x from e where len(x) = {DIMENSIONS} and list_bool_and(list_transform(x, lambda y: y is not null and isfinite(y)))),
        v as materialized (select rid, unnest(range(0, {DIMENSIONS})) as nr, unnest(list_transform(x, lambda y: cast(floor({SCALE} * y) as bigint))) as x from r),
        s as (select rid, row_number() over (order by sha256(concat('3:', vec_id)), x) - 1 as cluster from r where vec_id is not null),
        c0 as materialized (select cluster, nr, x as c from v join s using (rid) where cluster < {CENTROIDS}), {steps},
        h as (select cluster, sha256(string_agg(c::varchar, ',' order by nr)) as centroid_sha256 from c{ROUNDS} group by 1),
        i as (select cluster, sum(d) as n from n{ROUNDS} group by 1)
        select vec_id, cast(cluster as int) as cluster, cast(d as bigint) as distance, cast(n as bigint) as cluster_inertia, cast((select sum(n) from i) as bigint) as inertia, centroid_sha256
        from r join n{ROUNDS} using (rid) join i using (cluster) join h using (cluster)"""


SQL = _sql()
