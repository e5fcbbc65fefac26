"""op12 against a plain version with Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from listloom.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, dimensions, n, rounds, scale=1024):
    keep = [(i, [math.floor(v * scale) if abs(v) < 2**40 else int(v) * scale for v in e]) for i, e in rows if e is not None and len(e) == dimensions and all(v is not None and math.isfinite(v) for v in e)]
    start = sorted(keep, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:n]
    cs = [x for _, x in start]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x: min((far(x, c), k) for k, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in keep]
        cs = [[sum(col) // len(mine) for col in zip(*mine, strict=True)] if (mine := [x for (_, x), o in zip(keep, own, strict=True) if o == k]) else c for k, c in enumerate(cs)]
    return cs, sorted((i, near(x)[1], near(x)[0]) for i, x in keep)


def mine(spark, rows, dimensions, n, rounds):
    vectors = centroids.kept(spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA), dimensions=dimensions)
    cs = centroids.clustered(vectors, centroids.first_centroids(vectors, n), rounds)
    return cs, sorted(tuple(r) for r in centroids.assigned(vectors, cs).collect())


@pytest.mark.parametrize("scale", [0.01, 1.0, 900.0])
def test_equals_plain_rounds(spark, scale):
    rnd = np.random.default_rng(5)
    e = rnd.normal(0, scale, (300, 6)) + rnd.integers(-2, 3, (300, 1)) * scale
    rows = [(k, v.tolist()) for k, v in enumerate(e)] + [(k, e[k].tolist()) for k in range(40)]
    rows += [(900, None), (901, [1.0] * 5), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [math.nan] + [0.0] * 5), (904, [math.inf] + [0.0] * 5), (905, [0.0] * 6)]
    assert mine(spark, rows, 6, 8, 4) == plain(rows, 6, 8, 4)


def test_ties_go_to_the_smaller_number(spark):
    grid = [(k, [float(k % 3) / 1024, float(k // 3 % 3) / 1024]) for k in range(60)]
    for rounds in (0, 1, 3):
        assert mine(spark, grid, 2, 8, rounds) == plain(grid, 2, 8, rounds)


def test_few_rows_and_none(spark, write_tables, odd):
    assert mine(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])], 2, 8, 3) == plain([(1, [0.5, 1.0]), (2, [0.5, 1.0])], 2, 8, 3)
    assert mine(spark, [], 2, 8, 3) == ([], [])
    none = spark.createDataFrame([(1, None, 0)], SCHEMA)
    assert centroids.op12_centroids(spark, write_tables(odd, embeddings=none)).collect() == []


def test_components_of_any_size(spark):
    rows = [(k, [float(k) * 10.0 ** (6 * (k % 5)), -1.5 * k]) for k in range(25)] + [(99, [1e300, -1e300])]
    cs, found = mine(spark, rows, 2, 4, 3)
    want, all_ = plain(rows, 2, 4, 3)
    assert cs == want and found == [(i, c, d if d < 2**63 else None) for i, c, d in all_]
    for n in (0, 1, -1, 2**30, -(2**30), 2**200 + 7, -(2**200) - 7):
        assert sum(part << 30 * place for place, part in centroids._limbs(n)) == n


def test_most_centroids_are_passed_over():
    rnd = np.random.default_rng(1)
    x = rnd.integers(-2000, 2000, (3000, 1)) + rnd.integers(-40, 40, (3000, 16))
    search = centroids.Search(x[:200].tolist())
    number, distance = search.nearest(x)
    every = ((x[:, None, :] - x[None, :200, :]) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert search.tried < every.size / 20
