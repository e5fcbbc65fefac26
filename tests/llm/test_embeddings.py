import math

import numpy as np
import pandas as pd

from listloom.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    ok = {}
    for i, v, label in rows:
        if label is None or v is None or len(v) == 0 or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        x = np.asarray(v, np.float64)
        ok[i] = (x / np.sqrt((x * x).sum()), label)
    near = {i: set() for i, *_ in rows}
    ids = sorted(ok)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= threshold:
                near[a].add(b)
                near[b].add(a)
    component = {}
    for i in sorted(near):
        if i not in component:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in component:
                    component[j] = i
                    todo += near[j]
    return {i: (len(near[i]), component[i], component[i] == i) for i in near}


def test_recall_and_precision(spark, write_tables, empty):
    e = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet")
    rng = np.random.Generator(np.random.PCG64(2))
    data = [(int(i), [float(x) for x in v], int(label)) for i, v, label in zip(e.vec_id, e.embedding, e.label, strict=True)]
    for k in range(600):  # cosines on both sides of the threshold
        _, v, label = data[k]
        x = np.array(v)
        r = rng.normal(size=len(x))
        r -= (r @ x) / (x @ x) * x
        cos = rng.uniform(0.9, 1.0)
        data.append((100_000 + k, [float(np.float32(y)) for y in cos * x + (1 - cos**2) ** 0.5 * np.linalg.norm(x) * r / np.linalg.norm(r)], label))
    want = brute(data)
    folder = write_tables(empty, embeddings=spark.createDataFrame(data, SCHEMA))
    found = {r["vec_id"]: tuple(r)[1:] for r in embeddings.op2_embedding_dedup(spark, folder).collect()}
    assert found.keys() == want.keys()
    links = sum(w[0] for w in want.values())
    assert links > 0 and sum(f[0] for f in found.values()) >= 0.98 * links
    assert all(found[i][0] <= want[i][0] for i in want)
    assert sum(found[i] == want[i] for i in want) >= 0.98 * len(want)


def rows():
    rng = np.random.Generator(np.random.PCG64(1))
    centre = rng.normal(size=16)
    out = [(i, [float(np.float32(x)) for x in centre + 0.05 * rng.normal(size=16)], 1) for i in range(60)]
    out += [(100 + i, out[0][1], 1) for i in range(20)] + [(200, out[0][1], 2), (201, out[0][1], None), (202, None, 1), (203, [], 1)]
    out += [(204, [0.0] * 16, 1), (205, [float("nan")] * 16, 1), (206, [None] * 16, 1), (207, [float("inf")] + [0.0] * 15, 1), (208, [1.0, 2.0], 1), (209, [2.0, 4.0], 1), (210, [-0.0] * 15 + [1.0], 1), (211, [0.0] * 15 + [2.0], 1)]
    return out


def test_odd_vectors_and_tiles(spark, write_tables, empty, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 8)
    monkeypatch.setattr(embeddings, "REGION", 16)
    data = rows()
    folder = write_tables(empty, embeddings=spark.createDataFrame(data, SCHEMA))
    found = {r["vec_id"]: tuple(r)[1:] for r in embeddings.op2_embedding_dedup(spark, folder).collect()}
    assert found == brute(data)


def test_regions_and_doubles(spark, write_tables, empty, monkeypatch):
    """Many regions and tiles; vectors in double precision keep their bits."""
    monkeypatch.setattr(embeddings, "TILE", 200)
    monkeypatch.setattr(embeddings, "REGION", 100)
    rng = np.random.Generator(np.random.PCG64(6))
    data = [(k, rng.normal(size=24).tolist(), 1) for k in range(1500)]
    for k in range(500):
        x = np.array(data[k][1])
        r = rng.normal(size=24)
        r -= (r @ x) / (x @ x) * x
        cos = rng.uniform(0.92, 1.0)
        data.append((5000 + k, (cos * x + (1 - cos**2) ** 0.5 * np.linalg.norm(x) * r / np.linalg.norm(r)).tolist(), 1))
    data += [(9000, [1.0, 1.0 + 2**-40], 3), (9001, [1.0, 1.0], 3)]
    want = brute(data)
    folder = write_tables(empty, embeddings=spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"))
    found = {r["vec_id"]: tuple(r)[1:] for r in embeddings.op2_embedding_dedup(spark, folder).collect()}
    assert found.keys() == want.keys() and found[9000] == (1, 9000, True)
    assert all(found[i][0] <= want[i][0] for i in want)
    assert sum(found[i] == want[i] for i in want) >= 0.98 * len(want)


def test_empty(spark, write_tables, empty):
    folder = write_tables(empty, embeddings=spark.createDataFrame([], SCHEMA))
    assert embeddings.op2_embedding_dedup(spark, folder).collect() == []
