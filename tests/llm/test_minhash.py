import re

from listloom.llm import graph, minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=3, num=85, den=100):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_equals_brute_force(spark, sf_dir, documents):
    want = brute(list(zip(documents.doc_id.tolist(), documents.text, strict=True)))
    found = {r["doc_id"]: tuple(r)[1:] for r in minhash.op3_minhash(spark, sf_dir).collect()}
    assert found == want
    assert sum(not r[2] for r in found.values()) > 0


def test_group_of_near_copies_in_tiles(spark, monkeypatch, write_tables, odd):
    import random

    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + (i * 37) % 150, " ".join(w), None, None, 0))
    docs = spark.createDataFrame(rows, odd.schema)
    monkeypatch.setattr(minhash, "TILE", 16)
    found = {r["doc_id"]: tuple(r)[1:] for r in minhash.op3_minhash(spark, write_tables(docs)).collect()}
    assert found == brute([r[:2] for r in rows])


def test_odd_rows(spark, odd, write_tables):
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    rows = minhash.op3_minhash(spark, write_tables(odd)).collect()
    assert len(rows) == odd.count()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want


def test_empty(spark, empty, write_tables):
    assert minhash.op3_minhash(spark, write_tables(empty)).collect() == []


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(10, 40)] + [(1, 2), (2, 1), (5, 5), (50, 40), (7, 99)], "a long, b long")
    found = {r["node"]: r["component"] for r in graph.components(links).collect()}
    assert found == {**dict.fromkeys(range(10, 41), 10), 50: 10, 1: 1, 2: 1, 7: 7, 99: 7}


def test_stage_keeps_one_of_each_group(spark, odd, sf_dir):
    kept = sorted(r["doc_id"] for r in minhash.stage(spark, odd, sf_dir).collect())
    assert 4 in kept and 6 not in kept and 1 in kept and 3 in kept
