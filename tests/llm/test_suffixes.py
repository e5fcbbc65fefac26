import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from listloom.llm import exchange, suffixes


def brute(rows, n=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[k : k + n] for _, t in texts for k in range(len(t) - n + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1):
            if count[t[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_array():
    rng = random.Random(5)
    for n, k in [(0, 2), (1, 1), (2, 1), (7, 1), (9, 2), (60, 2), (300, 3), (300, 1), (500, 26)]:
        for _ in range(20):
            s = [rng.randrange(k) for _ in range(n)]
            assert suffixes.suffix_array(np.array(s, np.int64)) == sorted(range(n), key=lambda i: s[i:])
    fib = [0, 1]
    for _ in range(10):
        fib = fib + fib[: len(fib) // 2 + 1]
    assert suffixes.suffix_array(np.array(fib)) == sorted(range(len(fib)), key=lambda i: fib[i:])


def test_equals_brute_force(spark, sf_dir, documents):
    found = sorted(tuple(r) for r in suffixes.op9_suffix_dedup(spark, sf_dir).collect())
    assert found == brute(list(zip(documents.doc_id.tolist(), documents.text, strict=True)))
    assert sum(r[2] for r in found) > 0


@pytest.mark.parametrize("most", [16_384, 5])
def test_many_chunks_and_edges(spark, documents, monkeypatch, most):
    monkeypatch.setattr(exchange, "MOST", most)  # 5: arrays go by routers
    monkeypatch.setattr(exchange, "CHUNK", 9_000)
    rng = random.Random(6)
    passages = [t[:700] for t in documents.text[:6] if len(t) > 700]
    rows = [(k, t[:3000]) for k, t in enumerate(documents.text[:40])]
    for k in range(120):
        p = rng.choice(passages)
        a = rng.randrange(300)
        rows.append((100 + k, f"{rng.random()} " * rng.randrange(8) + p[a : a + rng.randrange(150, 400)] + f" {rng.random()}" * rng.randrange(8)))
    rows += [(900, "a" * 200), (901, "a" * 199), (902, "b" * 201), (903, "xy" * 150), (904, passages[0] * 2)]
    found = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["first"]), hashlib.sha256(r["kept"]).hexdigest()) for r in suffixes.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert found == brute(rows)


def test_odd_rows(spark, odd, write_tables):
    found = sorted(tuple(r) for r in suffixes.op9_suffix_dedup(spark, write_tables(odd)).collect())
    assert found == brute([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_empty(spark, empty, write_tables):
    assert suffixes.op9_suffix_dedup(spark, write_tables(empty)).collect() == []


def test_equal_rows_of_one_file_are_no_hot_chunk(spark, documents, tmp_path):
    """20,000 equal rows of 2 KB shrink to one small piece of a file; also rows below the string length, and others that share theirs."""
    from pyspark.sql import functions as F

    folder = str(tmp_path / "docs")
    text = documents.text[documents.text.str.len().idxmax()][:2000]
    same = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    short = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("short " * 20).alias("text"))
    other = [(100, "before " * 9 + "\x01" + text[300:900] + "\x01" + " after" * 9), (101, "nothing of it " * 2), (7, "short " * 21), (7, text), (102, "")]
    same.union(short).union(spark.createDataFrame(other, same.schema)).coalesce(1).write.parquet(folder)
    docs = spark.read.parquet(folder)
    chunks, plan = exchange.chunked(docs)
    sizes = [r["n"] for r in chunks.groupBy("chunk").agg(F.sum(F.octet_length("text")).alias("n")).collect()]
    assert plan.chunks > 20 and max(sizes) <= 4 * docs.agg(F.sum(F.octet_length("text"))).first()[0] / plan.chunks
    assert exchange.repeated(chunks.drop("chunk")).count() == docs.count()
    found = suffixes.dedup(docs).groupBy("doc_id", "n_bytes", "n_removed", "kept").agg(F.count("*").alias("n"), F.max(F.size("first")).alias("spans")).collect()
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"]), r["n"], r["spans"]) for r in found}
    size = len(text.encode())
    rest = len(other[0][1].encode()) - len(text[300:900].encode())
    assert (7, size, size, b"", 20_001, 1) in got and (None, 120, 0, b"short " * 20, 60_000, 0) in got and (7, 126, 0, b"short " * 21, 1, 0) in got
    assert {(r[0], r[1] - r[2], r[4]) for r in got if r[0] in (100, 101, 102)} == {(100, rest, 1), (101, 28, 1), (102, 0, 1)} and sum(r[4] for r in got) == docs.count()
