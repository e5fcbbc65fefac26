import hashlib
import re

import pytest

from listloom.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n=13):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - n + 1):
            if least[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_equals_brute_force(spark, sf_dir, documents):
    found = [tuple(r) for r in substrings.op5_substring_dedup(spark, sf_dir).collect()]
    assert sorted(found) == brute(list(zip(documents.doc_id, documents.text, strict=True)))
    assert sum(r[2] for r in found) > 0


def test_odd_rows(spark, odd, write_tables):
    folder = write_tables(odd)
    found = sorted(tuple(r) for r in substrings.op5_substring_dedup(spark, folder).collect())
    assert found == brute([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_repeated_and_null_ids_spread_over_chunks(spark, documents, tmp_path):
    from listloom.llm import exchange

    rows = [(None if k % 2 else 5, t) for k, t in enumerate(documents.text[:160])] * 3
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    chunks, plan = exchange.chunked(docs, size=20_000)
    sizes = [r["count"] for r in chunks.groupBy("chunk").count().collect()]
    assert len(sizes) > 0.9 * plan.chunks > 20 and max(sizes) < 0.1 * len(rows)


@pytest.mark.parametrize("most", [16_384, 5])
def test_many_chunks_and_other_lengths(spark, documents, monkeypatch, most):
    from listloom.llm import exchange

    monkeypatch.setattr(exchange, "MOST", most)  # 5: arrays go by routers
    monkeypatch.setattr(exchange, "CHUNK", 20_000)
    rows = list(zip(documents.doc_id.tolist(), documents.text, strict=True))[:120]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (3, 8, 21):
        found = sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substrings.dedup(docs, n).collect())
        assert found == brute(rows, n)


def test_empty(spark, empty, write_tables):
    assert substrings.op5_substring_dedup(spark, write_tables(empty)).collect() == []


def test_many_equal_rows(spark, documents, monkeypatch):
    """Rows that are equal in id and text are judged once and given as often as they stand."""
    from listloom.llm import exchange

    monkeypatch.setattr(exchange, "CHUNK", 20_000)
    text = max(documents.text, key=len)[:3000]
    rows = [(5, text)] * 300 + [(9, "some words " + text[500:1500])] + [(3, text[100:800])] + [(None, "a b c")] * 9000 + [(5, "")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    many, plan = exchange.chunked(docs)
    assert plan.chunks > 40 and many.where("times > 1").count() == 2 and exchange.repeated(many).count() == len(rows)
    found = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substrings.dedup(docs).collect()]
    assert sorted(found, key=str) == sorted(brute([r for r in rows if r[0] is not None]) + [(None, 3, 0, hashlib.sha256(b"a b c").hexdigest())] * 9000, key=str)
