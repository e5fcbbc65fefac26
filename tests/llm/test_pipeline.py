import corpus_pipeline
from listloom.llm import bpe, decontaminate, langid


def test_runs_and_each_stage_takes_effect(spark, sf_dir, documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = docs
    for _, stage in corpus_pipeline.STAGES:
        want = stage(spark, want, sf_dir)
    found = corpus_pipeline.run(spark, sf_dir)
    a = {r["doc_id"]: (r["text"], list(r["ids"]), bytes(r["decoded"])) for r in found.collect()}
    b = {r["doc_id"]: (r["text"], list(r["ids"]), bytes(r["decoded"])) for r in want.collect()}
    assert a == b and 0 < len(a) < len(documents)
    assert all(d.decode() == t for t, _, d in a.values())
    assert set(docs.columns) < set(found.columns)
    hit = {r["doc_id"] for r in decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert hit and not hit & a.keys()


def test_stages_take_odd_rows(spark, odd, sf_dir):
    left = odd
    for _, stage in corpus_pipeline.STAGES[:4]:
        left = stage(spark, left, sf_dir)
        assert left.columns == odd.columns
    last = corpus_pipeline.STAGES[4][1](spark, left, sf_dir).collect()
    ids = {r["doc_id"] for r in last}
    assert {4, 8, 10} <= ids and not ids & {1, 2, 3, 7}


def test_extra_columns_stay(spark, odd, sf_dir):
    more = odd.selectExpr("*", "text as lang_pred", "doc_id as component_id", "n_chars as bands", "1 as rep")
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, more, sf_dir).columns == more.columns
        stage(spark, more, sf_dir).collect()


def test_stages_take_an_empty_table(spark, empty, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []


def test_language_of_held_out_documents(spark, documents):
    sf = "/root/testdata/sf0.01"
    rows = langid.op6_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(spark, odd, write_tables, empty):
    rows = {r["doc_id"]: r for r in langid.op6_language_id(spark, write_tables(odd)).collect()}
    assert {rows[i]["lang_pred"] for i in (1, 2, 3, 7)} == {"und"} and rows[4]["lang_pred"] in {"en", "de"}
    assert langid.op6_language_id(spark, write_tables(empty)).collect() == []


def test_bpe_equals_the_library(spark, odd, documents, monkeypatch, write_tables):
    import hashlib

    import public_tokenizers

    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe.parts, "__defaults__", (50,))
    long = [t for t in documents.text if t][:30] + [r["text"] for r in odd.collect() if r["text"]] + [" \n  x\t\t  y 's don't  12ab \n\n é \xa0 z" * 40]
    for t in long:
        assert [i for p in bpe.parts(t) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
    for r in bpe.op10_byte_bpe(spark, write_tables(odd)).collect():
        t = next(x["text"] or "" for x in odd.collect() if x["doc_id"] == r["doc_id"])
        ids = enc.encode_ordinary(t)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
