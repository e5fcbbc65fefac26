"""Cases that every operator must take: other columns with clashing names, repeated rows, null ids, very long texts."""

import pytest
from pyspark.sql import functions as F

from listloom.llm import decontaminate, registry

NAMES = ["chunk", "bucket", "counts", "hashes", "key", "rep", "n", "a", "b", "node", "component", "component_id", "kept", "score", "predicted", "held_out", "lang_pred", "gram", "h2", "v", "level",
         "region", "tree", "leaf", "altered", "lo", "hi", "kids", "above", "cluster", "x", "times", "h1", "spans", "kind", "votes", "ids", "decoded", "n_tokens", "n_words", "n_bytes", "n_removed", "item_id", "edits", "word", "pack", "salt", "member", "n_links", "n_shingles", "label", "embedding", "quality"]


@pytest.fixture(scope="module")
def folders(spark, odd, documents, tmp_path_factory, sf_dir):
    """A folder of tables, and one of the same tables with more columns."""
    import os

    docs = odd.unionByName(spark.createDataFrame([(None, "no id here but words", "en", "s", 1), (None, "no id here but words", "en", "s", 1), (50, "the quick red fox runs over " * 60_000, "en", "s", 0)], odd.schema))
    docs = docs.unionByName(spark.createDataFrame([(1000 + i, t, lang, "s", 0) for i, t, lang in zip(documents.doc_id.tolist()[:60], documents.text, documents.lang, strict=False)], odd.schema))
    out = []
    for more in (False, True):
        folder = str(tmp_path_factory.mktemp("more" if more else "plain"))
        for name in os.listdir(sf_dir):
            df = spark.read.parquet(f"{sf_dir}/{name}") if name != "documents.parquet" else docs
            if more:
                df = df.select("*", *(F.lit(f"x{k}").alias(n) for k, n in enumerate(NAMES) if n not in df.columns))
            df.write.parquet(f"{folder}/{name}")
        out.append(folder)
    return out


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_other_columns_change_nothing(spark, folders, name):
    plain, more = ([tuple(r) for r in registry.QUERIES[name](spark, f).collect()] for f in folders)
    key = lambda r: [(x is None, str(x)) for x in r]
    assert plain and sorted(plain, key=key) == sorted(more, key=key)
    if name not in ("op2_embedding_dedup", "op4_html_text", "op8_decontaminate", "op12_centroids"):
        rows = [r for r in plain if r[0] == 6]  # a row that stands twice; as leaves of a tree each has a proof of its own
        assert len(rows) == 2 and (rows[0] == rows[1] or name == "op13_merkle" and rows[0][:4] == rows[1][:4])
        assert len([r for r in plain if r[0] is None]) == 2 and len([r for r in plain if r[0] == 50]) == 1


def test_an_item_in_a_very_long_text(spark, sf_dir):
    item = " ".join(spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"].split())
    words = " ".join(f"w{k % 9999}" for k in range(400_000))
    docs = spark.createDataFrame([(1, f"{words} {item} {words}"), (2, words)], "doc_id long, text string")
    found = decontaminate.matches(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [tuple(r) for r in found] == [(1, 7, 400_000, len(item.split()), 0)]
