"""op13 against a plain version with hashlib."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from listloom.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(hashes):
    """Root and, for each leaf, its levels of (left, right) siblings."""
    level, paths, at = list(hashes), [[] for _ in hashes], list(range(len(hashes)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append((run[: i % 8], run[i % 8 + 1 :]))
        level = [H(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def plain(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append((r, leaf(r)))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    found, subroots = [], []
    for lang in langs:
        own = sorted(by_lang[lang], key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        subroot, paths = tree([h for _, h in own])
        subroots.append(subroot)
        found += [(r, h, subroot, path, lang) for (r, h), path in zip(own, paths, strict=True)]
    root, tops = tree(subroots)
    out = []
    for r, h, subroot, path, lang in found:
        whole = path + tops[langs.index(lang)]
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
        fold = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if hit else h
        for left, right in whole:
            fold = H(*left, fold, *right)
        out.append((r[0], h, subroot, root, H(*(x for left, right in whole for x in left + right)), fold, fold == root))
    return sorted(out, key=str)


def mine(spark, write_tables, docs):
    return sorted((tuple(r) for r in merkle.op13_merkle(spark, write_tables(docs)).collect()), key=str)


def rows_of(docs):
    return [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def many(spark, odd):
    """Trees of 0 to 3 levels, a run of one, null languages and ids, repeated rows and ids."""
    add = [(100 + k, f"Text {k} É", lang, "s" if k % 2 else None, k) for lang, n in (("aa", 1), ("bb", 8), ("cc", 9), ("dd", 65), ("ee", 600), ("ff", 2), ("gg", 3), (None, 17), ("É", 4)) for k in range(n)]
    add += [(None, "No Id", "dd", "s", 1)] * 3 + [(105, f"again {k}", "dd", "s", 1) for k in range(20)] + [(105, "again 3", "dd", "s", 1)] * 30
    return odd.unionByName(spark.createDataFrame(add, odd.schema))


def test_equals_plain_version(spark, write_tables, many):
    assert mine(spark, write_tables, many) == plain(rows_of(many))


@pytest.mark.parametrize("n", [0, 1, 8, 9])
def test_small_tables(spark, write_tables, many, n):
    docs = many.where("lang = 'ee'").orderBy("doc_id").limit(n)
    assert mine(spark, write_tables, docs) == (plain(rows_of(docs)) if n else [])


def test_sql_on_odd_rows(spark, write_tables, many):
    folder = write_tables(many)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert sorted(con.execute(merkle.SQL).fetchall(), key=str) == plain(rows_of(many))


def test_levels_are_intervals(spark, many):
    own = merkle.numbered(merkle.leaves(many), ["doc_id", "leaf"], "t").withColumnRenamed("leaf", "h")
    made = merkle.levels(own.select("tree", "n", "lo", "hi", "h"), "t")
    assert len(made) == 4
    for k, level in enumerate(made, 1):
        assert level.where(F.size("kids") > 8).isEmpty()
        assert level.where((F.col("lo") % 8**k != 0) | (F.col("hi") > F.col("n")) | (F.col("hi") - F.col("lo") > 8**k)).isEmpty()
    whole = own.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("lo").alias("d"), F.max("hi").alias("hi"))
    assert whole.where("n <> d or n <> hi").isEmpty()


def test_any_change_is_seen(spark, many):
    """Proofs hold for the rows as they are, and for no other text, id or order."""
    rows = merkle.manifest(merkle.leaves(many, changed=F.concat("text", F.lit(" "))))
    judged = rows.select("altered", (merkle.folded(F.col("leaf"), F.col("above")) == F.col("root")).alias("good"), (merkle.folded(F.col("altered"), F.col("above")) == F.col("root")).alias("bad"))
    assert judged.where("not good or bad").isEmpty() and judged.where("altered is not null").count() > 600
