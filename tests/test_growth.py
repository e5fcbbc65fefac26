"""Steps whose cost a row must stay small, and whose tasks must stay few."""

import random

from pyspark.sql import functions as F

from listloom.functions import hashing, lines
from listloom.operators import artifacts, bloom, catalog, rules, trie
from listloom.sources import lists


def test_classification_takes_few_patterns(spark):
    heads, tails = ["", "||", "0.0.0.0 ", "127.0.0.1\t", "@@||", "! ", "#", "0.0.0.0"], ["a.com", "A.Com^", "a.com$x", "a.com/p", "a*b.com", "x\\y.com", "a b.com", "local", "localhost.localdomain", "1.2.3.4", "", "a.com # x", "a.com##.b"]
    df = spark.createDataFrame([("l", k, h + t) for k, (h, t) in enumerate((h, t) for h in heads for t in tails)], lists.LINES)
    named = rules.trimmed(df)
    both = named.select(lines.found_name(F.col("line")).alias("a"), F.coalesce(lines.adblock_name(F.col("line")), lines.hosts_name(F.col("line")), lines.plain_name(F.col("line"))).alias("b"))
    assert both.where("not (a <=> b)").isEmpty()
    assert rules.classified(df)._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") <= 3


def test_compiled_hashes_equal_the_fold(spark):
    some = random.Random(1)
    names = ["", *("x" * n for n in (1, 3, 4, 5, 39, 40, 41, 300)), "é" * 30, *("".join(map(chr, some.choices(range(1, 900), k=n))) for n in range(60))]
    df = hashing.with_fnv(spark.createDataFrame([(n,) for n in names], "x string"), "h", "x")
    assert df.count() == len(names) and df.where(F.col("h") != hashing.fnv(F.col("x"))).isEmpty()


def test_deep_pages_cut_few_ranges_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(catalog, "PIECES", 4)
    rows = spark.range(500).select("id", (F.col("id") % 7).cast("int").alias("rule_count"), F.col("id").cast("string").alias("name"))
    whole = rows.orderBy(*catalog.order_columns("rule")).collect()
    pieces, cut = [], type(rows).repartitionByRange
    monkeypatch.setattr(type(rows), "repartitionByRange", lambda self, n, *by: pieces.append(n) or cut(self, n, *by))
    for number, size in ((3, 7), (20, 10), (50, 10), (72, 7)):
        assert catalog.page(rows, number, size, sort="rule", top=0, size_of_range=6).collect() == whole[(number - 1) * size : number * size]
    assert max(pieces) <= 4 and len(pieces) > 4


def test_scanned_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\n\r\ntwo\r\r\nthree")
    found = lists.scan(spark, str(tmp_path))
    assert [r["raw"] for r in found.orderBy("line_no").collect()] == ["one", "", "two\r", "three"]
    assert "SortMergeJoin" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" in plan


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_trimmed_without_a_pattern(spark):
    df = spark.createDataFrame([(chr(c) + "a" + chr(c) + "b" + chr(c) * 2,) for c in range(1, 0x3100)] + [("",), (" \u3000",), (None,)], "x string")
    assert df.where(~lines.trim(F.col("x")).eqNullSafe(F.regexp_replace("x", r"(?U)^\s+|\s+$", ""))).isEmpty()
    assert "regexp_replace" not in _plan(rules.classified(spark.createDataFrame([("l", 1, " ||a.com^ ")], lists.LINES)))


def test_filters_are_built_without_a_row_for_each_bit(spark):
    some = random.Random(2)
    names = ["\u00e9" * 30, "x" * 300, "*.a.b", " ", "A.b", "a.b", *(f"{some.random()}.\u00e9.com" for _ in range(9000))]
    df = spark.createDataFrame([("a" if k % 9 else f"l{k % 5}", n) for k, n in enumerate(names)], "list_id string, domain string")
    sizes = bloom.params(df)
    found = [{(r["list_id"], r["block"]): bytes(r["bits"]) for r in b.collect()} for b in (bloom.built(df, sizes), bloom.blocks(bloom.positions(df, sizes)))]
    assert len(found[0]) > 6 and found[0] == found[1]
    plan = _plan(artifacts.bloom_parts(df))
    assert "bitmap_construct_agg" not in plan and "hash_count" in plan and "aggregate(" not in plan


def test_children_are_counted_without_a_join(spark):
    df = spark.createDataFrame([("l", n) for n in ("a.com", "b.a.com", "c.a.com", "d.net")] + [("m", "a.com")], "list_id string, domain string")
    nodes = trie.nodes(df)
    assert "Join" not in _plan(trie.counted(nodes))
    joined = nodes.join(trie.children(nodes), ["list_id", "path"], "left").fillna(0, ["child_count", "child_bytes"])
    assert sorted(map(tuple, trie.counted(nodes).collect())) == sorted(map(tuple, joined.collect()))
