"""Matching along label paths against a walk of plain tries, and joins and orders without hot tasks."""

import random

import pytest
from pyspark.sql import functions as F

from listloom.operators import joins, match, trie

RULES = ["a.com", "a.com.", ".c.com", "x..d.com", "local.", "b.a.com", "deep.er.x.d.com", "com.net", "..e.org", "München.de", "xd.com", "a.b", "ab", "a b.com"]
NAMES = ["a.com", "b.a.com", "z.b.a.com.", "aa.com", "com", "c.com", "x.c.com", "d.com", "x.d.com", "y.x.d.com", "x.y.d.com", "h.local", "local", "local.x", "net", "com.net", "e.org", ".e.org", "q..e.org", "münchen.de", "München.de",
         "w.München.de", "xd.com", "x..d..com", "deep.er.x.d.com", "", ".", "..", None, "a.b", "ab.", "b", "a.b.c", "x.a b.com"]


def labels(name):
    return [x for x in reversed(name.split(".")) if x]


def walk(rules):
    """A trie as nested dicts, and the terminal nodes on a name's way from the root."""
    root = {}
    for r in rules:
        node = root
        for x in labels(r):
            node = node.setdefault(x, {})
        node[None] = True

    def met(name):
        node, found, way = root, [], []
        if None in node:
            found.append(".")
        for x in labels(name):
            node = node.get(x)
            if node is None:
                break
            way.append(x)
            if None in node:
                found.append(".".join(reversed(way)))
        return found

    return met


def tables(spark, rules, names):
    domains = spark.createDataFrame([("l", r) for r in rules] + [("m", r) for r in rules[::2]], "list_id string, domain string")
    queries = spark.createDataFrame([(k, n, k) for k, n in enumerate(names)], "query_id long, qname string, n long")
    return domains, queries


@pytest.mark.parametrize("more", [[], ["."], ["..."]])
@pytest.mark.parametrize("most", [joins.HOT, 1])
def test_matches_are_those_of_a_walk(spark, more, most):
    rnd = random.Random(len(more) + most)
    rules = RULES + more + [".".join(rnd.choice(["a", "b", "c", ""]) for _ in range(rnd.randint(1, 5))) for _ in range(60)]
    names = NAMES * 2 + [".".join(rnd.choice(["a", "b", "c", "d", ""]) for _ in range(rnd.randint(1, 6))) for _ in range(200)]
    domains, queries = tables(spark, rules, names)
    met = walk(rules)
    hit = [k for k, n in enumerate(names) if n is not None and met(n)]
    assert sorted(r["query_id"] for r in match.blocked(queries, domains, most).collect()) == hit
    assert sorted(r["query_id"] for r in match.clean(queries, domains, most).collect()) == sorted(set(range(len(names))) - set(hit))
    found = {r["qname"]: (r["rule"], r["n_rules"]) for r in match.matched_rule(queries, domains, most).collect()}
    assert found == {n: (met(n)[0], len(met(n))) for n in names if n is not None and met(n)}
    # The nodes of the trie table lie on the same way.
    terminal = {tuple(r["path"]) for r in trie.nodes(domains.where("list_id = 'l'")).where("is_terminal").collect()}
    assert found.keys() == {n for n in names if n is not None and any(tuple(labels(n)[:k]) in terminal for k in range(len(labels(n)) + 1))}


@pytest.mark.parametrize("most", [joins.HOT, 2])
def test_verdicts_by_side_and_custom_rule(spark, most, monkeypatch):
    monkeypatch.setattr(match, "FEW", 0 if most == 2 else 500_000)
    domains = spark.createDataFrame([("sec", "a.com"), ("ad", "a.com."), ("ad", "b.com"), ("sec", "x.b.com"), ("ad", "x..b.com")], "list_id string, domain string")
    names = ["a.com", "q.a.com", "b.com", "q.b.com", "q.x.b.com.", "c.com", None, "own.a.com", "own.c.com", "a.com", "a.com"]
    queries = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "query_id long, qname string")
    custom = spark.createDataFrame([("own.a.com", 0), ("own.c.com", 1), ("unseen", 1)], "qname string, action int")
    found = match.verdicts(queries, custom, match.sides(domains, F.col("list_id") == "sec"), most)
    assert found.columns == ["query_id", "qname", "verdict"] or set(found.columns) == {"query_id", "qname", "verdict"}
    got = {r["query_id"]: r["verdict"] for r in found.collect()}
    want = ["block_security", "block_security", "block_ad", "block_ad", "block_security", "forward", "forward", "allow_custom", "block_custom", "block_security", "block_security"]
    assert [got[k] for k in range(len(names))] == want
    root = match.sides(spark.createDataFrame([("ad", "."), ("sec", "b.com")], domains.schema), F.col("list_id") == "sec")
    got = {r["query_id"]: r["verdict"] for r in match.verdicts(queries, custom, root, most).collect()}
    assert [got[k] for k in range(len(names))] == ["block_ad", "block_ad", "block_security", "block_security", "block_security", "block_ad", "forward", "allow_custom", "block_custom", "block_ad", "block_ad"]


def test_empty_tables(spark):
    domains, queries = tables(spark, ["a.com"], ["a.com"])
    none = queries.limit(0)
    assert match.blocked(none, domains).isEmpty() and match.blocked(queries, domains.limit(0)).isEmpty()
    assert match.clean(queries, domains.limit(0)).count() == 1 and match.matched_rule(none, domains).isEmpty()


def test_hot_keys_are_dealt_whole(spark):
    rows = spark.range(5000).withColumn("k", F.when(F.col("id") < 4000, 1).otherwise(F.col("id")))
    right = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    out = joins.dealt(rows, right, ["k"], "left", 100)
    assert out.count() == 5000 and out.where("v <> k * 2 or v is null").isEmpty() and set(out.columns) == {"id", "k", "v"}
    plan = joins.dealt(rows, right, ["k"], "inner", 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_no_range_of_an_order_is_large(spark):
    """200,000 names under one: every window's partition stays near the mean."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        names = spark.range(200_000).select(F.lit("l").alias("list_id"), F.concat(F.lit("n"), "id", F.lit(".blogspot.com")).alias("domain"))
        seen = {}
        keep = joins.stored
        joins.stored = lambda df, name: seen.setdefault(name, keep(df, name))
        try:
            placed = trie.laid_out(trie.nodes(names))
        finally:
            joins.stored = keep
        sizes = [r["n"] for r in seen["nodes"].groupBy("list_id", "_piece").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) >= 3 and max(sizes) <= 2 * sum(sizes) / len(sizes)
        top = placed.agg(F.max("bfs_index").alias("m"), F.count_distinct("bfs_index").alias("n"), F.max(F.col("byte_offset") + F.col("n_bytes")).alias("end"), F.sum("n_bytes").alias("bytes")).first()
        assert top["m"] == 200_002 and top["n"] == 200_003 and top["end"] == top["bytes"] + 16
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
