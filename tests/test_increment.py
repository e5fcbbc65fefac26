"""Builds kept up to date against whole builds, byte for byte."""

import pytest
from pyspark.sql import functions as F

from listloom.operators import artifacts, bloom, increment, trie
from listloom.sources import folders, generations

LINES = {"a": ["||x.com^", "y.x.com", "||z.org^"], "b": ["||x.com^", "new.y.x.com", "q.net", "x.com."], "c": ["! nothing"], "d": ["z.org", "x.com"]}


def table(spark, ids):
    return spark.createDataFrame([(k, i, raw) for k in ids for i, raw in enumerate(LINES[k])], "list_id string, line_no long, raw string")


def members(spark, *rows):
    return spark.createDataFrame(list(rows), "group string, id string, modified long")


def bytes_of(spark, folder):
    nodes, domains = increment.built(spark, folder, "nodes"), increment.built(spark, folder, "domains")
    tries = {(r["list_id"], r["part"]): bytes(r["content"]) for r in artifacts.trie_parts(trie.laid_out(nodes)).collect()}
    stored = {(r["list_id"], r["byte_idx"]): r["byte_val"] for r in bloom.filter_bytes(increment.built(spark, folder, "blocks")).collect()}
    whole = {(r["list_id"], r["byte_idx"]): r["byte_val"] for r in bloom.filter_bytes(bloom.blocks(bloom.positions(domains, bloom.params(domains)))).collect()}
    assert stored == whole
    return tries, stored


STEPS = [
    [("g", "a", 1), ("h", "a", 1), ("i", "d", 1)],
    [("g", "a", 1), ("g", "b", 1), ("h", "a", 1), ("i", "d", 1)],  # g gets a list
    [("g", "a", 1), ("g", "b", 1), ("h", "a", 1), ("h", "d", 5), ("h", "c", 5), ("i", "d", 1)],  # h gets lists without a new domain
    [("g", "b", 2), ("h", "a", 1), ("h", "d", 5), ("h", "c", 5)],  # g loses one and another changes, i goes
]
EXPECTED = [
    ([("g", "rebuild"), ("h", "rebuild"), ("i", "rebuild")], ["a", "d"]),
    ([("g", "add")], ["b"]),
    ([("h", "add")], ["c", "d"]),
    ([("g", "rebuild"), ("i", "rebuild")], ["b"]),
]


def test_every_step_equals_a_whole_build(spark, tmp_path):
    folder, asked = str(tmp_path / "build"), []
    read = lambda ids: asked.append(ids) or table(spark, ids)
    for k, (step, (how, parsed)) in enumerate(zip(STEPS, EXPECTED, strict=True)):
        asked.clear()
        found = increment.build(spark, folder, members(spark, *step), read)
        # A first build of a group has only additions.
        assert found == ([(g, "add") for g, _ in how] if k == 0 else how) and asked == [parsed]
        held = generations.state(spark, folder, "list_id string, generation string").where("generation is not null")
        whole = str(tmp_path / f"whole{k}")
        increment.build(spark, whole, members(spark, *step), lambda ids: table(spark, ids))
        assert bytes_of(spark, folder) == bytes_of(spark, whole) and {r["list_id"] for r in held.collect()} == {g for g, _, _ in step}
        asked.clear()
        assert increment.build(spark, folder, members(spark, *step), read) == [] and asked == []
    generations.sweep(spark, folder, "list_id string, generation string", keep=1)
    assert bytes_of(spark, folder) == bytes_of(spark, whole) and len(folders.names(spark, f"{folder}/nodes")) == 2


def test_a_filter_of_the_same_size_is_merged(spark, tmp_path, monkeypatch):
    """h gets lists without a new domain: its size stays, its blocks are merged, none of its old domains is hashed."""
    folder, hashed = str(tmp_path / "build"), []
    increment.build(spark, folder, members(spark, *STEPS[1]), lambda ids: table(spark, ids))
    positions = bloom.positions
    monkeypatch.setattr(bloom, "positions", lambda domains, sizes: hashed.append(domains.count()) or positions(domains, sizes))
    increment.build(spark, folder, members(spark, *STEPS[2]), lambda ids: table(spark, ids))
    assert hashed == [0]


def test_a_broken_build_leaves_the_last_one(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "build")
    increment.build(spark, folder, members(spark, *STEPS[0]), lambda ids: table(spark, ids))
    held = bytes_of(spark, folder)
    with monkeypatch.context() as m:
        m.setattr(folders, "mark", lambda *_: (_ for _ in ()).throw(OSError("broken")))
        with pytest.raises(OSError, match="broken"):
            increment.build(spark, folder, members(spark, *STEPS[1]), lambda ids: table(spark, ids))
    assert bytes_of(spark, folder) == held
    assert increment.build(spark, folder, members(spark, *STEPS[1]), lambda ids: table(spark, ids)) == [("g", "add")]


def test_merged_nodes_count_children_once(spark):
    domains = lambda *names: spark.createDataFrame([("l", n) for n in names], "list_id string, domain string")
    old = trie.counted(trie.nodes(domains("a.com", "b.a.com", "d.net")))
    more = domains("a.com.", "c.a.com", "x.y.org", "net", "b.a.com")
    same = lambda df: sorted((tuple(r["path"]), r["is_terminal"], r["child_count"], r["child_bytes"], r["depth"]) for r in df.collect())
    assert same(trie.merged(old, more)) == same(trie.counted(trie.nodes(domains("a.com", "b.a.com", "d.net").union(more))))
    assert same(trie.merged(old, more.where(F.lit(False)))) == same(old)
