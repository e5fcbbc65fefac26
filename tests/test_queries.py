"""Every registered query of the rule engine against its SQL in DuckDB, and properties of those without SQL."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from listloom.operators import artifacts, bloom, catalog, increment, match, rules
from listloom.plans import catalogue
from listloom.sources import fixtures, folders, lists
from listloom.streaming import live


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con


def rows(df):
    def text(v):
        if v is None or v != v:
            return ""
        return repr(round(float(v), 6)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    mine, theirs = catalogue.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_probe_loses_no_match_and_lets_few_through(spark, sf_dir):
    """Also where no block is broadcast, a filter's blocks are copied and names are dealt over the copies."""
    domains = rules.domains(rules.first_seen(fixtures.filter_lines(spark, sf_dir)))
    names = fixtures.dns_queries(spark, sf_dir)
    held = {r["qname"] for r in match.matched_rule(names, domains).collect()}
    maybe = catalogue.QUERIES["bloom_probe"](spark, sf_dir)
    assert held and held <= {r["qname"] for r in maybe.where("list_id = 'all'").collect()}
    by_list = maybe.where("list_id = 'list_3'")
    assert {r["qname"] for r in match.matched_rule(names, domains.where("list_id = 'list_3'")).collect()} <= {r["qname"] for r in by_list.collect()}
    assert all(r["rate"] < 0.01 for r in catalogue.QUERIES["bloom_fp_rate"](spark, sf_dir).collect())
    pairs = bloom.suffixes(names).selectExpr("explode(array('list_3', 'list_1', 'none')) as list_id", "suffix as name")
    filters = bloom.filters(domains)
    want = sorted(tuple(r) for r in bloom.probe(pairs, *filters).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(tuple(r) for r in bloom.probe(pairs, *filters, spread=5).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_probe_has_no_nested_loop_and_few_exchanges(spark, sf_dir):
    plan = catalogue.QUERIES["bloom_probe"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and plan.count("Exchange hashpartitioning") <= 3
    offsets = catalogue.QUERIES["trie_offsets"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert offsets.count("Exchange") - offsets.count("BroadcastExchange") <= 6


def test_every_query_has_sql():
    assert catalogue.QUERIES.keys() == catalogue.ORACLE_SQL.keys()


def test_refresh_takes_whole_lists_and_isolates_failures(spark, tmp_path, monkeypatch):
    landing, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    land = lambda rows: lists.land(spark.createDataFrame(rows, "list_id string, raw string"), landing)
    runs = lambda n: {(r["list_id"], r["status"], r["stage"], r["rule_count"]) for r in spark.read.parquet(f"{target}/runs/run_id={n}").collect()}
    rows_of = lambda: {r["name"]: (r["id"], r["rule_count"], r["file_size"]) for r in catalog.current(spark, f"{target}/catalog").collect()}
    land([("001", "||a.com^"), ("b", "! no rule"), ("c", "x" * (1 << 20)), ("c", "||c.com^")])
    live.refresh(spark, landing, target, state, catalogue.UPDATED)
    assert runs(0) == {("001", "ok", "compile", 1), ("b", "failed", "compile", 0), ("c", "failed", "compile", 0)}
    first = rows_of()
    assert first.keys() == {"001"}
    # Later files of a list are compiled with its earlier ones; other lists keep what they have.
    land([("001", "||b.com^"), ("d", "||d.com^"), ("d", "##.ad")])
    live.refresh(spark, landing, target, state, catalogue.UPDATED)
    assert runs(1) == {("001", "ok", "compile", 2), ("d", "ok", "compile", 1)}
    second = rows_of()
    assert second["001"][0] == first["001"][0] and second["001"][1] == 2 and second["d"][1] == 1
    sizes = {r["list_id"]: r["file_size"] for r in artifacts.bundle_size(artifacts.published(spark, f"{target}/artifacts")).collect()}
    assert sizes == {k: v[2] for k, v in second.items()}

    def broken(*_):
        raise AnalysisException("no catalog")

    # A catalog that can't be written stops nothing and is no failure of the run.
    monkeypatch.setattr(catalog, "write", broken)
    land([("d", "||e.com^")])
    live.refresh(spark, landing, target, state, catalogue.UPDATED)
    assert runs(2) == {("d", "ok", "compile", 2), ("d", "failed", "catalog", 2)}
    summary = catalog.run_summary(live.runs(spark, target)).collect()
    assert {r["run_id"]: (r["succeeded"], r["failed"]) for r in summary} == {0: (1, 2), 1: (2, 0), 2: (2, 0)}


def test_refresh_reads_only_touched_lists(spark, tmp_path, monkeypatch):
    """The scan has a partition filter, other lists' files are not read (they could not be), and nothing of a batch stays."""
    landing, target, state, shared = (str(tmp_path / x) for x in ("in", "out", "state", "shared"))
    monkeypatch.setattr(folders, "shared_base", lambda _: shared)
    land = lambda rows: lists.land(spark.createDataFrame(rows, "list_id string, raw string"), landing)
    land([(f"l{k}", f"||a{k}.com^") for k in range(7)] + [("a/b", "||slash.com^")])
    live.refresh(spark, landing, target, state, catalogue.UPDATED, group=3)
    assert live.runs(spark, target).count() == 8 and catalog.current(spark, f"{target}/catalog").count() == 8
    seen = []
    scan = lists.scan
    monkeypatch.setattr(lists, "scan", lambda *a, **k: seen.append(scan(*a, **k)) or seen[-1])
    assert folders.names(spark, shared) == []
    land([("l3", "||b.com^"), ("new", "||n.com^")])
    live.refresh(spark, landing, target, state, catalogue.UPDATED, group=3)
    assert folders.names(spark, shared) == []
    (df,) = seen
    files = set(df.inputFiles())
    assert {f.split("list_id=")[1].split("/")[0] for f in files} == {"l3", "new"} and len(files) == 3
    assert "PartitionFilters: [" in (plan := df._jdf.queryExecution().executedPlan().toString()) and "list_id" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r["list_id"]: r["rule_count"] for r in live.runs(spark, target).where("run_id = 1").collect()} == {"l3": 2, "new": 1}
    assert {r["list_id"] for r in artifacts.published(spark, f"{target}/artifacts").collect()} == {f"l{k}" for k in range(7)} | {"a/b", "new"}


def _parts(spark, *rows):
    return spark.createDataFrame([(x, "css", 0, y) for x, y in rows], "list_id string, entry string, part long, content binary")


def _held(parts):
    return {r["list_id"]: bytes(r["content"]) for r in parts.collect()}


def test_readers_see_whole_publications(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "a")
    assert artifacts.published(spark, folder).isEmpty() and artifacts.damaged(spark, folder).isEmpty()
    artifacts.publish(_parts(spark, ("x/y", b"1"), ("z", b"2")), folder)
    reader = artifacts.published(spark, folder)
    # A publication that breaks before its marker is not seen, and a reader keeps what it began with.
    with monkeypatch.context() as m:
        m.setattr(folders, "mark", lambda *_: (_ for _ in ()).throw(OSError("broken")))
        with pytest.raises(OSError, match="broken"):
            artifacts.publish(_parts(spark, ("x/y", b"half"), ("w", b"half")), folder)
    assert _held(artifacts.published(spark, folder)) == {"x/y": b"1", "z": b"2"}
    assert {r["list_id"]: r["n_bytes"] for r in artifacts.publish(_parts(spark, ("x/y", b"new")), folder).collect()} == {"x/y": 3}
    assert _held(reader) == {"x/y": b"1", "z": b"2"} and _held(artifacts.published(spark, folder)) == {"x/y": b"new", "z": b"2"}
    assert _held(artifacts.published(spark, folder, ["z", "nowhere"])) == {"z": b"2"}
    data = sorted(Path(folder, "data").glob("*/list_id=z/*.parquet"))
    before = [p.stat().st_mtime_ns for p in data]
    artifacts.unpublish(spark, folder, ["x/y", "nowhere"])
    assert _held(artifacts.published(spark, folder)) == {"z": b"2"} and before == [p.stat().st_mtime_ns for p in data] and _held(reader)["x/y"] == b"1"
    assert [r["generation"] for r in artifacts.state(spark, folder).where("list_id = 'x/y'").collect()] == [None]
    artifacts.sweep(spark, folder, keep=1)
    assert _held(artifacts.published(spark, folder)) == {"z": b"2"} and len(folders.names(spark, f"{folder}/data")) == 1 == len(folders.names(spark, f"{folder}/state"))
    artifacts.publish(_parts(spark, ("x/y", b"again")), folder)
    assert _held(artifacts.published(spark, folder)) == {"z": b"2", "x/y": b"again"} and artifacts.damaged(spark, folder).isEmpty()


def test_two_publishers_keep_each_others_lists(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "a")
    artifacts.publish(_parts(spark, ("a", b"1"), ("b", b"1")), folder)
    mark, first = folders.mark, []

    def raced(*args):
        if not first:
            first.append(1)
            artifacts.publish(_parts(spark, ("b", b"2"), ("c", b"2")), folder)
        mark(*args)

    monkeypatch.setattr(folders, "mark", raced)
    artifacts.publish(_parts(spark, ("a", b"3"), ("d", b"3")), folder)
    assert _held(artifacts.published(spark, folder)) == {"a": b"3", "b": b"2", "c": b"2", "d": b"3"}


def test_damaged_parts_are_found(spark, tmp_path):
    folder = str(tmp_path / "a")
    artifacts.publish(_parts(spark, ("a", b"1"), ("b", b"22")), folder)
    (file,) = Path(folder, "data").glob("*/list_id=b/*.parquet")
    bad = _parts(spark, ("b", b"2x")).selectExpr("entry", "part", "content", "2L as n_bytes", "sha2('22', 256) as sha256")
    bad.coalesce(1).write.parquet(str(tmp_path / "bad"))
    (other,) = (tmp_path / "bad").glob("*.parquet")
    file.write_bytes(other.read_bytes())
    Path(file.parent, f".{file.name}.crc").unlink()
    assert [tuple(r) for r in artifacts.damaged(spark, folder).collect()] == [("b", "css", 0)]


def test_catalog_snapshots(spark, tmp_path, sf_dir):
    folder = str(tmp_path / "catalog")
    assert catalog.current(spark, folder).count() == 0 == catalog.last_version(spark, folder)
    rows_ = fixtures.filter_lists(spark, sf_dir)
    catalog.write(rows_, folder, 3)
    catalog.write(rows_.limit(2), folder, 10)
    with pytest.raises(folders.Taken):
        catalog.write(rows_.limit(1), folder, 10)
    assert catalog.current(spark, folder).count() == 2 and catalog.last_version(spark, folder) == 10
    assert rows(catalog.current(spark, folder, before=10).toPandas()) == rows(rows_.toPandas())
    assert catalog.current(spark, folder, before=3).count() == 0
    catalog.write(rows_.limit(1), folder, 11)
    catalog.sweep(spark, folder, keep=2)
    assert folders.versions(spark, folder) == [10, 11] and len(folders.names(spark, f"{folder}/data")) == 2
    assert catalog.current(spark, folder, before=11).count() == 2


def test_a_broken_catalog_write_leaves_the_last_snapshot(spark, tmp_path, sf_dir):
    """A task that fails in the middle of a write leaves files behind, and no reader takes them for a snapshot."""
    folder = str(tmp_path / "catalog")
    rows_ = fixtures.filter_lists(spark, sf_dir)
    catalog.write(rows_, folder, 1)
    half = rows_.repartition(4).withColumn("name", F.when(F.col("id") % 20 == 0, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        catalog.write(half, folder, 2)
    Path(folder, "data", "2-left").mkdir(parents=True)
    assert rows(catalog.current(spark, folder).toPandas()) == rows(rows_.toPandas()) and folders.versions(spark, folder) == [1]
    catalog.write(rows_.limit(1), folder, 2)
    assert catalog.current(spark, folder).count() == 1


def test_a_second_catalog_writer_begins_anew(spark, tmp_path, monkeypatch, sf_dir):
    folder = str(tmp_path / "catalog")
    rows_ = fixtures.filter_lists(spark, sf_dir)
    batch = fixtures.upsert_batch(rows_)
    write, first = catalog.write, []

    def raced(frame, *args):
        if not first:
            first.append(1)
            write(rows_, folder, 1)
        write(frame, *args)

    monkeypatch.setattr(catalog, "write", raced)
    assert catalog.apply(spark, folder, batch, fixtures.NOW) == 2
    assert rows(catalog.current(spark, folder).toPandas()) == rows(catalog.upsert(rows_, batch, fixtures.NOW).toPandas())


def test_stream_restarts_repeat_nothing(spark, tmp_path):
    """A native append-mode stream: names of any depth, the root's rule, and a restart that finds only the new file."""
    landed, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    deep = ".".join("abcdefghijklmnopqrstuvwxyz")
    domains = spark.createDataFrame([("sec", "a.com."), ("ad", "b.com"), ("sec", deep), ("ad", "x." + deep)], "list_id string, domain string")
    custom = spark.createDataFrame([("own.a.com", 0)], "qname string, action int")
    put = lambda names, at: spark.createDataFrame([(at + k, n) for k, n in enumerate(names)], "query_id long, qname string").coalesce(1).write.mode("append").parquet(landed)
    go = lambda side: live.verdicts(spark.readStream.schema("query_id long, qname string").parquet(landed), custom, side, target, state)
    got = lambda: {r["query_id"]: r["verdict"] for r in spark.read.parquet(target).collect()}
    side = match.sides(domains, F.col("list_id") == "sec")
    put(["a.com", "q.a.com.", "own.a.com", "b.com", "c.com", None, f"q.{deep}", f"y.x.{deep}", deep[2:]], 0)
    go(side)
    want = dict(enumerate(["block_security", "block_security", "allow_custom", "block_ad", "forward", "forward", "block_security", "block_security", "forward"]))
    assert got() == want
    go(side)
    put(["b.com", "c.com", None], 100)
    go(match.sides(domains.union(spark.createDataFrame([("ad", ".")], "list_id string, domain string").selectExpr("list_id", "domain")), F.col("list_id") == "sec"))
    assert got() == want | {100: "block_ad", 101: "block_ad", 102: "forward"} and spark.read.parquet(target).count() == 12


def test_upsert_twice_is_once_and_last_row_counts(spark, sf_dir):
    rows_ = fixtures.filter_lists(spark, sf_dir)
    batch = fixtures.upsert_batch(rows_)
    once = catalog.upsert(rows_, batch, fixtures.NOW)
    assert rows(catalog.upsert(once, batch, fixtures.NOW).toPandas()) == rows(once.toPandas())
    assert catalog.duplicate_urls(once).isEmpty()
    later = batch.limit(1).withColumns({"seq": batch["seq"] + 10_000, "name": batch["url"]})
    assert catalog.upsert(rows_, batch.unionByName(later), fixtures.NOW).where("name = url").count() == 1


def test_page_arguments_and_order():
    assert catalog.page_arguments(0, 0) == (1, 10) and catalog.page_arguments(-3, 1000) == (1, 100)
    text = [[str(c) for c in catalog.order_columns(*a)] for a in ((), ("name",), ("name", "DESC"), ("size", "Asc"), ("rule", "asc"))]
    assert ["last_updated DESC" in text[0][0], "name ASC" in text[1][0], "name DESC" in text[2][0], "file_size DESC" in text[3][0], "rule_count ASC" in text[4][0]] == [True] * 5


def test_deep_pages_sort_only_their_range(spark, sf_dir):
    rows_ = fixtures.filter_lists(spark, sf_dir).withColumn("rule_count", (F.col("id") % 7).cast("int"))
    for sort, order in (("rule", ""), ("name", "desc"), ("size", "asc"), ("", "")):
        whole = rows_.orderBy(*catalog.order_columns(sort, order)).collect()
        for number, limit in ((3, 4), (2, 7), (5, 10), (1, 60), (40, 10)):
            found = catalog.page(rows_, number, limit, sort=sort, order=order, top=0, size_of_range=6)
            size = catalog.page_arguments(number, limit)[1]
            assert found.collect() == whole[(number - 1) * size : number * size]
    deep = catalog.page(rows_, 9, 5, sort="rule", top=20, size_of_range=6)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in deep and "limit=45" not in deep and "_piece" in deep
    assert catalog.page(rows_, 10_000_000, 100).isEmpty()


def test_delete_reports_unknown_urls(spark, sf_dir):
    rows_ = fixtures.filter_lists(spark, sf_dir)
    left, unknown = catalog.delete(rows_, spark.createDataFrame([("nowhere",)], "url string"))
    assert left.count() == rows_.count() and [r["url"] for r in unknown.collect()] == ["nowhere"]


def test_add_then_difference_is_empty(spark, sf_dir):
    one, two = catalogue._sides(spark, sf_dir)
    whole = increment.added(one, two)
    assert increment.difference(whole, increment.added(whole, two)).isEmpty()


def test_lists_of_several_files_keep_their_order(spark, tmp_path):
    """Files by name, lines numbered from 1 through all of them, also where a file is read in many pieces; CSS in that order."""
    folder = tmp_path / "list_id=l"
    folder.mkdir()
    texts = {f"part-{k}.txt": "".join(f"##.f{k}-{i}\n" if i % 5 else "! c\r\n" for i in range(n)) for k, n in ((2, 40), (0, 3000), (1, 1), (3, 700))}
    for name, text in texts.items():
        (folder / name).write_text(text, newline="")
    (tmp_path / "list_id=other").mkdir()
    (tmp_path / "list_id=other" / "a.txt").write_bytes(b"a.com\rb.com\n\n##.x")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = lists.scan(spark, str(tmp_path)).where("list_id = 'l'").orderBy("line_no").collect()
        css = artifacts.css_parts(rules.first_seen(lists.scan(spark, str(tmp_path), ["l"]))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [x.removesuffix("\r") for name in sorted(texts) for x in texts[name].split("\n")[:-1]]
    assert [r["raw"] for r in found] == want and [r["line_no"] for r in found] == list(range(1, len(want) + 1))
    assert b"".join(bytes(r["content"]) for r in sorted(css, key=lambda r: r["part"])).decode() == "".join(f"{x}\n" for x in dict.fromkeys(want) if x.startswith("##"))
    other = lists.scan(spark, str(tmp_path), ["other", "nowhere"]).orderBy("line_no").collect()
    assert [(r["line_no"], r["raw"], r["n_bytes"]) for r in other] == [(1, "a.com\rb.com", 11), (2, "", 0), (3, "##.x", 4)]
    assert lists.scan(spark, str(tmp_path), ["nowhere"]).isEmpty()


@pytest.mark.parametrize("body, fails", [(b"x" * 1048575 + b"\n", False), (b"x" * 1048574 + b"\r\n", False), (b"x" * 1048575 + b"\r\n", True), (b"x" * 1048576, True), (b"x" * 1048575, False)])
def test_a_line_is_measured_with_its_carriage_return(spark, tmp_path, body, fails):
    Path(tmp_path, "a.txt").write_bytes(b"b.com\n" + body)
    assert [r["list_id"] for r in lists.too_long(lists.scan(spark, str(tmp_path))).collect()] == ["a"] * fails


def test_scan_of_files(spark, tmp_path):
    Path(tmp_path, "a.txt").write_bytes(b"||a.com^\r\n! c\r\n\r\nb.com\n")
    Path(tmp_path, "b.txt").write_bytes(b"x" * (1 << 20) + b"\nc.com\n")
    found = lists.scan(spark, str(tmp_path))
    assert [r["raw"] for r in found.where("list_id = 'a'").orderBy("line_no").collect()] == ["||a.com^", "! c", "", "b.com"]
    assert [r["list_id"] for r in lists.too_long(found).collect()] == ["b"]
    counted = {r["list_id"]: r["rule_count"] for r in rules.counts(rules.first_seen(lists.readable(found)), found).collect()}
    assert counted == {"a": 2, "b": 0}
    assert [r["list_id"] for r in rules.empty(rules.counts(rules.first_seen(lists.readable(found)), found)).collect()] == ["b"]


def test_plans_have_no_python(spark, sf_dir):
    for name in ("rule_counts", "trie_offsets", "bloom_bytes", "dns_verdict", "catalog_upsert"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_bloom_size_matches_rate():
    assert math.isclose(14.38, -math.log(0.001) / math.log(2) ** 2, rel_tol=1e-3)
