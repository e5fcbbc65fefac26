"""All registered queries of the rule engine with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import lines as L
from ..functions import naming as N
from ..operators import artifacts, bloom, catalog, increment, joins, match, rules, trie, validate
from ..sources import fixtures as X
from ..sources import lists as S
from ..sources.folders import shared_folder, stored
from .oracle import ORACLE_SQL as ORACLE_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SECURITY = ("list_0", "list_1", "list_2", "list_3")
UPDATED = "2024-06-01T00:00:00Z"
BASE = "https://lists.example.com/"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _lines(spark, sf):
    return X.filter_lines(spark, sf)


def _trimmed(spark, sf):
    return rules.trimmed(_lines(spark, sf))


def _rules(spark, sf):
    return rules.first_seen(_lines(spark, sf))


def _domains(spark, sf):
    return rules.domains(_rules(spark, sf))


def _counted(spark, sf):
    lines = _lines(spark, sf)
    return rules.counts(rules.first_seen(lines), lines)


def _lists(spark, sf):
    return _lines(spark, sf).select("list_id").distinct().select("list_id", F.concat(F.lit(BASE), "list_id").alias("url"))


def _joined(path="path"):
    return F.array_join(path, "/").alias("path")


def line():
    return F.col("line")


def _landed(spark, sf):
    """The lines as scanned from text files that they are landed in."""
    folder = shared_folder(spark, "lists")
    S.land(X.landed_lines(spark, sf), folder)
    return S.scan(spark, folder)


@query
def scan_list_lines(spark, sf):
    lines = _landed(spark, sf).groupBy("list_id").agg(F.count("*").alias("n_lines"), F.max(F.octet_length("raw")).alias("longest"))
    return lines.withColumn("too_long", F.col("longest") >= S.LONGEST)


@query
def trim_lines(spark, sf):
    return _trimmed(spark, sf)


@query
def drop_comments(spark, sf):
    return _trimmed(spark, sf).where(~L.is_comment(line()))


def _of_kind(kind: str) -> Query:
    return lambda spark, sf: _rules(spark, sf).where(F.col("kind") == kind).select("list_id", "text", "first_line")


for _kind in ("scriptlet", "cosmetic", "domain"):
    QUERIES[f"{_kind}_rules"] = _of_kind(_kind)


def _names(name) -> Query:
    def run(spark, sf):
        return L.with_domain(_trimmed(spark, sf), name(line())).where("domain is not null").select("list_id", "line_no", "domain")

    return run


for _form, _name in (("adblock", L.adblock_name), ("hosts", L.hosts_name), ("plain", L.plain_name)):
    QUERIES[f"domains_{_form}"] = _names(_name)


@query
def reject_reserved(spark, sf):
    named = L.once(_trimmed(spark, sf), "name", L.hosts_name(line())).select("list_id", "line_no", "name")
    return named.where(L.is_reserved(L.lower(L.trim(F.col("name")))))


@query
def reject_ip(spark, sf):
    return L.once(_trimmed(spark, sf), "name", L.plain_name(line())).select("list_id", "line_no", "name").where(L.is_address(F.col("name")))


@query
def classify_lines(spark, sf):
    return rules.classified(_lines(spark, sf))


@query
def classify_noise(spark, sf):
    each = L.with_rules(L.once(X.noise_lines(spark, sf), "line", L.trim(F.col("raw")))).select("doc_id", F.col("rules")["kind"].alias("kinds"))
    return each.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.array_contains("kinds", "cosmetic")).alias("cosmetic"), F.count_if(F.array_contains("kinds", "domain")).alias("domains"))


@query
def reversed_labels(spark, sf):
    return _domains(spark, sf).select("list_id", "domain", F.array_join(L.reversed_labels(F.col("domain")), "/").alias("labels"))


@query
def rules_first_seen(spark, sf):
    return _rules(spark, sf)


@query
def rule_counts(spark, sf):
    return _counted(spark, sf)


@query
def empty_lists(spark, sf):
    lines = _landed(spark, sf)
    return rules.empty(rules.counts(rules.first_seen(S.readable(lines)), lines))


@query
def trie_nodes(spark, sf):
    return trie.nodes(_domains(spark, sf)).select("list_id", _joined(), "depth", "is_terminal")


@query
def trie_children(spark, sf):
    return trie.children(trie.nodes(_domains(spark, sf))).select("list_id", _joined(), "child_count", "child_bytes")


@query
def trie_stats(spark, sf):
    return trie.stats(trie.nodes(_domains(spark, sf)))


@query
def trie_bfs(spark, sf):
    return trie.laid_out(trie.nodes(_domains(spark, sf))).select("list_id", _joined(), "depth", "bfs_index")


@query
def trie_offsets(spark, sf):
    return trie.laid_out(trie.nodes(_domains(spark, sf))).select("list_id", _joined(), "bfs_index", "byte_offset")


def _hash(name: str, high: str, low: str) -> Query:
    def run(spark, sf):
        hashed = H.with_fnv(_domains(spark, sf), "hash", "domain")
        return hashed.select("list_id", "domain", H.number(F.col("hash")[high], F.col("hash")[low]).cast("string").alias(name))

    return run


QUERIES["fnv1a64"], QUERIES["fnv1_64"] = _hash("h1", "a", "a_lo"), _hash("f1", "f", "f_lo")


@query
def bloom_params(spark, sf):
    return bloom.params(_domains(spark, sf))


@query
def bloom_positions(spark, sf):
    domains = _domains(spark, sf)
    return bloom.positions(domains, bloom.params(domains))


@query
def bloom_bytes(spark, sf):
    domains = _domains(spark, sf)
    return bloom.filter_bytes(bloom.built(domains, stored(bloom.params(domains), "bloom-sizes")))


#: The lists of the fixture, and all of them as one.
LISTS = (*(f"list_{k}" for k in range(8)), "all")


def _probed(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rules of each list, all suffixes with the number of names that have each, and the suffixes that a list's filter may
    hold, with that number."""
    domains = stored(_domains(spark, sf), "domains")
    domains = domains.unionByName(bloom.merged(domains))
    counted = stored(bloom.suffixes(X.dns_queries(spark, sf)).groupBy("suffix").agg(F.count("*").alias("n")), "suffixes")
    pairs = counted.select(F.explode(F.array(*map(F.lit, LISTS))).alias("list_id"), F.col("suffix").alias("name"))
    maybe = bloom.probe(pairs, *bloom.filters(domains)).select("list_id", F.col("name").alias("suffix"))
    return domains, counted, stored(maybe.join(counted, "suffix"), "maybe")


@query
def bloom_probe(spark, sf):
    """Names that a list's filter lets through: some suffix may be a rule of the list."""
    _, _, maybe = _probed(spark, sf)
    return joins.dealt(bloom.suffixes(X.dns_queries(spark, sf)), maybe, ["suffix"]).select("list_id", "qname").distinct()


@query
def bloom_fp_rate(spark, sf):
    """For each list the distinct suffixes that are no rule of it, and the share of them that its filter lets through."""
    domains, counted, maybe = _probed(spark, sf)
    flags = maybe.select("list_id", "suffix").join(domains.select("list_id", F.col("domain").alias("suffix"), F.lit(True).alias("rule")), ["list_id", "suffix"], "left")
    tally = flags.groupBy("list_id").agg(F.count("rule").alias("held"), (F.count("*") - F.count("rule")).alias("n_false"))
    total = counted.agg(F.count("*").alias("n")).select(F.explode(F.array(*map(F.lit, LISTS))).alias("list_id"), "n")
    both = total.join(tally, "list_id", "left").na.fill(0)
    return both.select("list_id", (F.col("n") - F.col("held")).alias("n_clean"), "n_false", (F.col("n_false") / (F.col("n") - F.col("held"))).alias("rate"))


def _match_domains(spark, sf):
    return rules.domains(rules.first_seen(X.match_lines(spark, sf)))


@query
def match_blocked(spark, sf):
    return match.blocked(X.match_queries(spark, sf), _match_domains(spark, sf))


@query
def match_clean(spark, sf):
    return match.clean(X.match_queries(spark, sf), _match_domains(spark, sf))


@query
def match_rule(spark, sf):
    return match.matched_rule(X.match_queries(spark, sf), _match_domains(spark, sf))


def _sides(spark, sf):
    domains = _domains(spark, sf)
    one = domains.where(F.col("list_id").isin(*SECURITY)).select("domain").distinct()
    return one, domains.where(~F.col("list_id").isin(*SECURITY)).select("domain").distinct()


def _matched(spark, sf):
    return match.sides(_match_domains(spark, sf), F.col("list_id").isin(*SECURITY))


def _custom(spark, sf):
    named = X.match_queries(spark, sf).where("query_id % 97 = 0")
    return named.groupBy("qname").agg((F.min("query_id") % 2).cast("int").alias("action"))


@query
def dns_verdict(spark, sf):
    return match.verdicts(X.match_queries(spark, sf), _custom(spark, sf), _matched(spark, sf))


@query
def stream_verdict(spark, sf):
    """The verdicts again, from a stream over the landed names."""
    from ..streaming import live

    landed, target, state = (shared_folder(spark, f"verdict-{x}") for x in ("landed", "out", "state"))
    names = X.match_queries(spark, sf)
    names.write.parquet(landed)
    live.verdicts(spark.readStream.schema(names.schema).parquet(landed), _custom(spark, sf), _matched(spark, sf), target, state)
    return spark.read.parquet(target).select("query_id", "ts", "qname", "verdict")


@query
def refresh_lists(spark, sf):
    """Status, rules and catalogued size of every list, compiled from a stream over the landed files."""
    from ..streaming import live

    landed, target, state = (shared_folder(spark, f"refresh-{x}") for x in ("landed", "out", "state"))
    S.land(X.landed_lines(spark, sf), landed)
    live.refresh(spark, landed, target, state, UPDATED)
    rows = catalog.current(spark, f"{target}/catalog").select(F.col("name").alias("list_id"), "file_size")
    return live.runs(spark, target).where("stage = 'compile'").select("list_id", "status", "rule_count").join(rows, "list_id", "left").fillna(0, ["file_size"])


@query
def catalog_all(spark, sf):
    return X.filter_lists(spark, sf).orderBy("name", "id")


@query
def catalog_by_url(spark, sf):
    rows = X.filter_lists(spark, sf)
    return rows.where(F.col("url") == rows.agg(F.min("url")).first()[0])


@query
def catalog_dup_urls(spark, sf):
    rows = X.filter_lists(spark, sf)
    return catalog.duplicate_urls(rows.select("url").unionAll(X.upsert_batch(rows).select("url")))


@query
def catalog_search(spark, sf):
    return catalog.found(X.filter_lists(spark, sf), "st_1")


@query
def catalog_sorted(spark, sf):
    """The first hundred by rule count, with their places: a top-k report."""
    top = catalog.page(X.filter_lists(spark, sf), limit=100, sort="rule")
    place = F.row_number().over(catalog.Window.orderBy(*catalog.order_columns("rule")))
    return top.select("id", "name", "rule_count", place.alias("place"))


@query
def catalog_page(spark, sf):
    return catalog.page(X.filter_lists(spark, sf), page=2, limit=0, search="list", sort="size", order="asc")


@query
def catalog_deep_page(spark, sf):
    """A page beyond the rows that a heap takes: found by ranges of the order."""
    return catalog.page(X.filter_lists(spark, sf), page=3, limit=15, sort="rule", order="desc", top=20, size_of_range=8)


@query
def catalog_meta(spark, sf):
    return catalog.meta(X.filter_lists(spark, sf), page=2, limit=0, search="list")


@query
def catalog_upsert(spark, sf):
    rows = X.filter_lists(spark, sf)
    return catalog.upsert(rows, X.upsert_batch(rows), X.NOW)


@query
def catalog_write(spark, sf):
    """The catalog after an upsert, written as a second snapshot and read back."""
    folder = shared_folder(spark, "catalog")
    catalog.write(X.filter_lists(spark, sf), folder, 1)
    rows = catalog.current(spark, folder)
    catalog.write(catalog.upsert(rows, X.upsert_batch(rows), X.NOW), folder, 2)
    return catalog.current(spark, folder)


@query
def catalog_delete(spark, sf):
    rows = X.filter_lists(spark, sf)
    return catalog.delete(rows, rows.where("id % 7 = 0").select("url"))[0].select("id", "name", "url")


@query
def build_todo(spark, sf):
    rows = X.filter_lists(spark, sf)
    return catalog.to_build(X.upsert_batch(rows).select("name", "url"), rows).select("name", "url")


@query
def build_cached(spark, sf):
    rows = X.filter_lists(spark, sf)
    return catalog.cached(X.upsert_batch(rows), rows).select("id", "name", "url")


@query
def run_summary(spark, sf):
    ok = validate.line_verdicts(X.fetch_log(spark, sf), "page_id")
    runs = ok.select((F.col("page_id") % 5).alias("run_id"), F.when(F.col("is_list"), "ok").otherwise("failed").alias("status"), F.when(F.col("page_id") % 3 == 0, "catalog").otherwise("compile").alias("stage"))
    return catalog.run_summary(runs)


@query
def derive_name(spark, sf):
    return X.urls(spark, sf).select("page_id", "url", N.derive_name(F.col("url")).alias("name"))


@query
def format_bytes(spark, sf):
    n = (F.col("l_orderkey") * F.col("l_partkey") * (F.col("l_linenumber") + 1) * 37).cast("long").alias("n")
    return X.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", n).withColumn("size", N.format_bytes(F.col("n")))


@query
def download_link(spark, sf):
    return X.filter_lists(spark, sf).select("id", N.download_link(BASE, F.col("name"), F.col("last_updated")).alias("link"))


@query
def url_scheme_check(spark, sf):
    return X.read(spark, sf, "pages").select("page_id", "url", validate.has_scheme(F.col("url")).alias("ok"))


@query
def content_type_check(spark, sf):
    return X.fetch_log(spark, sf).select("page_id", "content_type", validate.bad_type(F.col("content_type")).alias("bad"))


@query
def html_check(spark, sf):
    return X.fetch_log(spark, sf).select("page_id", validate.is_html(F.col("body")).alias("is_html"), (F.octet_length("body") == 0).alias("is_empty"))


@query
def signature_lines(spark, sf):
    return _trimmed(spark, sf).groupBy("list_id").agg(F.count_if(L.is_signature(line())).alias("signature"), F.count_if(L.looks_like_domain(line())).alias("plain"))


@query
def list_verdict(spark, sf):
    return validate.line_verdicts(X.fetch_log(spark, sf), "page_id", "url")


@query
def validate_fetch(spark, sf):
    return validate.checked(X.fetch_log(spark, sf)).select("page_id", "url", "problem")


def _digest(parts):
    return parts.select("list_id", "part", F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@query
def artifact_trie(spark, sf):
    return _digest(artifacts.trie_parts(stored(trie.laid_out(trie.nodes(_domains(spark, sf))), "nodes")))


@query
def artifact_bloom(spark, sf):
    return _digest(artifacts.bloom_parts(stored(_domains(spark, sf), "domains")))


@query
def artifact_css(spark, sf):
    return artifacts.css_parts(_rules(spark, sf)).select("list_id", "part", F.decode("content", "UTF-8").alias("content"))


@query
def artifact_scriptlets(spark, sf):
    """The lines of each list's scriptlets with their places."""
    parts = artifacts.scriptlet_parts(_rules(spark, sf)).select("list_id", "part", F.split(F.rtrim(F.decode("content", "UTF-8"), F.lit("\n")), "\n").alias("lines"))
    ahead = catalog.Window.partitionBy("list_id").orderBy("part").rowsBetween(catalog.Window.unboundedPreceding, -1)
    placed = parts.withColumn("before", F.coalesce(F.sum(F.size("lines")).over(ahead), F.lit(0)))
    return placed.select("list_id", "before", F.posexplode("lines").alias("at", "text")).select("list_id", (F.col("before") + F.col("at") + 1).alias("nth"), "text")


@query
def artifact_info(spark, sf):
    text = F.decode("content", "UTF-8")
    parts = artifacts.info_parts(_counted(spark, sf), _lists(spark, sf), UPDATED)
    return parts.select("list_id", F.get_json_object(text, "$.ruleCount").cast("long").alias("rule_count"), F.get_json_object(text, "$.url").alias("url"), F.get_json_object(text, "$.updatedAt").alias("updated"))


def _bundle(spark, sf):
    lines = _lines(spark, sf)
    found = stored(rules.first_seen(lines), "rules")
    counted = stored(rules.counts(found, lines), "counts")
    placed = stored(trie.laid_out(trie.nodes(rules.domains(found))), "nodes")
    lists = counted.select("list_id", F.concat(F.lit(BASE), "list_id").alias("url"))
    return artifacts.bundle(found, placed, counted, lists, UPDATED)


@query
def bundle_manifest(spark, sf):
    return artifacts.manifest(_bundle(spark, sf))


@query
def bundle_size(spark, sf):
    return artifacts.bundle_size(_bundle(spark, sf))


@query
def publish_artifacts(spark, sf):
    folder = shared_folder(spark, "artifacts")
    artifacts.publish(_bundle(spark, sf), folder)
    return artifacts.manifest(artifacts.published(spark, folder))


@query
def unpublish(spark, sf):
    folder = shared_folder(spark, "artifacts")
    artifacts.publish(_bundle(spark, sf), folder)
    artifacts.unpublish(spark, folder, ["list_0"])
    return artifacts.manifest(artifacts.published(spark, folder))


@query
def rules_incremental_add(spark, sf):
    return increment.added(*_sides(spark, sf))


def _built(spark, sf):
    """Two builds of three groups of lists, the second after one group got lists, one lost and changed some, one stayed."""
    lines = _lines(spark, sf)
    read = lambda ids: lines.where(F.col("list_id").isin(ids))
    members = lambda rows: spark.createDataFrame(rows, "group string, id string, modified long")
    folder = shared_folder(spark, "build")
    stays = [("solo", "list_0", 1)]
    increment.build(spark, folder, members([("security", x, 1) for x in SECURITY[:2]] + [("ads", x, 1) for x in LISTS[4:8]] + stays), read)
    increment.build(spark, folder, members([("security", x, 1) for x in SECURITY] + [("ads", x, 2 if x == "list_5" else 1) for x in LISTS[4:7]] + stays), read)
    return folder


@query
def incremental_offsets(spark, sf):
    """Layout of the tries after an incremental build: as of a whole one."""
    return trie.laid_out(increment.built(spark, _built(spark, sf), "nodes")).select("list_id", _joined(), "is_terminal", "bfs_index", "byte_offset")


@query
def incremental_bloom(spark, sf):
    """Bytes of the filters after an incremental build."""
    return bloom.filter_bytes(increment.built(spark, _built(spark, sf), "blocks"))


@query
def rules_diff(spark, sf):
    return increment.difference(*_sides(spark, sf))


@query
def build_strategy(spark, sf):
    pages = X.read(spark, sf, "pages").select((F.col("page_id") % 40).alias("group"), F.col("page_id").alias("id"))
    old = pages.where("id % 9 <> 0").withColumn("modified", F.col("id"))
    kept = pages.where("not (group % 4 = 2 and id % 9 = 2) and not (group % 4 = 0 and id % 9 = 0)")
    return increment.strategy(old, kept.withColumn("modified", F.when(F.expr("group % 4 = 3 and id % 9 = 1"), F.col("id") + 1).otherwise(F.col("id"))))
