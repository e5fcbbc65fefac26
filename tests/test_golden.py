"""Golden rows: line classes, names, trie bytes, hashes, sizes and Bloom bytes."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from listloom.functions import hashing, lines, naming
from listloom.operators import artifacts, bloom, rules, trie, validate

LINES = [
    ("||ads.example.com^", {("domain", "ads.example.com")}), ("||Ads.Example.COM^$third-party", {("domain", "ads.example.com")}), ("||ads.example.com^*/x?", set()), ("||a.com^$domain=b.com/c", set()),
    ("||1.2.3.4^", set()), ("||a.com|", {("domain", "a.com|")}), ("||a.com:8080^", {("domain", "a.com:8080")}), ("||com^", set()), ("||*.a.com^", set()), ("0.0.0.0 ads.b.com", {("domain", "ads.b.com")}),
    ("127.0.0.1\tads.c.com#note", {("domain", "ads.c.com")}), ("0.0.0.0 d.com # see http://x", set()), ("0.0.0.0 e.com ## note", {("cosmetic", "0.0.0.0 e.com ## note"), ("domain", "e.com")}),
    ("0.0.0.0 localhost", set()), ("::1 localhost", set()), ("0.0.0.0 0.0.0.0", set()), ("tracker.com", {("domain", "tracker.com")}), ("*.tracker.com", set()), ("tracker.com.", {("domain", "tracker.com.")}),
    (".", {("domain", ".")}), ("1.2.3.4", set()), ("1.2.3.4:80", {("domain", "1.2.3.4:80")}), ("@@||ok.com^", set()), ("! Title: x", set()), ("!nospace", set()), ("# c", set()), ("#c.com", set()),
    ("# ##.x", {("cosmetic", "# ##.x")}), ("! see ##.x", {("cosmetic", "! see ##.x")}), ("##.ad-banner", {("cosmetic", "##.ad-banner")}), ("example.com##.ad", {("cosmetic", "example.com##.ad"), ("domain", "example.com##.ad")}),
    ("example.com##div .ad", {("cosmetic", "example.com##div .ad")}), ("example.com#@#.ad", {("domain", "example.com#@#.ad")}), ("example.com##^script", {("domain", "example.com##^script")}),
    ("example.com##+js(noop)", {("scriptlet", "example.com##+js(noop)")}), ("example.com##+jsx", {("domain", "example.com##+jsx")}), ('example.com#%#//scriptlet("x")', {("scriptlet", 'example.com#%#//scriptlet("x")')}),
    ("! c ##+js(a)", {("scriptlet", "! c ##+js(a)")}), ("example.com#@#+js(noop)", {("domain", "example.com#@#+js(noop)")}), ("[Adblock Plus 2.0]", set()), ("/ads/*", set()), ("a.com$third-party", set()),
    ("##########", {("cosmetic", "##########")}), ("local.", {("domain", "local.")}), ("a b.com", set()), ("", set()), (" n.com ", {("domain", "n.com")}), ("MÜNCHEN.de", {("domain", "münchen.de")}),
    ("İΣ.com", {("domain", "iσ.com")}),
]

NAMES = [
    ("https://raw.githubusercontent.com/RPiList/specials/master/Blocklisten/malware", "githubusercontent_specials_blocklisten_malware_50092b74"),
    ("https://filters.adtidy.org/extension/ublock/filters/2.txt", "filters_adtidy_ublock_filters_2_0a810dd2"),
    ("https://easylist.to/easylist/easylist.txt", "easylist_easylist_easylist_d830652c"),
    ("https://cdn.jsdelivr.net/gh/hagezi/dns-blocklists@latest/adblock/pro.txt", "jsdelivr_dns_blocklistslatest_adblock_pro_a617b16b"),
    ("https://user.github.io/a.hosts.txt", "user_a_8663a722"), ("http://www.example.com:8080/", "example_1cf50185"), ("not a url", "filter"),
    ("https://a.com/%zz", "filter"), ("https://a.com:port/x", "filter"), ("https://a b.com/x", "filter"), ("https://us er@a.com/x", "filter"), ("https://a.com/x#%4", "filter"), ("https:///x", "filter"), ("///a.com/x", "filter"),
    ("https://a.com/x\x01", "filter"), ("https://a%41.com/", "filter"), ("mailto:a@b.com", "filter"), ("", "filter"),
]

HASHES = [
    ("a.com", 1079864132778930279, 2878617951729878955), ("b.a.com", 11214436786095919907, 12343016668927864351),
    ("ads.example.com", 13876489133429007710, 7195335431625043288), ("tracker.net", 13783847034296344274, 17468933062597757784),
]

TRIES = [
    (["ads.google.com", "google.com"], "5452494500000002000000040000000200000000010003636f6d0000001e00000000010006676f6f676c650000002f010000000100036164730000003d0100000000"),
    (["a.com", "b.a.com", "a.com.", "tracker.net"], "5452494500000002000000060000000300000000020003636f6d0000002700036e65740000003300000000010001610000004500000000010007747261636b65720000005101000000010001620000005601000000000100000000"),
]


def test_lines(spark):
    df = spark.createDataFrame([("l", k, raw) for k, (raw, _) in enumerate(LINES)], "list_id string, line_no long, raw string")
    found: dict[int, set] = {}
    for r in rules.classified(df).collect():
        found.setdefault(r["line_no"], set()).add((r["kind"], r["text"]))
    assert {k: found.get(k, set()) for k in range(len(LINES))} == {k: want for k, (_, want) in enumerate(LINES)}


def test_names(spark):
    df = spark.createDataFrame(NAMES, "url string, want string").select("want", naming.derive_name(F.col("url")).alias("name"))
    assert all(r["name"] == r["want"] for r in df.collect()), df.collect()


def test_hashes(spark):
    df = spark.createDataFrame([(h[0],) for h in HASHES], "x string").select("x", hashing.fnv(F.col("x")).alias("h")).select("x", hashing.number(F.col("h.a"), F.col("h.a_lo")).alias("a"), hashing.number(F.col("h.f"), F.col("h.f_lo")).alias("b"))
    assert sorted((r["x"], int(r["a"]), int(r["b"])) for r in df.collect()) == sorted(HASHES)
    empty = spark.range(1).select(hashing.fnv(F.lit("")).alias("h")).first()["h"]
    assert empty["a"] * 2**32 + empty["a_lo"] == empty["f"] * 2**32 + empty["f_lo"] == 14695981039346656037


def fnv(name: str) -> tuple[int, int]:
    a = f = 14695981039346656037
    for b in name.encode():
        a = (a ^ b) * 1099511628211 % 2**64
        f = f * 1099511628211 % 2**64 ^ b
    return a, f


def test_hashes_and_positions_of_any_bytes(spark):
    names = ["münchen.de", "日本.jp", "x" * 253, "a.b", "\x7f\x80ÿ.com"]
    sizes = [8, 14377592, 2**31 + 8, 2**40 + 8, 2**46 + 8]
    df = spark.createDataFrame([(n,) for n in names], "x string").select("x", hashing.fnv(F.col("x")).alias("h"))
    found = df.select("x", "h", *(hashing.position(F.col("h"), F.lit(i), F.lit(m).cast("long")).alias(f"p{i}_{m}") for i in (0, 1, 9) for m in sizes)).collect()
    for r in found:
        a, f = fnv(r["x"])
        assert (r["h"]["a"] * 2**32 + r["h"]["a_lo"], r["h"]["f"] * 2**32 + r["h"]["f_lo"]) == (a, f)
        assert all(r[f"p{i}_{m}"] == (a + i * (f | 1)) % 2**64 % m for i in (0, 1, 9) for m in sizes)


def test_sizes(spark):
    want = {0: 16, 1: 16, 2: 32, 3: 48, 10: 144, 1000: 14384, 100000: 1437760, 1000000: 14377592}
    df = spark.createDataFrame([(n,) for n in want], "n long").select("n", bloom.bit_count(F.col("n")).alias("m"), bloom.bit_count(F.col("n"), 7.0).alias("bad"))
    assert {r["n"]: r["m"] for r in df.collect()} == want == {r["n"]: r["bad"] for r in df.collect()}
    assert bloom.hash_count() == 10 and bloom.hash_count(0.5) == 1


def _bytes(parts) -> bytes:
    return b"".join(bytes(r["content"]) for r in sorted(parts.collect(), key=lambda r: r["part"]))


@pytest.mark.parametrize("part", [1 << 20, 7])
def test_trie_bytes(spark, part):
    for names, want in TRIES:
        domains = spark.createDataFrame([("l", n) for n in names], "list_id string, domain string")
        assert _bytes(artifacts.trie_parts(trie.laid_out(trie.nodes(domains)), part)).hex() == want


def test_bloom_bytes(spark):
    domains = spark.createDataFrame([("l", n) for n in TRIES[0][0]], "list_id string, domain string")
    assert _bytes(artifacts.bloom_parts(domains)).hex() == "424c4f4d0000000100000000000000200000000a00000000f5aa6a55"


@pytest.mark.parametrize("blocks", [256, 1])
def test_bloom_bytes_of_several_blocks(spark, blocks):
    names = [f"n{k}.example.com" for k in range(5000)]
    size = 8 * -(-math.ceil(-5000 * math.log(0.001) / math.log(2) ** 2) // 8)
    want = bytearray(size // 8)
    for n in names:
        a, f = fnv(n)
        for i in range(10):
            at = (a + i * (f | 1)) % 2**64 % size
            want[at // 8] |= 1 << at % 8
    parts = artifacts.bloom_parts(spark.createDataFrame([("l", n) for n in names], "list_id string, domain string"), blocks)
    assert _bytes(parts)[24:] == bytes(want) and parts.count() == (1 if blocks == 256 else 3)


def test_parts_are_bounded_whatever_one_name_holds(spark):
    """40,000 names under one, and as many scriptlet rules with one beginning."""
    names = spark.range(40_000).select(F.lit("l").alias("list_id"), F.concat(F.lit("n"), "id", F.lit(".com")).alias("domain"))
    placed = trie.laid_out(trie.nodes(names))
    parts = artifacts.trie_parts(placed, 4096)
    sizes = [len(r["content"]) for r in parts.select("content").collect()]
    assert max(sizes) < 4096 + 300 and sum(sizes) == placed.agg(F.sum("n_bytes")).first()[0] + 16
    texts = spark.range(40_000).select(F.lit("l").alias("list_id"), F.lit("scriptlet").alias("kind"), F.concat(F.lit("##+js("), "id", F.lit(")")).alias("text"))
    parts = artifacts.scriptlet_parts(texts, 1000)
    assert max(len(r["content"].splitlines()) for r in parts.select("content").collect()) <= 1000
    assert _bytes(parts).decode().splitlines() == sorted(f"##+js({k})" for k in range(40_000))


def test_offsets_follow_a_plain_walk(spark):
    names = [f"{a}.{b}.{c}" for a in ("x", "yy", "é") for b in ("m", "nn", "mz", "n") for c in ("com", "net", "o")] + ["com", "."]
    domains = spark.createDataFrame([("l", n) for n in names], "list_id string, domain string")
    paths = {()}
    for n in names:
        labels = tuple(reversed([p for p in n.split(".") if p]))
        paths |= {labels[:k] for k in range(len(labels) + 1)}
    order = sorted(paths, key=lambda p: (len(p), tuple(x.encode() for x in p)))
    size = {p: 5 + sum(6 + len(q[-1].encode()) for q in paths if q and q[:-1] == p) for p in paths}
    want, at = {}, 16
    for k, p in enumerate(order):
        want[p], at = (k, at), at + size[p]
    assert {tuple(r["path"]): (r["bfs_index"], r["byte_offset"]) for r in trie.laid_out(trie.nodes(domains)).collect()} == want


def test_format_bytes_and_trim(spark):
    want = {0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1331: "1.3 KB", 1792: "1.8 KB", 1245678: "1.2 MB", 3 * 2**30: "3.0 GB", 5 * 2**40: "5120.0 GB"}
    df = spark.createDataFrame([(n,) for n in want], "n long").select("n", naming.format_bytes(F.col("n")).alias("s"))
    assert {r["n"]: r["s"] for r in df.collect()} == want
    assert spark.range(1).select(lines.trim(F.lit("  a b \t"))).first()[0] == "a b"


@pytest.mark.parametrize("url, start", [("//host.com/x.txt", "host_x_"), ("https://me:pw@host.com:80/a%20b", "host_a_b_"), ("https://h.com:/x", "h_x_"), ("http://[::1]:80/l", "180_l_")])
def test_names_from_the_host(spark, url, start):
    import hashlib

    name = spark.createDataFrame([(url,)], "url string").select(naming.derive_name(F.col("url")).alias("name")).first()["name"]
    assert name == start + hashlib.sha256(url.encode()).hexdigest()[:8]


def test_bodies_that_are_no_utf8(spark):
    bodies = [b"\xff\xfe||a.com^", "é".encode() * 8191 + b"x" + "é".encode() + b"\n||a.com^", b"a.com\nb.com\n\x80c.com\n" + b"\xe2" * 20_000, b"||a.com^\n" + b"\xff" * 20_000, b"\xef\xbb\xbf<html>"]
    df = spark.createDataFrame([(k, b) for k, b in enumerate(bodies)], "k int, body binary")
    assert {r["k"]: r["is_list"] for r in validate.line_verdicts(df, "k").collect()} == {0: False, 1: False, 2: True, 3: True, 4: False}
    assert not any(r["h"] for r in df.select(validate.is_html(F.col("body")).alias("h")).collect())


def test_fetch_checks(spark):
    rows = [
        ("ftp://x", True, 200, "", True, 200, b"||a.com^", "scheme"), ("http://x", True, 404, "", True, 200, b"||a.com^", "head_status"), ("http://x", True, 200, "Text/HTML ; charset=x", True, 200, b"||a.com^", "content_type"),
        ("http://x", False, 404, "text/html", True, 200, b"||a.com^", None), ("http://x", True, 200, "", False, 0, b"", "unreachable"), ("http://x", True, 200, "", True, 500, b"||a.com^", "get_status"),
        ("http://x", True, 200, None, True, 200, b"", "empty"), ("http://x", True, 200, "", True, 200, b" \n<HTML>||a.com^", "html"), ("http://x", True, 200, "", True, 200, b"a.com\r\nb.com\r\nc d", "syntax"),
        ("http://x", True, 200, "", True, 200, b"a.com\r\nb.com\r\n\r\nc.com", None), ("http://x", True, 200, "", True, 200, b"\n" * 300 + b"||a.com^", "syntax"), ("http://x", True, 200, "", True, 200, b"x" * 16384 + b"\n||a.com^", "syntax"),
    ]
    df = spark.createDataFrame(rows, "url string, head_ok boolean, head_status int, content_type string, get_ok boolean, get_status int, body binary, want string")
    assert all(r["problem"] == r["want"] for r in validate.checked(df).collect())
