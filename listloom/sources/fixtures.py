"""Views over the driver's tables that stand for list lines, name lookups, a catalog, fetch results and prose.

The same text runs in Spark (with a DataFrame in the braces) and in the oracle (with the table's name there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILTER_LINES = """
select concat('list_', l_suppkey % 8) as list_id, l_orderkey * 10 + l_linenumber as line_no,
  case (l_orderkey + l_linenumber) % 16
    when 0 then concat('||', h, '^')             when 1 then concat('||', upper(h), '^$third-party')
    when 2 then concat('0.0.0.0 ', h)            when 3 then concat('127.0.0.1', chr(9), h, ' # x')
    when 4 then h                                when 5 then concat('||', h, '^*/path?')
    when 6 then concat('@@||', h, '^')           when 7 then concat('! note ', h)
    when 8 then concat('# note ', h)             when 9 then concat('##.ad-', l_partkey % 50)
    when 10 then concat(h, '##.banner')          when 11 then concat(h, '##+js(set, ', l_partkey % 5, ')')
    when 12 then concat(h, '#%#//scriptlet("noop")')
    when 13 then concat('10.0.', l_partkey % 250, '.1')
    when 14 then concat('  ', h, '  ')           else '0.0.0.0 localhost' end as raw
from (select *, concat('p', l_partkey % 200, '.s', l_suppkey, '.example.com') as h from {lineitem}) x
"""

#: With a list of comments alone and one with a line that is too long.
LANDED_LINES = f"""
select list_id, line_no, raw from ({FILTER_LINES}) y
union all select 'list_bare', l_orderkey * 10, concat('! only note ', l_partkey) from {{lineitem}} where l_linenumber = 1 and l_orderkey % 50 = 0
union all select 'list_long', l_orderkey * 10, concat('||l', l_partkey, '.example.com^') from {{lineitem}} where l_linenumber = 1 and l_orderkey % 50 = 1
union all select 'list_long', 0, repeat('x', 1048576) from {{lineitem}} where l_linenumber = 1 and l_orderkey = (select min(l_orderkey) from {{lineitem}})
"""

DNS_QUERIES = """
select event_id as query_id, ts,
  concat('q', event_id % 3, '.p', cast(regexp_extract(props, '([0-9]+)', 1) as int) % 200,
         '.s', user_id % 100, case when event_id % 5 = 0 then '.example.org' else '.example.com' end) as qname
from {events}
"""

#: With rules that have a dot at an end or two in a row, and one of a single label.
MATCH_LINES = f"""
select list_id, line_no, raw from ({FILTER_LINES}) y
union all select concat('list_', s_suppkey % 8), s_suppkey, case s_suppkey % 5
    when 0 then concat('.s', s_suppkey, '.example.org')  when 1 then concat('||s', s_suppkey, '.example.org.^')
    when 2 then concat('0.0.0.0 p', s_suppkey, '..s', s_suppkey, '.example.org')
    when 3 then concat('s', s_suppkey, '..example.org..') else 'local.' end from {{supplier}}
"""

#: With names that are null, that have such dots too, or that end in the single label.
MATCH_QUERIES = f"""
select query_id, ts, case query_id % 11 when 3 then concat(qname, '.') when 5 then concat('.', qname)
  when 7 then replace(qname, '.example', '..example') when 9 then concat('h', query_id % 50, '.local') when 10 then null else qname end as qname
from ({DNS_QUERIES}) y
"""

CATALOG_SEED = """
select min(page_id) + 1 as id, concat('list_', min(page_id)) as name, url, '' as r2_download_link,
  cast(min(length(html)) % 1000 as int) as rule_count, cast(min(length(html)) as bigint) as file_size,
  min(page_id) as age_hours
from {pages} group by url
"""

FETCH_LOG = """
select page_id, url, page_id % 7 <> 0 as head_ok, case when page_id % 11 = 0 then 404 else 200 end as head_status,
  case page_id % 4 when 0 then 'text/plain; charset=utf-8' when 1 then 'text/html'
                   when 2 then '' else 'Image/PNG' end as content_type,
  case when page_id % 13 = 0 then 500 else 200 end as get_status,
  case page_id % 5 when 0 then html
    when 1 then concat('! Title: t', chr(10), '||a.com^')
    when 2 then concat('a.com', chr(10), chr(10), 'b.com', chr(10), 'c.com')
    when 3 then concat('a.com', chr(10), 'b.com')
    else case page_id % 20 when 9 then concat(repeat('é', 8191), 'x€', chr(10), '||a.com^') when 14 then concat('||a.com^', chr(10), repeat('é', 9000)) else '' end end as body_text
from {pages}
"""

#: Web addresses, some of them malformed or without a scheme.
URLS = """
select page_id, case page_id % 9 when 1 then concat(url, '/%zz') when 3 then regexp_replace(url, '^https?:', '') when 5 then replace(url, '.example.', '.example:port.')
  when 7 then concat(url, '/raw/Some List@2.TXT') when 8 then concat('list ', url) else url end as url
from {pages}
"""

#: All times of the catalog count from here.
EPOCH = "2024-01-01 00:00:00"
#: The clock of an upsert.
NOW = "2024-06-01 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filter_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """list_id, line_no, raw; line_no has ties, so order is by (line_no, raw)."""
    return spark.sql(FILTER_LINES, lineitem=read(spark, sf_dir, "lineitem"))


def landed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LANDED_LINES, lineitem=read(spark, sf_dir, "lineitem"))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url."""
    return spark.sql(URLS, pages=read(spark, sf_dir, "pages"))


def dns_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, ts, qname."""
    return spark.sql(DNS_QUERIES, events=read(spark, sf_dir, "events"))


def match_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MATCH_LINES, lineitem=read(spark, sf_dir, "lineitem"), supplier=read(spark, sf_dir, "supplier"))


def match_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MATCH_QUERIES, events=read(spark, sf_dir, "events"))


def filter_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog: id, name, url, r2_download_link, rule_count, file_size, last_updated, created_at."""
    seed = spark.sql(CATALOG_SEED, pages=read(spark, sf_dir, "pages"))
    at = F.lit(EPOCH).cast("timestamp") + F.make_dt_interval(hours=F.col("age_hours").cast("int"))
    return seed.select("id", "name", "url", "r2_download_link", "rule_count", "file_size", at.alias("last_updated"), at.alias("created_at"))


def upsert_batch(catalog: DataFrame) -> DataFrame:
    """Changed rows (every third id) and new ones (every tenth), with the order in which they came."""
    changed = catalog.where("id % 3 = 0").select("name", "url", "r2_download_link", (F.col("rule_count") + 1).alias("rule_count"), "file_size", F.col("id").alias("seq"))
    new = catalog.where("id % 10 = 0").select("name", F.concat("url", F.lit("#new")).alias("url"), "r2_download_link", "rule_count", "file_size", F.col("id").alias("seq"))
    return changed.unionAll(new)


def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, head_ok, head_status, content_type, get_ok, get_status, body."""
    log = spark.sql(FETCH_LOG, pages=read(spark, sf_dir, "pages"))
    return log.select("page_id", "url", "head_ok", "head_status", "content_type", F.lit(True).alias("get_ok"), "get_status", F.encode("body_text", "UTF-8").alias("body"))


def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, raw: prose that is no list."""
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "raw")
