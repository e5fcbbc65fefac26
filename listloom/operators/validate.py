"""Is a fetched file a filter list? Checks of scheme, status, content type, HTML and line syntax over a fetch log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L

# Content types that are never lists, whole or by their beginning.
TYPES = ("text/html", "application/json", "application/xml", "text/xml")
TYPE_STARTS = ("image/", "video/", "audio/", "application/zip", "application/pdf")
#: Bytes and lines that are looked at, and plain names that make a list.
WINDOW, LINES, PLAIN = 16384, 300, 3


def has_scheme(url: Column) -> Column:
    return url.startswith("http://") | url.startswith("https://")


def bad_type(content_type: Column) -> Column:
    kind = F.lower(content_type)
    kind = F.when(kind.contains(";"), L.trim(F.substring_index(kind, ";", 1))).otherwise(kind)
    found = kind.isin(*TYPES)
    for start in TYPE_STARTS:
        found = found | kind.startswith(start)
    return F.coalesce(found, F.lit(False))


def window(body: Column) -> Column:
    """The first bytes as text; bytes that are no UTF-8, a character cut at the end included, are replaced."""
    return F.make_valid_utf8(F.substring(body, 1, WINDOW).cast("string"))


def is_html(body: Column) -> Column:
    return F.lower(L.trim(window(body))).rlike("^<(!doctype|html|head)")


def line_verdicts(log: DataFrame, *keys: str) -> DataFrame:
    """keys, has_signature, plain_lines, is_list from the first lines of each body; one row an input row."""
    rows = F.slice(F.split(window(F.col("body")), "\r?\n"), 1, LINES)
    pinned = L.once(log.select(*keys, "body"), "_lines", F.transform(rows, L.trim))
    each = pinned.select(*keys, F.exists("_lines", L.is_signature).alias("has_signature"), F.size(F.filter("_lines", L.looks_like_domain)).alias("plain_lines"))
    return each.withColumn("is_list", F.col("has_signature") | (F.col("plain_lines") >= PLAIN))


def status_error(log: DataFrame) -> Column:
    head = F.col("head_ok") & (F.col("head_status") >= 400)
    return F.when(head, F.col("head_status")).when(F.col("get_status") >= 400, F.col("get_status"))


def checked(log: DataFrame) -> DataFrame:
    """log with `problem`: the first check that fails in the order of a fetch, or null."""
    log = L.once(log, "_lines", F.transform(F.slice(F.split(window(F.col("body")), "\r?\n"), 1, LINES), L.trim))
    listed = F.exists("_lines", L.is_signature) | (F.size(F.filter("_lines", L.looks_like_domain)) >= PLAIN)
    problem = (
        F.when(~has_scheme(F.col("url")), "scheme").when(F.col("head_ok") & (F.col("head_status") >= 400), "head_status")
        .when(F.col("head_ok") & bad_type(F.col("content_type")), "content_type").when(~F.col("get_ok"), "unreachable")
        .when(F.col("get_status") >= 400, "get_status").when(F.octet_length("body") == 0, "empty")
        .when(is_html(F.col("body")), "html").when(~listed, "syntax")
    )
    return log.withColumn("problem", problem).drop("_lines")
