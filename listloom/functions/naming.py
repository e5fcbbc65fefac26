"""Column expressions for list names, sizes and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Host endings of hosting services, file endings in the order in which they are cut, path parts without meaning.
HOSTING = (".githubusercontent.com", ".github.io", ".jsdelivr.net", ".gitlab.io")
ENDINGS = (".txt", ".csv", ".hosts", ".list", ".php")
SKIPPED = ("raw", "master", "main", "latest", "refs", "heads", "gh", "download", "downloads", "extension")


_BROKEN_ESCAPE = "%($|[^0-9A-Fa-f]|[0-9A-Fa-f]($|[^0-9A-Fa-f]))"
_URL = r"(?s)^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?]*)([^?]*)"


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def _part(url: Column, group: int) -> Column:
    """What stands before the first slash (1) or after it (2), with or without a scheme before."""
    return F.regexp_extract(F.regexp_replace(url, "(?s)#.*$", ""), _URL, group)


def host(url: Column) -> Column:
    """Host with port, without user info, in lower case; empty if there is none."""
    return F.lower(_decoded(F.regexp_replace(_part(url, 1), "(?s)^.*@", "")))


def path(url: Column) -> Column:
    return _decoded(_part(url, 2))


def is_malformed(url: Column) -> Column:
    """Whether a URL cannot be parsed: control characters, broken percent escapes, a port that is no number, or characters
    that cannot stand in a host or user info."""
    authority, fragment = _part(url, 1), F.regexp_extract(url, "(?s)#(.*)$", 1)
    name, user = F.regexp_replace(authority, "(?s)^.*@", ""), F.regexp_extract(authority, "(?s)^(.*)@", 1)
    bad_host = ~name.rlike(r"""^([A-Za-z0-9\-_.~!$&'()*+,;=:\[\]<>"]|[^\x00-\x7f]|%[89A-Fa-f][0-9A-Fa-f])*$""")
    bad_port = F.when(name.startswith("["), ~name.rlike(r"^\[[^\]]*\](:[0-9]*)?$")).otherwise(name.rlike(":[^:]*[^0-9:][^:]*$"))
    bad_user = user.rlike(r"[^A-Za-z0-9\-._:~!$&'()*+,;=%@]") | user.rlike(_BROKEN_ESCAPE)
    return url.rlike(r"[\x00-\x1f\x7f]") | fragment.rlike(_BROKEN_ESCAPE) | _part(url, 2).rlike(_BROKEN_ESCAPE) | bad_host | bad_port | bad_user


def short_host(name: Column) -> Column:
    """The host without www., raw., cdn., a hosting service's ending and the last label."""
    for prefix in (r"^www\.", r"^raw\.", r"^cdn\."):
        name = F.regexp_replace(name, prefix, "")
    cut = F.regexp_replace(name, "(" + "|".join(h.replace(".", r"\.") for h in HOSTING) + ")$", "")
    return F.regexp_replace(cut, r"^(.+)\.[^.]*$", "$1")


def derive_name(url: Column) -> Column:
    """Host, up to three telling path parts and eight digits of the URL's SHA-256, joined by underscores; `filter` where
    there is no host or the URL is malformed."""
    parts = F.split(F.lower(F.regexp_replace(path(url), "^/+|/+$", "")), "/")
    parts = reduce(lambda p, e: F.transform(p, lambda x: F.regexp_replace(x, e.replace(".", r"\.") + "$", "")), ENDINGS, parts)
    parts = F.filter(parts, lambda x: (x != "") & ~x.isin(*SKIPPED))
    parts = F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3))
    owner = F.translate(short_host(host(url)), ".-", "__")
    whole = F.array_join(F.concat(F.filter(F.array(owner), lambda x: x != ""), parts), "_")
    digest = F.substring(F.sha2(url, 256), 1, 8)
    name = F.concat(F.translate(F.replace(whole, F.lit("@"), F.lit("")), ".- ", "___"), F.lit("_"), digest)
    return sanitize(F.when(is_malformed(url) | (_part(url, 1) == "") | (host(url) == ""), F.lit("filter")).when(whole == "", F.concat(F.lit("filter_"), digest)).otherwise(name))


def sanitize(name: Column) -> Column:
    """Letters, digits, - and _ stay, spaces become _, the rest goes."""
    from .lines import trim

    return F.regexp_replace(F.translate(trim(name), " ", "_"), r"[^\p{L}\p{Nd}_-]", "")


def _one_decimal(n: Column, unit: int) -> Column:
    """n / unit with one decimal; a tie goes to the even digit."""
    tenths, rest = F.floor(n * 10 / unit).cast("long"), (n * 10) % unit
    tenths = tenths + F.when((rest * 2 > unit) | ((rest * 2 == unit) & (tenths % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def format_bytes(n: Column) -> Column:
    """B, KB, MB or GB with one decimal; sizes of a TiB and more stay in GB."""
    larger = F.when(n < 1024**2, F.concat(_one_decimal(n, 1024), F.lit(" KB"))).when(n < 1024**3, F.concat(_one_decimal(n, 1024**2), F.lit(" MB")))
    return F.when(n < 1024, F.format_string("%d B", n)).otherwise(larger.otherwise(F.concat(_one_decimal(n, 1024**3), F.lit(" GB"))))


def download_link(base: str, name: Column, updated: Column | None = None) -> Column:
    """<base>/<name>.zip, with ?v=<unix seconds> if a time is given."""
    link = F.concat(F.lit(base.rstrip("/") + "/"), name, F.lit(".zip"))
    return link if updated is None else F.concat(link, F.lit("?v="), F.unix_timestamp(updated).cast("string"))
