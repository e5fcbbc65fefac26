"""Column expressions that classify one line of a filter list."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that are never domains.
RESERVED = ("localhost", "localhost.localdomain", "broadcasthost", "local")
# The letters that Unicode counts as white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim(line: Column) -> Column:
    """The line without Unicode white space at its ends, by its letters: a pattern costs many times as much on every line."""
    return F.btrim(F.make_valid_utf8(line), F.lit(WHITE))


def is_comment(line: Column) -> Column:
    return (line.startswith("! ") | line.startswith("# ")) & ~line.contains("##")


def is_scriptlet(line: Column) -> Column:
    return line.contains("##+js(") | line.contains("#%#//scriptlet(")


def is_cosmetic(line: Column) -> Column:
    return line.contains("##") & ~line.contains("#@#") & ~line.contains("##+js") & ~line.contains("##^")


def lower(text: Column) -> Column:
    """Letter by letter, also for the two letters whose lower case depends on more than themselves."""
    return F.lower(F.translate(text, "İΣ", "iσ"))


def _any(tests) -> Column:
    """Plain tests of a text in place of a pattern, which costs many times as much on every line."""
    return reduce(or_, tests)


def _skipped(line: Column) -> Column:
    return (line == "") | _any(map(line.startswith, ("#", "!", "@@"))) | (~line.startswith("||") & _any(map(line.contains, "$/\\*")))


def _has_blank(line: Column) -> Column:
    return _any(map(line.contains, " \t"))


def _is_hosts(line: Column) -> Column:
    return _any(line.startswith(a + b) for a in ("0.0.0.0", "127.0.0.1") for b in " \t")


def adblock_name(line: Column) -> Column:
    """The name in ||name^options; null for rules with a path or wildcard and for other lines."""
    rest = F.substring(line, 3, 2**31 - 1)
    name = F.substring_index(F.substring_index(rest, "^", 1), "$", 1)
    return F.when(line.startswith("||") & ~_any(map(rest.contains, "/*?")), name)


def _second(line: Column) -> Column:
    return F.substring_index(F.get(F.split(line, r"(?U)\s+"), F.lit(1)), "#", 1)


def hosts_name(line: Column) -> Column:
    """The second field of a hosts line, up to a number sign."""
    return F.when(_is_hosts(line) & ~_skipped(line), _second(line))


def plain_name(line: Column) -> Column:
    """A line without blanks that has a dot."""
    return F.when(~_has_blank(line) & line.contains(".") & ~line.startswith("||") & ~_skipped(line), line)  # a hosts line has a blank


def is_reserved(name: Column) -> Column:
    return name.isin(*RESERVED)


def is_address(name: Column) -> Column:
    return (name >= "0") & (name < ":") & name.rlike("^[0-9][0-9.]*$")  # only what begins with a digit meets the pattern


def found_name(line: Column) -> Column:
    """The name in a line of any of the three forms, as it stands there; no line has two of them."""
    other = F.when(_is_hosts(line), _second(line)).when(~_has_blank(line) & line.contains("."), line)
    return F.when(line.startswith("||"), adblock_name(line)).when(~_skipped(line), other)


def is_domain(name: Column) -> Column:
    """Whether a name in lower case is a domain: not reserved, with a dot, and not like an IPv4 address."""
    return name.contains(".") & ~name.isin(*(r for r in RESERVED if "." in r)) & ~is_address(name)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row.

    Catalyst copies a projected expression into every later use, filters included; the copies of nested patterns grow
    beyond what it can compile. It doesn't look through an exploded array of one element.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def lowered(df: DataFrame, name: str, text: Column) -> DataFrame:
    """df with a text trimmed and in lower case (as of `lower`), pinned in two steps: letters are only translated one by one
    where one of the two is there."""
    put = F.col(name)
    special = put.contains("İ") | put.contains("Σ")
    return once(once(df, name, trim(text)), name, F.when(special, lower(put)).otherwise(F.lower(put)))


def with_domain(lines: DataFrame, name: Column) -> DataFrame:
    """lines with `domain`: the name in lower case, or null."""
    named = lowered(lines, "_name", name)
    return named.withColumn("domain", F.when(is_domain(F.col("_name")), F.col("_name"))).drop("_name")


def with_rules(lines: DataFrame) -> DataFrame:
    """lines (with a trimmed `line`) and `rules`, an array of (kind, text): a cosmetic line can be a domain too. A rule that
    the line is not stands as null."""
    line, domain = F.col("line"), F.col("domain")
    open_ = ~is_comment(line) & ~is_scriptlet(line)
    kinds = F.array(
        F.when(~is_comment(line) & is_scriptlet(line), F.struct(F.lit("scriptlet").alias("kind"), line.alias("text"))),
        F.when(open_ & is_cosmetic(line), F.struct(F.lit("cosmetic").alias("kind"), line.alias("text"))),
        F.when(open_ & domain.isNotNull(), F.struct(F.lit("domain").alias("kind"), domain.alias("text"))),
    )
    return with_domain(lines, found_name(line)).withColumn("rules", kinds).drop("domain")


# Line beginnings that only filter lists have.
SIGNATURES = (
    "[Adblock Plus", "[Adblock", "! Title:", "! Homepage:", "! Last modified:", "# Title:", "# Description:", "# Homepage:", "# Expires:", "# Syntax:", "# Version:",
    "# License:", "# Number of entries:", "#Number of Entries:", "# Last Updated:", "#Last Updated:", "Created using", "0.0.0.0 ", "0.0.0.0\t", "127.0.0.1 ", "127.0.0.1\t", "||", "@@||",
)


def is_signature(line: Column) -> Column:
    """Whether a trimmed line alone shows that the text is a filter list."""
    found = line.contains("##") & ~line.startswith("#")
    for s in SIGNATURES:
        found = found | line.startswith(s)
    return found


def looks_like_domain(line: Column) -> Column:
    return ~is_signature(line) & (line != "") & ~line.rlike("^[#!]") & line.contains(".") & ~line.rlike("[ \t]")


def reversed_labels(name: Column) -> Column:
    """The labels of a name from the top-level domain down, without empty ones."""
    return F.array_remove(F.reverse(F.split(name, "\\.")), "")
