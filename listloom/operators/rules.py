"""Rules of lists: first-seen dedup, counts and empty lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L


def trimmed(lines: DataFrame) -> DataFrame:
    return L.once(lines, "line", L.trim(F.col("raw"))).select("list_id", "line_no", "line")


def classified(lines: DataFrame) -> DataFrame:
    """list_id, line_no, kind, text: one row for each rule of each line."""
    found = L.with_rules(trimmed(lines)).select("list_id", "line_no", F.explode("rules").alias("rule")).where("rule is not null")
    return found.select("list_id", "line_no", "rule.kind", "rule.text")


def first_seen(lines: DataFrame) -> DataFrame:
    """list_id, kind, text, first_line: each rule of a list once. Partial aggregates run before the one shuffle."""
    return classified(lines).groupBy("list_id", "kind", "text").agg(F.min("line_no").alias("first_line"))


def counts(rules: DataFrame, lists: DataFrame) -> DataFrame:
    """list_id, domains, cosmetic, scriptlets, rule_count of every list, also of those without a rule."""
    per = rules.groupBy("list_id").agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("domain", "domains"), ("cosmetic", "cosmetic"), ("scriptlet", "scriptlets"))))
    zero = [F.coalesce(n, F.lit(0)).alias(n) for n in ("domains", "cosmetic", "scriptlets")]
    return lists.select("list_id").distinct().join(per, "list_id", "left").select("list_id", *zero, F.coalesce("domains", F.lit(0)).alias("rule_count"))


def empty(counted: DataFrame) -> DataFrame:
    """Lists without any rule, with the status that a build gives them."""
    return counted.where("domains + cosmetic + scriptlets = 0").select("list_id", F.lit("failed").alias("status"))


def domains(rules: DataFrame) -> DataFrame:
    """list_id, domain of the domain rules."""
    return rules.where("kind = 'domain'").select("list_id", F.col("text").alias("domain"))
