"""Matching names against rules along label paths.

A rule and a name are both the labels from the top-level domain down, empty ones left out; a rule covers a name when its
labels are the first ones of the name's. So `a.com.` is the rule `a.com`, and a rule without a label (`.`) covers every
name, as the root of a trie does that is marked itself. Paths are compared by two rolling 64-bit hashes, one step a label.

Distinct names are exploded into their paths; the paths are counted and meet the rules once each, and only those that hit
are stored and go back to the names. Where many names share a path, or many rows a name, the join deals them over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import once, reversed_labels
from ..sources.folders import stored
from .joins import HOT, dealt

#: Custom rules that are broadcast: some 50 bytes each.
FEW = 500_000
#: What a rule without a label is called.
ROOT = "."
_STEPS = "array<struct<a:bigint,b:bigint>>"


def label_paths(name: Column) -> Column:
    """The hashes (a, b) of a name's first label, of its first two, and so on; empty for a name without a label."""
    start = F.struct(F.array().cast(_STEPS).alias("all"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def step(at: Column, label: Column) -> Column:
        a, b = F.xxhash64(at["a"], label), F.xxhash64(label, at["b"])
        return F.struct(F.concat(at["all"], F.array(F.struct(a.alias("a"), b.alias("b")))).alias("all"), a.alias("a"), b.alias("b"))

    return F.aggregate(reversed_labels(name), start, step, lambda at: at["all"])


def canonical(name: Column) -> Column:
    """A name without empty labels; ROOT for one without any."""
    labels = F.filter(F.split(name, "[.]"), lambda x: x != "")
    return F.when(F.size(labels) == 0, ROOT).otherwise(F.array_join(labels, "."))


def rule_paths(domains: DataFrame, **flags: Column) -> DataFrame:
    """a, b, depth, rule of every rule once, whatever dots it is written with; flags: whether any of its rows holds each."""
    path = once(domains.withColumns({f"_f_{k}": v for k, v in flags.items()}), "_path", label_paths(F.col("domain")))
    last = F.try_element_at("_path", F.lit(-1))
    keyed = path.where("domain is not null").select(F.coalesce(last["a"], F.lit(0)).alias("a"), F.coalesce(last["b"], F.lit(0)).alias("b"), F.size("_path").alias("depth"), canonical(F.col("domain")).alias("rule"), *(F.col(f"_f_{k}").alias(k) for k in flags))
    return keyed.groupBy("a", "b", "depth").agg(F.first("rule").alias("rule"), *(F.bool_or(k).alias(k) for k in flags))


def sides(domains: DataFrame, security: Column) -> DataFrame:
    """Rule paths with sec and ad: whether a security list (rows where `security` holds) or another has the rule."""
    return rule_paths(domains, sec=security, ad=~security)


def _met(queries: DataFrame, rules: DataFrame, most: int) -> DataFrame:
    """qname, n and each rule that covers the name, with the rule's other columns; n is the number of rows of the name.

    The root is a path of every name. Rules that some name reaches are stored with the number of names that do: they are
    few beside the paths, and that table tells which joins are small.
    """
    names = queries.where("qname is not null").groupBy("qname").agg(F.count("*").alias("n"))
    top = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    each = names.select("qname", F.col("n").alias("rows"), F.explode(F.concat(top, label_paths(F.col("qname")))).alias("path")).select("qname", "rows", "path.a", "path.b")
    reached = each.groupBy("a", "b").agg(F.count("*").alias("n"))
    hits = stored(reached.join(rules, ["a", "b"]), "reached")
    return dealt(each, hits, ["a", "b"], "inner", most).drop("a", "b").withColumnRenamed("rows", "n")


def _once(met: DataFrame, *columns: Column) -> DataFrame:
    """A stored row for each covered name: qname, n and aggregates over its rules."""
    return stored(met.groupBy("qname").agg(F.first("n").alias("n"), *columns), "covered")


def blocked(queries: DataFrame, domains: DataFrame, most: int = HOT) -> DataFrame:
    """Queries whose name some rule covers."""
    return dealt(queries, _once(_met(queries, rule_paths(domains), most)), ["qname"], "left_semi", most)


def clean(queries: DataFrame, domains: DataFrame, most: int = HOT) -> DataFrame:
    """Queries that no rule covers; a null name is covered by none."""
    return dealt(queries, _once(_met(queries, rule_paths(domains), most)), ["qname"], "left_anti", most)


def matched_rule(queries: DataFrame, domains: DataFrame, most: int = HOT) -> DataFrame:
    """qname, rule, n_rules: the shortest covering rule, which a walk from the top-level domain meets first, and how many
    rules lie on the name's path."""
    return _met(queries, rule_paths(domains), most).groupBy("qname").agg(F.min_by("rule", "depth").alias("rule"), F.count("*").alias("n_rules"))


def verdict(action: Column, sec: Column, ad: Column) -> Column:
    """A custom rule (0 allow, 1 block) comes before a security list, this before another list, this before forward."""
    return F.when(action == 0, "allow_custom").when(action == 1, "block_custom").when(sec, "block_security").when(ad, "block_ad").otherwise("forward")


def verdicts(queries: DataFrame, custom: DataFrame, rules: DataFrame, most: int = HOT) -> DataFrame:
    """queries with a verdict, worked out once a name. custom: qname, action; rules: of `sides`."""
    met = _once(_met(queries, rules, most), F.bool_or("sec").alias("_sec"), F.bool_or("ad").alias("_ad"))
    own, both = stored(custom.select("qname", F.col("action").alias("_action")), "custom"), dealt(queries, met, ["qname"], "left", most)
    if own.count() <= FEW:
        both = both.join(F.broadcast(own), "qname", "left")
    else:
        both = dealt(both, own.join(queries.groupBy("qname").agg(F.count("*").alias("n")), "qname"), ["qname"], "left", most)
    return both.withColumn("verdict", verdict(F.col("_action"), F.col("_sec"), F.col("_ad"))).drop("_action", "_sec", "_ad")
