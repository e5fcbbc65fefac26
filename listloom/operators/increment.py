"""What a change of lists means for a build: added rules, rule differences, the build strategy, and builds kept up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import generations
from ..sources.folders import scratch, stored
from . import bloom, rules, trie


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Domains of the old rules and of new lists, once each."""
    return old.select("domain").unionByName(new.select("domain")).dropDuplicates(["domain"])


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """domain, change (`added` or `removed`) between two snapshots of distinct domains."""
    gone = old.select("domain").distinct().join(new.select("domain"), "domain", "left_anti").withColumn("change", F.lit("removed"))
    come = new.select("domain").distinct().join(old.select("domain"), "domain", "left_anti").withColumn("change", F.lit("added"))
    return gone.unionAll(come)


def strategy(old: DataFrame, new: DataFrame) -> DataFrame:
    """group, strategy from fingerprints (group, id, modified): unchanged gives cache, only additions add, else rebuild."""
    a, b = old.withColumnRenamed("modified", "was"), new.withColumnRenamed("modified", "now")
    both = a.join(b, ["group", "id"], "full")
    lost = F.bool_or(F.col("now").isNull() | (F.col("was").isNotNull() & (F.col("was") != F.col("now"))))
    more = F.bool_or(F.col("was").isNull())
    return both.groupBy("group").agg(F.when(lost, "rebuild").when(more, "add").otherwise("cache").alias("strategy"))


#: What a build keeps of each group; `list_id` is the group's name there.
KINDS = {
    "members": "list_id string, id string, modified long",
    "domains": "list_id string, domain string",
    "nodes": "list_id string, path array<string>, depth int, is_terminal boolean, child_count long, child_bytes long",
    "sizes": "list_id string, n long, bit_count long, hash_count int",
    "blocks": "list_id string, block long, bits binary",
}
_STATE = "list_id string, generation string"


def built(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """What the last build of every group keeps of one kind (see KINDS)."""
    return generations.read(spark, folder, kind, KINDS[kind], generations.state(spark, folder, _STATE), "list_id")


def build(spark: SparkSession, folder: str, members: DataFrame, read: Callable[[list[str]], DataFrame]) -> list[tuple[str, str]]:
    """Brings the tries and filters of all groups of lists up to date; the groups that were touched, with how.

    members: group, id, modified of the lists that each group has now; read gives the lines (list_id, line_no, raw) of some
    lists. A group without a change keeps its generation. One that only got lists has these alone parsed: their new domains
    are merged into its stored nodes, and into its filter where the filter's size stays; where it doesn't, the filter is
    made from the stored domains. One that lost a list, or of which a list changed, is built from all its lists. A group
    without members is dropped. Bytes are those of a whole build.
    """
    with scratch(spark):
        members = stored(members.select("group", F.col("id").cast("string").alias("id"), F.col("modified").cast("long").alias("modified")).distinct(), "members")
        old = built(spark, folder, "members").withColumnRenamed("list_id", "group")
        plan = stored(strategy(old, members).where("strategy <> 'cache'"), "plan")
        touched = sorted((r["group"], r["strategy"]) for r in plan.collect())  # a row a group that changes
        if not touched:
            return []
        adds, group = plan.where("strategy = 'add'").select("group"), F.col("group").alias("list_id")
        known = old.join(adds, "group", "left_semi").select("group", "id")
        parsed = stored(members.join(plan.select("group"), "group", "left_semi").join(known, ["group", "id"], "left_anti"), "parsed")
        ids = sorted(r["id"] for r in parsed.select("id").distinct().collect())  # names of lists to parse
        kept = {k: built(spark, folder, k).join(adds.select(group), "list_id", "left_semi") for k in KINDS}
        found = rules.domains(rules.first_seen(read(ids))).withColumnRenamed("list_id", "id") if ids else spark.createDataFrame([], "id string, domain string")
        fresh = found.join(parsed.select(group, "id"), "id").select("list_id", "domain").distinct()
        fresh = stored(fresh.join(kept["domains"], ["list_id", "domain"], "left_anti"), "fresh")
        generation = generations.new()
        at = {k: generations.path(folder, k, generation) for k in KINDS}
        members.join(plan.select("group"), "group", "left_semi").select(group, "id", "modified").write.parquet(at["members"])
        kept["domains"].unionByName(fresh).write.parquet(at["domains"])
        domains = spark.read.schema(KINDS["domains"]).parquet(at["domains"])
        trie.merged(kept["nodes"], fresh).write.parquet(at["nodes"])
        bloom.params(domains).write.parquet(at["sizes"])
        sizes = spark.read.schema(KINDS["sizes"]).parquet(at["sizes"])
        same = sizes.join(kept["sizes"].select("list_id", "bit_count"), ["list_id", "bit_count"], "left_semi").select("list_id")
        added = fresh.join(same, "list_id", "left_semi").unionByName(domains.join(same, "list_id", "left_anti"))
        bloom.joined_blocks(kept["blocks"].join(same, "list_id", "left_semi"), bloom.built(added, sizes)).write.parquet(at["blocks"])
        now = spark.createDataFrame([(g,) for g, _ in touched], "group string").join(members.select("group").distinct().withColumn("there", F.lit(True)), "group", "left")
        generations.switch(spark, folder, _STATE, "list_id", now.select(group, F.when(F.col("there"), F.lit(generation)).alias("generation")))
        return touched
