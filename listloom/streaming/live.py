"""Structured Streaming: refreshing lists as files land, and verdicts on a stream of names."""

from __future__ import annotations

from itertools import islice

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lines import once
from ..operators import artifacts, catalog, match, rules, trie
from ..sources import lists as S
from ..sources.folders import Taken, scratch, stored


#: Lists that are compiled together.
GROUP = 1000


def refresh(spark: SparkSession, landing: str, target: str, checkpoint: str, updated: str, group: int = GROUP) -> None:
    """Compiles every list of which files have landed since the last call, publishes it and updates the catalog; then stops.

    landing has a subfolder `list_id=<id>` of text files for each list. A batch names the lists it touches; in groups of
    bounded size the folders of these alone are read whole, so a list that comes in several files or batches is compiled from
    all it has by then, and no other list costs anything. A list without rules, or with a line that is too long, gets the
    status `failed`, keeps its last artifacts and catalog row, and stops no other. Each batch writes `runs` (list_id, status,
    stage, rule_count); where the catalog cannot be written, its lists get a row of the stage `catalog` with the status
    `failed` and stay published. A repeated batch publishes the same bytes again and replaces its runs. What a batch stores
    for itself is removed with it.
    """

    def compile_(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            touched = stored(batch.select(F.col("list_id").cast("string")).where("list_id is not null").distinct(), "touched")
            names = touched.orderBy("list_id").toLocalIterator(prefetchPartitions=True)  # a group of names at a time
            at = 0
            while ids := [r["list_id"] for r in islice(names, group)]:
                with scratch(spark):
                    run = _compiled(spark, landing, target, ids, updated)
                    run.write.mode("overwrite").parquet(f"{target}/runs/run_id={batch_id}/group={at}")
                at += 1

    stream = spark.readStream.schema("value string, list_id string").option("pathGlobFilter", "*.txt").text(landing)
    stream.writeStream.foreachBatch(compile_).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _compiled(spark: SparkSession, landing: str, target: str, ids: list[str], updated: str) -> DataFrame:
    """Compiles, publishes and records some lists; the rows of `runs`."""
    lists = spark.createDataFrame([(x,) for x in ids], "list_id string")
    lines = S.scan(spark, landing, ids)
    found = stored(rules.first_seen(S.readable(lines)), "rules")
    counted = stored(rules.counts(found, lists), "counts")
    named = lists.select("list_id", F.concat(F.lit("file:"), "list_id").alias("url"))
    placed = stored(trie.laid_out(trie.nodes(rules.domains(found))), "placed")
    sizes = artifacts.publish(artifacts.bundle(found, placed, counted, named, updated), f"{target}/artifacts")
    good = F.col("domains") + F.col("cosmetic") + F.col("scriptlets") > 0
    run = counted.select("list_id", F.when(good, "ok").otherwise("failed").alias("status"), F.lit("compile").alias("stage"), "rule_count")
    done = counted.where(good).join(sizes, "list_id").join(named, "list_id")
    link = F.concat(F.lit("artifacts/list_id="), "list_id")
    rows = done.select(F.col("list_id").alias("name"), "url", link.alias("r2_download_link"), F.col("rule_count").cast("int").alias("rule_count"), F.col("n_bytes").alias("file_size"), F.lit(0).alias("seq"))
    try:
        catalog.apply(spark, f"{target}/catalog", rows, updated)
    except (PySparkException, Py4JJavaError, Taken):
        run = run.unionAll(done.select("list_id", F.lit("failed"), F.lit("catalog"), "rule_count"))
    return run


def runs(spark: SparkSession, target: str) -> DataFrame:
    """run_id, list_id, status, stage, rule_count of all batches."""
    return spark.read.schema("list_id string, status string, stage string, rule_count long, run_id long, group long").parquet(f"{target}/runs").drop("group")


def verdicts(stream: DataFrame, custom: DataFrame, rules: DataFrame, target: str, checkpoint: str) -> None:
    """Writes the verdicts on all names that the stream (query_id, ts, qname) has now, then stops.

    A native append-mode stream without state: each row's label path meets the stored rules in one stream-static join for
    each depth that rules have, so a name of any length is decided exactly, and the file sink's own log lets a restart
    repeat nothing. custom: qname, action; rules: of `match.sides`.
    """
    spark = stream.sparkSession
    custom = stored(custom.select("qname", "action"), "custom")
    rules = stored(rules.select("a", "b", "depth", "sec", "ad"), "sides")
    depths = sorted(r["depth"] for r in rules.select("depth").distinct().collect())  # no more than a rule has labels
    rows = once(stream, "_path", match.label_paths(F.col("qname"))).join(custom, "qname", "left")
    sec, ad = F.lit(False), F.lit(False)
    for d in depths:
        one = rules.where(F.col("depth") == d).select(F.col("a").alias(f"_a{d}"), F.col("b").alias(f"_b{d}"), F.col("sec").alias(f"_s{d}"), F.col("ad").alias(f"_d{d}"))
        at = F.get("_path", F.lit(d - 1)) if d else None
        named = F.col("qname").isNotNull()
        keys = (at["a"], at["b"]) if d else (F.when(named, F.lit(0)).cast("long"), F.when(named, F.lit(0)).cast("long"))
        rows = rows.withColumns({f"_ka{d}": keys[0], f"_kb{d}": keys[1]})
        rows = rows.join(one, (F.col(f"_ka{d}") == F.col(f"_a{d}")) & (F.col(f"_kb{d}") == F.col(f"_b{d}")), "left")
        sec, ad = sec | F.coalesce(f"_s{d}", F.lit(False)), ad | F.coalesce(f"_d{d}", F.lit(False))
    judged = rows.select(*stream.columns, match.verdict(F.col("action"), sec, ad).alias("verdict"))
    judged.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
