"""Tables whose rows belong to keys that are replaced as a whole, with versions that readers can trust.

A write puts the rows of some keys into a generation folder of its own; then a new state, a row a key with the generation that
holds it, is written and switched by one marker. A reader sees the state that it began with, and no generation changes once
it is written. Of two writers the one that comes second takes up the other's keys.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folders


def new() -> str:
    """A name for a generation."""
    return uuid.uuid4().hex


def path(folder: str, kind: str, generation: str) -> str:
    """Where a generation's rows of one kind stand."""
    return f"{folder}/{kind}/generation={generation}"


def state(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The last state; schema has a column `generation`, null for keys that are taken back."""
    known = folders.versions(spark, folder)
    return spark.read.schema(schema).parquet(f"{folder}/{folders.facts(spark, folder, known[-1])['state']}") if known else spark.createDataFrame([], schema)


def switch(spark: SparkSession, folder: str, schema: str, key: str, rows: DataFrame, tries: int = 5) -> None:
    """Publishes the next state: `rows` instead of those of the same keys."""
    for left in range(tries - 1, -1, -1):
        version = max(folders.versions(spark, folder), default=0) + 1
        at = f"state/{version}-{uuid.uuid4().hex}"
        old = state(spark, folder, schema).join(rows.select(key), key, "left_anti")
        old.unionByName(rows).write.parquet(f"{folder}/{at}")
        try:
            return folders.mark(spark, folder, version, {"state": at})
        except folders.Taken:
            if not left:
                raise


def read(spark: SparkSession, folder: str, kind: str, schema: str, now: DataFrame, key: str) -> DataFrame:
    """The rows of a kind that a state (or some of its rows) holds: only its generations are listed and read."""
    now = now.where("generation is not null")
    live = sorted(r["generation"] for r in now.select("generation").distinct().collect())  # one a write that is not swept
    if not live:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, generation string").option("basePath", f"{folder}/{kind}").parquet(*(path(folder, kind, g) for g in live))
    return rows.join(now.select(key, "generation"), [key, "generation"], "left_semi").drop("generation")


def sweep(spark: SparkSession, folder: str, schema: str, keep: int = 2) -> None:
    """Removes generations that none of the last `keep` states names, older states, and what broken writes have left.
    Nobody must be writing meanwhile, and readers of older states must be done."""
    kept = folders.versions(spark, folder)[-keep:]
    states = {folders.facts(spark, folder, v)["state"] for v in kept}
    live: set[str] = set()
    for at in states:
        rows = spark.read.schema(schema).parquet(f"{folder}/{at}").where("generation is not null")
        live |= {r["generation"] for r in rows.select("generation").distinct().collect()}
    for kind in folders.names(spark, folder):
        for name in folders.names(spark, f"{folder}/{kind}") if kind != "_versions" else ():
            if (f"state/{name}" not in states) if kind == "state" else (name.removeprefix("generation=") not in live):
                folders.remove(spark, f"{folder}/{kind}/{name}")
    folders.prune(spark, folder, min(kept, default=0))
