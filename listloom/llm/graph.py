"""Connected components of a link table by alternating star steps; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut

#: A key with more than one in SHARE of all rows is hot: there are fewer than SHARE of them, whatever the input.
SHARE = 1000
#: Parts that the rows of a hot key are dealt into.
SALTS = 64


def joined(rows: DataFrame, right: DataFrame, key: str, n: int, how: str = "left") -> DataFrame:
    """rows (n of them) joined with right, which has at most one row for each key, without gathering a hot key.

    Rows of hot keys are dealt by their other columns; right repeats its rows of those keys alone. The hot keys, fewer
    than SHARE, are broadcast.
    """
    hot = F.broadcast(rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") * SHARE > n).select(key, F.lit(SALTS).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("_salts")
    every = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(every, [key, "_salt"], how).drop("_salt")


def _large(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or the node itself; a > b in edges."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b")
    return joined(edges, least, "b", n).select("a", F.coalesce("m", "b").alias("b"))


def _small(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them; edges come with a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = joined(edges, least, "a", n, "inner").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); component is the smallest node reachable.

    Links to oneself and repeated links do no harm; an empty table gives an empty table. Rounds grow with the
    logarithm of the longest path. Every step is checkpointed.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    size = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    now = size(edges)
    while True:
        before = now
        edges = cut(_small(cut(_large(edges, now["n"])), now["n"]))
        now = size(edges)
        if before == now:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
