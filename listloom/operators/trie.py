"""Reversed-label tries as tables: nodes, children, breadth-first order and byte offsets.

Nodes of a list are ordered by (depth, path). No task sorts a whole list, nor all that it has under one name: the order is
cut into ranges of equal size, positions are counted within a range, and the ranges' totals give each its start.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lines import reversed_labels
from .joins import running

#: Bytes before the first node.
HEADER = 16


def nodes(domains: DataFrame) -> DataFrame:
    """list_id, path, depth, is_terminal: every distinct label path, the root included."""
    labels = domains.select("list_id", reversed_labels(F.col("domain")).alias("labels"))
    each = labels.select("list_id", "labels", F.explode(F.sequence(F.lit(0), F.size("labels"))).alias("depth"))
    paths = each.select("list_id", F.slice("labels", F.lit(1), F.col("depth")).alias("path"), (F.col("depth") == F.size("labels")).alias("whole"))
    return paths.groupBy("list_id", "path").agg(F.bool_or("whole").alias("is_terminal")).select("list_id", "path", F.size("path").alias("depth"), "is_terminal")


def stats(nodes_: DataFrame) -> DataFrame:
    """list_id, node_count, terminal_count."""
    return nodes_.groupBy("list_id").agg(F.count("*").alias("node_count"), F.count_if("is_terminal").alias("terminal_count"))


def children(nodes_: DataFrame) -> DataFrame:
    """list_id, path, child_count, child_bytes of every node that has children; 6 bytes and the label for each child."""
    up = nodes_.where("depth > 0").select("list_id", F.slice("path", F.lit(1), F.col("depth") - 1).alias("path"), F.element_at("path", -1).alias("label"))
    return up.groupBy("list_id", "path").agg(F.count("*").alias("child_count"), F.sum(F.octet_length("label") + 6).cast("long").alias("child_bytes"))


def counted(nodes_: DataFrame) -> DataFrame:
    """Nodes with child_count and child_bytes, 0 where there is no child.

    Each node is handed on once as itself and once as a child of the one above, and both meet in one hash aggregate: the nodes
    are made once, and none are sorted for a join.
    """
    zero = F.lit(0).cast("long")
    own = F.struct("path", "is_terminal", zero.alias("child_count"), zero.alias("child_bytes"))
    up = F.slice("path", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0)))
    child = F.struct(up.alias("path"), F.lit(False).alias("is_terminal"), F.lit(1).cast("long").alias("child_count"), (F.octet_length(F.try_element_at("path", F.lit(-1))) + 6).cast("long").alias("child_bytes"))
    each = nodes_.select("list_id", F.explode(F.array(own, F.when(F.col("depth") > 0, child))).alias("node")).where("node is not null").select("list_id", "node.*")
    met = each.groupBy("list_id", "path").agg(F.bool_or("is_terminal").alias("is_terminal"), F.sum("child_count").alias("child_count"), F.sum("child_bytes").alias("child_bytes"))
    return met.select("list_id", "path", F.size("path").alias("depth"), "is_terminal", "child_count", "child_bytes")


def merged(counted_: DataFrame, domains: DataFrame) -> DataFrame:
    """Counted nodes (as of `counted`) with the paths of more domains; only what the new paths change is counted anew."""
    old = counted_.select("list_id", "path", "is_terminal", "child_count", "child_bytes", F.lit(True).alias("old"))
    new = nodes(domains).select("list_id", "path", "is_terminal", F.lit(0).cast("long").alias("child_count"), F.lit(0).cast("long").alias("child_bytes"), F.lit(False).alias("old"))
    both = old.unionByName(new).groupBy("list_id", "path").agg(F.bool_or("is_terminal").alias("is_terminal"), F.sum("child_count").alias("child_count"), F.sum("child_bytes").alias("child_bytes"), F.bool_or("old").alias("old"))
    both = both.withColumn("depth", F.size("path"))
    more = children(both.where("not old")).select("list_id", "path", F.col("child_count").alias("more"), F.col("child_bytes").alias("more_bytes"))
    summed = both.join(more, ["list_id", "path"], "left").fillna(0, ["more", "more_bytes"])
    return summed.select("list_id", "path", "depth", "is_terminal", (F.col("child_count") + F.col("more")).alias("child_count"), (F.col("child_bytes") + F.col("more_bytes")).alias("child_bytes"))


def laid_out(nodes_: DataFrame) -> DataFrame:
    """Nodes with child_count, bfs_index (the root is 0), byte_offset in the serialised trie, and labels_before: the bytes
    of the child records of all nodes before, from which a child's place in its parent's record follows."""
    full = nodes_ if "child_count" in nodes_.columns else counted(nodes_)
    own = F.when(F.col("depth") > 0, F.octet_length(F.try_element_at("path", F.lit(-1))) + 6).otherwise(0).cast("long")
    full = full.select("list_id", "path", "depth", "is_terminal", F.coalesce("child_count", F.lit(0)).alias("child_count"), (F.coalesce("child_bytes", F.lit(0)) + 5).alias("n_bytes"), own.alias("n_label"))
    placed = running(full, ["list_id"], ["depth", "path"], {"bfs_index": F.lit(1), "before": F.col("n_bytes"), "labels_before": F.col("n_label")}, "nodes")
    return placed.select("list_id", "path", "depth", "is_terminal", "child_count", "bfs_index", (F.col("before") + HEADER).alias("byte_offset"), "n_bytes", "labels_before")
