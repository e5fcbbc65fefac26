"""Reading and landing list files as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folders import names

#: A list with a line of this many bytes fails as a whole.
LONGEST = 1 << 20
LINES = "list_id string, line_no long, raw string"


def scan(spark: SparkSession, folder: str, list_ids: list[str] | None = None) -> DataFrame:
    """list_id, line_no, raw, n_bytes of all text files in a folder; a list is a file, or a subfolder `list_id=<id>` of files.

    A list's files follow one another by name, and line_no counts its lines from 1 through all of them: lines are counted for
    each piece of a file that a task reads, and the pieces' totals, a row for 128 MB or a file, are broadcast and give every piece its start. Lines end with a
    line feed; a carriage return before it is no part of `raw` but counts in `n_bytes`. With `list_ids` only the subfolders
    of these lists are listed and read.
    """
    read = spark.read.option("pathGlobFilter", "*.txt").option("lineSep", "\n")
    if list_ids is None:
        rows, id_ = read.text(folder), F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "")
    if list_ids is not None or "list_id" in rows.columns:
        found = set(names(spark, folder)) if list_ids is not None else set()
        own = [f"{folder}/{x}" for x in map(partition, list_ids or []) if x in found]
        if list_ids is not None and not own:
            return spark.createDataFrame([], f"{LINES}, n_bytes long")
        read = read.schema("value string, list_id string").option("basePath", folder)
        rows, id_ = read.text(own if list_ids is not None else folder), F.col("list_id")
        rows = rows if list_ids is None else rows.where(F.col("list_id").isin(list_ids))
    piece = ("list_id", "file", "begin")
    rows = rows.select("value", id_.alias("list_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("nth"))
    counted = rows.groupBy(*piece).agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    ahead = Window.partitionBy("list_id").orderBy("file", "begin").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select(*piece, "first", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    line_no = F.col("before") + F.col("nth") - F.col("first") + 1
    raw = F.when(F.col("value").endswith("\r"), F.substring("value", F.lit(1), F.char_length("value") - 1)).otherwise(F.col("value"))
    return rows.join(F.broadcast(starts), [*piece]).select("list_id", line_no.alias("line_no"), raw.alias("raw"), F.octet_length("value").cast("long").alias("n_bytes"))


def partition(list_id: str) -> str:
    """The name of a list's subfolder."""
    return "list_id=" + SparkSession.active()._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(list_id)


def land(lines: DataFrame, folder: str) -> None:
    """Writes lines (list_id, raw) as text files, a subfolder for each list; more files of a list may follow."""
    lines.select("list_id", F.col("raw").alias("value")).write.partitionBy("list_id").mode("append").text(folder)


def too_long(lines: DataFrame) -> DataFrame:
    """Lists that fail because a line is too long, its carriage return included where `n_bytes` tells."""
    size = F.col("n_bytes") if "n_bytes" in lines.columns else F.octet_length("raw")
    return lines.groupBy("list_id").agg(F.max(size).alias("longest")).where(F.col("longest") >= LONGEST).select("list_id")


def readable(lines: DataFrame) -> DataFrame:
    """Lines of the lists that do not fail; the failed ones are few and found by one aggregate."""
    return lines.join(F.broadcast(too_long(lines)), "list_id", "left_anti")
