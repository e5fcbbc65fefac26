"""Artifacts of compiled lists in their fixed binary and text layouts.

An artifact is a table of parts of bounded size: (list_id, entry, part, content). The parts of an entry, joined by
their number, are its bytes. Tries are cut by byte position, where a node's head and each of its children are records of
their own, Bloom filters by blocks, texts by lines: no task builds a whole artifact, and no cell grows with a list or with
what it has under one name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import generations
from ..sources.folders import stored
from . import bloom, trie
from .rules import domains

# Magic numbers and versions of the two binary formats.
TRIE_MAGIC, TRIE_VERSION = "54524945", 2
BLOOM_MAGIC, BLOOM_VERSION = "424C4F4D", 1
#: Bytes of a part of a trie (a record that begins in it is in it), blocks of one of a Bloom filter, lines of one of a text.
PART, BLOCKS, LINES = 1 << 20, 256, 100_000
COLUMNS = ("list_id", "entry", "part", "content")


def big_endian(n: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), width * 2, "0"))


def trie_parts(placed: DataFrame, part: int = PART) -> DataFrame:
    """The serialised tries from laid-out nodes: a header, then each node with the labels and offsets of its children.

    A child's record lies behind the header, the heads of all nodes up to its parent and the records of all children before.
    """
    up = F.slice("path", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0)))
    parents = placed.where("child_count > 0").select("list_id", F.col("path").alias("up"), F.col("bfs_index").alias("parent"))
    below = placed.where("depth > 0").withColumn("up", up).join(parents, ["list_id", "up"])
    label = F.element_at("path", -1)
    child = F.concat(big_endian(F.octet_length(label), 2), F.encode(label, "UTF-8"), big_endian(F.col("byte_offset"), 4))
    children = below.select("list_id", (F.lit(trie.HEADER + 5) + 5 * F.col("parent") + F.col("labels_before")).alias("at"), child.alias("bytes"))
    heads = placed.select("list_id", F.col("byte_offset").alias("at"), F.concat(F.unhex(F.when(F.col("is_terminal"), "01").otherwise("00")), big_endian(F.col("child_count"), 4)).alias("bytes"))
    counts = trie.stats(placed)
    header = counts.select("list_id", F.lit(0).cast("long").alias("at"), F.concat(F.unhex(F.lit(TRIE_MAGIC)), big_endian(F.lit(TRIE_VERSION), 4), big_endian(F.col("node_count"), 4), big_endian(F.col("terminal_count"), 4)).alias("bytes"))
    return _joined(header.unionAll(heads).unionAll(children), "trie", F.floor(F.col("at") / part))


def bloom_parts(domains: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The serialised Bloom filters: a header, then all bytes, zero or not."""
    sizes = stored(bloom.params(domains), "bloom-sizes")  # few rows, read thrice, and broadcast where their size is known
    set_ = bloom.built(domains, sizes)
    n_bytes = F.shiftright("bit_count", 3)
    all_ = sizes.select("list_id", n_bytes.alias("n_bytes"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n_bytes - 1) / bloom.BLOCK))).alias("block"))
    size = F.least(F.lit(bloom.BLOCK).cast("long"), F.col("n_bytes") - F.col("block") * bloom.BLOCK).cast("int")
    content = F.substring(F.coalesce("bits", F.unhex(F.lit("00" * bloom.BLOCK))), F.lit(1), size)
    records = all_.join(set_, ["list_id", "block"], "left").select("list_id", F.col("block").alias("at"), content.alias("bytes"))
    header = sizes.select("list_id", F.lit(-1).cast("long").alias("at"), F.concat(F.unhex(F.lit(BLOOM_MAGIC)), big_endian(F.lit(BLOOM_VERSION), 4), big_endian(F.col("bit_count"), 8), big_endian(F.col("hash_count"), 4), F.unhex(F.lit("00000000"))).alias("bytes"))
    return _joined(header.unionAll(records), "bloom", F.greatest(F.floor(F.col("at") / blocks), F.lit(0)))


def _joined(records: DataFrame, entry: str, part: Column) -> DataFrame:
    parted = records.withColumn("part", part.cast("long"))
    whole = parted.groupBy("list_id", "part").agg(F.sort_array(F.collect_list(F.struct("at", "bytes"))).alias("all"))
    content = F.unhex(F.array_join(F.transform(F.col("all")["bytes"], F.hex), ""))
    return whole.select("list_id", F.lit(entry).alias("entry"), "part", content.alias("content"))


def css_parts(rules: DataFrame, lines: int = LINES) -> DataFrame:
    """Cosmetic rules, a line each, in first-seen order; a part holds a range of line numbers."""
    text = rules.where("kind = 'cosmetic'").select("list_id", F.floor(F.col("first_line") / lines).alias("part"), F.struct("first_line", "text").alias("row"))
    return _texts(text, "css")


def scriptlet_parts(rules: DataFrame, lines: int = LINES) -> DataFrame:
    """Scriptlet rules, a line each, sorted by bytes; parts are runs of lines of one range partition, so that neither a
    list nor a common beginning is one task's."""
    ranged = rules.where("kind = 'scriptlet'").select("list_id", "text").repartitionByRange("list_id", "text").withColumn("piece", F.spark_partition_id())
    nth = F.row_number().over(Window.partitionBy("list_id", "piece").orderBy("text")) - 1
    part = F.shiftleft(F.col("piece").cast("long"), 32) + F.floor(nth / lines)
    return _texts(ranged.select("list_id", part.alias("part"), F.struct(F.lit(0).alias("first_line"), "text").alias("row")), "scriptlets")


def _texts(rows: DataFrame, entry: str) -> DataFrame:
    whole = rows.groupBy("list_id", "part").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return whole.select("list_id", F.lit(entry).alias("entry"), "part", F.encode(F.concat(F.array_join(F.col("rows")["text"], "\n"), F.lit("\n")), "UTF-8").alias("content"))


def info_parts(counted: DataFrame, lists: DataFrame, updated: str) -> DataFrame:
    """A JSON document for each list: name, url, ruleCount, updatedAt. lists: list_id, url."""
    text = F.to_json(F.struct(F.col("list_id").alias("name"), "url", F.col("rule_count").alias("ruleCount"), F.lit(updated).alias("updatedAt")))
    return counted.join(lists.select("list_id", "url"), "list_id").select("list_id", F.lit("info.json").alias("entry"), F.lit(0).cast("long").alias("part"), F.encode(text, "UTF-8").alias("content"))


def bundle(rules: DataFrame, placed: DataFrame, counted: DataFrame, lists: DataFrame, updated: str) -> DataFrame:
    """All entries of all lists that hold a rule, from the rules and the laid-out nodes of their domains; both are read
    several times, so hand in stored tables. An entry without data has no rows."""
    full = counted.where("domains + cosmetic + scriptlets > 0")
    parts = [trie_parts(placed), bloom_parts(domains(rules)), css_parts(rules), scriptlet_parts(rules), info_parts(full, lists, updated)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def manifest(parts: DataFrame) -> DataFrame:
    """list_id, entry, n_bytes."""
    return parts.groupBy("list_id", "entry").agg(F.sum(F.octet_length("content")).cast("long").alias("n_bytes"))


def bundle_size(parts: DataFrame) -> DataFrame:
    return parts.groupBy("list_id").agg(F.sum(F.octet_length("content")).cast("long").alias("file_size"))


_DATA = "entry string, part long, content binary, n_bytes long, sha256 string, list_id string"
_STATE = "list_id string, generation string, n_bytes long"


def publish(parts: DataFrame, folder: str) -> DataFrame:
    """Publishes the parts of some lists; those lists are replaced as a whole, others stay. Returns list_id and n_bytes of them.

    Parts go to a generation of their own (see `generations`) with their length and SHA-256, from which sizes are summed;
    a reader in the middle of it sees the old bytes whole, and they stay until `sweep`.
    """
    spark, generation = parts.sparkSession, generations.new()
    marked = parts.select("entry", "part", "content", F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"), "list_id")
    at = generations.path(folder, "data", generation)
    marked.write.partitionBy("list_id").parquet(at)
    new = spark.read.schema(_DATA).parquet(at).groupBy("list_id").agg(F.sum("n_bytes").alias("n_bytes"))
    generations.switch(spark, folder, _STATE, "list_id", new.select("list_id", F.lit(generation).alias("generation"), "n_bytes"))
    return new


def state(spark: SparkSession, folder: str) -> DataFrame:
    """list_id, generation, n_bytes of all lists ever published; the generation is null once a list is taken back."""
    return generations.state(spark, folder, _STATE)


def _parts(spark: SparkSession, folder: str, list_ids: list[str] | None) -> DataFrame:
    now = state(spark, folder)
    rows = generations.read(spark, folder, "data", _DATA, now if list_ids is None else now.where(F.col("list_id").isin(list_ids)), "list_id")
    return rows if list_ids is None else rows.where(F.col("list_id").isin(list_ids))


def published(spark: SparkSession, folder: str, list_ids: list[str] | None = None) -> DataFrame:
    """The parts of all lists, or of some, as they are published now."""
    return _parts(spark, folder, list_ids).select(*COLUMNS)


def damaged(spark: SparkSession, folder: str) -> DataFrame:
    """list_id, entry, part of published parts whose bytes are not those that were written."""
    bad = (F.octet_length("content") != F.col("n_bytes")) | (F.sha2("content", 256) != F.col("sha256"))
    return _parts(spark, folder, None).where(bad).select("list_id", "entry", "part")


def unpublish(spark: SparkSession, folder: str, list_ids: list[str]) -> None:
    """Takes some lists back: their rows of the state become tombstones. Unknown lists do no harm, no file is touched."""
    gone = state(spark, folder).where(F.col("list_id").isin(list_ids)).select("list_id", F.lit(None).cast("string").alias("generation"), F.lit(0).cast("long").alias("n_bytes"))
    generations.switch(spark, folder, _STATE, "list_id", gone)


def sweep(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Removes what none of the last `keep` states holds; see `generations.sweep`."""
    generations.sweep(spark, folder, _STATE, keep)
