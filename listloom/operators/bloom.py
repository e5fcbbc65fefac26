"""Bloom filters as tables: sizes, bit positions, bytes and probes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.lines import lowered, once
from ..sources.folders import stored
from . import packing
from .joins import dealt

#: Target false-positive rate, used too where a rate is out of range.
RATE = 0.001
#: Bytes of a block: Spark's own bitmaps have this size.
BLOCK = 4096
#: Copies of a filter's blocks that names are dealt over, at least, and the hashes that each round of a probe asks for.
SPREAD, ROUNDS = 64, ((0, 2), (2, 5), (5, 2**31 - 1))
#: Lists whose sizes are broadcast: some 50 bytes each.
FEW = 500_000


def bit_count(n: Column, rate: float = RATE) -> Column:
    """ceil(-n ln p / ln(2)**2), rounded up to whole bytes; n below 1 counts as 1."""
    p = rate if 0 < rate < 1 else RATE
    m = F.ceil(-F.greatest(n, F.lit(1)).cast("double") * F.lit(math.log(p)) / F.lit(math.log(2) * math.log(2)))
    return (F.ceil(m / 8) * 8).cast("long")


def hash_count(rate: float = RATE) -> int:
    p = rate if 0 < rate < 1 else RATE
    return max(1, math.ceil(-math.log(p) / (math.log(2) * math.log(2)) * math.log(2)))


def params(domains: DataFrame, rate: float = RATE) -> DataFrame:
    """list_id, n, bit_count, hash_count."""
    counted = domains.groupBy("list_id").agg(F.count("*").alias("n"))
    return counted.select("list_id", "n", bit_count(F.col("n"), rate).alias("bit_count"), F.lit(hash_count(rate)).alias("hash_count"))


def _named(names: DataFrame, name: str) -> DataFrame:
    """names with `_name`, the name as of H.bloom_name; rows whose name comes to nothing go."""
    put = lowered(names, "_name", F.col(name))
    return put.withColumn("_name", F.when(F.col("_name").startswith("*."), F.substring("_name", 3, 2**31 - 1)).otherwise(F.col("_name"))).where("_name <> ''")


def hashed(names: DataFrame, name: str = "domain", compiled: bool = False) -> DataFrame:
    """names with `hash`, both hashes of the normalised name; rows whose name comes to nothing go."""
    put = _named(names, name)
    return (H.with_fnv(put, "hash", "_name") if compiled else once(put, "hash", H.fnv(F.col("_name")))).drop("_name")


def positions(domains: DataFrame, params_: DataFrame) -> DataFrame:
    """list_id, domain, i, pos: the bit that each of the k hashes sets."""
    with_size = dealt(hashed(domains, compiled=True), params_.select("list_id", "n", "bit_count", "hash_count"), ["list_id"])
    each = with_size.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("hash_count") - 1)))
    return each.select("list_id", "domain", "i", H.position(F.col("hash"), F.col("i"), F.col("bit_count")).alias("pos"))


def blocks(positions_: DataFrame) -> DataFrame:
    """list_id, block, bits: BLOCK bytes of a filter that aren't all zero, the lowest bit of each byte first.

    Positions go to their block as they are: bitmaps of single tasks would be larger than the few bits that a task has for
    one block.
    """
    at = F.col("pos") + 1  # Spark counts bits of its bitmaps from 1
    put = positions_.select("list_id", (F.bitmap_bucket_number(at) - 1).alias("block"), F.bitmap_bit_position(at).alias("bit"))
    return put.repartition("list_id", "block").groupBy("list_id", "block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def built(domains: DataFrame, sizes: DataFrame) -> DataFrame:
    """The blocks (as of `blocks`) of the filters of domains, without a row for each bit.

    A task hashes its names by numpy and sends, for some hundred thousand names at a time, a row for each block with the places
    that they set in it, two bytes each; such rows of a block meet in one place and become its bytes. A block has 32,768 bits,
    so no row grows with a list. Sizes are a row a list: hand in a stored table, so that they can be broadcast.
    """
    sized = dealt(_named(domains, "domain").select("list_id", "_name"), sizes.select("list_id", "n", "bit_count", "hash_count"), ["list_id"])
    put = sized.select("list_id", F.col("_name").alias("name"), "bit_count", "hash_count").mapInArrow(packing.packed, packing.PACKED)
    met = put.repartition("list_id", "block").groupBy("list_id", "block").agg(F.collect_list("offsets").alias("packs"))
    return met.mapInArrow(packing.whole, packing.WHOLE)


def joined_blocks(one: DataFrame, two: DataFrame) -> DataFrame:
    """The blocks of filters of equal size, bit by bit or'ed."""
    return one.unionByName(two).groupBy("list_id", "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def filter_bytes(blocks_: DataFrame) -> DataFrame:
    """list_id, byte_idx, byte_val of the bytes that are not zero; bit 0 of a byte is its lowest."""
    letters = F.split(F.decode("bits", "ISO-8859-1"), "")  # a letter for each byte
    each = blocks_.select("list_id", "block", F.posexplode(letters).alias("at", "letter")).where(F.col("letter") != "\x00")
    return each.select("list_id", (F.col("block") * BLOCK + F.col("at")).alias("byte_idx"), F.ascii("letter").alias("byte_val"))


def merged(domains: DataFrame, name: str = "all") -> DataFrame:
    """The distinct domains of all lists as one list."""
    return domains.select("domain").distinct().select(F.lit(name).alias("list_id"), "domain")


def filters(domains: DataFrame, rate: float = RATE) -> tuple[DataFrame, DataFrame]:
    """Sizes and blocks of each list's filter, stored, so that a plan over them knows how large they are."""
    sizes = stored(params(domains, rate), "bloom-sizes")
    return sizes, stored(built(domains, sizes), "bloom-blocks")


def probe(pairs: DataFrame, sizes: DataFrame, blocks_: DataFrame, spread: int = SPREAD) -> DataFrame:
    """The pairs (list_id, name) for which that list's filter may hold the name: all its bits are set.

    Bits are asked for in rounds, first two of a name, then three, then the rest; a name without one of them goes at once,
    and half of all bits are set, so the later rounds see few names that a filter doesn't hold. A bit is tested inside the
    row that meets its block. Where blocks are few enough they are broadcast by their stored size; where they are not, those
    of a filter with less than `spread` blocks are repeated, and its names dealt over the copies.
    """
    sized = sizes.select("list_id", "bit_count", "hash_count", _copies(F.col("bit_count"), spread).alias("copies"))
    distinct = pairs.select("list_id", "name").distinct()
    if sizes.count() <= FEW:
        left = hashed(distinct, "name").join(F.broadcast(sized), "list_id")
    else:
        left = dealt(hashed(distinct, "name"), sized.join(distinct.groupBy("list_id").agg(F.count("*").alias("n")), "list_id"), ["list_id"])
    every = blocks_.join(sized.select("list_id", "copies"), "list_id").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    for first, end in ROUNDS:
        last = F.least(F.lit(end), F.col("hash_count"))
        asked = F.when(last > first, F.transform(F.sequence(F.lit(first), F.greatest(last, F.lit(first + 1)) - 1), lambda i: H.position(F.col("hash"), i, F.col("bit_count"))))
        each = left.withColumn("pos", F.explode_outer(asked)).withColumns({"block": F.floor(F.col("pos") / (8 * BLOCK)).cast("long"), "copy": F.pmod(F.col("hash")["a"], F.col("copies")).cast("int")})
        met = each.join(every, ["list_id", "block", "copy"], "left")
        at = F.pmod(F.col("pos"), F.lit(8 * BLOCK)).cast("int")
        byte = F.ascii(F.decode(F.substring("bits", F.shiftright(at, 3) + 1, F.lit(1)), "ISO-8859-1"))
        unset = F.col("pos").isNotNull() & (F.coalesce(F.call_function("getbit", byte.cast("long"), at.bitwiseAND(F.lit(7))), F.lit(0)) == 0)
        judged = met.select("list_id", "name", "hash", "bit_count", "hash_count", "copies", unset.alias("unset"))
        left = judged.groupBy("list_id", "name").agg(*(F.first(c).alias(c) for c in ("hash", "bit_count", "hash_count", "copies")), F.bool_or("unset").alias("unset")).where("not unset").drop("unset")
    return left.select("list_id", "name")


def _copies(bits: Column, spread: int) -> Column:
    return F.greatest(F.floor(F.lit(spread) / F.ceil(bits / (8 * BLOCK))), F.lit(1)).cast("int")


def suffixes(queries: DataFrame) -> DataFrame:
    """qname, suffix: every distinct name with itself and all its parents, as they stand in it."""
    names = queries.select("qname").distinct().withColumn("parts", F.split("qname", "[.]"))
    each = names.select("qname", "parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("at"))
    return each.select("qname", F.array_join(F.slice("parts", F.col("at"), F.size("parts")), ".").alias("suffix"))
