"""FNV hashes of 64 bits from built-in expressions, in two halves of 32 bits: Spark has no unsigned 64-bit type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import once

# The offset basis of 64-bit FNV in two halves; its prime is 2**40 + 435.
BASIS_HI, BASIS_LO, PRIME_LOW = 0xCBF29CE4, 0x84222325, 435
_MASK = 0xFFFFFFFF
_TWO32 = "4294967296"


def byte_values(text: Column) -> Column:
    """The UTF-8 bytes of a text as an array of numbers."""
    letters = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")  # a letter for each byte
    at = F.when(F.octet_length(text) > 0, F.sequence(F.lit(1), F.octet_length(text))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.ascii(F.substring(letters, i, F.lit(1))).cast("long"))


def _times_prime(hi: Column, lo: Column, there: Column | None = None) -> tuple[Column, Column]:
    """The halves times the prime, or times one where `there` is 0."""
    low, high, top = (lo * PRIME_LOW, hi * PRIME_LOW, F.shiftleft(lo, 8)) if there is None else (lo * (there * (PRIME_LOW - 1) + 1), hi * (there * (PRIME_LOW - 1) + 1), F.shiftleft(lo, 8) * there)
    high = high + F.shiftright(low, 32) + top
    return high.bitwiseAND(F.lit(_MASK)), low.bitwiseAND(F.lit(_MASK))


def _basis() -> Column:
    high, low = F.lit(BASIS_HI).cast("long"), F.lit(BASIS_LO).cast("long")
    return F.struct(high.alias("a"), low.alias("a_lo"), high.alias("f"), low.alias("f_lo"))


def _step(h: Column, b: Column) -> Column:
    a_hi, a_lo = _times_prime(h["a"], h["a_lo"].bitwiseXOR(b))
    f_hi, f_lo = _times_prime(h["f"], h["f_lo"])
    return F.struct(a_hi.alias("a"), a_lo.alias("a_lo"), f_hi.alias("f"), f_lo.bitwiseXOR(b).alias("f_lo"))


def fnv(text: Column) -> Column:
    """struct<a, a_lo, f, f_lo>: the upper and lower halves of the FNV-1a hash (each byte is mixed in, then multiplied)
    and of the FNV-1 hash (multiplied, then each byte is mixed in), in one pass over the bytes. Pin it with
    `lines.once`, or each use folds anew; `with_fnv` is many times as fast over a table."""
    return F.aggregate(byte_values(text), _basis(), _step)


#: Bytes of a name that `with_fnv` takes in compiled steps, and bytes of a step.
UNROLLED, AT_ONCE = 40, 4


def with_fnv(df: DataFrame, name: str, text: str) -> DataFrame:
    """df with `name`, the hashes (as of `fnv`) of the column `text`.

    Spark interprets the function that an array is folded with, node by node for each byte, but compiles plain projections.
    So the first bytes are mixed in by steps of a few bytes, each pinned; a byte behind the end is 0 and multiplies by one.
    Only what a long name has beyond them is folded.
    """
    df = once(df, "_letters", F.decode(F.encode(F.col(text), "UTF-8"), "ISO-8859-1"))
    state = dict(a=F.lit(BASIS_HI).cast("long"), a_lo=F.lit(BASIS_LO).cast("long"), f=F.lit(BASIS_HI).cast("long"), f_lo=F.lit(BASIS_LO).cast("long"))
    for at in range(0, UNROLLED, AT_ONCE):
        for k in range(at + 1, at + AT_ONCE + 1):
            there = (F.char_length("_letters") >= k).cast("long")
            byte = F.ascii(F.substring("_letters", k, 1)).cast("long")
            mixed = state["a_lo"].bitwiseXOR(byte)
            a, a_lo = _times_prime(state["a"], mixed, there)
            f, f_lo = _times_prime(state["f"], state["f_lo"], there)
            state = dict(a=a, a_lo=a_lo, f=f, f_lo=f_lo.bitwiseXOR(byte))
        df = once(df.withColumn("_made", F.struct(*(v.alias(k) for k, v in state.items()))), name, F.col("_made"))
        state = {k: F.col(name)[k] for k in state}
    rest = F.transform(F.sequence(F.lit(UNROLLED + 1), F.char_length("_letters")), lambda i: F.ascii(F.substring("_letters", i, F.lit(1))).cast("long"))
    return df.withColumn(name, F.when(F.char_length("_letters") > UNROLLED, F.aggregate(rest, F.col(name), _step)).otherwise(F.col(name))).drop("_letters", "_made")


def number(high: Column, low: Column) -> Column:
    """Two halves as decimal(20,0)."""
    return (high.cast("decimal(20,0)") * F.lit(_TWO32).cast("decimal(11,0)") + low.cast("decimal(20,0)")).cast("decimal(20,0)")


def bloom_name(text: Column) -> Column:
    """A name as a Bloom filter takes it: trimmed, lower case, without a leading wildcard label; null if nothing is left."""
    from .lines import lower, trim

    name = F.regexp_replace(lower(trim(text)), r"^\*\.", "")
    return F.when(name != "", name)


def position(h: Column, i: Column, bits: Column) -> Column:
    """((h1 + i * h2) mod 2**64) mod bits for a struct of `fnv`: h1 is FNV-1a, h2 is FNV-1, made odd by its lowest bit.

    In halves and then by 16 bits at a time, so that no product leaves 63 bits while bits is below 2**47.
    """
    low = h["a_lo"] + i * h["f_lo"].bitwiseOR(F.lit(1))
    high = (h["a"] + i * h["f"] + F.shiftright(low, 32)).bitwiseAND(F.lit(_MASK))
    low = low.bitwiseAND(F.lit(_MASK))
    upper = ((high % bits) * 65536 + F.shiftright(low, 16)) % bits
    return (upper * 65536 + low.bitwiseAND(F.lit(0xFFFF))) % bits
