"""Fixed-size bit filters as DataFrames, made of built-in functions only.

A filter is a table of (bucket, bitmap): 32,768 bits in each row. Its size is bounded by its
number of bits, so it may be broadcast; more keys than it was sized for only make more false
hits, never a miss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_BUCKET = 32768
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 29


def bits_for(keys: int, per_key: int = 16) -> int:
    """A power of two of at least ``per_key`` bits a key; at most MOST_BITS (64 MB, so a broadcast fits a small driver)."""
    bits = LEAST_BITS
    while bits < keys * per_key and bits < MOST_BITS:
        bits *= 2
    return bits


def slots(key: Column, bits: int) -> list[Column]:
    """The two positions of a 64-bit key."""
    return [F.pmod(key, F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(7)), F.lit(bits))]


def _pack(marked: DataFrame) -> DataFrame:
    """A filter from a table of positions ``slot``."""
    return marked.groupBy(F.floor(F.col("slot") / PER_BUCKET).alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("slot") % PER_BUCKET).alias("bitmap")
    )


def members(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """The filter of all keys of a table."""
    return _pack(keys.select(F.explode(F.array(*slots(key, bits))).alias("slot")))


def repeated(keys: DataFrame, key: Column, bits: int) -> DataFrame:
    """The filter of the keys that may occur more than once: positions hit twice or more."""
    hit = keys.select(F.explode(F.array(*slots(key, bits))).alias("slot")).groupBy("slot").count()
    return _pack(hit.where("count > 1"))


def flag(rows: DataFrame, key: Column, bits: int, bitmaps: DataFrame, name: str) -> DataFrame:
    """Add ``name``: whether the filter may hold the key. No row of ``rows`` is shuffled."""
    columns = rows.columns
    test = F.lit(True)
    for k, slot in enumerate(slots(key, bits)):
        at, bucket, bitmap = f"{name}_at{k}", f"{name}_bucket{k}", f"{name}_bitmap{k}"
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(bucket), F.col("bitmap").alias(bitmap)))
        rows = rows.withColumn(at, slot)
        rows = rows.join(side, F.floor(F.col(at) / PER_BUCKET) == F.col(bucket), "left")
        byte = F.expr(f"substring({bitmap}, cast((`{at}` % {PER_BUCKET}) div 8 as int) + 1, 1)")
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        bit = F.expr(f"cast(`{at}` % 8 as int)")
        test = test & F.coalesce((F.call_function("shiftright", value, bit).bitwiseAND(F.lit(1))) == 1, F.lit(False))
    return rows.select(*[F.col(f"`{c}`") for c in columns], test.alias(name))


def split(rows: DataFrame, key: Column, keys: DataFrame, keys_key: Column, count: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is surely not among ``keys``, and the rest. Key columns are 64-bit."""
    bits = bits_for(count)
    flagged = flag(rows, key, bits, members(keys, keys_key, bits), "__kw_maybe")
    return tuple(flagged.where(c).drop("__kw_maybe") for c in (~F.col("__kw_maybe"), F.col("__kw_maybe")))
