"""Operator 8: shards by jump consistent hashing, all of built-in functions.

The key's 64-bit linear congruential sequence drives the jumps (Lamping and Veach, 2014);
going from n to n + 1 shards moves only rows that go into the new shard. Products wrap at 64
bits; as Spark's BIGINT arithmetic raises an error there, the state is kept as two 32-bit
halves.

A row's slot in its shard is its rank by a hash of its id and text. Ranks come from counts of 1,024
hash ranges in each shard, a table of bounded size, plus the rank inside the range, so no task
sorts a whole shard. Equal rows are counted before anything is ranked.

Defined cases: a null text has no bytes (size 1, crc 0); a null id is hashed as 0, an id that
isn't a whole number by its xxhash64; repeated
rows each have a slot of their own; an empty table gives an empty result. Columns of the input
other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The multiplier of the published generator.
MULTIPLIER = 2862933555777941757
RANGES = 1024


def _times(x: str, by: int) -> str:
    """SQL for the low 32 bits of x times a constant; x and the constant have 32 bits."""
    high, low = by >> 16, by & 0xFFFF
    return f"(({x} * {low}L + shiftleft(({x} * {high}L) & 65535L, 16)) & 4294967295L)"


def jump_hash(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard among ``shards``, and among one more."""
    mh, ml = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
    mlh, mll = ml >> 16, ml & 0xFFFF
    low = f"(s.lo * {mll}L + shiftleft((s.lo * {mlh}L) & 65535L, 16) + 1L)"
    hi = f"((shiftright(s.lo * {mlh}L, 16) + shiftright({low}, 32) + {_times('s.lo', mh)} + {_times('s.hi', ml)}) & 4294967295L)"
    step = (
        f"named_struct('hi', {hi}, 'lo', {low} & 4294967295L, 'j', "
        f"cast(floor((s.j + 1) * (2147483648D / cast(shiftright({hi}, 1) + 1 as double))) as bigint), "
        f"'shard', if(s.j < {shards}, s.j, s.shard), 'grown', s.j)"
    )
    text = (
        f"aggregate(sequence(0, {shards}), named_struct('hi', shiftrightunsigned(`__kw_key`, 32), "
        f"'lo', `__kw_key` & 4294967295L, 'j', 0L, 'shard', 0L, 'grown', 0L), "
        f"(s, i) -> if(s.j <= {shards}, {step}, s), "
        "s -> named_struct('shard', cast(s.shard as int), 'grown', cast(s.grown as int)))"
    )
    return F.expr(text)


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    number = docs.select(id_col).dtypes[0][1] in ("tinyint", "smallint", "int", "bigint")
    key = F.col(id_col).cast("long") if number else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.coalesce(key, F.lit(0).cast("long")).alias("__kw_key"),
    )
    rows = rows.groupBy("doc_id", "size", "text_crc32", "__kw_key").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("__kw_jump", jump_hash(F.col("__kw_key"), shards)).withColumn("rank_key", F.xxhash64("__kw_key", "size", "text_crc32"))
    rows = rows.select(
        "doc_id", "size", "text_crc32", "copies", "rank_key",
        F.col("__kw_jump.shard").alias("shard"), F.col("__kw_jump.grown").alias("grown_shard"),
        F.pmod(F.col("rank_key"), F.lit(RANGES)).alias("part"),
    )
    sizes = rows.groupBy("shard", "part").agg(F.sum("copies").alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy("shard", "part").orderBy("rank_key", "doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("first", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    placed = ranked.join(F.broadcast(starts), ["shard", "part"])  # at most shards * RANGES rows
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        F.explode(F.sequence(F.col("start") + F.col("first"), F.col("start") + F.col("first") + F.col("copies") - 1)).alias("slot"),
        "grown_shard",
    )
