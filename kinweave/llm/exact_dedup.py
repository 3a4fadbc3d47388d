"""Operator 3: exact deduplication behind a two-pass Bloom filter, all of built-in functions.

Pass 1 counts hits of the texts' hashes in a bit array of bounded size and keeps the positions
that are hit twice. Pass 2 tests every row against them: a row that fails is surely unique and
passes straight through; only the others are shuffled and compared by SHA-256.

Defined cases: a null text counts as empty; of equal texts the largest ``doc_id`` stays (a
null id is smaller than any other); rows that repeat both id and text are one document, of
which one row stays; an empty table gives an empty result; other columns are carried along
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bitset
from .common import settle

ID, SHA, MAYBE, ROW = "__kw_id", "__kw_sha", "__kw_maybe", "__kw_row"


def _sha(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def _judge(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Digests with the flag ``maybe repeated``, the filter, and its bits. One scan of the texts."""
    digests = settle(docs.select(F.col(id_col).alias(ID), _sha(text_col).alias(SHA)), "digests")
    bits = bitset.bits_for(digests.count())
    bitmaps = settle(bitset.repeated(digests, F.xxhash64(SHA), bits), "repeated")
    return bitset.flag(digests, F.xxhash64(SHA), bits, bitmaps, MAYBE), bitmaps, bits


def _groups(flagged: DataFrame) -> DataFrame:
    """Of the possibly repeated texts: which id stays, and how many rows there are.

    It is written, so that a join with it is a stage of its own, in which Spark splits a hot text.
    """
    return settle(flagged.where(MAYBE).groupBy(SHA).agg(F.max(ID).alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")


def exact_dedup_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    flagged, _, _ = _judge(docs, id_col, text_col)
    alone = flagged.where(~F.col(MAYBE)).select(ID, SHA, F.col(ID).alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    shared = flagged.where(MAYBE).select(ID, SHA).join(_groups(flagged), SHA).select(ID, SHA, "keep_id", "group_size")
    return alone.unionByName(shared).select(
        F.col(ID).alias("doc_id"),
        "keep_id",
        "group_size",
        F.col(ID).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex(SHA)).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Unique rows are never shuffled."""
    judged, bitmaps, bits = _judge(docs, id_col, text_col)
    keepers = _groups(judged).select(F.col(SHA).alias("__kw_ks"), F.col("keep_id").alias("__kw_ki"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW), F.col(id_col).alias(ID), _sha(text_col).alias(SHA))
    rows = bitset.flag(rows, F.xxhash64(SHA), bits, bitmaps, MAYBE)
    shared = rows.where(MAYBE).join(keepers, (F.col(SHA) == F.col("__kw_ks")) & F.col(ID).eqNullSafe(F.col("__kw_ki")), "left_semi")
    once = shared.groupBy(SHA, ID).agg(F.first(ROW).alias(ROW))
    return rows.where(~F.col(MAYBE)).select(f"{ROW}.*").unionByName(once.select(f"{ROW}.*"))
