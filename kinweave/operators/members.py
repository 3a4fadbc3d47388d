"""Members: each has a layer of its own; and the log of what people did."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMBERS = "id string, name string, email string"
AUDIT = "at timestamp, actor string, action string, detail string"


def find(members: DataFrame, ref: str) -> DataFrame:
    """Members with that id, name or address; more than one is an ambiguity that the caller must not guess away."""
    q = (ref or "").strip()
    return members.where((F.col("id") == q) | (F.lower("name") == q.lower()) | (F.lower("email") == q.lower()))


def add(members: DataFrame, name: str, email: str | None) -> DataFrame:
    """Members with one more; a name or address that is taken is an error."""
    name, email = (name or "").strip(), (email or "").strip() or None
    if not name:
        raise ValueError("a member needs a name")
    taken = find(members, name)
    taken = taken.unionByName(find(members, email)) if email else taken
    if not taken.isEmpty():
        raise ValueError(f"a member named {name}, or with that address, exists")
    one = members.sparkSession.createDataFrame([(name, email)], "name string, email string")
    fresh = one.select(F.concat(F.lit("mem_"), F.substring(F.sha1(F.concat_ws("|", F.lower("name"), F.lower("email")).cast("binary")), 1, 20)).alias("id"), "name", "email")
    return members.unionByName(fresh)


def with_counts(members: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, name, email, documents)."""
    n = documents.groupBy(F.col("owner").alias("id")).agg(F.count(F.lit(1)).alias("documents"))
    return members.join(n, "id", "left").fillna({"documents": 0}).orderBy("name", "id")


def drop_layer(documents: DataFrame, mentions: DataFrame, owner: str, share: bool) -> tuple[DataFrame, DataFrame]:
    """Documents and mentions without a member's layer; with ``share`` its documents are everybody's now.

    Entities, evidence and edges are made from these tables, so what was private becomes shared or goes with them.
    """
    if share:
        return documents.withColumn("owner", F.when(F.col("owner") == owner, "").otherwise(F.col("owner"))), mentions
    gone = documents.where(F.col("owner") == owner).select(F.col("id").alias("document_id"))
    return documents.where(F.col("owner") != owner), mentions.join(gone, "document_id", "left_anti").select(*mentions.columns)


def entry(spark, action: str, detail: str, actor: str, now: str) -> DataFrame:
    """One row of the log. Its detail holds ids, never names: all may read it."""
    return spark.createDataFrame([(action, detail, actor)], "action string, detail string, actor string").select(F.lit(now).cast("timestamp").alias("at"), "actor", "action", "detail")


def newest(log: DataFrame, limit: int = 50) -> DataFrame:
    return log.orderBy(F.desc("at"), "action", "detail").limit(limit)
