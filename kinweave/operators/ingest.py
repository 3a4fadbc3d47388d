"""From incoming records to documents and mentions, again and again with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.functions.text import document_id, norm_email, norm_org, norm_person

LEAST_BODY = 40


def last_wins(rows: DataFrame, key: list[str], order: list[str], carry: str | None = None) -> DataFrame:
    """The last row of each key; ``carry`` keeps its last value that isn't null."""
    w = W.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    if carry:
        every = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        rows = rows.withColumn(carry, F.last(carry, ignorenulls=True).over(every))
    return rows.withColumn("__kw_place", F.row_number().over(w)).where("__kw_place = 1").drop("__kw_place")


def upsert(old: DataFrame, new: DataFrame, key: str, keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones of the same key; ``keep_if_null`` columns keep the old value where the new is null."""
    o = old.select(F.col(key), F.struct(*[c for c in old.columns]).alias("o"))
    n = new.select(F.col(key), F.struct(*[c for c in old.columns]).alias("n"))
    both = o.join(n, key, "full_outer")
    pick = [
        F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in keep_if_null else F.col(f"n.{c}")).alias(c)
        for c in old.columns
    ]
    return both.select(*pick)


def drop_stale(old: DataFrame, fresh: DataFrame, scope: str, key: str) -> DataFrame:
    """Old rows without those that belong to a reread ``scope`` but came up no more."""
    reread = fresh.select(scope).distinct().withColumn("__kw_reread", F.lit(True))
    known = fresh.select(key).distinct().withColumn("__kw_known", F.lit(True))
    marked = old.join(reread, scope, "left").join(known, key, "left")
    return marked.where(F.col("__kw_reread").isNull() | F.col("__kw_known").isNotNull()).select(*old.columns)


def normalise(records: DataFrame, position: str = "__kw_position") -> tuple[DataFrame, DataFrame]:
    """(documents, mentions) of a batch of records; of records with the same id the last counts.

    ``position`` says which is the last (readers of files add it). Records without one are put in an order of their
    own, by date and content, so the result doesn't depend on how they are dealt over tasks.
    """
    if position not in records.columns:
        records = records.withColumn(position, F.struct("occurred_at", F.to_json(F.struct(*records.columns))))
    did = document_id(F.col("source"), F.col("external_id"), F.col("kind"), F.col("title"), F.col("occurred_at"), F.col("owner"))
    body = F.when(F.length("body") >= LEAST_BODY, F.col("body"))
    rows = last_wins(records.withColumn("id", did).withColumn("body", body), ["id"], [position], "body")
    documents = rows.select(
        "id", "source", "kind", "external_id", "title", F.try_to_timestamp("occurred_at").alias("occurred_at"), "raw", "body",
        F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"), F.coalesce("owner", F.lit("")).alias("owner"),
    )
    people = rows.select("id", F.posexplode("people").alias("pos", "p")).select(
        F.col("id").alias("document_id"), "pos", F.lit("person").alias("kind"), F.col("p.name").alias("name"), F.col("p.email").alias("email"),
        F.col("p.org").alias("org_hint"), F.coalesce("p.role", F.lit("mentioned")).alias("role"),
        norm_person(F.col("p.name")).alias("norm_name"), norm_email(F.col("p.email")).alias("norm_email"),
    )
    orgs = rows.select("id", F.posexplode("orgs").alias("pos", "o")).select(
        F.col("id").alias("document_id"), (F.col("pos") + 1_000_000).alias("pos"), F.lit("org").alias("kind"), F.col("o").alias("name"), F.lit(None).cast("string").alias("email"),
        F.lit(None).cast("string").alias("org_hint"), F.lit("mentioned").alias("role"), norm_org(F.col("o")).alias("norm_name"), F.lit(None).cast("string").alias("norm_email"),
    )
    both = people.unionByName(orgs)
    same = W.partitionBy("document_id", "kind", "role", "norm_email", "norm_name").orderBy("pos")
    both = both.withColumn("ordinal", F.row_number().over(same) - 1)
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    key = F.concat(F.concat_ws(":", "document_id", "kind", "role", F.concat(e("norm_email"), F.lit("|"), e("norm_name"))), F.lit("#"), F.col("ordinal").cast("string"))
    mentions = both.select(
        F.concat(F.lit("men_"), F.substring(F.sha1(key.cast("binary")), 1, 20)).alias("id"), "document_id", "kind", "name", "email", "org_hint", "role",
        "norm_name", "norm_email", F.lit(None).cast("string").alias("entity_id"), F.lit("structured").alias("origin"),
        F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("context"),
    )
    return documents, mentions


def ingest(documents: DataFrame, mentions: DataFrame, records: DataFrame, bodies: bool = True) -> tuple[DataFrame, DataFrame]:
    """The stored tables with a batch of records taken in. Resolved mentions stay resolved.

    Without ``bodies`` none is kept of the documents that come in, and what was kept of them goes.
    """
    d, m = normalise(records)
    if not bodies:
        none = F.lit(None).cast("string")
        m = m.where("origin = 'structured'")
        return upsert(documents, d.withColumns({"body": none, "body_sha256": none}), "id"), _with_mentions(mentions, m)
    return upsert(documents, d, "id", ("body", "body_sha256")), _with_mentions(mentions, m)


def _with_mentions(mentions: DataFrame, m: DataFrame) -> DataFrame:
    stay = drop_stale(mentions.where("origin = 'structured'"), m, "document_id", "id").unionByName(mentions.where("origin <> 'structured'"))
    return upsert(stay, m, "id", ("entity_id",))
