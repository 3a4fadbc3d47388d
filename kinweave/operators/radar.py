"""Which relationships are due, by each pair's own rhythm of contact."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.operators.edges import pairs
from kinweave.settings import Settings

LEAST_CADENCE, LEAST_SPAN = 1.0, 7.0
STATUS_RANK = {"cold": 0, "overdue": 1, "due": 2, "dormant": 3, "new": 4, "active": 5}


def contact_radar(contacts: DataFrame, now: str, s: Settings = Settings(), key: str = "pair", distinct: bool = False) -> DataFrame:
    """One row a key, from (key, document_id, at): contacts, cadence, status, trend, last and next contact.

    A document counts once however often it mentions the pair; ``distinct`` says that it comes once
    anyway, as from ``pair_contacts``, and saves a shuffle. What lies in the future is the next
    contact and nothing else.
    """
    at_now = F.lit(now).cast("timestamp")
    day = F.lit(86_400_000_000.0)
    days = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / day
    once = contacts.where(F.col("at").isNotNull()).select(key, "document_id", F.col("at").cast("timestamp").alias("at"))
    once = once if distinct else once.dropDuplicates([key, "document_id"])
    past = F.col("at") <= at_now
    gap = F.when(past, days(F.col("at"), F.lag(F.when(past, F.col("at"))).over(W.partitionBy(key).orderBy("at", "document_id"))))
    ago = lambda n: F.expr(f"timestamp'{now}' - interval {n} days")
    r = once.withColumn("gap", gap).groupBy(key).agg(
        F.count_if(past).alias("contacts"),
        F.max(F.when(past, F.col("at"))).alias("last_contact"),
        F.min(F.when(past, F.col("at"))).alias("first_contact"),
        F.min(F.when(~past, F.col("at"))).alias("next_scheduled"),
        F.max(F.when(past, F.struct("at", "document_id"))).alias("last"),
        F.expr("percentile(gap, 0.5)").alias("median_gap"),
        F.count_if(past & (F.col("at") > ago(90))).alias("recent"),
        F.count_if((F.col("at") <= ago(90)) & (F.col("at") > ago(180))).alias("prior"),
    )
    cadence = F.greatest(F.col("median_gap"), F.lit(LEAST_CADENCE))
    r = r.withColumn("days_since", F.floor(days(at_now, F.col("last_contact"))).cast("long"))
    span = days(F.col("last_contact"), F.col("first_contact"))
    ratio = F.col("days_since") / cadence
    thin = (F.col("contacts") < 2) | F.col("median_gap").isNull() | (span < LEAST_SPAN)
    status = (
        F.when(F.col("contacts") == 0, "new").when(thin & (F.col("days_since") > s.dormant_days), "dormant").when(thin, "new")
        .when(ratio >= s.cold_ratio, "cold").when(ratio >= s.overdue_ratio, "overdue").when(ratio >= 1, "due").otherwise("active")
    )
    trend = (
        F.when((F.col("recent") == 0) & (F.col("prior") == 0), F.lit(None).cast("string"))
        .when(F.col("recent") > F.col("prior"), "warming").when(F.col("recent") < F.col("prior"), "cooling").otherwise("steady")
    )
    return r.select(
        key, "contacts", "last_contact", F.col("last.document_id").alias("last_document"), "next_scheduled", "days_since",
        (F.floor(cadence * 10 + 0.5) / 10).alias("cadence_days"),
        F.greatest(F.floor(F.col("days_since") - cadence + 0.5), F.lit(0)).cast("long").alias("overdue_by"),
        status.alias("status"), trend.alias("trend"),
    )


def pair_contacts(documents: DataFrame, mentions: DataFrame, viewer_layers: list[str], s: Settings = Settings(), leave_out: DataFrame | None = None) -> DataFrame:
    """(pair, document_id, at) for all pairs of people in visible, dated documents within the cap (over all layers).

    ``leave_out`` has the entity_id of automated senders; they count for the cap, but make no pair.
    """
    seen = documents.where(F.col("owner").isin(viewer_layers) & F.col("occurred_at").isNotNull())
    p = pairs(seen, mentions, s)
    if leave_out is not None:
        for c in "ab":
            p = p.join(leave_out.select(F.col("entity_id").alias(c)).distinct(), c, "left_anti")
    return p.select(F.struct("a", "b").alias("pair"), "document_id", F.col("occurred_at").alias("at"))


def of_person(radar: DataFrame, who) -> DataFrame:
    """The rows of a pair radar that have one person, with ``other``."""
    a, b = F.col("pair.a"), F.col("pair.b")
    return radar.where((a == F.lit(who)) | (b == F.lit(who))).withColumn("other", F.when(a == F.lit(who), b).otherwise(a))


def summary(radar: DataFrame) -> DataFrame:
    """(status, pairs, contacts): how many relationships are in each state."""
    return radar.groupBy("status").agg(F.count(F.lit(1)).alias("pairs"), F.sum("contacts").alias("contacts"))


def most_urgent(radar: DataFrame, limit: int = 25, key: str = "pair") -> DataFrame:
    """The most actionable first: cold, overdue, due; then by how late."""
    rank = F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])[F.col("status")]
    return radar.orderBy(rank, F.desc(F.coalesce("overdue_by", F.lit(0))), key).limit(limit)
