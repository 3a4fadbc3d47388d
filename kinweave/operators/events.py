"""Guests and events: touches are (event, event_date, entity, name, tier), one row a mention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIERS = ["attended", "rsvp", "declined", "invited"]


def show_rate(attended: Column, events: Column) -> Column:
    """attended / events with two decimals, rounded from the exact binary value, ties up."""
    x = attended / events
    tie = (x * 8 == F.floor(x * 8)) & (F.floor(x * 8) % 2 == 1)
    return F.when(tie, F.floor(x * 100 + 0.5) / 100).otherwise(F.format_number(x, 2).cast("double"))


def _tiers() -> list[Column]:
    return [F.count_if(F.col("tier") == t).alias(t) for t in TIERS]


def touches(documents: DataFrame, mentions: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """Touches from documents whose ``raw`` names an event and a tier: one row for each guest-side mention that is resolved.

    (event, event_name, event_date, entity, tier, evidence, host, invited_by, via, attributes, document_id, occurred_at)
    """
    get = lambda path: F.get_json_object("raw", f"$.{path}")
    d = documents.where(F.col("owner").isin(layers)) if layers is not None else documents
    d = d.select(
        F.col("id").alias("document_id"), get("event").alias("event"), get("event_name").alias("event_name"), get("event_date").alias("event_date"), get("tier").alias("tier"),
        get("evidence").alias("evidence"), get("host.name").alias("host"), get("invited_by").alias("invited_by"), get("via").alias("via"), get("attributes").alias("attributes"), "occurred_at",
    ).where("event is not null and tier is not null")
    guests = mentions.where("kind = 'person' and entity_id is not null and role in ('attendee', 'to')").select("document_id", F.col("entity_id").alias("entity"))
    return d.join(guests, "document_id")


def list_events(touches: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Per event and tier the number of different guests, and their sum; ``since`` and ``until`` bound the date."""
    t = touches.where(F.col("event_date") >= since) if since else touches
    t = t.where(F.col("event_date") <= until) if until else t
    per = [F.count_distinct(F.when(F.col("tier") == x, F.col("entity"))).alias(x) for x in TIERS]
    return t.groupBy(*[c for c in ("event", "event_name", "event_date") if c in touches.columns]).agg(*per).withColumn("contacted", sum((F.col(t) for t in TIERS[1:]), F.col(TIERS[0])))


def resolve_event(events: DataFrame, ref: str) -> DataFrame:
    """Events that a slug or name means: those that match exactly if there are any, else those it is a part of. One row is an answer, more are a question."""
    q = (ref or "").strip().lower()
    if not q:
        raise ValueError("give an event slug or name")
    name = F.lower("event_name") if "event_name" in events.columns else F.lower("event")
    rank = F.when((F.lower("event") == q) | (name == q), 0).when(F.contains(name, F.lit(q)) | F.contains(F.lower("event"), F.lit(q)), 1)
    hits = events.withColumn("rank", rank).where("rank is not null")
    best = hits.agg(F.min("rank").alias("rank"))
    return hits.join(F.broadcast(best), "rank").drop("rank").orderBy("event_date", "event")  # one row is broadcast


def event_guests(touches: DataFrame, event, tier: str | None = None) -> DataFrame:
    """Guests of an event by tier, best first."""
    rank = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    t = touches.where(F.col("event") == event)
    t = t.where(F.col("tier") == tier) if tier else t
    more = [c for c in ("host", "invited_by", "via", "attributes") if c in touches.columns]
    return t.select("entity", "tier", rank.alias("rank"), *more).orderBy("rank", "entity")


def tier_counts(guests: DataFrame) -> DataFrame:
    """(tier, guests), also for tiers that nobody reached."""
    every = guests.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    return every.join(guests.groupBy("tier").agg(F.count(F.lit(1)).alias("guests")), "tier", "left").fillna({"guests": 0})


def event_history(touches: DataFrame, who, limit: int = 100) -> DataFrame:
    """What one person was contacted about, newest first; undated last."""
    at = "occurred_at" if "occurred_at" in touches.columns else "ts"
    return touches.where(F.col("entity") == F.lit(who)).orderBy(F.desc_nulls_last(at), "document_id").limit(limit)


def guest_summary(touches: DataFrame) -> DataFrame:
    """Per guest: counts by tier, first and last event, last attended, and the show rate."""
    attended = F.when(F.col("tier") == "attended", F.col("event_date"))
    g = touches.groupBy("entity").agg(
        F.count(F.lit(1)).alias("events"), *_tiers(), F.min("event_date").alias("first_event"), F.max("event_date").alias("last_event"), F.max(attended).alias("last_attended")
    )
    return g.withColumn("show_rate", show_rate(F.col("attended"), F.col("events")))


def guest_league(
    touches: DataFrame, sort: str, since: str | None = None, until: str | None = None, min_events: int = 1, limit: int = 25, leave_out: DataFrame | None = None
) -> DataFrame:
    """League tables; ``lapsed`` needs ``since`` (attended before it, nothing after) and ignores ``until``.

    ``leave_out`` has the ``entity`` of automated senders and of hosts. One aggregation gives all: counts by tier, what was
    before and after ``since``, and the last three events attended.
    """
    if sort == "lapsed" and not since:
        raise ValueError("lapsed needs since")
    t = touches
    if sort != "lapsed":
        t = t.where(F.col("event_date") >= since) if since else t
        t = t.where(F.col("event_date") <= until) if until else t
    if leave_out is not None:
        t = t.join(leave_out.select("entity").distinct(), "entity", "left_anti")
    came = F.col("tier") == "attended"
    name = "event_name" if "event_name" in t.columns else "event"
    recent = F.struct(F.col("event_date").alias("at"), F.col(name).alias("event"))
    g = t.groupBy("entity").agg(
        F.count(F.lit(1)).alias("events"), *_tiers(), F.max("event_date").alias("last_event"), F.max(F.when(came, F.col("event_date"))).alias("last_attended"),
        F.count_if(came & (F.col("event_date") < F.lit(since))).alias("attended_before"), F.count_if(came & (F.col("event_date") >= F.lit(since))).alias("attended_after"),
        F.count_if(F.col("event_date") >= F.lit(since)).alias("contacted_after"),
        F.transform(F.slice(F.sort_array(F.collect_list(F.when(came, recent)), asc=False), 1, 3), lambda r: r.event).alias("recent"),
    ).withColumn("show_rate", show_rate(F.col("attended"), F.col("events")))
    known = {
        "most_attended": (F.col("attended") >= max(1, min_events), [F.desc("attended"), F.desc("events"), F.desc_nulls_last("last_attended")]),
        "never_attended": ((F.col("attended") == 0) & (F.col("events") >= max(2, min_events)), [F.desc("events"), F.desc_nulls_last("last_event")]),
        "most_invited": (F.col("events") >= max(1, min_events), [F.desc("events"), F.desc("attended")]),
        "lapsed": ((F.col("attended_before") >= max(1, min_events)) & (F.col("attended_after") == 0), [F.desc("attended_before"), F.desc_nulls_last("last_attended")]),
        "best_show_rate": ((F.col("events") >= max(2, min_events)) & (F.col("attended") > 0), [F.desc("show_rate"), F.desc("attended")]),
    }
    if sort not in known:
        raise ValueError(f"sort must be one of {', '.join(known)}")
    keep, order = known[sort]
    return g.where(keep).orderBy(*order, "entity").limit(limit)


def hosts(documents: DataFrame) -> DataFrame:
    """(name): who is named as the host of an event."""
    return documents.select(F.get_json_object("raw", "$.host.name").alias("name")).where("name is not null").distinct()
