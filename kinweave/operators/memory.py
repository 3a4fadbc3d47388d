"""What is on record of people and companies, as a viewer may read it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.functions.text import norm_org
from kinweave.operators.resolve import overlay

SECTION = 10


def seen_mentions(documents: DataFrame, mentions: DataFrame, layers: list[str]) -> DataFrame:
    """Mentions in documents of some layers."""
    return mentions.join(documents.where(F.col("owner").isin(layers)).select(F.col("id").alias("document_id")), "document_id", "left_semi")


def visible(known: DataFrame, documents: DataFrame, mentions: DataFrame, layers: list[str], hide: bool = True) -> DataFrame:
    """Entities that some mention in the viewer's layers tells of; all of them if private ones aren't hidden."""
    return known.join(seen_mentions(documents, mentions, layers), "entity_id", "left_semi") if hide else known


def search(known: DataFrame, private: DataFrame, text: str, viewer: str | None, limit: int = 25) -> DataFrame:
    """Entities whose name, addresses or organisations hold a text (% and _ are wildcards), or what the viewer's own documents say."""
    like = f"%{text.lower()}%"
    own = private.where((F.col("owner") == F.lit(viewer)) & F.lower("value").like(like)).select("entity_id", F.lit(True).alias("own")).distinct()
    listed = lambda c: F.lower(F.to_json(c)).like(like)
    e = known.join(own, "entity_id", "left")
    hit = F.lower("name").like(like) | listed("emails") | listed("orgs") | F.coalesce("own", F.lit(False))
    return overlay(e.where(hit).drop("own"), private, viewer).orderBy("name", "entity_id").limit(limit)


def resolve_ref(found: DataFrame, direct: DataFrame) -> DataFrame:
    """(entity_id, name, orgs, sure): the entity with that id, else what a search found; one row is sure, more are candidates."""
    by_id = direct.select("entity_id", "name", "orgs", F.lit(True).alias("sure"))
    one = F.lit(1).alias("one")
    others = found.select("entity_id", "name", "orgs", one).join(direct.select(one).limit(1), "one", "left_anti")
    alone = F.count(F.lit(1)).over(W.partitionBy("one")) == 1  # of the few rows that a search gives
    return by_id.unionByName(others.select("entity_id", "name", "orgs", alone.alias("sure")))


def documents_of(documents: DataFrame, mentions: DataFrame, who, layers: list[str], limit: int = SECTION) -> DataFrame:
    """The newest documents of an entity in the viewer's layers; undated last."""
    of = mentions.where(F.col("entity_id") == F.lit(who)).select(F.col("document_id").alias("id")).distinct()
    d = documents.where(F.col("owner").isin(layers)).join(of, "id", "left_semi")
    return d.orderBy(F.desc_nulls_last("occurred_at"), "id").limit(limit).select("id", "source", "kind", "title", "occurred_at")


def withheld(documents: DataFrame, mentions: DataFrame, layers: list[str]) -> DataFrame:
    """(entity_id, withheld): in how many documents of other layers an entity occurs."""
    foreign = documents.where((F.col("owner") != "") & ~F.col("owner").isin(layers)).select(F.col("id").alias("document_id"))
    return mentions.where("entity_id is not null").join(foreign, "document_id").groupBy("entity_id").agg(F.count_distinct("document_id").alias("withheld"))


def deals_of(deals: DataFrame, documents: DataFrame, names: Column | list[str], layers: list[str]) -> DataFrame:
    """Deals of a company under any of its names, with their documents, the newest first."""
    d = documents.where(F.col("owner").isin(layers)).select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), F.col("source").alias("document_source"), "occurred_at")
    return deals.where(F.col("company_norm").isin(names)).join(d, "document_id").orderBy(F.desc_nulls_last("occurred_at"), "id")


def people_of(known: DataFrame, names: list[str]) -> DataFrame:
    """People whose organisations have one of the names."""
    hit = F.arrays_overlap("orgs", F.array(*map(F.lit, names)))
    return known.where((F.col("kind") == "person") & hit).select("entity_id", "name", "emails").orderBy("name", "entity_id")


def company_names(known: DataFrame, ref: str) -> DataFrame:
    """(entity_id, name, names): of organisations found for a reference the one with just that name, else the first; all it is called."""
    norm = norm_org(F.lit(ref))
    exact = (norm_org(F.col("name")) == norm) | F.array_contains("aliases", norm)
    best = known.where("kind = 'org'").orderBy(F.coalesce(exact, F.lit(False)).desc(), "name", "entity_id").limit(1)
    names = F.array_distinct(F.array_compact(F.concat(F.array(norm, norm_org(F.col("name"))), F.col("aliases"))))
    return best.select("entity_id", "name", names.alias("names"))


def source_breakdown(documents: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """(source, kind, documents, latest) of the viewer's layers."""
    d = documents if layers is None else documents.where(F.col("owner").isin(layers))
    return d.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("documents"), F.max("occurred_at").alias("latest"))


def recent_documents(documents: DataFrame, layers: list[str], limit: int = 12) -> DataFrame:
    d = documents.where(F.col("owner").isin(layers))
    return d.orderBy(F.desc_nulls_last("occurred_at"), "id").limit(limit).select("source", "kind", "title", "occurred_at")


def layer_counts(documents: DataFrame, layers: list[str]) -> DataFrame:
    """One row: documents a viewer may read, and how many are withheld."""
    mine = F.col("owner").isin(layers)
    return documents.agg(F.count_if(mine).alias("documents"), F.count_if(~mine & (F.col("owner") != "")).alias("withheld"))


def counts(documents: DataFrame, mentions: DataFrame, known: DataFrame, decisions: DataFrame, edges: DataFrame, extractions: DataFrame, layers: list[str], hide: bool = True) -> DataFrame:
    """One row of numbers of what a viewer may read; each table is read once."""
    d = documents.withColumn("mine", F.col("owner").isin(layers))
    done = extractions.where("status = 'ok' or attempts >= 3").select(F.col("document_id").alias("id"), F.lit(True).alias("done"))
    a = d.join(done, "id", "left").agg(
        F.count_if("mine").alias("documents"), F.count_if(~F.col("mine") & (F.col("owner") != "")).alias("withheld_documents"),
        F.count_if(F.col("mine") & F.col("body_sha256").isNotNull() & F.col("done").isNull()).alias("pending_extraction"),
    )
    asked = decisions.where("decision = 'queue'").select(F.col("mention_id").alias("id"), F.lit(True).alias("asked"))
    m = seen_mentions(documents, mentions, layers).join(asked, "id", "left")
    b = m.agg(F.count(F.lit(1)).alias("mentions"), F.count_if(F.col("entity_id").isNull()).alias("unresolved_mentions"), F.count_if(F.col("asked").isNotNull()).alias("pending_reviews"), F.count_distinct("entity_id").alias("seen"))
    c = known.agg(F.count(F.lit(1)).alias("all"))
    e = edges.where(F.col("owner").isin(layers)).agg(F.count_distinct(F.struct("a", "b")).alias("edges"))
    row = reduce(lambda x, y: x.join(F.broadcast(y)), [a, b, c, e])  # single rows
    return row.withColumn("entities", F.col("seen") if hide else F.col("all")).drop("seen", "all")


def _lines(title: str, rows: DataFrame, order: list[Column], *parts: Column) -> DataFrame:
    """One row: a title over a list with an item a row; nothing where there are no rows. For tables that have few."""
    line = F.concat(F.lit("* "), F.concat_ws("; ", *parts))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], line.alias("line")))).alias("all"))
    return listed.select(F.when(F.size("all") > 0, F.concat(F.lit(f"\n## {title}\n\n"), F.array_join(F.transform("all", lambda x: x.line), "\n"))).alias("text"))


def markdown(brief: dict[str, DataFrame]) -> DataFrame:
    """One row, ``text``: the tables of a brief as a page, each that has rows under a heading of its own."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    say = lambda label, c: F.concat(F.lit(f"{label} "), c.cast("string"))
    head = brief["entity"].select(F.concat_ws("\n", F.concat(F.lit("# "), "name"), F.nullif(F.concat_ws(", ", "orgs", "emails"), F.lit(""))).alias("text"))
    c, d = brief["connections"], brief["documents"]
    signals = F.array_join(F.transform(F.array_sort(F.map_entries("signals")), lambda s: F.concat_ws(" ", s.value.cast("string"), s.key)), ", ")
    parts = [head, _lines("Knows", c, [-F.col("strength"), F.col("name")], F.col("name"), say("strength", F.format_number("strength", 2)), signals)]
    if "events" in brief:
        e, r = brief["events"], brief["recent_events"]
        parts.append(_lines("Guest of", e, [F.lit(0)], say("events", F.col("events")), say("attended", F.col("attended"))))
        host = F.coalesce(say("asked by", F.col("invited_by")), say("through", F.col("via")))
        parts.append(_lines("Last events", r, [-F.unix_date(F.to_date("event_date")), F.col("event_name")], F.col("event_name"), F.col("event_date"), F.col("tier"), host))
    if "deals" in brief:
        parts.append(_lines("Deals", brief["deals"], [F.col("company"), F.col("id")], F.col("company"), F.col("stage"), F.col("status"), F.col("summary")))
    parts.append(_lines("Documents", d, [-F.unix_micros(F.col("occurred_at").cast("timestamp")), F.col("id")], F.coalesce("title", F.lit("no title")), F.col("source"), day("occurred_at")))
    page = reduce(lambda x, y: x.unionByName(y), [p.withColumn("place", F.lit(i)) for i, p in enumerate(parts)]).where("text is not null")
    return page.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x.text), "\n").alias("text"))
