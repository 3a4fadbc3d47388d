"""Weighted co-occurrence edges: per document all pairs of people, decayed by age, summed per layer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.settings import Settings

#: Mentions for each task that makes pairs or adds them up. A mention gives at most half the cap of pairs, mostly one or two.
MENTIONS = 1 << 17
ROLE_RANK = {"from": 5, "to": 4, "attendee": 4, "author": 3, "cc": 2, "mentioned": 1}


def _by(value: Column, table: dict, other) -> Column:
    return reduce(lambda c, kv: c.when(value == kv[0], kv[1]), table.items(), F.when(F.lit(False), F.lit(other))).otherwise(other)


def decay(occurred_at: Column, now: str, s: Settings) -> Column:
    """Halves every half life; undated documents count a fixed part, future ones in full."""
    micros = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(occurred_at.cast("timestamp"))
    days = F.greatest(F.lit(0.0), micros / F.lit(86_400_000_000.0))
    # greatest passes over nulls, so a date that is missing is asked for itself
    return F.when(occurred_at.isNull(), s.undated_decay).otherwise(F.pow(F.lit(0.5), days / F.lit(float(s.half_life_days))))


def pair_weight(kind: Column, a: Column, b: Column, s: Settings) -> Column:
    """Mail between sender and direct recipients weighs more than copies; being mentioned weighs half."""
    direct = a.isin("from", "to") & b.isin("from", "to")
    known = {k: w for k, w in s.weights.items() if k != "email"}
    base = F.when((kind == "email") & direct, s.weights["email"]).when(kind == "email", s.email_cc).otherwise(_by(kind, known, 1.0))
    damp = lambda r: F.when(r == "mentioned", s.mentioned_factor).otherwise(1.0)
    return base * damp(a) * damp(b)


def strength(weight: Column, s: Settings) -> Column:
    return 1 - F.exp(-weight / F.lit(float(s.saturation)))


def tasks(mentions: DataFrame) -> int:
    """How many tasks mentions are dealt over: what one holds stays the same however many there are. (Left to itself Spark makes few tasks of what is small in a shuffle, and its pairs aren't.)"""
    return max(mentions.sparkSession.sparkContext.defaultParallelism, -(-mentions.count() // MENTIONS))


def participants(mentions: DataFrame, s: Settings, n: int | None = None, dealt: bool = False) -> DataFrame:
    """(document_id, people): distinct people with their strongest role, of documents within the cap; in ``n`` tasks, unless mentions are ``dealt`` by document already.

    Mentions are shuffled once, by document; the role, the count and the list all use that
    partitioning. A mass mail never becomes a list: it is filtered by its count first.
    """
    from pyspark.sql import Window as W

    seen = mentions.where(F.col("entity_id").isNotNull())
    seen = seen if dealt else seen.repartition(n or tasks(mentions), "document_id")
    rank = _by(F.col("role"), ROLE_RANK, 0)
    roles = seen.groupBy("document_id", "entity_id").agg(F.max(F.struct(rank.alias("rank"), F.col("role").alias("role"))).alias("r"))
    roles = roles.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("document_id"))).where(F.col("n").between(2, s.max_participants))
    return roles.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("entity_id", F.col("r.role").alias("role")))).alias("people"))


def pairs(documents: DataFrame, mentions: DataFrame, s: Settings, n: int | None = None, dealt: bool = False) -> DataFrame:
    """(owner, a, b, kind, occurred_at, role_a, role_b), a < b, for each document and pair; dealt by pair over ``n`` tasks, so that whatever is grouped by pairs next isn't shuffled again."""
    n = n or tasks(mentions)
    groups = participants(mentions, s, n, dealt).join(documents.select(F.col("id").alias("document_id"), "kind", "occurred_at", "owner"), "document_id")
    each = F.flatten(
        F.transform("people", lambda x, i: F.transform(F.slice("people", i + 2, F.greatest(F.size("people") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("x"), y.alias("y"))))
    )
    p = groups.select("document_id", "kind", "occurred_at", "owner", F.explode(each).alias("p"))
    return p.select(
        "document_id", "owner", F.col("p.x.entity_id").alias("a"), F.col("p.y.entity_id").alias("b"), "kind", "occurred_at",
        F.col("p.x.role").alias("role_a"), F.col("p.y.role").alias("role_b"),
    ).repartition(n, "a", "b")


def _fold(each: DataFrame, now: str, s: Settings, signals: bool = False) -> DataFrame:
    """Edges from pairs; ``signals`` adds a map of how many documents of each kind a pair shares."""
    w = pair_weight(F.col("kind"), F.col("role_a"), F.col("role_b"), s) * decay(F.col("occurred_at"), now, s)
    still = F.coalesce(F.sum(F.when(F.col("occurred_at").isNull(), w)), F.lit(0.0)).alias("undated")
    pair, total = ["owner", "a", "b"], [F.sum(w).alias("weight"), still, F.max("occurred_at").alias("last_seen"), F.count(F.lit(1)).alias("n")]
    if signals:
        kinds = each.groupBy(*pair, F.coalesce("kind", F.lit("other")).alias("kind")).agg(*total)
        each = kinds.groupBy(*pair).agg(
            F.sum("weight").alias("weight"), F.sum("undated").alias("undated"), F.max("last_seen").alias("last_seen"), F.sum("n").alias("n"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("signals"),
        )
    else:
        each = each.groupBy(*pair).agg(*total)
    value = strength(F.col("weight"), s)
    finite = F.coalesce(F.abs(F.col("weight")) < F.lit(float("inf")), F.lit(False))  # neither NaN nor infinite
    return each.withColumn("strength", F.when(finite, value).otherwise(F.raise_error("an edge's weight isn't finite").cast("double")))


def rebuild_edges(documents: DataFrame, mentions: DataFrame, now: str, s: Settings = Settings(), signals: bool = False) -> DataFrame:
    """All edges (owner, a, b, weight, undated, last_seen, n, strength), with ``signals`` if asked for; ``undated`` is the part of the weight that no time takes away."""
    return _fold(pairs(documents, mentions, s), now, s, signals)


def edges_at(edges: DataFrame, then: str, now: str, s: Settings = Settings()) -> DataFrame:
    """Edges made for the time ``then`` as they are at ``now``, without reading a document: what is dated decays by one factor, what isn't stays.

    That holds for pairs last seen by ``then``; those seen later are still to come (see ``ahead``) and have to be made anew.
    """
    micros = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.lit(then).cast("timestamp"))
    factor = F.pow(F.lit(0.5), micros / F.lit(86_400_000_000.0) / F.lit(float(s.half_life_days)))
    weight = (F.col("weight") - F.col("undated")) * factor + F.col("undated")
    return edges.withColumn("weight", weight).withColumn("strength", strength(F.col("weight"), s))


def ahead(edges: DataFrame, then: str) -> DataFrame:
    """Edges with documents later than ``then``."""
    return edges.where(F.col("last_seen") > F.lit(then).cast("timestamp"))


def edge_signals(documents: DataFrame, mentions: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(owner, a, b, kind, signals): how many documents of each kind a pair shares."""
    return pairs(documents, mentions, s).groupBy("owner", "a", "b", "kind").agg(F.count(F.lit(1)).alias("signals"))


def rebuild_edges_for(edges: DataFrame, documents: DataFrame, mentions: DataFrame, dirty: DataFrame, now: str, s: Settings = Settings()) -> DataFrame:
    """Edges after some entities changed; ``dirty`` has their entity_id.

    Only documents with a dirty participant are read again, and only pairs with one are
    replaced. A document that has just passed the participant cap would change other pairs as
    well; callers then rebuild all (see ``needs_full_rebuild``).
    """
    dirty = dirty.select("entity_id").distinct()
    n = tasks(mentions)  # whatever joins mentions by document is dealt over as many
    touched = mentions.join(dirty, "entity_id", "left_semi").select("document_id").repartition(n, "document_id").distinct()
    some = mentions.repartition(n, "document_id").join(touched, "document_id", "left_semi")
    each = pairs(documents, some, s, n, dealt=True)
    a, b = (dirty.select(F.col("entity_id").alias(c), F.lit(True).alias(f"in_{c}")) for c in "ab")
    mark = lambda df: df.join(a, "a", "left").join(b, "b", "left")
    hit = F.col("in_a").isNotNull() | F.col("in_b").isNotNull()
    fresh = _fold(mark(each).where(hit), now, s, "signals" in edges.columns)
    rest = mark(edges).where(~hit).select(*fresh.columns)
    return rest.unionByName(fresh)


def needs_full_rebuild(mentions: DataFrame, dirty: DataFrame, s: Settings = Settings()) -> bool:
    """Whether a dirty entity is in a document at the participant cap, or one over it."""
    docs = mentions.join(dirty.select("entity_id").distinct(), "entity_id", "left_semi").select("document_id").distinct()
    n = mentions.join(docs, "document_id", "left_semi").groupBy("document_id").agg(F.count_distinct("entity_id").alias("n"))
    return not n.where(F.col("n").between(s.max_participants, s.max_participants + 1)).isEmpty()
