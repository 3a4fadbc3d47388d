"""Contact radar, guest tables, senders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave import scratch
from kinweave.operators import events as V
from kinweave.operators import guests as L
from kinweave.operators import radar as R
from kinweave.operators import resolve as P
from kinweave.streaming import alerts as A
from kinweave.streaming import records as C

from .star import DOCS, NOW, TOUCHES, documents, mentions, pairs_sql, query, table, touches

def radar_sql(docs: str, now: str) -> str:
    return f"""WITH {docs}, past AS (SELECT customer, id, occurred_at AS met,
    (epoch_us(occurred_at) - lag(epoch_us(occurred_at)) OVER (PARTITION BY customer ORDER BY occurred_at, id)) / 86400000000.0::double AS gap
    FROM docs WHERE occurred_at <= {now}),
  agg AS (SELECT customer, count(*) AS contacts, max(met) AS last_contact, min(met) AS first_contact, median(gap) AS gap,
    count(*) FILTER (WHERE met > {now} - INTERVAL 90 DAY) AS recent,
    count(*) FILTER (WHERE met <= {now} - INTERVAL 90 DAY AND met > {now} - INTERVAL 180 DAY) AS prior FROM past GROUP BY customer),
  r AS (SELECT *, CAST(floor((epoch_us({now}) - epoch_us(last_contact)) / 86400000000.0::double) AS BIGINT) AS days_since, greatest(gap, 1.0::double) AS cadence,
    (epoch_us(last_contact) - epoch_us(first_contact)) / 86400000000.0::double AS span FROM agg),
  radar AS (SELECT customer, contacts, days_since, floor(cadence * 10 + 0.5::double) / 10 AS cadence_days,
    CAST(greatest(floor(days_since - cadence + 0.5::double), 0) AS BIGINT) AS overdue_by,
    CASE WHEN contacts < 2 OR gap IS NULL OR span < 7 THEN CASE WHEN days_since > 180 THEN 'dormant' ELSE 'new' END
      WHEN days_since / cadence >= 3 THEN 'cold' WHEN days_since / cadence >= 1.5::double THEN 'overdue' WHEN days_since / cadence >= 1 THEN 'due' ELSE 'active' END AS status,
    CASE WHEN recent = 0 AND prior = 0 THEN NULL WHEN recent > prior THEN 'warming' WHEN recent < prior THEN 'cooling' ELSE 'steady' END AS trend FROM r)"""


RADAR = radar_sql(DOCS, f"TIMESTAMP '{NOW}'")


def _radar(spark, sf, now: str = NOW) -> DataFrame:
    d = documents(spark, sf).select("customer", F.col("id").alias("document_id"), F.col("occurred_at").alias("at"))
    return R.contact_radar(d, now, key="customer")


@query(f"{RADAR} SELECT customer, contacts, days_since, cadence_days, overdue_by FROM radar")
def radar_cadence(spark, sf):
    return _radar(spark, sf).select("customer", "contacts", "days_since", "cadence_days", "overdue_by")


@query(f"{RADAR} SELECT customer, status FROM radar")
def radar_status(spark, sf):
    return _radar(spark, sf).select("customer", "status")


@query(f"{RADAR} SELECT customer, trend FROM radar")
def radar_trend(spark, sf):
    return _radar(spark, sf).select("customer", "trend")


@query(f"{RADAR} SELECT status, count(*) AS customers, sum(contacts)::bigint AS contacts FROM radar GROUP BY status")
def radar_summary_counts(spark, sf):
    return _radar(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("customers"), F.sum("contacts").alias("contacts"))


@query(f"""{RADAR} SELECT customer, status, overdue_by FROM radar ORDER BY
  CASE status WHEN 'cold' THEN 0 WHEN 'overdue' THEN 1 WHEN 'due' THEN 2 WHEN 'dormant' THEN 3 WHEN 'new' THEN 4 ELSE 5 END, coalesce(overdue_by, 0) DESC, customer LIMIT 25""")
def radar_most_urgent(spark, sf):
    return R.most_urgent(_radar(spark, sf), 25, "customer").select("customer", "status", "overdue_by")


@query(f"""WITH {DOCS} SELECT customer, count(*) FILTER (WHERE occurred_at <= TIMESTAMP '1998-06-01') AS contacts,
  min(occurred_at) FILTER (WHERE occurred_at > TIMESTAMP '1998-06-01') AS next_scheduled FROM docs GROUP BY customer""")
def radar_next_scheduled(spark, sf):
    return _radar(spark, sf, "1998-06-01 00:00:00").select("customer", "contacts", F.col("next_scheduled").cast("timestamp_ntz").alias("next_scheduled"))


@query(f"""WITH {TOUCHES} SELECT event, event_date, count(DISTINCT entity) FILTER (WHERE tier = 'attended') AS attended,
  count(DISTINCT entity) FILTER (WHERE tier = 'rsvp') AS rsvp, count(DISTINCT entity) FILTER (WHERE tier = 'declined') AS declined,
  count(DISTINCT entity) FILTER (WHERE tier = 'invited') AS invited,
  count(DISTINCT entity) FILTER (WHERE tier = 'attended') + count(DISTINCT entity) FILTER (WHERE tier = 'rsvp')
  + count(DISTINCT entity) FILTER (WHERE tier = 'declined') + count(DISTINCT entity) FILTER (WHERE tier = 'invited') AS contacted FROM touches GROUP BY event, event_date""")
def events_list(spark, sf):
    return V.list_events(touches(spark, sf))


@query(f"""WITH {TOUCHES} SELECT entity, tier, CASE tier WHEN 'attended' THEN 1 WHEN 'rsvp' THEN 2 WHEN 'declined' THEN 3 ELSE 4 END::bigint AS rank
  FROM touches WHERE event = '2024-01-10'""")
def event_guests(spark, sf):
    return V.event_guests(touches(spark, sf), "2024-01-10")


def _stored(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(documents, mentions) of touches as they are stored: the event in ``raw``, the guest as a mention, and its host beside."""
    t = touches(spark, sf)
    host = F.struct(F.concat(F.lit("Host "), (F.col("entity") % 3).cast("string")).alias("name"))
    raw = F.to_json(F.struct("event", F.concat(F.lit("Day of "), "event").alias("event_name"), "event_date", "tier", F.concat(F.lit("from "), "tier").alias("evidence"), host.alias("host")))
    d = t.select(F.col("document_id").alias("id"), F.when(F.col("document_id") % 10 > 0, raw).alias("raw"), F.when(F.col("entity") % 5 == 0, "eve").otherwise("").alias("owner"), F.col("ts").alias("occurred_at"))
    guest = t.select("document_id", F.col("entity").alias("entity_id"), F.lit("person").alias("kind"), F.when(F.col("tier") == "attended", "attendee").otherwise("to").alias("role"))
    return d, guest.unionByName(guest.withColumn("entity_id", F.col("entity_id") + 1_000_000).withColumn("role", F.lit("author")))


@query(f"""WITH {TOUCHES} SELECT event, 'Day of ' || event AS event_name, event_date, tier, 'from ' || tier AS evidence, 'Host ' || (entity % 3)::varchar AS host, event_id AS document_id, entity
  FROM touches WHERE event_id % 10 > 0 AND entity % 5 > 0""")
def stored_touches(spark, sf):
    """Touches read from stored documents: shared ones that name an event, guests and not hosts."""
    return V.touches(*_stored(spark, sf), [""]).select("event", "event_name", "event_date", "tier", "evidence", "host", "document_id", "entity")


@query(f"WITH {TOUCHES} SELECT event, event_date, tier, event_id AS document_id FROM touches WHERE entity = 11 AND event_id % 10 > 0 ORDER BY ts DESC, event_id LIMIT 100")
def event_history(spark, sf):
    return V.event_history(V.touches(*_stored(spark, sf)), 11).select("event", "event_date", "tier", "document_id")


@query("WITH e AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS event FROM events) SELECT event FROM e WHERE event LIKE '%01-1%'")
def event_by_name(spark, sf):
    """A part of a name that several events have is a question."""
    return V.resolve_event(V.list_events(touches(spark, sf)).select("event", "event_date"), " 01-1").select("event")


SUMMARY = f"""WITH {TOUCHES}, g AS (SELECT entity, count(*) AS events, count(*) FILTER (WHERE tier = 'attended') AS attended, count(*) FILTER (WHERE tier = 'rsvp') AS rsvp,
  count(*) FILTER (WHERE tier = 'declined') AS declined, count(*) FILTER (WHERE tier = 'invited') AS invited, min(event_date) AS first_event, max(event_date) AS last_event,
  max(event_date) FILTER (WHERE tier = 'attended') AS last_attended FROM touches {{where}} GROUP BY entity)"""


RATE = """CASE WHEN attended::double / events * 8 = floor(attended::double / events * 8) AND floor(attended::double / events * 8)::BIGINT % 2 = 1 THEN floor(attended::double / events * 100 + 0.5::double) / 100
  ELSE printf('%.2f', attended::double / events)::double END"""


@query(f"{SUMMARY.format(where='')} SELECT entity, events, attended, {RATE} AS show_rate FROM g")
def show_rate(spark, sf):
    return V.guest_summary(touches(spark, sf)).select("entity", "events", "attended", "show_rate")


def _league(spark, sf, sort: str, **how) -> DataFrame:
    return V.guest_league(touches(spark, sf), sort, **how).select("entity", "events", "attended", "last_event", "last_attended")


LEAGUE = "SELECT entity, events, attended, last_event, last_attended FROM g"


@query(f"{SUMMARY.format(where='')} {LEAGUE} WHERE attended >= 1 ORDER BY attended DESC, events DESC, last_attended DESC, entity LIMIT 25")
def league_most_attended(spark, sf):
    return _league(spark, sf, "most_attended")


@query(f"""{SUMMARY.format(where="WHERE event_date >= '2024-01-20' AND event_date <= '2024-01-21'")} {LEAGUE} WHERE attended = 0 AND events >= 2 ORDER BY events DESC, last_event DESC, entity LIMIT 25""")
def league_never_attended(spark, sf):
    return _league(spark, sf, "never_attended", since="2024-01-20", until="2024-01-21")


@query(f"{SUMMARY.format(where='')} {LEAGUE} ORDER BY events DESC, attended DESC, entity LIMIT 25")
def league_most_invited(spark, sf):
    return _league(spark, sf, "most_invited")


@query(f"""{SUMMARY.format(where='')} SELECT g.entity, events, attended, last_event, last_attended FROM g JOIN (SELECT entity,
  count(*) FILTER (WHERE tier = 'attended' AND event_date < '2024-01-27') AS before, count(*) FILTER (WHERE tier = 'attended' AND event_date >= '2024-01-27') AS after
  FROM touches GROUP BY entity) t ON t.entity = g.entity WHERE before >= 1 AND after = 0 ORDER BY before DESC, last_attended DESC, g.entity LIMIT 25""")
def league_lapsed(spark, sf):
    return _league(spark, sf, "lapsed", since="2024-01-27")


@query(f"""{SUMMARY.format(where='')} {LEAGUE} WHERE events >= 30 AND attended > 0
  ORDER BY floor(attended::double / events * 100 + 0.5::double) DESC, attended DESC, entity LIMIT 25""")
def league_best_show_rate(spark, sf):
    return _league(spark, sf, "best_show_rate", min_events=30)


def _entries(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(events, entries) of a CRM: a list a day, an entry a touch; what happened decides which attributes it has."""
    cell = lambda kind, value=None, option=None: F.array(F.struct(F.lit(kind).alias("attribute_type"), F.lit(value).cast("string").alias("value"), F.struct(F.lit(option).cast("string").alias("title")).alias("option"), F.struct(F.lit(None).cast("string").alias("title")).alias("status")))
    values = lambda **k: F.create_map(*[x for n, c in k.items() for x in (F.lit(n), c)])
    t = F.col("event_type")
    v = (
        F.when(t == "purchase", values(attended=cell("checkbox", "true"), rsvp=cell("select", option="Yes"))).when(t == "click", values(attended=cell("checkbox", "false"), rsvp=cell("select", option="Yes +1")))
        .when(t == "error", values(rsvp_status=cell("select", option="Cancelled"), priority=cell("select", option="Yes"))).when(t == "view", values(stage=cell("select", option="Not sent"), invite_sent=cell("date", "2024-01-01")))
        .when(F.col("event_id") % 2 == 0, values(stage=cell("select", option="For review"))).otherwise(values(notes=cell("text", "x")))
    )
    day = F.date_format("ts", "yyyy-MM-dd")
    e = table(spark, sf, "events")
    entries = e.select(day.alias("slug"), F.col("event_id").cast("string").alias("entry_id"), F.lit("people").alias("parent_object"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("parent_record_id"), v.alias("entry_values"))
    lists = e.select(day.alias("list_id"), day.alias("slug"), F.concat(F.lit("Salon · "), F.date_format("ts", "MMM d, yyyy")).alias("name"), F.lit("people").alias("parent_object")).distinct()
    return L.events_from_lists(lists, "2024-01-16 00:00:00"), entries


@query("""SELECT strftime(ts, '%Y-%m-%d') AS slug, 'Salon · ' || strftime(ts, '%b ') || day(ts)::varchar || strftime(ts, ', %Y') AS name, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y-%m-%d') < '2024-01-16' AS past FROM events GROUP BY ALL""")
def events_from_lists(spark, sf):
    """Lists whose names end in a date are events."""
    return _entries(spark, sf)[0].select("slug", "name", "date", "past")


TIER = """CASE event_type WHEN 'purchase' THEN 'attended' WHEN 'click' THEN 'rsvp' WHEN 'error' THEN 'declined' WHEN 'view' THEN 'invited' ELSE CASE WHEN event_id % 2 = 1 AND strftime(ts, '%Y-%m-%d') < '2024-01-16' THEN 'invited' END END"""


@query(f"""SELECT event_id::varchar AS entry_id, {TIER} AS tier, CASE event_type WHEN 'purchase' THEN 'attended=true' WHEN 'click' THEN 'rsvp=Yes +1' WHEN 'error' THEN 'rsvp_status=Cancelled' WHEN 'view' THEN 'invite_sent=2024-01-01'
  ELSE CASE WHEN event_id % 2 = 1 AND strftime(ts, '%Y-%m-%d') < '2024-01-16' THEN 'on the guest list of a past event' END END AS evidence FROM events""")
def tier_classify(spark, sf):
    """The tier that an entry's typed attributes show, and which one said so."""
    events, entries = _entries(spark, sf)
    t = entries.join(events, "slug").withColumn("t", L.classify_tier(F.col("entry_values"), F.col("past")))
    return t.select("entry_id", F.col("t.tier").alias("tier"), F.col("t.evidence").alias("evidence"))


@query(f"""WITH t AS (SELECT strftime(ts, '%Y-%m-%d') AS slug, {TIER} AS tier FROM events WHERE user_id % 4 > 0) SELECT slug, 'attended' AS basis, count(*)::int AS size FROM t WHERE tier = 'attended' GROUP BY slug HAVING count(*) >= 2""")
def event_rooms(spark, sf):
    """Who was in the room of each event, of guests that the CRM knows."""
    events, entries = _entries(spark, sf)
    people = table(spark, sf, "events").where("user_id % 4 > 0").select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("record_id"), F.concat(F.lit("Guest "), F.col("user_id").cast("string")).alias("name"), F.array().cast("array<string>").alias("emails"), F.lit(None).cast("string").alias("org")).distinct()
    touched = L.guest_touches(events, entries, people, table(spark, sf, "region").select(F.lower("r_name").alias("name")), L.hosts("Jo <jo@firm.example>"), "^firm")
    return L.rooms(touched, entries).select("slug", "basis", "size")


@query("""WITH t AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role)
  SELECT conv_id::varchar || ':' || role AS entity_id, CASE WHEN role = 'system' THEN true WHEN role = 'user' AND conv_id % 3 = 0 THEN n >= 3 WHEN role = 'user' THEN n >= 5 ELSE false END AS automated FROM t""")
def automated_broadcasters(spark, sf):
    """Services by name, and addresses that only ever send: in conversations users send, assistants receive."""
    c = table(spark, sf, "conversations")
    who = F.concat_ws(":", F.col("conv_id").cast("string"), "role")
    email = F.when(F.col("role") == "user", F.when(F.col("conv_id") % 3 == 0, "team@a.example").otherwise("ann@a.example"))
    m = c.select(F.col("conv_id").alias("document_id"), who.alias("entity_id"), F.lit("person").alias("kind"), F.when(F.col("role") == "user", "from").otherwise("to").alias("role"), email.alias("norm_email"), F.when(F.col("role") == "system", "Mail daemon").alias("name"))
    d = c.select(F.col("conv_id").alias("id"), F.lit("email").alias("kind"), F.lit("").alias("owner")).distinct()
    return P.automated(d, m).select("entity_id", "automated")


PAIR_RADAR = f"""WITH {pairs_sql()}, met AS (SELECT a, b, document_id, occurred_at FROM pairs WHERE owner IN ('', 'O') AND a % 10 > 0 AND b % 10 > 0),
  past AS (SELECT *, (epoch_us(occurred_at) - lag(epoch_us(occurred_at)) OVER (PARTITION BY a, b ORDER BY occurred_at, document_id)) / 86400000000.0::double AS gap FROM met),
  agg AS (SELECT a, b, count(*) AS contacts, max(occurred_at) AS last, greatest(median(gap), 1.0::double) AS cadence, max(struct_pack(at := occurred_at, d := document_id)).d AS last_document FROM past GROUP BY a, b)"""


@query(f"""{PAIR_RADAR} SELECT a, b, contacts, last_document, CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last)) / 86400000000.0::double) AS BIGINT) AS days_since, floor(cadence * 10 + 0.5::double) / 10 AS cadence_days FROM agg""")
def radar_pairs(spark, sf):
    """The rhythm of every pair of suppliers in what a viewer may read, automated ones left out."""
    m = mentions(spark, sf)
    robots = m.where("entity_id % 10 = 0").select("entity_id")
    r = R.contact_radar(R.pair_contacts(documents(spark, sf), m, ["", "O"], leave_out=robots), NOW, distinct=True)
    return r.select("pair.a", "pair.b", "contacts", "last_document", "days_since", "cadence_days")


@query("""WITH t AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM t)
  SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS touches FROM s GROUP BY user_id, burst""")
def session_bursts(spark, sf):
    """Bursts of contact: touches less than six hours apart; the same operator runs on a stream."""
    t = table(spark, sf, "events").select(F.col("user_id").alias("pair"), F.col("ts").cast("timestamp").alias("at"))
    b = C.bursts(t)
    ended = F.col("session_window.end") - F.expr("interval 6 hours")
    return b.select(F.col("pair").alias("user_id"), F.col("session_window.start").cast("timestamp_ntz").alias("started"), ended.cast("timestamp_ntz").alias("ended"), F.col("contacts").alias("touches"))


@query("""WITH d AS (SELECT user_id, ts, unnest(generate_series(0, 89)) AS k FROM events) SELECT date_trunc('day', ts) - k * INTERVAL 1 DAY AS start, user_id AS pair, count(*) AS contacts FROM d GROUP BY ALL""")
def contact_windows(spark, sf):
    """Contacts in windows of 90 days, a day apart; the same operator runs on a stream."""
    t = table(spark, sf, "events").select(F.col("user_id").alias("pair"), F.col("ts").cast("timestamp").alias("at"))
    return C.contact_counts(t).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "pair", "contacts")


@query(f"""WITH {DOCS} SELECT x.customer, x.id, count(*) AS trailing FROM docs x JOIN docs y ON y.customer = x.customer
  AND y.occurred_at <= x.occurred_at AND y.occurred_at > x.occurred_at - INTERVAL 90 DAY GROUP BY x.customer, x.id""")
def sliding_90d(spark, sf):
    """For each contact, how many the customer had in the 90 days up to it: a range window, no self-join."""
    us = F.unix_micros(F.col("occurred_at").cast("timestamp"))
    w = W.partitionBy("customer").orderBy("us").rangeBetween(-(90 * 86_400_000_000 - 1), 0)
    return documents(spark, sf).withColumn("us", us).select("customer", "id", F.count(F.lit(1)).over(w).alias("trailing"))


HEARD = """docs AS (SELECT event_id AS id, ts AS occurred_at, user_id AS customer FROM events), moment AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 2 DAY AS t FROM events)"""


@query(f"{radar_sql(HEARD, '(SELECT t FROM moment)')} SELECT customer, contacts, days_since, cadence_days, status FROM radar")
def radar_alerts(spark, sf):
    """What a stream of contacts told last of each pair; its time is two days behind the latest contact."""
    schema = table(spark, sf, "events").schema
    heard = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    at = f"{scratch.shared(spark)}/kinweave-alerts-{uuid.uuid4().hex}"
    A.watch(heard.select(F.col("user_id").alias("pair"), F.col("event_id").alias("document_id"), F.col("ts").alias("at")), f"{at}/told", f"{at}/state").awaitTermination()
    told = A.last_told(spark.read.parquet(f"{at}/told")).where("contacts > 0")
    return told.select(F.col("pair").alias("customer"), "contacts", "days_since", "cadence_days", "status")
