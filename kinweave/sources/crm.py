"""Payloads of CRMs, note takers and mail, calendar and drive services, saved as JSON lines or documents, as RECORDs. No network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import mailtext
from kinweave.schemas import PEOPLE, RECORD

_ID = "struct<record_id: string>"
COMPANIES = f"id {_ID}, created_at string, values struct<name: array<struct<value: string, full_name: string>>, created_at: array<struct<value: string>>>"
PERSONS = (
    f"id {_ID}, created_at string, values struct<name: array<struct<full_name: string, first_name: string, last_name: string>>, "
    "email_addresses: array<struct<email_address: string, value: string, original_email_address: string>>, company: array<struct<target_record_id: string>>, created_at: array<struct<value: string>>>"
)
NOTES = "id struct<note_id: string>, parent_record_id string, title string, created_at string"
AFFINITY = {
    "organizations": "id long, name string, domain string",
    "persons": "id long, first_name string, last_name string, primary_email string, emails array<string>, organization_ids array<long>",
    "notes": "id long, person_ids array<long>, created_at string",
}
_PERSON = "name: string, displayName: string, display_name: string, email: string"
_MEETING = (
    f"id: string, document_id: string, title: string, name: string, created_at: string, createdAt: string, start_timestamp: string, people: string, "
    f"google_calendar_event: struct<attendees: array<struct<{_PERSON}>>>"
)
MESSAGES = "id string, payload struct<headers: array<struct<name: string, value: string>>>"
CALENDAR = "id string, summary string, start struct<dateTime: string, date: string>, attendees array<struct<displayName: string, email: string>>, organizer struct<displayName: string, email: string>"
DRIVE = (
    "id string, name string, createdTime string, modifiedTime string, owners array<struct<displayName: string, emailAddress: string>>, "
    "lastModifyingUser struct<displayName: string, emailAddress: string>, permissions array<struct<displayName: string, emailAddress: string>>"
)


def _records(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RECORD.fields])


def _iso(text: Column) -> Column:
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _person(name: Column, email: Column, role: str, org: Column | None = None) -> Column:
    return F.struct(name.cast("string").alias("name"), email.cast("string").alias("email"), (F.lit(None) if org is None else org).cast("string").alias("org"), F.lit(role).alias("role"))


def _each_address(name: Column, emails: Column, org: Column) -> Column:
    """One person for each address, or one without."""
    return F.when(F.size(emails) > 0, F.transform(emails, lambda e: _person(name, e, "mentioned", org))).otherwise(F.array(_person(name, F.lit(None), "mentioned", org)))


def _first(array: Column) -> Column:
    return F.get(F.filter(array, lambda x: F.coalesce(x, F.lit("")) != ""), F.lit(0))


def _joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]), F.lit(""))


def _with_org(people: DataFrame, ids: str, companies: DataFrame) -> DataFrame:
    """People (key, name, emails, ids, ...) with ``org``, the name of the first of their companies that is known."""
    found = people.select("key", F.posexplode(ids).alias("pos", "company_id")).join(companies.select("company_id", F.col("name").alias("company")), "company_id")
    found = found.groupBy("key").agg(F.min_by("company", "pos").alias("org"))
    return people.join(found, "key", "left")


def attio_companies(rows: DataFrame) -> DataFrame:
    """(company_id, name, at) of COMPANIES rows that have a name."""
    name = _first(F.transform("values.name", lambda c: F.coalesce(c.value, c.full_name)))
    return rows.select(F.col("id.record_id").alias("company_id"), name.alias("name"), _iso(F.coalesce("created_at", F.get("values.created_at.value", F.lit(0)))).alias("at")).where("name is not null")


def attio_people(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """(record_id, name, emails, org, at) of PERSONS rows that have a name or an address."""
    name = _first(F.transform("values.name", lambda c: F.coalesce(F.nullif(c.full_name, F.lit("")), _joined(c.first_name, c.last_name))))
    emails = F.filter(F.transform("values.email_addresses", lambda c: F.coalesce(c.email_address, c.value, c.original_email_address)), lambda e: F.contains(e, F.lit("@")))
    at = _iso(F.coalesce("created_at", F.get("values.created_at.value", F.lit(0))))
    p = rows.select(F.col("id.record_id").alias("key"), name.alias("name"), F.coalesce(emails, F.array().cast("array<string>")).alias("emails"), F.col("values.company.target_record_id").alias("ids"), at.alias("at"))
    p = _with_org(p.where("name is not null or size(emails) > 0"), "ids", companies)
    return p.select(F.col("key").alias("record_id"), "name", "emails", "org", "at")


def attio_records(companies: DataFrame, people: DataFrame) -> DataFrame:
    """RECORDs of companies and contacts, as ``attio_companies`` and ``attio_people`` give them."""
    c = _records(
        companies, source=F.lit("attio"), kind=F.lit("record"), external_id=F.concat(F.lit("attio-company-"), "company_id"), title=F.concat(F.lit("Company: "), "name"), occurred_at=F.col("at"),
        people=F.array().cast(PEOPLE), orgs=F.array("name"),
    )
    p = _records(
        people, source=F.lit("attio"), kind=F.lit("record"), external_id=F.concat(F.lit("attio-person-"), "record_id"), title=F.concat(F.lit("Contact: "), F.coalesce("name", F.get("emails", F.lit(0)))),
        occurred_at=F.col("at"), people=_each_address(F.col("name"), F.col("emails"), F.col("org")), orgs=F.array_compact(F.array("org")),
    )
    return c.unionByName(p)


def attio_notes(notes: DataFrame, people: DataFrame) -> DataFrame:
    """RECORDs of NOTES on known people; the text of a note is never read."""
    n = notes.join(people.select(F.col("record_id").alias("parent_record_id"), "name", F.get("emails", F.lit(0)).alias("email")), "parent_record_id")
    return _records(
        n, source=F.lit("attio"), kind=F.lit("note"), external_id=F.concat(F.lit("attio-note-"), "id.note_id"), title=F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled note)")),
        occurred_at=_iso(F.col("created_at")), people=F.array(_person(F.col("name"), F.col("email"), "mentioned")),
    )


def affinity(persons: DataFrame, organizations: DataFrame, notes: DataFrame) -> DataFrame:
    """RECORDs of a CRM's organisations, people and notes; what a note says is never read."""
    o = organizations.where("name <> ''").select(F.col("id").alias("company_id"), "name", "domain")
    orgs = _records(
        o, source=F.lit("affinity"), kind=F.lit("record"), external_id=F.concat(F.lit("affinity-org-"), F.col("company_id").cast("string")), title=F.concat(F.lit("Company: "), "name"),
        people=F.array().cast(PEOPLE), orgs=F.array("name"), raw=F.when(F.col("domain") != "", F.to_json(F.struct("domain"))),
    )
    every = F.array_distinct(F.concat(F.array("primary_email"), F.coalesce("emails", F.array().cast("array<string>"))))
    p = persons.select(F.col("id").alias("key"), _joined(F.col("first_name"), F.col("last_name")).alias("name"), F.filter(every, lambda e: F.contains(e, F.lit("@"))).alias("emails"), "organization_ids")
    p = _with_org(p.where("name is not null or size(emails) > 0"), "organization_ids", o)
    people = _records(
        p, source=F.lit("affinity"), kind=F.lit("record"), external_id=F.concat(F.lit("affinity-person-"), F.col("key").cast("string")), title=F.concat(F.lit("Contact: "), F.coalesce("name", F.get("emails", F.lit(0)))),
        people=_each_address(F.col("name"), F.col("emails"), F.col("org")), orgs=F.array_compact(F.array("org")),
    )
    n = notes.select("id", "created_at", F.posexplode("person_ids").alias("pos", "key")).join(p.select("key", "name", F.get("emails", F.lit(0)).alias("email")), "key")
    who = F.sort_array(F.collect_list(F.struct("pos", _person(F.col("name"), F.col("email"), "mentioned").alias("p"))))
    n = n.groupBy("id", "created_at").agg(F.transform(who, lambda x: x.p).alias("who"))
    told = _records(
        n, source=F.lit("affinity"), kind=F.lit("note"), external_id=F.concat(F.lit("affinity-note-"), F.col("id").cast("string")), title=F.lit("(CRM note)"), occurred_at=_iso(F.col("created_at")), people=F.col("who"),
    )
    return orgs.unionByName(people).unionByName(told)


def granola(spark: SparkSession, path: str) -> DataFrame:
    """RECORDs of the meetings with attendees in a note taker's cache file; its ``cache`` may be JSON within JSON, ``documents`` a list or a map."""
    raw = spark.read.text(path, wholetext=True).select(F.coalesce(F.get_json_object("value", "$.cache"), F.col("value")).alias("j"))
    state = raw.select(F.coalesce(F.get_json_object("j", "$.state.documents"), F.get_json_object("j", "$.documents")).alias("d"))
    listed = F.from_json("d", f"array<struct<{_MEETING}>>")
    by_id = F.map_values(F.from_json("d", f"map<string, struct<{_MEETING}>>"))
    m = state.select(F.explode(F.when(F.startswith(F.trim("d"), F.lit("[")), listed).otherwise(by_id)).alias("m")).select("m.*")
    several, one = F.from_json("people", f"array<struct<{_PERSON}>>"), F.from_json("people", f"struct<creator: struct<{_PERSON}>, attendees: array<struct<{_PERSON}>>>")
    none = F.array().cast(f"array<struct<{_PERSON}>>")
    people = F.when(F.startswith(F.trim("people"), F.lit("[")), several).otherwise(F.concat(F.array(one.creator), F.coalesce(one.attendees, none)))
    people = F.concat(F.coalesce(people, none), F.coalesce("google_calendar_event.attendees", none))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    people = F.transform(people, lambda p: _person(blank(F.coalesce(p["name"], p.displayName, p.display_name)), blank(p.email), "attendee"))
    people = F.filter(people, lambda p: p["name"].isNotNull() | p.email.isNotNull())
    m = m.withColumns({"people": people}).withColumn("keys", F.transform("people", lambda p: F.lower(F.coalesce(p.email, p["name"]))))
    once = F.filter("people", lambda p, i: F.array_position(F.col("keys"), F.get(F.col("keys"), i)) == i + 1)
    return _records(
        m.where(F.size("people") > 0), source=F.lit("granola"), kind=F.lit("meeting"), external_id=F.coalesce("id", "document_id"), title=F.coalesce("title", "name", F.lit("(untitled meeting)")),
        occurred_at=_iso(F.coalesce("created_at", "createdAt", "start_timestamp")), people=once,
    )


def gmail(rows: DataFrame) -> DataFrame:
    """RECORDs of MESSAGES with their headers, those aside that name no one; who is in From, To and Cc has that role."""

    def field(name: str) -> Column:
        found = F.filter("payload.headers", lambda h: F.lower(h["name"]) == name)
        return F.try_element_at(F.transform(found, lambda h: h.value), F.lit(-1))

    people = F.concat(*[mailtext.address_list(field(role), role) for role in ("from", "to", "cc")])
    blank = lambda c: F.nullif(c, F.lit(""))
    return _records(
        rows.withColumn("people", people).where(F.size("people") > 0), source=F.lit("gmail"), kind=F.lit("email"), external_id=blank(F.regexp_replace(F.coalesce(blank(field("message-id")), F.col("id")), "[<>]", "")),
        title=F.coalesce(blank(field("subject")), F.lit("(no subject)")), occurred_at=mailtext.mail_date(field("date")), people=F.col("people"),
    )


def calendar(rows: DataFrame) -> DataFrame:
    """RECORDs of CALENDAR events; attendees and the organiser attend. A day without a time begins at midnight."""
    every = F.concat(F.coalesce("attendees", F.array().cast("array<struct<displayName: string, email: string>>")), F.array("organizer"))
    people = F.transform(F.filter(every, lambda a: F.coalesce(a.email, F.lit("")) != ""), lambda a: _person(a.displayName, a.email, "attendee"))
    e = rows.withColumn("people", people).where(F.size("people") > 0)
    at = F.coalesce("start.dateTime", F.concat("start.date", F.lit("T00:00:00Z")))
    return _records(e, source=F.lit("calendar"), kind=F.lit("event"), external_id=F.col("id"), title=F.coalesce("summary", F.lit("(untitled event)")), occurred_at=at, people=F.col("people"))


def drive(rows: DataFrame) -> DataFrame:
    """RECORDs of DRIVE files: owners and who changed them last are authors, who may read them is mentioned."""
    none = F.array().cast("array<struct<displayName: string, emailAddress: string>>")
    with_role = lambda a, role: F.transform(a, lambda p: _person(p.displayName, p.emailAddress, role))
    has = lambda a: F.filter(a, lambda p: F.coalesce(p.emailAddress, F.lit("")) != "")
    people = F.concat(with_role(F.coalesce("owners", none), "author"), with_role(has(F.array("lastModifyingUser")), "author"), with_role(has(F.coalesce("permissions", none)), "mentioned"))
    f = rows.withColumn("people", people).where(F.size("people") > 0)
    return _records(f, source=F.lit("drive"), kind=F.lit("doc"), external_id=F.col("id"), title=F.coalesce("name", F.lit("(untitled file)")), occurred_at=F.coalesce("modifiedTime", "createdTime"), people=F.col("people"))
