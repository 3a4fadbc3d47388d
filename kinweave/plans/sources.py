"""Given tables written as mailboxes, calendars, contact tables, JSON lines and mail payloads, and read back by the readers of those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave import scratch
from kinweave.functions import mailtext as M
from kinweave.schemas import RECORD
from kinweave.sources import crm, files, mail

from .star import query, table

#: A text is kept whole here; the usual bounds are the reader's parameters.
WHOLE = 1 << 30
TURNS = """turns AS (SELECT coalesce(conv_id, -1) AS conv, coalesce(turn, -1) AS turn, coalesce(role, 'none') AS who, coalesce(text, '') AS text FROM conversations)"""


def _turns(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.coalesce("conv_id", F.lit(-1)).alias("conv"), F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("none")).alias("who"), F.coalesce("text", F.lit("")).alias("text")
    )


def _word(text: Column) -> Column:
    return F.concat(F.lit("=?utf-8?B?"), F.base64(F.encode(text, "UTF-8")), F.lit("?="))


def _head(t: DataFrame) -> dict[str, Column]:
    """Header fields of a turn: who speaks sends, in a name with a comma; the others are a group, one of them in encoded words."""
    text = lambda c: F.col(c).cast("string")
    return {
        "From": F.concat(F.lit('"Roe, '), "who", F.lit('" <'), "who", F.lit("."), text("conv"), F.lit("@x.example>")),
        "To": F.concat(F.lit("Team: "), _word(F.concat(F.lit("Zoë "), text("conv"))), F.lit(" <zoe@y.example>, all"), text("turn"), F.lit("@z.example (All of);")),
        "Subject": F.concat(F.lit("Re: "), _word(F.concat(F.lit("été "), text("turn"))), F.lit(" "), F.lit("=?iso-8859-1?q?_=E0_1+1?=")),
        "Date": F.concat(F.lit("Mon, 5 Jan 2026 "), F.lpad((F.greatest("turn", F.lit(0)) % 24).cast("string"), 2, "0"), F.lit(":30:00 +0100")),
        "Message-ID": F.concat(F.lit("<"), text("conv"), F.lit("."), text("turn"), F.lit("@x.example>")),
    }


def _people(rows: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("people", lambda p: F.concat_ws("|", p.role, F.coalesce(p["name"], F.lit("-")), p.email)), ";")
    return rows.select("external_id", "title", "occurred_at", said.alias("people"), "body")


READ = """conv::varchar || '.' || turn::varchar || '@x.example' AS external_id, 'Re: été ' || turn::varchar || ' à 1+1' AS title,
  strftime(TIMESTAMP '2026-01-04 23:30:00' + (greatest(turn, 0) % 24) * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS occurred_at,
  'from|Roe, ' || who || '|' || who || '.' || conv::varchar || '@x.example;to|Zoë ' || conv::varchar || '|zoe@y.example;to|All of|all' || turn::varchar || '@z.example' AS people"""


def write_mailbox(t: DataFrame, to: str) -> None:
    """A mailbox of turns: bodies as they are, in quoted-printable or, beside an HTML part, in base64."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    head = line("From ", "a@x.example Mon Jan  5 10:00:00 2026\n", *[p for n, v in _head(t).items() for p in (f"{n}: ", F.replace(v, F.lit(", "), F.lit(",\n ")) if n == "To" else v, "\n")])
    raw = F.encode("text", "UTF-8")
    quoted = F.regexp_replace(F.regexp_replace(F.hex(raw), "(..)", "=$1"), "((?:=..){20})", "$1=\n")
    parts = line(
        'Content-Type: multipart/alternative; boundary="b.1"\n\n--b.1\nContent-Type: text/html\n\n<p>', "no", "</p>\n--b.1\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n",
        F.base64(raw), "\n--b.1--",
    )
    plain = (F.col("turn") % 3 == 0) & ~F.col("text").rlike("\r|(?m)^From ")
    body = F.when(plain, line("\n", F.col("text"))).when(F.col("turn") % 3 == 1, line("Content-Type: text/plain; charset=UTF-8\nContent-Transfer-Encoding: quoted-printable\n\n", quoted)).otherwise(parts)
    t.select(F.concat(head, body).alias("value")).write.text(to)


@query(rf"WITH {TURNS} SELECT {READ}, CASE WHEN regexp_matches(text, '[^\x20\x09-\x0D]') THEN text WHEN turn % 3 NOT IN (0, 1) THEN nullif(text, '') END AS body FROM turns")
def mbox_round_trip(spark, sf):
    """Conversations written as a mailbox, a message a turn, and read back by the mailbox reader in small ranges."""
    to = scratch.folder(spark)
    write_mailbox(_turns(spark, sf), to)
    return _people(mail.mbox(spark, to, split=1 << 20, most_raw=WHOLE, most_body=WHOLE))


@query(f"WITH {TURNS} SELECT {READ.replace('Re: été ', 'Re: =?utf-8?B?').replace("turn::varchar || ' à 1+1' AS title", "to_base64(encode('été ' || turn::varchar)) || '?= =?iso-8859-1?q?_=E0_1+1?=' AS title")}, NULL::varchar AS body FROM turns")
def gmail_payloads(spark, sf):
    """Conversations as payloads of a mail service. Its subjects stay as they come, for the service has decoded them."""
    fields = [F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in _head(_turns(spark, sf)).items()]
    return _people(crm.gmail(_turns(spark, sf).select(F.col("conv").cast("string").alias("id"), F.struct(F.array(*fields).alias("headers")).alias("payload"))))


@query(r"""SELECT event_id::varchar AS external_id, event_type || ', a; b' AS title, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS occurred_at, 'attendee|User, ' || user_id::varchar || '|u' || user_id::varchar || '@x.example;attendee|Org|-' AS people,
  props || chr(10) || 'end' AS body FROM events""")
def ics_round_trip(spark, sf):
    """Events written as calendars, with folded lines, alarms and escapes, and read back."""
    user, to = F.col("user_id").cast("string"), scratch.folder(spark)
    safe = lambda c: F.regexp_replace(c, "([,;])", r"\\$1")
    lines = [
        "BEGIN:VEVENT", F.concat(F.lit("UID:"), F.col("event_id").cast("string")), F.concat(F.lit("SUMMARY;LANGUAGE=en:"), safe(F.concat("event_type", F.lit(", a; ")))), " b",
        F.concat(F.lit("DTSTART:"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")), F.concat(F.lit('ATTENDEE;ROLE=REQ-PARTICIPANT;CN="User, '), user, F.lit('":mail')), F.concat(F.lit(" to:u"), user, F.lit("@x.example")),
        "ORGANIZER;CN=Org:urn:x", "BEGIN:VALARM\r\nDESCRIPTION:no\r\nEND:VALARM", F.concat(F.lit("DESCRIPTION:"), safe(F.col("props")), F.lit("\\nend")), "END:VEVENT",
    ]
    table(spark, sf, "events").select(F.concat_ws("\r\n", *[F.lit(x) if isinstance(x, str) else x for x in lines]).alias("value")).write.option("lineSep", "\r\n").text(to)
    rows = mail.ics(spark, to)
    said = F.array_join(F.transform("people", lambda p: F.concat_ws("|", p.role, p["name"], F.coalesce(p.email, F.lit("-")))), ";")
    return rows.select("external_id", "title", "occurred_at", said.alias("people"), "body")


@query(r"""SELECT 'c' || c_custkey::varchar || '@x.example' AS external_id, 'Jo "J" ' || c_name || ', Jr' AS title, 'c' || c_custkey::varchar || '@X.example|' || CASE WHEN c_custkey % 3 = 0 THEN 'd' || c_custkey::varchar || '@y.example|' ELSE '' END AS emails,
  c_mktsegment || ', Ltd' AS org, 'line' || chr(10) || c_mktsegment AS body FROM customer""")
def contacts_round_trip(spark, sf):
    """Customers written as contact tables with quotes, commas and line ends in their fields, and read back."""
    key, to = F.col("c_custkey").cast("string"), scratch.folder(spark)
    t = table(spark, sf, "customer").select(
        F.lit('Jo "J"').alias("First Name"), F.concat("c_name", F.lit(", Jr")).alias("Last Name"), F.concat(F.lit("c"), key, F.lit("@X.example")).alias("E-mail 1 - Value"), F.lit("home").alias("E-mail 1 - Label"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("d"), key, F.lit("@y.example"))).alias("Email"), F.concat("c_mktsegment", F.lit(", Ltd")).alias("Company Name"), F.concat(F.lit("line\n"), "c_mktsegment").alias("Notes"),
    )
    t.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(to)
    rows = files.contacts(spark, to)
    return rows.select("external_id", "title", F.array_join(F.transform("people", lambda p: F.concat(p.email, F.lit("|"))), "").alias("emails"), F.get("orgs", F.lit(0)).alias("org"), "body")


@query("""SELECT o_orderkey::varchar AS external_id, o_orderpriority AS kind, 'Order "' || o_custkey::varchar || '"' AS title, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS occurred_at, o_custkey::varchar AS name,
  CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS owner FROM orders""")
def jsonl_round_trip(spark, sf):
    """Orders written as JSON lines, a record each, and read back."""
    to, none = scratch.folder(spark), F.lit(None)
    person = F.struct(F.col("o_custkey").cast("string").alias("name"), none.cast("string").alias("email"), none.cast("string").alias("org"), none.cast("string").alias("role"))
    made = {
        "source": F.lit("local"), "kind": F.col("o_orderpriority"), "external_id": F.col("o_orderkey"), "title": F.concat(F.lit('Order "'), F.col("o_custkey").cast("string"), F.lit('"')),
        "occurred_at": F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "people": F.array(person), "owner": F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")),
    }
    table(spark, sf, "orders").select(*[made.get(f.name, none).cast(f.dataType).alias(f.name) for f in RECORD.fields]).write.json(to)
    return files.jsonl(spark, to).select("external_id", "kind", "title", "occurred_at", F.get("people", F.lit(0))["name"].alias("name"), "owner")
