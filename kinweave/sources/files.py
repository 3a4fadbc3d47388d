"""Readers of JSON lines, contact tables and connection exports; each gives a DataFrame of records."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.schemas import PEOPLE, RECORD


#: Where a record stands: its file, the part of it that was read, and its place there.
POSITION = "__kw_position"


def _position() -> Column:
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))


def jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One record a line, blank lines aside, and its position; a line that isn't JSON fails the read."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path).select(*RECORD.names, _position().alias(POSITION))


def bad_line(spark: SparkSession, path: str) -> str | None:
    """"path:line: text" of the first line that isn't JSON; None if all are."""
    lines = spark.read.text(path).select("value", _position().alias("p"), F.trim("value").alias("t"))
    bad = lines.where("t <> ''").where(F.try_parse_json("t").isNull()).orderBy("p").limit(1).collect()
    if not bad:
        return None
    file, start, at = bad[0].p
    before = spark.read.text(path).select(_position().alias("p")).where((F.col("p.file_path") == file) & ((F.col("p.file_block_start") < start) | ((F.col("p.file_block_start") == start) & (F.col("p.at") < at)))).count()
    return f"{file}:{before + 1}: {bad[0].value[:80]}"


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _plain(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def _first(df: DataFrame, *wanted: str) -> Column:
    """The first column with one of the names, exactly or else as a part."""
    plain = {_plain(c): c for c in df.columns}
    hit = next((plain[w] for w in wanted if w in plain), None) or next((c for w in wanted for p, c in plain.items() if w in p), None)
    return F.trim(F.col(f"`{hit}`")) if hit else F.lit(None).cast("string")


def _record(df: DataFrame, **columns: Column) -> DataFrame:
    types = {f.name: f.dataType for f in RECORD.fields}
    return df.select(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def contacts(spark: SparkSession, path: str, source: str = "crm") -> DataFrame:
    """A contact table: one record a row, one person for each address column; first and last name go before a full one."""
    df = _table(spark, path)
    name = F.trim(F.concat_ws(" ", _first(df, "firstname", "givenname"), _first(df, "middlename"), _first(df, "lastname", "familyname")))
    full = next((c for c in df.columns if _plain(c) in ("name", "fullname", "displayname")), None)
    name = F.when(name != "", name).otherwise(F.col(f"`{full}`") if full else F.lit(None))
    mail = [F.col(f"`{c}`") for c in df.columns if "email" in _plain(c) and not re.search("label|type", _plain(c))]
    org = _first(df, "company", "organization", "organisation", "organizationname")
    person = lambda e: F.struct(name.alias("name"), e.cast("string").alias("email"), org.alias("org"), F.lit("mentioned").alias("role"))
    people = F.filter(F.array(*[person(F.when(F.trim(m) != "", F.trim(m))) for m in mail]), lambda p: p.email.isNotNull())
    people = F.when(F.size(people) > 0, people).otherwise(F.array(person(F.lit(None))))
    first = F.coalesce(*[F.when(F.trim(m) != "", F.lower(F.trim(m))) for m in mail], name) if mail else name
    rows = _record(
        df, source=F.lit(source), kind=F.lit("record"), external_id=first, title=name, people=people,
        orgs=F.when(org.isNotNull(), F.array(org)), body=_first(df, "notes", "note"),
    )
    return rows.where("external_id is not null")


def connections(spark: SparkSession, path: str) -> DataFrame:
    """A connections export: a preamble, then a header with first name and connection date."""
    table = spark.read.option("multiLine", True).option("escape", '"').csv(path)  # quoted fields may hold commas and line ends
    found = F.array(*[F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]", "") for c in table.columns])
    head = table.where(F.array_contains(found, "firstname") & F.array_contains(found, "connectedon")).limit(1).collect()
    if not head:  # the preamble may be narrower than the table, and then hides its columns
        width = max(len(next(csv.reader([r[0]]))) for r in spark.read.text(path).limit(10).collect() if r[0])
        schema = ", ".join(f"_c{i} string" for i in range(width))
        table = spark.read.schema(schema).option("multiLine", True).option("escape", '"').csv(path)
        found = F.array(*[F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]", "") for c in table.columns])
        head = table.where(F.array_contains(found, "firstname") & F.array_contains(found, "connectedon")).limit(1).collect()
    if not head:
        raise ValueError(f"{path}: no header with first name and connection date")
    rows = table.select(*[F.col(c).alias(_plain(n)) for c, n in zip(table.columns, head[0]) if n])
    at = F.try_to_timestamp("connectedon", F.lit("d MMM yyyy"))
    rows = rows.where(at.isNotNull())
    name = F.trim(F.concat_ws(" ", "firstname", "lastname"))
    person = F.struct(name.alias("name"), F.when(F.col("emailaddress") != "", F.col("emailaddress")).alias("email"), F.col("company").alias("org"), F.lit("mentioned").alias("role"))
    return _record(
        rows, source=F.lit("linkedin"), kind=F.lit("connection"), external_id=F.coalesce("url", name), title=name,
        occurred_at=F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), people=F.array(person).cast(PEOPLE), orgs=F.when(F.col("company") != "", F.array("company")),
    )
