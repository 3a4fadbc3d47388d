"""The star-schema tables read as documents, mentions, contacts and touches; and the same as SQL.

An order is a document (its kind from the priority, its layer from the status; 'P' is shared), a
line item a mention of a supplier (its role from the return flag), an event a guest's touch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2001-08-01 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    p = F.substring("o_orderpriority", 1, 1)
    kind = F.when(p == "1", "email").when(p == "2", "meeting").when(p == "3", "event").when(p == "4", "note").otherwise("other")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), kind.alias("kind"), F.col("o_orderdate").alias("occurred_at"),
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("owner"), F.col("o_custkey").alias("customer"),
    )


def mentions(spark: SparkSession, sf: str, entity: str = "l_suppkey") -> DataFrame:
    role = F.when(F.col("l_returnflag") == "N", "from").when(F.col("l_returnflag") == "A", "to").otherwise("mentioned")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col(entity).alias("entity_id"), role.alias("role"))


def touches(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    tier = F.when(t == "purchase", "attended").when(t == "click", "rsvp").when(t == "error", "declined").otherwise("invited")
    return table(spark, sf, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("event"), F.date_format("ts", "yyyy-MM-dd").alias("event_date"), F.col("user_id").alias("entity"), tier.alias("tier"),
        F.col("event_id").alias("document_id"), F.col("ts"),
    )


DOCS = """docs AS (SELECT o_orderkey AS id, o_orderdate AS occurred_at, o_custkey AS customer,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'email' WHEN '2' THEN 'meeting' WHEN '3' THEN 'event' WHEN '4' THEN 'note' ELSE 'other' END AS kind,
  CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS owner FROM orders)"""


def roles_sql(entity: str = "l_suppkey") -> str:
    return f"""roles AS (SELECT l_orderkey AS document_id, {entity} AS entity_id,
  max(CASE l_returnflag WHEN 'N' THEN 5 WHEN 'A' THEN 4 ELSE 1 END) AS r FROM lineitem GROUP BY l_orderkey, {entity})"""


def pairs_sql(cap: int = 50, entity: str = "l_suppkey") -> str:
    """CTEs docs, roles, capped, pairs(document_id, owner, a, b, kind, occurred_at, w); w is decayed."""
    return f"""{DOCS}, {roles_sql(entity)},
capped AS (SELECT document_id FROM roles GROUP BY document_id HAVING count(*) <= {cap}),
pairs AS (SELECT d.id AS document_id, d.owner, x.entity_id AS a, y.entity_id AS b, d.kind, d.occurred_at,
  CASE WHEN d.kind = 'email' THEN CASE WHEN x.r >= 4 AND y.r >= 4 THEN 2.5::double ELSE 1.0::double END
       WHEN d.kind = 'meeting' THEN 3.0::double WHEN d.kind = 'event' THEN 2.0::double WHEN d.kind = 'note' THEN 1.5::double ELSE 1.0::double END
  * CASE WHEN x.r = 1 THEN 0.5::double ELSE 1.0::double END * CASE WHEN y.r = 1 THEN 0.5::double ELSE 1.0::double END
  * pow(0.5::double, greatest(0.0::double, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(d.occurred_at)) / 86400000000.0::double) / 180.0::double) AS w
  FROM capped c JOIN docs d ON d.id = c.document_id JOIN roles x ON x.document_id = d.id
  JOIN roles y ON y.document_id = d.id AND x.entity_id < y.entity_id)"""


def edges_sql(cap: int = 50, entity: str = "l_suppkey") -> str:
    return f"""{pairs_sql(cap, entity)},
edges AS (SELECT owner, a, b, sum(w) AS weight, max(occurred_at) AS last_seen, count(*) AS n FROM pairs GROUP BY owner, a, b)"""


VISIBLE = """visible AS (SELECT a, b, sum(weight) AS weight, max(last_seen) AS last_seen, 1 - exp(-sum(weight) / 6.0::double) AS strength
  FROM edges WHERE owner IN ('', 'O') GROUP BY a, b HAVING 1 - exp(-sum(weight) / 6.0::double) > 0.01::double)"""
NEAR = "near AS (SELECT a AS src, b AS dst, strength, weight, last_seen FROM visible UNION ALL SELECT b, a, strength, weight, last_seen FROM visible)"
TOUCHES = """touches AS (SELECT strftime(ts, '%Y-%m-%d') AS event, strftime(ts, '%Y-%m-%d') AS event_date, user_id AS entity, event_id, ts,
  CASE event_type WHEN 'purchase' THEN 'attended' WHEN 'click' THEN 'rsvp' WHEN 'error' THEN 'declined' ELSE 'invited' END AS tier FROM events)"""
