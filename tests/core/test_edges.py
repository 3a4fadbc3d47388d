import re

import pytest
from kinweave.operators import edges as E
from kinweave.operators import graph as G
from kinweave.settings import Settings
from pyspark.sql import functions as F

NOW = "2026-08-04 00:00:00"


def test_decay_of_dated_undated_and_future_documents(spark):
    rows = spark.createDataFrame([("2026-08-04",), ("2026-02-05",), ("2030-01-01",), (None,)], "at string").select(F.to_timestamp("at").alias("at"))
    assert [r[0] for r in rows.select(E.decay(F.col("at"), NOW, Settings())).collect()] == pytest.approx([1.0, 0.5, 1.0, 0.7])


def test_aged_edges_equal_those_made_anew(spark):
    docs = spark.createDataFrame([(1, "email", "2026-01-01", ""), (2, "meeting", None, ""), (3, "note", "2025-03-01", "eve"), (4, "email", "2026-09-01", "")], "id int, kind string, at string, owner string")
    docs = docs.withColumn("occurred_at", F.to_timestamp("at"))
    mentions = spark.createDataFrame([(d, e, "to") for d in (1, 2, 3) for e in "abc"] + [(4, "a", "to"), (4, "d", "to")], "document_id int, entity_id string, role string")
    then, later = E.rebuild_edges(docs, mentions, NOW, signals=True), "2027-11-05 06:00:00"
    key = lambda df: {(r.owner, r.a, r.b): (r.weight, r.strength) for r in df.collect()}
    assert {(r.a, r.b) for r in E.ahead(then, NOW).collect()} == {("a", "d")}
    got, want = key(E.edges_at(then, NOW, later)), key(E.rebuild_edges(docs, mentions, later))
    assert got.keys() == want.keys()
    for k in got.keys() - {("", "a", "d")}:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_tasks_grow_with_the_mentions(spark, monkeypatch):
    docs = spark.range(60).selectExpr("id", "'email' AS kind", "timestamp'2026-01-01 00:00:00' AS occurred_at", "'' AS owner")
    mentions = spark.range(240).selectExpr("id % 60 AS document_id", "id % 7 AS entity_id", "'to' AS role")
    read = lambda: sorted(map(str, E.rebuild_edges(docs, mentions, "2026-08-04 00:00:00").collect()))
    before = read()
    monkeypatch.setattr(E, "MENTIONS", 10, raising=False)
    assert E.rebuild_edges(docs, mentions, "2026-08-04 00:00:00").rdd.getNumPartitions() >= 24
    assert len(before) == 21 and [r.split("weight")[0] for r in read()] == [r.split("weight")[0] for r in before]


def test_joins_by_document_grow_with_the_mentions(spark, monkeypatch):
    docs = spark.range(60).selectExpr("id", "'email' AS kind", "timestamp'2026-01-01 00:00:00' AS occurred_at", "'' AS owner")
    mentions = spark.range(240).selectExpr("id % 60 AS document_id", "(id * 7 + id div 60) % 16 AS entity_id", "'to' AS role")
    monkeypatch.setattr(E, "MENTIONS", 10)
    full = E.rebuild_edges(docs, mentions, NOW)
    stale = E.rebuild_edges(docs.where("id < 40"), mentions, NOW).where("a = 3 or b = 3").unionByName(full.where("a <> 3 and b <> 3"))
    key = lambda df: sorted((r.owner, r.a, r.b, r.n, round(r.weight, 9)) for r in df.collect())
    at = "spark.sql.autoBroadcastJoinThreshold"
    small = spark.conf.get(at)
    try:
        spark.conf.set(at, "-1")  # as where neither side is small
        new = E.rebuild_edges_for(stale, docs, mentions, spark.createDataFrame([(3,)], "entity_id long"), NOW)
        plan = new._jdf.queryExecution().executedPlan().toString()
        dealt = {int(n) for n in re.findall(r"hashpartitioning\((?:document_id|id)#\d+L?, (\d+)\)", plan)}
        assert dealt == {24} and key(new) == key(full)
    finally:
        spark.conf.set(at, small)


def test_private_path_reads_the_edges_once(spark):
    read = spark.sparkContext.accumulator(0)

    def weigh(w):
        read.add(1)
        return w

    rows = [("", 1, 2, 9.0), ("", 2, 3, 9.0), ("", 3, 4, 9.0), ("eve", 2, 4, 1.0), ("", 1, 5, 9.0), ("bob", 2, 4, 1.0), ("me", 5, 6, 0.01), ("bob", 5, 6, 1.0)]
    edges = spark.createDataFrame(rows, "owner string, a long, b long, w double").withColumn("weight", F.udf(weigh, "double")("w")).drop("w").withColumn("last_seen", F.lit(NOW).cast("timestamp"))
    steps = [tuple(r) for r in G.private_path(edges, 1, 4, "me").collect()]
    assert steps == [(0, 1, False, None), (1, 2, False, None), (2, 4, True, ["bob", "eve"])]
    assert read.value == len(rows)
    assert G.private_path(edges, 1, 3, "me").count() == G.private_path(edges, 1, 1, "me").count() == G.private_path(edges, 1, 9, "me").count() == 0  # visible as short, oneself, nobody
    assert [tuple(r) for r in G.private_path(edges, 6, 1, "me", max_hops=2).collect()] == [(0, 6, False, None), (1, 5, True, ["bob"]), (2, 1, False, None)]
