"""The stream of changes of status, against the radar over all contacts."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.operators.radar import contact_radar
from kinweave.settings import Settings
from kinweave.streaming import alerts as A
from kinweave.streaming.records import contact_counts

START = datetime(2024, 1, 1)
SCHEMA = "pair string, document_id long, at timestamp"


def contacts(seed: int, pairs: int = 12, days: float = 400) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for p in range(pairs):
        at, rhythm = r.uniform(0, 60), r.choice([0.3, 3, 9, 30, 80])
        while at < days and r.random() > 0.04:
            rows.append((f"p{p}", len(rows), START + timedelta(days=at)))
            at += r.expovariate(1 / rhythm)
    return rows


def rows_of(df):
    return {r.pair: (r.status, r.contacts, r.cadence_days, r.days_since) for r in df.collect()}


@pytest.fixture
def stream(spark, tmp_path):
    def feed(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        A.watch(source, f"{tmp_path}/told", f"{tmp_path}/state").awaitTermination()
        return spark.read.parquet(f"{tmp_path}/told")

    return feed


def test_restarts_and_late_contacts(spark, stream):
    """Two runs over one state; contacts up to two days late count, later ones don't; repeats and nulls count for nothing."""
    rows = sorted(contacts(1), key=lambda r: r[2])
    half = rows[len(rows) // 2][2]
    first, rest = [r for r in rows if r[2] <= half], [r for r in rows if r[2] > half]
    slow = [r for r in first if r[2] > half - timedelta(days=2)][:-1]  # these come with the second run
    told = stream([r for r in first if r not in slow] + first[:3])
    now = half - timedelta(days=2)
    expected = rows_of(contact_radar(spark.createDataFrame(first, SCHEMA), str(now)))
    assert rows_of(A.last_told(told)) == {k: v for k, v in expected.items() if v[1]}
    too_late = [("p0", 10_000, half - timedelta(days=9)), ("late", 10_001, half - timedelta(days=9))]
    told = stream(rest + slow + too_late + [(None, 1, half), ("p1", None, half), ("p1", 2, None)]).cache()
    now = max(r[2] for r in rows) - timedelta(days=2)
    now = now.replace(microsecond=now.microsecond // 1000 * 1000)
    expected = rows_of(contact_radar(spark.createDataFrame(rows, SCHEMA), str(now)))
    got = rows_of(A.last_told(told))
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    fresh = {r.pair for r in told.where(F.col("at") == F.lit(str(now)).cast("timestamp")).collect()}
    assert fresh and all(got[k] == expected[k] for k in fresh)  # figures are those of the moment a status was told
    by_pair = {}
    for r in told.orderBy("at").collect():
        assert r.was == by_pair.get(r.pair) and r.status != r.was
        by_pair[r.pair] = r.status


def test_time_alone_changes_a_status(stream):
    """A pair that falls silent is told of although only others write."""
    weekly = [("quiet", i, START + timedelta(days=7 * i)) for i in range(6)]
    stream(weekly)
    for day in (46, 49, 60):
        told = stream([("other", 100 + day, START + timedelta(days=day))])
    seen = [r.status for r in told.where("pair = 'quiet'").orderBy("at").collect()]
    assert seen == ["active", "due", "overdue", "cold"]


@pytest.mark.parametrize("seed", [2, 3])
def test_standing_is_the_radar(spark, seed):
    rows = contacts(seed, 30)
    s, now = Settings(), datetime(2025, 1, 3, 5)
    expected = {r.pair: r for r in contact_radar(spark.createDataFrame(rows, SCHEMA), str(now), s).collect()}
    us = lambda t: (t - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    for pair, e in expected.items():
        times = np.array(sorted(us(r[2]) for r in rows if r[0] == pair))
        told, then = A.standing(times, us(now), s)
        assert (told["status"], told["contacts"], told["days_since"], told["cadence_days"]) == (e.status, e.contacts, e.days_since, e.cadence_days)
        # nothing changes before the next moment that was named, and after the last nothing ever does
        for later in ([then - 1] if then else [us(now) + k * A.DAY for k in (1, 100, 5_000)]):
            assert A.standing(times, later, s)[0]["status"] == told["status"]


def test_no_contacts(spark):
    assert A.standing(np.empty(0, np.int64), 0, Settings()) == ({"status": "new", "contacts": 0, "last_contact": None, "cadence_days": None, "days_since": None}, None)


def test_panes_are_sliding_windows(spark, tmp_path):
    """Counts of days summed are the windows themselves, gaps of more than 90 days and dates before 1970 included."""
    rows = contacts(4, 5, 300) + [("p0", 9_000, START + timedelta(days=700)), ("old", 9_001, datetime(1969, 12, 31, 23)), ("old", 9_002, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = df.groupBy(F.window("at", "90 days", "1 day"), "pair").agg(F.count(F.lit(1)).alias("contacts"))
    take = lambda d: sorted((r.pair, r.window.start, r.window.end, r.contacts) for r in d.collect())
    assert take(contact_counts(df)) == take(plain.where("window is not null"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = contact_counts(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    closed = datetime(2024, 1, 1) + timedelta(days=698)
    got = take(spark.read.parquet(f"{tmp_path}/out"))
    assert got and set(got) <= set(take(plain)) and {g for g in take(plain) if g[2] < closed and g[0] != "old"} <= set(got)  # a stream's time begins in 1970
