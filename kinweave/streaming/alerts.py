"""Alerts when a relationship's status changes, as contacts arrive and as time passes without any."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from kinweave.operators.radar import LEAST_CADENCE, LEAST_SPAN
from kinweave.settings import Settings

DAY = 86_400_000_000  # microseconds
ALERT = "at timestamp, was string, status string, contacts bigint, last_contact timestamp, cadence_days double, days_since bigint"
STATE = "contacts binary, status string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def standing(times: np.ndarray, now: int, s: Settings) -> tuple[dict, int | None]:
    """What ``contact_radar`` says of a pair at ``now``, and the next moment at which time alone, or a contact that is already known, can change it.

    ``times`` are sorted microseconds; later ones than ``now`` haven't happened yet.
    """
    n = int(np.searchsorted(times, now, "right"))
    due = [int(times[n])] if n < len(times) else []
    if n == 0:
        return {"status": "new", "contacts": 0, "last_contact": None, "cadence_days": None, "days_since": None}, min(due, default=None)
    last = int(times[n - 1])
    days = (now - last) // DAY
    cadence = max(float(np.median(np.diff(times[:n]) / DAY)), LEAST_CADENCE) if n > 1 else LEAST_CADENCE
    if n < 2 or (last - int(times[0])) / DAY < LEAST_SPAN:
        status, steps = ("dormant" if days > s.dormant_days else "new"), [int(np.floor(s.dormant_days)) + 1]
    else:
        bounds = [("cold", s.cold_ratio), ("overdue", s.overdue_ratio), ("due", 1.0)]
        status = next((name for name, ratio in bounds if days / cadence >= ratio), "active")
        about = [int(np.floor(ratio * cadence)) for _, ratio in bounds]
        steps = [next(d for d in range(max(a - 1, 0), a + 3) if d / cadence >= ratio) for a, (_, ratio) in zip(about, bounds)]
    due += [last + d * DAY for d in steps if d > days]
    told = {"status": status, "contacts": n, "last_contact": last, "cadence_days": float(np.floor(cadence * 10 + 0.5) / 10), "days_since": days}
    return told, min(due, default=None)


class _Watch(StatefulProcessor):
    """Keeps the contacts of a pair, 16 bytes each, and what was last told; one timer stands at the next moment that matters."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("contacts", STATE)

    def _kept(self) -> tuple[np.ndarray, str | None]:
        row = self.state.get()
        return (np.frombuffer(bytes(row[0]), np.int64).reshape(-1, 2), row[1]) if row else (np.empty((0, 2), np.int64), None)

    def _tell(self, key: tuple, contacts: np.ndarray, was: str | None, watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Settle a pair as of the watermark: a row if its status is another, the state, and the timer."""
        now = watermark_ms * 1000
        told, then = standing(contacts[:, 0], now, self.settings)
        status = told["status"] if told["contacts"] else was  # before the first contact there is nothing to tell
        self.state.update((contacts.tobytes(), status))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if then is not None:
            self.handle.registerTimer(-(-then // 1000))
        if status != was:
            row = {"pair": key[0], "at": now, "was": was, **told}
            out = pd.DataFrame([row]).astype({"contacts": "int64", "days_since": "Int64", "cadence_days": "float64"})
            for c in ("at", "last_contact"):
                out[c] = pd.to_datetime(out[c], unit="us", utc=True)
            yield out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        contacts, was = self._kept()
        fresh = [r[["us", "document"]].to_numpy(np.int64) for r in rows]
        yield from self._tell(key, np.unique(np.concatenate([contacts, *fresh]), axis=0), was, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        contacts, was = self._kept()
        yield from self._tell(key, contacts, was, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def status_changes(contacts: DataFrame, late: str = "2 days", s: Settings = Settings()) -> DataFrame:
    """A stream of (pair, at, was, status, ...) from a stream of (pair, document_id, at): one row whenever a pair's status is another than the one last told.

    Time is the watermark, which is ``late`` behind the latest contact: a contact beyond it hasn't happened yet, one that
    comes later than it allows, or dates from before 1970, is left out, and a pair's last row says what ``contact_radar`` says with the watermark as
    ``now``. A document counts once. Nulls in ``pair``, ``document_id`` or ``at`` are no contacts. Changes that fall
    between two batches are told as one. A pair's contacts lie in one state, 16 bytes each, rewritten when one arrives;
    it needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass`` = ``PROVIDER``).
    """
    at = F.col("at").cast("timestamp")
    rows = contacts.where("pair is not null and document_id is not null and at is not null").select("pair", at.alias("at"), F.unix_micros(at).alias("us"), F.xxhash64("document_id").alias("document"))
    kind = rows.schema["pair"].dataType
    out = StructType([StructField("pair", kind), *StructType.fromDDL(ALERT).fields])
    assert rows.schema["document"].dataType == LongType()
    return rows.withWatermark("at", late).groupBy("pair").transformWithStateInPandas(_Watch(s), out, "append", "eventtime")


def last_told(alerts: DataFrame) -> DataFrame:
    """What stands now: the last row of each pair."""
    rest = [c for c in alerts.columns if c != "pair"]
    return alerts.groupBy("pair").agg(F.max_by(F.struct(*rest), "at").alias("r")).select("pair", "r.*")


def watch(contacts: DataFrame, path: str, checkpoint: str, late: str = "2 days", s: Settings = Settings()) -> StreamingQuery:
    """Append the changes that what has arrived brings to a Parquet table, each once even if a batch is tried again."""
    spark, key = contacts.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)  # a query keeps the settings that it starts with
    try:
        out = status_changes(contacts, late, s).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return out.trigger(availableNow=True).start()
    finally:
        spark.conf.set(key, before)
