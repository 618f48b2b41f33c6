"""A capture session from start to stop in one streaming query.

A stream has session_id, kind (start, message, stop), at (timestamp), seq (rising in a session), ports (of a
start: how many devices could be opened), device_id, device, channel (null for system messages) and message. State is kept by
session: its status, and its messages as a list that is only appended to. A stop, or silence of ``idle`` in the events' time, completes
the session and hands its messages on. Each batch is written under its number, so a batch that is repeated after a
failure replaces what it wrote before, and no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .capture import channel_of, track_name

#: What a streaming query of this kind needs of its session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
EVENTS = "session_id long, kind string, at timestamp, seq long, ports int, device_id long, device string, channel int, message string"
#: Rows of a batch: what a session has become (status), or one of its messages.
OUT = "session_id long, status string, at timestamp, seq long, device_id long, device string, channel int, message string"
_HELD = ("seq", "device_id", "device", "channel", "message")
#: The same with the time in microseconds, which no time zone changes on the way through Python.
_OUT_ROW = Row("session_id", "status", "us", *_HELD)


class Session(StatefulProcessor):
    """pending, recording, then completed or completed_empty; failed if no port could be opened. Whatever comes at another time is ignored."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, last long")
        self.held = handle.getListState("messages", "seq long, device_id long, device string, channel int, message string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        was = status = self.status.get()[0] if self.status.exists() else "pending"
        new, last = [], None
        for r in sorted(rows, key=lambda r: (r.seq is None, r.seq)):
            last = r.us
            if r.kind == "start" and status == "pending":
                status = "failed" if r.ports == 0 else "recording"
                yield self._told(key, status, r.us)
            elif r.kind == "message" and status == "recording":
                new.append(tuple(r[c] for c in _HELD))
            elif r.kind == "stop" and status == "recording":
                status = yield from self._ended(key, r.us, was == "recording", new)
                new = []
        if new:
            self.held.appendList(new)
        self.status.update((status, last // 1000))
        if was == "recording":  # else nothing is held or awaited
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
        if status == "recording":
            self.handle.registerTimer(last // 1000 + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.status.exists() and self.status.get()[0] == "recording":
            last = self.status.get()[1]
            status = yield from self._ended(key, last * 1000, True, [])
            self.status.update((status, last))

    def _ended(self, key: tuple, us: int, stored: bool, new: list[tuple]) -> Iterator[Row]:
        """Hand the messages on, those held and the new ones, each seq once; the session's new status."""
        seen: set[int] = set()
        for row in chain(self.held.get() if stored and self.held.exists() else (), new):
            if row[0] not in seen and row[1] is not None:
                seen.add(row[0])
                yield _OUT_ROW(key[0], None, None, *row)
        if stored:
            self.held.clear()
        status = "completed" if seen else "completed_empty"
        yield self._told(key, status, us)
        return status

    def _told(self, key: tuple, status: str, us: int) -> Row:
        return _OUT_ROW(key[0], status, us, None, None, None, None, None)

    def close(self) -> None:
        pass


def capture_sessions(events: DataFrame, folder: str, checkpoint: str, idle: str = "30 minutes", late: str = "1 minute", **trigger) -> StreamingQuery:
    """Run sessions from start to stop and write what becomes of them below a folder, see ``statuses`` and ``saved_tracks``.

    A restart with the same checkpoint goes on where the last batch ended.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = events.select(*[c.split()[0] for c in EVENTS.split(", ")]).withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    told = rows.groupBy("session_id").transformWithState(Session(idle_ms), outputStructType=OUT.replace("at timestamp", "us long"), outputMode="Append", timeMode="EventTime")
    made = told.withColumn("us", F.timestamp_micros("us")).withColumnRenamed("us", "at")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return made.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def _written(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(f"{OUT}, batch long").parquet(folder)


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, status, start_time, end_time) of every session that was started."""
    rows = _written(spark, folder).where("status IS NOT NULL")
    ended = F.col("status").isin("completed", "completed_empty")
    return rows.groupBy("session_id").agg(F.coalesce(F.max(F.when(ended, F.col("status"))), F.max("status")).alias("status"), F.min(F.when(~ended, F.col("at"))).alias("start_time"), F.max(F.when(ended, F.col("at"))).alias("end_time"))


def saved_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, device_id, channel, name, messages): a row for each track of a completed session; its messages in order are one row, as a file is."""
    rows = _written(spark, folder).where("status IS NULL").withColumn("channel", channel_of(F.col("channel")))
    packed = F.transform(F.sort_array(F.collect_list(F.struct("seq", "message"))), lambda m: m["message"])
    return rows.groupBy("session_id", "device_id", "device", "channel").agg(packed.alias("messages")).select("session_id", "device_id", "channel", track_name(F.col("device"), F.col("channel")).alias("name"), "messages")
