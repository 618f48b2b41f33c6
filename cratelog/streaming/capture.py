"""Capture of MIDI messages and audio chunks: the same expressions over batches and streams.

A stream of messages has session_id, device_id, device, channel (null for system messages), seq and
message; one of audio chunks session_id, seq and chunk. Start and stop are rows of a session table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import sanitize_filename

SYSTEM_CHANNEL = -1


def channel_of(channel: Column) -> Column:
    return F.coalesce(channel, F.lit(SYSTEM_CHANNEL))


def track_name(device: Column, channel: Column) -> Column:
    n = F.when(channel == SYSTEM_CHANNEL, "sys").otherwise(channel.cast("string"))
    return F.concat(sanitize_filename(device), F.lit("_ch"), n)


def tracks(messages: DataFrame, *keys: str) -> DataFrame:
    """(keys, messages): the messages of each key in the order of seq."""
    keys = keys or ("device_id", "channel")
    rows = F.sort_array(F.collect_list(F.struct("seq", "message")))
    return messages.groupBy(*keys).agg(F.transform(rows, lambda m: m["message"]).alias("messages"))


def joined_audio(chunks: DataFrame) -> DataFrame:
    """(session_id, audio): all chunks of a session in the order of seq; sessions without chunk have no row."""
    rows = F.sort_array(F.collect_list(F.struct("seq", "chunk")))
    return chunks.groupBy("session_id").agg(F.flatten(F.transform(rows, lambda c: c["chunk"])).alias("audio"))


def sessions(messages: DataFrame, key: str, at: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, first_at, last_at, messages) of bursts with less than ``gap`` between messages.

    For a stream give ``late``: state is dropped that long after a burst's end.
    """
    rows = messages.withWatermark(at, late) if late else messages
    out = rows.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("messages"))
    return out.select(key, "first_at", "last_at", "messages")


def started(session: DataFrame, session_id: int, now: Column) -> DataFrame:
    """Sessions after one has been started: pending becomes recording from now on; another status fails at run time."""
    own = F.col("id") == session_id
    ready = F.when(F.col("status") == "pending", "recording").otherwise(F.raise_error(F.concat(F.lit("not pending: "), "status")).cast("string"))
    return session.withColumns({"status": F.when(own, ready).otherwise(F.col("status")), "start_time": F.when(own, now).otherwise(F.col("start_time"))})


def session_status(session: DataFrame, files: DataFrame) -> DataFrame:
    """Status after a stop: completed with files, completed_empty without; failed ones stay failed."""
    have = files.select(F.col("capture_session_id").alias("id")).distinct().withColumn("__has", F.lit(True))
    ended = F.when(F.col("status") == "recording", F.when(F.col("__has"), "completed").otherwise("completed_empty")).otherwise(F.col("status"))
    return session.join(have, "id", "left").withColumn("status", ended).drop("__has")


def capture_to(messages: DataFrame, active: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the messages of active sessions to a Parquet log, exactly once.

    active: session_id, device_id of open ports; what comes from elsewhere is ignored. Tracks are
    made of the log when a session stops, so no state grows with a session's length.
    """
    return _append(messages.withColumn("channel", channel_of(F.col("channel"))).join(active, ["session_id", "device_id"]), path, checkpoint, **trigger)


def record_to(chunks: DataFrame, active: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the audio chunks (session_id, seq, chunk) of active sessions to a Parquet log, exactly once; ``joined_audio`` makes takes of it."""
    return _append(chunks.join(active.select("session_id").distinct(), "session_id"), path, checkpoint, **trigger)


def _append(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("session_id").trigger(**(trigger or {"availableNow": True})).start()


def flush(log: DataFrame, session_id: int, devices: DataFrame) -> DataFrame:
    """(capture_session_id, device_id, channel, name, messages): a row for each non-empty track of a known device."""
    own = log.where(F.col("session_id") == session_id)
    named = tracks(own, "session_id", "device_id", "channel").join(devices.select(F.col("id").alias("device_id"), F.col("name").alias("device")), "device_id")
    return named.select(F.col("session_id").alias("capture_session_id"), "device_id", "channel", track_name(F.col("device"), F.col("channel")).alias("name"), "messages")
