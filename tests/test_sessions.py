"""Capture sessions in one streaming query: from start to stop, by silence, over restarts."""

import datetime as dt
import os

import pytest

from cratelog.streaming import session

T0 = dt.datetime(2024, 1, 1)


def event(s, kind, seq, minute=0, ports=None, device=None, channel=None, message=None):
    return (s, kind, T0 + dt.timedelta(minutes=minute), seq, ports, None if device is None else ord(device), None if device is None else f"Key {device}", channel, message)


@pytest.fixture
def stateful(spark):
    for k, v in session.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in session.STATE_STORE:
        spark.conf.unset(k)


def test_sessions(stateful, tmp_path):
    spark, source, out, cp = stateful, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    put = lambda rows: spark.createDataFrame(rows, session.EVENTS).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(session.EVENTS).option("maxFilesPerTrigger", 1).parquet(source)
        session.capture_sessions(stream, out, cp, idle="20 minutes").awaitTermination()
        told = {r.session_id: r.status for r in session.statuses(spark, out).collect()}
        return told, {(r.session_id, r.name): r.messages for r in session.saved_tracks(spark, out).collect()}

    put([event(1, "message", 0, 0, None, "A", 0, "early"), event(1, "start", 1, 0, 2), event(1, "message", 3, 1, None, "A", 0, "b"), event(1, "message", 2, 1, None, "A", 0, "a"), event(2, "start", 1, 0, 0), event(2, "message", 2, 1, None, "A", 0, "lost"), event(3, "start", 1, 0, 1)])
    assert run() == ({1: "recording", 2: "failed", 3: "recording"}, {})
    put([event(1, "message", 3, 2, None, "A", 0, "b"), event(1, "message", 4, 2, None, "A", None, "sys"), event(1, "message", 5, 2, None, "B", 1, "c")])
    assert run() == ({1: "recording", 2: "failed", 3: "recording"}, {})  # a restart keeps the state
    put([event(1, "stop", 6, 3), event(1, "message", 7, 3, None, "A", 0, "late"), event(4, "start", 1, 3, 1), event(4, "message", 2, 3, None, "A", 5, "x")])
    tracks = {(1, "Key_A_ch0"): ["a", "b"], (1, "Key_A_chsys"): ["sys"], (1, "Key_B_ch1"): ["c"]}
    assert run() == ({1: "completed", 2: "failed", 3: "recording", 4: "recording"}, tracks)
    batches = {b: sorted(os.listdir(f"{out}/{b}")) for b in os.listdir(out)}
    assert run() == ({1: "completed", 2: "failed", 3: "recording", 4: "recording"}, tracks)  # nothing new: nothing changes
    assert {b: v for b, v in {b: sorted(os.listdir(f"{out}/{b}")) for b in os.listdir(out)}.items() if b in batches} == batches
    put([event(9, "start", 1, 90, 1)])
    put([event(9, "stop", 2, 200)])
    told, found = run()  # silence has completed 3 and 4
    assert told == {1: "completed", 2: "failed", 3: "completed_empty", 4: "completed", 9: "completed_empty"} and found == tracks | {(4, "Key_A_ch5"): ["x"]}


def test_a_repeated_batch_changes_nothing(stateful, tmp_path):
    """A failure after a batch was written: its commit is missing, and the restart writes it again under the same number."""
    spark, source, out, cp = stateful, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    spark.createDataFrame([event(1, "start", 1, 0, 1), event(1, "message", 2, 1, None, "A", 0, "a"), event(1, "stop", 3, 1)], session.EVENTS).coalesce(1).write.parquet(source)
    run = lambda: session.capture_sessions(spark.readStream.schema(session.EVENTS).parquet(source), out, cp).awaitTermination()
    run()
    want = sorted(map(str, session.saved_tracks(spark, out).collect())), sorted(map(str, session.statuses(spark, out).collect()))
    for name in sorted(os.listdir(f"{cp}/commits")):
        os.remove(f"{cp}/commits/{name}")
    run()
    assert (sorted(map(str, session.saved_tracks(spark, out).collect())), sorted(map(str, session.statuses(spark, out).collect()))) == want
    assert session.saved_tracks(spark, out).first().messages == ["a"]
