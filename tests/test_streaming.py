"""Capture as a stream gives what the batch expressions give."""

from pyspark.sql import functions as F

from cratelog.streaming import capture


def test_capture_and_flush(spark, tmp_path):
    rows = [(1, 1, "Key Lab", 0, 2, "b"), (1, 1, "Key Lab", 0, 1, "a"), (1, 1, "Key Lab", None, 3, "s"), (1, 9, "Other", 0, 4, "x")]
    made = spark.createDataFrame(rows, "session_id long, device_id long, device string, channel int, seq long, message string")
    made.write.parquet(str(tmp_path / "in"))
    active = spark.createDataFrame([(1, 1)], "session_id long, device_id long")
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    capture.capture_to(stream, active, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    devices = spark.createDataFrame([(1, "Key Lab")], "id long, name string")
    got = {r["name"]: r["messages"] for r in capture.flush(spark.read.parquet(str(tmp_path / "log")), 1, devices).collect()}
    assert got == {"Key_Lab_ch0": ["a", "b"], "Key_Lab_chsys": ["s"]}


def test_sessions_as_stream(spark, tmp_path):
    rows = spark.range(6).select((F.col("id") % 2).alias("user_id"), F.timestamp_seconds(F.col("id") * 1000).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    want = {(r[0], r[3]) for r in capture.sessions(rows, "user_id", "ts", "30 minutes").collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = capture.sessions(stream, "user_id", "ts", "30 minutes", "1 minute").writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r[0], r[3]) for r in spark.sql("SELECT * FROM bursts").collect()} == want


def test_audio_and_status(spark):
    chunks = spark.createDataFrame([(1, 2, [3.0]), (1, 1, [1.0, 2.0])], "session_id int, seq int, chunk array<double>")
    assert capture.joined_audio(chunks).first()["audio"] == [1.0, 2.0, 3.0]
    sessions = spark.createDataFrame([(1, "recording"), (2, "recording"), (3, "failed")], "id int, status string")
    files = spark.createDataFrame([(1,)], "capture_session_id int")
    assert {(r.id, r.status) for r in capture.session_status(sessions, files).collect()} == {(1, "completed"), (2, "completed_empty"), (3, "failed")}


def test_recording_to_a_log(spark, tmp_path):
    made = spark.createDataFrame([(1, 2, [3.0]), (1, 1, [1.0, 2.0]), (9, 1, [7.0])], "session_id long, seq int, chunk array<double>")
    made.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    capture.record_to(stream, spark.createDataFrame([(1, 4)], "session_id long, device_id long"), str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert [(r.session_id, r.audio) for r in capture.joined_audio(spark.read.parquet(str(tmp_path / "log"))).collect()] == [(1, [1.0, 2.0, 3.0])]


def test_session_start(spark):
    import pytest

    sessions = spark.createDataFrame([(1, "pending", None), (2, "failed", None)], "id int, status string, start_time string")
    assert [(r.id, r.status, r.start_time) for r in capture.started(sessions, 1, F.lit("now")).orderBy("id").collect()] == [(1, "recording", "now"), (2, "failed", None)]
    with pytest.raises(Exception, match="not pending"):
        capture.started(sessions, 2, F.lit("now")).collect()
