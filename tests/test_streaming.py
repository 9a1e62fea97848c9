"""The tracker on a stream gives what it gives on the whole table."""

import pytest
from pyspark.sql import functions as F

from trackframe.operators.tracker import TrackerConfig, run_tracking, spine
from trackframe.sources import adapters, generators
from trackframe.sources.frames import CameraReader, FrameSource
from trackframe.streaming.live import SPINE, stage_windows, track_stream, write_sessions

CONFIG = TrackerConfig(min_hits=1)


def test_stream_equals_batch(spark, tmp_path):
    frames, det, motion = generators.synthetic_frames(spark, 40, every=2), generators.synthetic_detections(spark, 40, 6), generators.synthetic_motion(spark, 40)
    whole = spine(frames, det, motion).cache()
    for k, (low, high) in enumerate(((0, 15), (10, 30), (30, 40))):  # frames 10 to 14 come twice
        whole.filter(F.col("frame").between(low, high - 1)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(SPINE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = track_stream(stream, CONFIG).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    key = ["frame", "track_id", "missed", "age", F.round("x1", 6).alias("x1")]
    got = spark.read.parquet(str(tmp_path / "out")).select(*key)
    expected = run_tracking(frames, det, motion, CONFIG).select(*key)
    assert got.count() == expected.count() and got.exceptAll(expected).count() == 0


def test_windows_and_sink(spark, tmp_path):
    samples = adapters.samples(spark, "/root/testdata/sf0.001")
    samples.limit(200).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(samples.schema).parquet(str(tmp_path / "in"))
    q = stage_windows(stream).writeStream.format("memory").queryName("stages").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("stages").agg(F.sum("n")).first()[0] == 200
    q = write_sessions(stream, str(tmp_path / "log"), str(tmp_path / "cp2"))
    assert q.awaitTermination(120)
    assert spark.read.option("recursiveFileLookup", "true").text(str(tmp_path / "log")).count() == 200


def test_camera_stream(spark, tmp_path):
    """Frames as they appear; a folder that is away for a while costs a reconnect, and one that stays away an error."""
    spark.dataSource.register(FrameSource)
    folder = tmp_path / "cam"
    reader = CameraReader({"path": str(folder), "attempts": "2", "delay_ms": "1"})
    with pytest.raises(ConnectionError):
        reader.read(reader.initialOffset())
    folder.mkdir()
    for k in range(5):
        (folder / f"{k:03d}.rgb").write_bytes(bytes([k]))
    rows, end = reader.read({"name": "001.rgb", "number": 2, "reconnects": 1})
    assert [r[1] for r in rows] == [3, 4, 5] and end == {"name": "004.rgb", "number": 5, "reconnects": 1}
    assert [r[-1] for r in reader.readBetweenOffsets({"name": "", "number": 0, "reconnects": 0}, end)] == [bytes([k]) for k in range(5)]
    assert [r[-2] for r in reader.readBetweenOffsets({"name": "", "number": 0, "reconnects": 0}, end)] == [True, False, False, False, False]
    stream = spark.readStream.format("frames").option("path", str(folder)).option("every", 2).option("most", 2).load()
    q = stream.select("frame", "should_detect").writeStream.format("memory").queryName("camera").start()
    try:
        q.processAllAvailable()
        (folder / "005.rgb").write_bytes(b"x")
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r.frame, r.should_detect) for r in spark.table("camera").orderBy("frame").collect()] == [(k, k % 2 == 1) for k in range(1, 7)]
