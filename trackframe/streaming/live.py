"""The tracker on a stream: the same step as in batch, with one state per video.

Event time is the frame: each micro-batch is sorted by frame, frames at or before the last one of the state are dropped.
State is the video's tracks as JSON and is bounded by the number of living tracks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackframe.operators.tracker import TrackerConfig, Tracks, page_of
from trackframe.schemas import TRACK_STATES

#: The columns of a stream of frames: a spine row with its detections, motion and flags.
SPINE = (
    "video string, frame bigint, should_detect boolean, reset boolean, "
    "dets array<struct<det_idx:int,x1:double,y1:double,x2:double,y2:double,score:double,class_id:int,label:string,appearance:array<double>>>, "
    "dx double, dy double, affine array<double>"
)


def track_stream(spine: DataFrame, config: TrackerConfig = TrackerConfig()) -> DataFrame:  # noqa: B008
    """TRACK_STATES in append mode from a streaming spine (SPINE)."""

    def fold(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracks = Tracks.from_json(state.get[0], config) if state.exists else Tracks(config)
        rows = pd.concat(list(pages), ignore_index=True).sort_values("frame").to_dict("records")
        out = page_of([r for row in rows if (r := tracks.advance(row)) is not None])
        state.update((tracks.to_json(),))
        yield out

    return spine.groupBy("video").applyInPandasWithState(fold, TRACK_STATES, "tracks string", "append", GroupStateTimeout.NoTimeout)


def stage_windows(samples: DataFrame, length: str = "1 minute", late: str = "30 seconds") -> DataFrame:
    """Mean and highest milliseconds of each stage by windows of event time ts; samples later than late are dropped."""
    timed = samples.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy("session", "stage", F.window("ts", length)).agg(F.count("*").alias("n"), F.avg("ms").alias("ms_avg"), F.max("ms").alias("ms_max"))
    return grouped.select("session", "stage", F.col("window.start").alias("start"), "n", "ms_avg", "ms_max")


def write_sessions(stream: DataFrame, path: str, checkpoint: str):
    """Session rows of a stream as JSON lines; one folder per micro-batch number, so a repeated batch replaces itself."""

    def save(rows: DataFrame, number: int) -> None:
        rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_frames(frames: DataFrame) -> DataFrame:
    """Of a micro-batch (in foreachBatch) the newest frame of each video: what a consumer that is late would show."""
    return frames.groupBy("video").agg(F.max_by(F.struct(*(c for c in frames.columns if c != "video")), "frame").alias("f")).select("video", "f.*")
