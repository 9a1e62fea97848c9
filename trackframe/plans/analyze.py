"""Folder analysis end to end: frames and detections to track states, tracklets and the similarity graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.functions.tracks import quality
from trackframe.operators import graph, tracklets
from trackframe.operators.tracker import TrackerConfig, run_tracking


@dataclass
class Analysis:
    states: DataFrame
    tracklets: DataFrame
    edges: DataFrame
    reviews: DataFrame | None
    strong: float

    @cached_property
    def entities(self) -> DataFrame:
        return graph.entities(self.tracklets, self.reviews, self.strong)


def observations(states: DataFrame, frames: DataFrame, descriptors: DataFrame | None = None) -> DataFrame:
    """The states that count for tracklets, with quality; descriptors (video, frame, track_id, descriptor) replace appearances."""
    rows = tracklets.eligible(states.join(frames.select("video", "frame", F.coalesce("should_detect", F.lit(True)).alias("should_detect")), ["video", "frame"]))
    rows = rows.join(descriptors, ["video", "frame", "track_id"], "left") if descriptors is not None else rows.withColumn("descriptor", F.col("appearance"))
    seen = F.coalesce(F.nullif("last_score", F.lit(0.0)), F.col("score"))
    q = quality(F.col("hits"), F.col("last_score"), F.col("score"), F.col("missed"), F.col("confirmed"))
    return rows.select("video", "track_id", "frame", "class_id", "label", seen.alias("score"), q.alias("quality"), "descriptor")


def analyze(
    frames: DataFrame, detections: DataFrame, motion: DataFrame | None = None, reviews: DataFrame | None = None, descriptors: DataFrame | None = None, config: TrackerConfig = TrackerConfig(),  # noqa: B008
    classes: str = "", min_observations: int = 3, candidate: float = graph.CANDIDATE, strong: float = graph.STRONG, max_frames: int = 0,
) -> Analysis:
    """Every step is lazy; entities are found when they are asked for. max_frames bounds each video's frames (0: all), as a filter that reaches the scan."""
    graph.check_thresholds(candidate, strong)
    if min_observations < 1 or max_frames < 0:
        raise ValueError("min_observations is at least 1 and max_frames at least 0")
    if max_frames:
        frames = frames.filter(F.col("frame") <= max_frames)
    states = run_tracking(frames, detections, motion, config, classes)
    fps = frames.groupBy("video").agg(F.max("fps").alias("fps"))
    found = tracklets.summarize(observations(states, frames, descriptors), fps, min_observations)
    return Analysis(states, found, graph.edges(found, reviews, candidate, strong), reviews, strong)
