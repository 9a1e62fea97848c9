"""Tracklets: one row per video and track, from the observed, confirmed states that have a descriptor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackframe.functions import tracks as T
from trackframe.functions.numbers import cosine, unit

GALLERY, GALLERY_ALIKE = 6, 0.985


def eligible(states: DataFrame) -> DataFrame:
    """States that count: confirmed, observed on this frame, with an appearance, on a frame with a detector pass."""
    return states.filter("confirmed AND missed = 0 AND appearance IS NOT NULL AND should_detect")


def gallery(observations: Column) -> Column:
    """Of an ordered array of structs with a descriptor: those unlike all kept before, at most GALLERY."""

    def step(kept: Column, o: Column) -> Column:
        like = F.exists(kept, lambda k: F.coalesce(cosine(k, o["descriptor"]), F.lit(0.0)) >= GALLERY_ALIKE)
        return F.when((F.size(kept) >= GALLERY) | like, kept).otherwise(F.concat(kept, F.array(o["descriptor"])))

    return F.aggregate(observations, F.array().cast("array<array<double>>"), step)


def mean_descriptor(observations: Column) -> Column:
    """Sum by element in order, at length 1."""
    zero = F.transform(F.get(observations, F.lit(0))["descriptor"], lambda x: F.lit(0.0))
    return unit(F.aggregate(observations, zero, lambda s, o: F.zip_with(s, o["descriptor"], lambda a, b: a + b.cast("double"))))


def summarize(observed: DataFrame, fps: DataFrame | None = None, min_observations: int = 3) -> DataFrame:
    """TRACKLETS from rows (video, track_id, frame, class_id, label, score, quality, descriptor).

    Class, label and first frame are those of the track's first row, even if that has no descriptor; all else comes from
    rows whose descriptor has the length of the first one. The best frame has the highest 0.65 * score + 0.35 * quality,
    the earliest of equals. A track's rows are gathered in one row, which is bounded by its number of frames.
    """
    value = F.col("score") * 0.65 + F.col("quality") * 0.35
    item = F.struct("frame", F.col("score").cast("double").alias("score"), F.col("quality").cast("double").alias("quality"), value.alias("value"), F.transform("descriptor", lambda x: x.cast("double")).alias("descriptor"))
    grouped = observed.groupBy("video", "track_id").agg(
        F.min_by("class_id", "frame").alias("class_id"),
        F.min_by("label", "frame").alias("label"),
        F.min("frame").alias("first_frame"),
        F.sort_array(F.collect_list(F.when(F.col("descriptor").isNotNull(), item))).alias("all"),
    )
    same = F.filter("all", lambda o: F.size(o["descriptor"]) == F.size(F.get(F.col("all"), F.lit(0))["descriptor"]))
    rows = grouped.withColumn("obs", same).filter(F.size("obs") >= max(1, min_observations))
    total = lambda field: F.aggregate("obs", F.lit(0.0), lambda s, o: s + o[field])
    best = F.aggregate("obs", F.struct(F.lit(-1.0).alias("value"), F.lit(0).cast("bigint").alias("frame")), lambda b, o: F.when(o["value"] > b["value"], F.struct(o["value"].alias("value"), o["frame"].cast("bigint").alias("frame"))).otherwise(b))
    n = F.size("obs")
    out = rows.select(
        "video", F.col("track_id").alias("local_track_id"), "class_id", "label", "first_frame", F.element_at("obs", -1)["frame"].alias("last_frame"),
        n.cast("bigint").alias("observations"), (total("score") / n).alias("mean_score"), (total("quality") / n).alias("mean_quality"), best["frame"].alias("best_frame"),
        mean_descriptor(F.col("obs")).alias("descriptor"), gallery(F.col("obs")).alias("gallery"),
    )
    out = out.join(fps, "video", "left") if fps is not None else out.withColumn("fps", F.lit(0.0))
    return out.withColumn("preview_path", F.lit(None).cast("string"))


def public(tracklets: DataFrame) -> DataFrame:
    """Without descriptors: key, and times in seconds where the frame rate is known."""
    time = lambda c: F.when(F.col("fps") > 0, F.floor(F.col(c) / F.col("fps") * 1000 + 0.5) / 1000)
    return tracklets.drop("descriptor", "gallery").withColumns({"key": T.tracklet_key(F.col("video"), F.col("local_track_id")), "start_s": time("first_frame"), "end_s": time("last_frame")})
