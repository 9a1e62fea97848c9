"""Tracking tables made from the test tables, in Spark; plans.catalog has the same projections in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Distinct stages, in the order of their numbers.
STAGES = ("capture", "detect", "track", "draw")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a frame, its lines are detections, numbered by score and then by all that tells lines apart."""
    rows = table(spark, sf_dir, "lineitem")
    score = (F.lit(0.05) + (F.col("l_partkey") % 77).cast("double") / 80).alias("score")
    x1, y1 = (F.col("l_suppkey") % 12).cast("double") * 40, (F.col("l_partkey") % 7).cast("double") * 30
    boxed = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", score, x1.alias("x1"), y1.alias("y1"), (x1 + 40 + F.col("l_quantity")).alias("x2"), (y1 + 30 + F.col("l_quantity") * 0.5).alias("y2"))
    order = Window.partitionBy("l_orderkey").orderBy("score", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    kind = (F.col("l_partkey") % 3).cast("int")
    return boxed.select(
        F.lit("orders").alias("video"), F.col("l_orderkey").alias("frame"), (F.row_number().over(order) - 1).cast("int").alias("det_idx"), "x1", "y1", "x2", "y2", "score", kind.alias("class_id"),
    )


def tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector is a tracklet of its label's class, in one of five videos."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        F.concat(F.lit("v"), (F.col("vec_id") % 5).cast("string")).alias("video"), F.col("vec_id").cast("int").alias("local_track_id"), F.col("label").alias("class_id"), F.concat(F.lit("class "), F.col("label").cast("string")).alias("label"),
        F.col("embedding").cast("array<double>").alias("descriptor"), F.lit(None).cast("array<array<double>>").alias("gallery"), F.lit(1).cast("bigint").alias("first_frame"), (F.col("vec_id") + 1).alias("last_frame"), F.lit(30.0).alias("fps"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring vectors of one class: same, different and unsure in turn."""
    rows = tracklets(spark, sf_dir).select(F.concat("video", F.lit("#T"), F.col("local_track_id").cast("string")).alias("key"), "class_id", "local_track_id")
    after = Window.partitionBy("class_id").orderBy("local_track_id")
    pairs = rows.withColumns({"other": F.lead("key").over(after), "n": F.row_number().over(after)}).filter("n % 20 = 1 AND other IS NOT NULL")
    turn = F.element_at(F.array(F.lit("same"), F.lit("different"), F.lit("unsure")), (F.floor(F.col("n") / 20) % 3 + 1).cast("int"))
    return pairs.select(F.least("key", "other").alias("lo"), F.greatest("key", "other").alias("hi"), turn.alias("decision"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a sample: the user's session, a stage by the kind of event, milliseconds by its value."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq"), F.col("value").alias("ms"), "ts")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a track whose frames are event numbers by 50; gaps and values give misses and confirmation."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.floor(F.col("event_id") / 50).alias("frame"), "event_id", "event_type", "value")
    one = rows.groupBy("track_id", "frame").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("label"), F.max_by("value", "event_id").alias("value"))
    number = F.row_number().over(Window.partitionBy("track_id").orderBy("frame"))
    return one.select(
        F.lit("events").alias("video"), F.lit(0).alias("epoch"), "track_id", "frame", "label", (number > 2).alias("confirmed"), (F.col("event_id") % 4).cast("int").alias("missed"), number.cast("int").alias("hits"),
        F.lit(0).alias("recoveries"), F.col("value").alias("x1"), (F.col("value") * 0.5).alias("y1"), (F.col("value") + 20).alias("x2"), (F.col("value") * 0.5 + 40).alias("y2"),
    )


#: Orders of a video, by their key.
FRAMES_A_VIDEO = 300


def tracking(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames, detections and motion: an order is a frame, FRAMES_A_VIDEO keys a video. Some frames have no detections, no
    detector pass, a reset, a shift or an affine motion (valid or not), by their number; some detections have no appearance."""
    every = detections(spark, sf_dir).withColumn("video", F.concat(F.lit("o"), F.floor(F.col("frame") / FRAMES_A_VIDEO).cast("string")))
    look = F.array(F.col("score"), F.col("x1") / 480, F.col("y1") / 210, F.col("class_id") + F.lit(1.0))
    name = F.concat(F.lit("class "), F.col("class_id").cast("string"))
    found = every.filter("frame % 11 <> 5").withColumns({"label": name, "appearance": F.when(F.col("det_idx") % 5 != 4, look)})
    frame = F.col("frame")
    frames = every.select("video", "frame").distinct().withColumns({"fps": F.lit(30.0), "should_detect": frame % 6 != 0, "reset": frame % 151 == 0})
    shift, turn = frame % 3 == 1, frame % 3 == 2
    affine = F.array(F.lit(1.0), F.lit(0.01), (frame % 4).cast("double"), F.lit(-0.01), F.lit(1.0), F.lit(1.0))
    motion = frames.filter(shift | turn).select(
        "video", "frame", F.when(shift, (frame % 7 - 3).cast("double")).otherwise(0.0).alias("dx"), F.when(shift, (frame % 5 - 2).cast("double")).otherwise(0.0).alias("dy"),
        F.when(turn, affine).alias("affine"), (shift | (frame % 2 == 0)).alias("valid"),
    )
    return frames, found, motion
