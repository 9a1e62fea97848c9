"""Synthetic inputs as plain ranges, for benchmarks and demonstrations. The numbers in the formulas are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.functions import geometry as G


def synthetic_detections(spark: SparkSession, frames: int = 3000, targets: int = 32, w: int = 1920, h: int = 1080, first: int = 0) -> DataFrame:
    """Targets in sinusoidal motion; weak scores on every 47th frame, every 5th target missing on every 89th."""
    grid = spark.range(first, first + frames).select(F.col("id").alias("frame")).crossJoin(F.broadcast(spark.range(targets).select(F.col("id").alias("i"))))
    phase = F.col("i") * 0.73
    cx = F.lit(float(w)) * (F.lit(0.1) + F.lit(0.8) * ((F.col("i") + 1) / F.lit(targets + 1.0))) + F.sin(F.col("frame") * 0.031 + phase) * 45
    cy = F.lit(h * 0.5) + F.cos(F.col("frame") * 0.027 + phase) * 180
    box = G.from_center(cx, cy, 45 + F.col("i") % 4 * 12, 80 + F.col("i") % 3 * 18)
    kept = grid.filter(~((F.col("frame") % 89 == 0) & (F.col("i") % 5 == 0)))
    kind = (F.col("i") % 3).cast("int")
    return kept.select(
        F.lit("synthetic").alias("video"), "frame", F.col("i").cast("int").alias("det_idx"), *box.columns(), F.when(F.col("frame") % 47 == 0, 0.28).otherwise(0.86).alias("score"),
        kind.alias("class_id"), F.concat(F.lit("class_"), kind.cast("string")).alias("label"), F.lit(None).cast("array<double>").alias("appearance"),
    )


def synthetic_motion(spark: SparkSession, frames: int = 3000, first: int = 0) -> DataFrame:
    f = F.col("id")
    return spark.range(first, first + frames).select(F.lit("synthetic").alias("video"), f.alias("frame"), (F.sin(f * 0.02) * 2.0).alias("dx"), F.cos(f * 0.018).alias("dy"), F.lit(None).cast("array<double>").alias("affine"), F.lit(True).alias("valid"))


def synthetic_frames(spark: SparkSession, frames: int = 3000, every: int = 1, first: int = 0, fps: float = 30.0) -> DataFrame:
    return spark.range(first, first + frames).select(
        F.lit("synthetic").alias("video"), F.col("id").alias("frame"), F.lit(fps).alias("fps"), F.lit(1920).alias("width"), F.lit(1080).alias("height"),
        ((F.col("id") - first) % every == 0).alias("should_detect"), F.lit(False).alias("reset"),
    )


def demo_detections(spark: SparkSession, frames: int = 600, fps: float = 30.0) -> DataFrame:
    """A car, a person who drops out for 8 of 120 frames, and an airplane; time is frame / fps."""
    t = F.col("id") / F.lit(fps)
    wave = lambda base, size, rate, at=0.0, f=F.sin: base + f(t * rate + at) * size
    specs = [
        ("car", 2, 0.93, wave(220, 120, 0.9), wave(240, 50, 0.6, f=F.cos), 170, 90),
        ("person", 0, 0.88, wave(650, 160, 0.5, 1.2), wave(380, 110, 0.8, f=F.cos), 75, 170),
        ("airplane", 4, 0.84, wave(510, 300, 0.32), wave(115, 38, 0.4, f=F.cos), 210, 70),
    ]
    items = [F.struct(F.lit(n).alias("label"), F.lit(c).alias("class_id"), F.lit(s).alias("score"), *G.from_center(cx, cy, F.lit(bw), F.lit(bh)).columns()) for n, c, s, cx, cy, bw, bh in specs]
    rows = spark.range(frames).select(F.lit("demo").alias("video"), F.col("id").alias("frame"), F.posexplode(F.array(*items)).alias("det_idx", "d"))
    seen = rows.filter(~((F.col("d.label") == "person") & (F.col("frame") % 120).between(78, 85)))
    return seen.select("video", "frame", "det_idx", *(f"d.{c}" for c in G.Box._fields), "d.score", "d.class_id", "d.label", F.lit(None).cast("array<double>").alias("appearance"))
