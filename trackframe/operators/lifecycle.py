"""What happens to tracks from frame to frame, as windows over track states."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions.numbers import rounded

KEY = ("video", "epoch", "track_id")


def events(states: DataFrame, last_frames: DataFrame | None = None, key: tuple[str, ...] = KEY) -> DataFrame:
    """track_created, track_confirmed, track_recovered and track_ended, with the frame that each belongs to.

    A track ends on the frame after its last row, if its video (key[:-1]) has one: last_frames gives video and frame; without it
    the last frame on which any track lives counts.
    """
    order = Window.partitionBy(*key).orderBy("frame")
    before = {c: F.lag(c).over(order) for c in ("confirmed", "missed", "frame")}
    group = [key[0]]
    ends = last_frames.select(*group, F.col("frame").alias("last_frame")) if last_frames is not None else states.groupBy(*group).agg(F.max("frame").alias("last_frame"))
    rows = states.withColumns({"was_confirmed": before["confirmed"], "was_missed": before["missed"], "was": before["frame"], "next": F.lead("frame").over(order)}).join(ends, group)
    happened = F.array(
        F.when(F.col("was").isNull(), F.struct("frame", F.lit("track_created").alias("name"))),
        F.when(F.col("was").isNotNull() & ~F.col("was_confirmed") & F.col("confirmed"), F.struct("frame", F.lit("track_confirmed").alias("name"))),
        F.when((F.col("was_missed") > 0) & (F.col("missed") == 0), F.struct("frame", F.lit("track_recovered").alias("name"))),
        F.when(F.col("next").isNull() & (F.col("frame") < F.col("last_frame")), F.struct((F.col("frame") + 1).alias("frame"), F.lit("track_ended").alias("name"))),
    )
    out = rows.select(*key, "label", "confirmed", "missed", "recoveries", F.explode(F.filter(happened, lambda x: x.isNotNull())).alias("e"))
    return out.select(*key, F.col("e.frame").alias("frame"), F.col("e.name").alias("name"), "label", "confirmed", "missed", "recoveries")


def target_lost(states: DataFrame, selected: DataFrame) -> DataFrame:
    """Of (video, frame, selected_id): the rows whose track isn't among that frame's states."""
    alive = states.select("video", "frame", F.col("track_id").alias("selected_id"))
    return selected.filter("selected_id IS NOT NULL").join(alive, ["video", "frame", "selected_id"], "left_anti")


def trajectory(states: DataFrame, length: int = 64, key: tuple[str, ...] = KEY) -> DataFrame:
    """Adds history: the last centres up to each row, cut to whole pixels."""
    tail = Window.partitionBy(*key).orderBy("frame").rowsBetween(1 - length, 0)
    point = F.struct(((F.col("x1") + F.col("x2")) * 0.5).cast("int").alias("x"), ((F.col("y1") + F.col("y2")) * 0.5).cast("int").alias("y"))
    return states.withColumn("history", F.collect_list(point).over(tail))


def _smoothed(values: np.ndarray, keep: float, seed_first: bool) -> np.ndarray:
    """keep * last + (1 - keep) * value, row by row; the first row is taken as it is, or zeros precede it."""
    out = np.empty_like(values)
    last = np.zeros(values.shape[1])
    for i, v in enumerate(values):
        last = v if seed_first and i == 0 else last * keep + v * (1 - keep)
        out[i] = last
    return out


def ema(values: DataFrame, key: tuple[str, ...], order: str, value: str, keep: float, seed_first: bool = True) -> DataFrame:
    """key, order, ema: keep * last + (1 - keep) * value along each key; the first value is taken as it is, or 0 precedes it.

    One pass over each key's values in order; a key's values are one task's.
    """
    rows = values.select(*key, order, F.col(value).cast("double").alias("ema"))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        smooth = _smoothed(table.column("ema").to_numpy()[:, None], keep, seed_first)[:, 0]
        return table.set_column(table.column_names.index("ema"), "ema", pa.array(smooth))

    return rows.groupBy(*key).applyInArrow(fold, rows.schema)


def stabilizer(motion: DataFrame, keep: float = 0.82) -> DataFrame:
    """video, frame, corr_dx, corr_dy, corr_da: what smoothing the summed camera motion would correct."""
    parts = ("dx", "dy", "da")
    rows = motion.select("video", "frame", *(F.col(c).cast("double").alias(f"corr_{c}") for c in parts))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("frame")
        total = np.cumsum(np.stack([table.column(f"corr_{c}").to_numpy() for c in parts], axis=1), axis=0)
        corrections = _smoothed(total, keep, seed_first=False) - total
        return pa.table([table.column("video"), table.column("frame"), *(pa.array(corrections[:, k]) for k in range(3))], names=table.column_names)

    return rows.groupBy("video").applyInArrow(fold, rows.schema)


def rounded_columns(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})
