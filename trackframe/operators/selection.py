"""Target lock: which track is selected on each frame, as a fold over clicks and living tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.functions.tracks import refine_valid, snapshot_name
from trackframe.operators import reports
from trackframe.operators.tracker import moved


def selected_tracks(states: DataFrame, frames: DataFrame, clicks: DataFrame) -> DataFrame:
    """video, frame, selected_id, event: a click selects the topmost hit track, or nothing on a second click or a miss.

    Clicks (video, frame, seq, x, y) are judged on the frame's tracks in order of seq. A selected track that isn't among a
    frame's tracks gives target_lost and is let go; a click gives target_lock. A video is one row of the fold.
    """
    hits = reports.clicked(states, clicks).select("video", "frame", F.struct("seq", F.coalesce("hit", F.lit(-1)).alias("hit")).alias("click"))
    clicked = hits.groupBy("video", "frame").agg(F.transform(F.sort_array(F.collect_list("click")), lambda c: c["hit"]).alias("clicks"))
    alive = states.groupBy("video", "frame").agg(F.collect_set("track_id").alias("alive"))
    spine = frames.select("video", "frame").join(clicked, ["video", "frame"], "left").join(alive, ["video", "frame"], "left")

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        held, out = -1, []
        for r in page.sort_values("frame").itertuples():
            lost = held >= 0 and (r.alive is None or held not in r.alive)
            held = -1 if lost else held
            for hit in () if r.clicks is None else r.clicks:
                held = -1 if hit == held else int(hit)
            event = "target_lock" if r.clicks is not None and len(r.clicks) else "target_lost" if lost else None
            out.append((r.video, r.frame, None if held < 0 else held, event))
        return pd.DataFrame(out, columns=["video", "frame", "selected_id", "event"]).astype({"selected_id": "Int32"})

    return spine.groupBy("video").applyInPandas(fold, "video string, frame bigint, selected_id int, event string")


#: The display modes, in the order in which the key goes through them.
MODES = ("normal", "clarity", "lowlight", "edges", "pseudo-thermal")


def check_mode(mode: str) -> str:
    """The mode in small letters, if there is such a one; else ValueError."""
    if mode.lower() not in MODES:
        raise ValueError(f"unknown display mode: {mode}")
    return mode.lower()


def control_events(keys: DataFrame, upscaler: bool = False) -> DataFrame:
    """video, frame, seq, name, data (JSON): the session events of an operator's keys.

    keys: video, frame, seq, key, selected_id and ts. e and z turn enhancement and stabilization on and off, m goes to the
    next display mode, r resets the tracker; s saves a snapshot of the selected track if there is one, and so does u, which
    also upscales it if an upscaler is at hand. What is on after a key is a matter of how often it has been pressed.
    """
    times = F.count("*").over(Window.partitionBy("video", "key").orderBy("frame", "seq"))
    rows = keys.withColumn("times", times)
    on, selected = F.col("times") % 2 == 1, F.col("selected_id").isNotNull()
    path = snapshot_name(F.col("selected_id"), F.col("ts"))
    event = lambda name, **data: F.struct(F.lit(name).alias("name"), F.to_json(F.struct(*(v.alias(k) for k, v in data.items()))).alias("data") if data else F.lit("{}").alias("data"))
    none = F.lit(None).cast("struct<name:string,data:string>")
    mode = F.element_at(F.array(*(F.lit(m) for m in MODES)), (F.col("times") % len(MODES) + 1).cast("int"))
    saved = F.when(F.col("key").isin("s", "u") & selected, event("snapshot", track_id=F.col("selected_id"), path=path))
    larger = F.regexp_replace(path, r"\.png$", "-x4.png")
    happened = F.array(
        F.when(F.col("key") == "e", event("enhance", enabled=on)), F.when(F.col("key") == "m", event("view_mode", mode=mode)), F.when(F.col("key") == "z", event("stabilize", enabled=on)), F.when(F.col("key") == "r", event("tracker_reset")),
        saved, F.when((F.col("key") == "u") & selected, event("ai_upscale", track_id=F.col("selected_id"), path=larger)) if upscaler else none,
    )
    return rows.select("video", "frame", "seq", F.inline(F.filter(happened, lambda x: x.isNotNull())))


def refined_boxes(selected: DataFrame, estimates: DataFrame) -> DataFrame:
    """video, frame, track_id, box, refined: a selected track's box between detections.

    selected: video, frame, track_id, x1 to y2, fresh (the detector has just seen it). estimates: video, frame, affine, inliers,
    ratio. On frames that aren't fresh an estimate that passes the gate moves the box of the frame before; else, and when the
    selection changes, the track's own box starts anew.
    """
    scale, turn = F.hypot(F.col("affine")[0], F.col("affine")[3]), F.atan2(F.col("affine")[3], F.col("affine")[0])
    known = estimates.select("video", "frame", "affine", refine_valid(F.col("inliers"), F.col("ratio"), scale, turn).alias("valid"))
    rows = selected.join(known, ["video", "frame"], "left").select("video", "frame", "track_id", *G.Box._fields, "fresh", F.coalesce("valid", F.lit(False)).alias("valid"), "affine")
    schema = "video string, frame bigint, track_id int, x1 double, y1 double, x2 double, y2 double, refined boolean"

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        track, box, out = None, None, []
        for r in page.sort_values("frame").itertuples():
            use = not r.fresh and r.valid and track == r.track_id
            box = moved(box, (0.0, 0.0), r.affine) if use else np.array([[r.x1, r.y1, r.x2, r.y2]], float)
            track = r.track_id
            out.append((r.video, r.frame, track, *box[0].tolist(), use))
        return pd.DataFrame(out, columns=["video", "frame", "track_id", *G.Box._fields, "refined"])

    return rows.groupBy("video").applyInPandas(fold, schema)
