"""Session analytics: frame rates, stage timings, track statistics and event counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions.numbers import nearest_rank, rounded

EVENTS = ("created", "confirmed", "recovered", "ended")


def ranked(rows: DataFrame, key: tuple[str, ...], value: str, name: str, q: float = 0.95) -> DataFrame:
    """key and name: the value at place min(n-1, round((n-1)*q)) in order, rounding half to even, of the values that aren't null.

    Values are numbered in a window, which spills, and are never gathered in an array.
    """
    whole = Window.partitionBy(*key)
    last = F.count("*").over(whole) - 1
    place = F.least(last, F.bround(last * F.lit(q), 0).cast("bigint"))
    numbered = rows.filter(F.col(value).isNotNull()).withColumns({"_place": place, "_number": F.row_number().over(whole.orderBy(value)) - 1})
    return numbered.filter("_number = _place").select(*key, F.col(value).alias(name))


def fps_report(frames: DataFrame, key: tuple[str, ...] = ("session",)) -> DataFrame:
    """avg, p95 and min of the frame rates above 0; 0.0 for a session without any."""
    rows = frames.select(*key, F.when(F.col("fps") > 0, F.col("fps")).alias("fps"))
    grouped = rows.groupBy(*key).agg(F.avg("fps").alias("a"), F.min("fps").alias("m")).join(ranked(rows, key, "fps", "p"), list(key), "left")
    r = lambda c: rounded(F.coalesce(c, F.lit(0.0)), 3)
    return grouped.select(*key, *(r(c).alias(n) for c, n in (("a", "fps_avg"), ("p", "fps_p95"), ("m", "fps_min"))))


def stage_report(samples: DataFrame, key: tuple[str, ...] = ("session",)) -> DataFrame:
    """avg, p95 and max of each stage's milliseconds, from rows (key, stage, ms)."""
    full = (*key, "stage")
    grouped = samples.groupBy(*full).agg(F.avg("ms").alias("a"), F.max("ms").alias("m")).join(ranked(samples, full, "ms", "p"), list(full), "left")
    return grouped.select(*full, rounded(F.col("a"), 3).alias("ms_avg"), rounded(F.coalesce("p", F.lit(0.0)), 3).alias("ms_p95"), rounded(F.col("m"), 3).alias("ms_max"))


def stage_samples(frames: DataFrame) -> DataFrame:
    """Frame rows of a session log to rows (session, line, stage, ms)."""
    return frames.select("session", "line", F.explode("timings_ms").alias("stage", "ms"))


def rolling_stages(samples: DataFrame, length: int = 240, key: tuple[str, ...] = ("session", "stage")) -> DataFrame:
    """latest, mean and p95 of the last samples up to each one, in order of seq."""
    tail = Window.partitionBy(*key).orderBy("seq").rowsBetween(1 - length, 0)
    rows = samples.withColumns({"mean": F.avg("ms").over(tail), "held": F.collect_list("ms").over(tail)})
    return rows.select(*key, "seq", F.col("ms").alias("latest"), "mean", nearest_rank(F.col("held")).alias("p95"))


def track_report(flat: DataFrame, key: tuple[str, ...] = ("session",)) -> DataFrame:
    """Per track: how often it was present, predicted and confirmed, mean quality, most recoveries, its last label."""
    n = F.count("*")
    share = lambda c: rounded(F.count_if(c) / n, 4)
    return flat.groupBy(*key, F.col("track_id").alias("id")).agg(
        F.max_by("label", F.struct("line", "place")).alias("label"), n.alias("frames_present"), F.count_if(F.col("missed") > 0).alias("frames_predicted"), share(F.col("missed") > 0).alias("prediction_ratio"),
        share(F.col("confirmed")).alias("confirmed_ratio"), rounded(F.avg("quality"), 4).alias("avg_quality"), F.max("recoveries").alias("recoveries"),
    )


def event_counts(rows: DataFrame, key: tuple[str, ...] = ("session",)) -> DataFrame:
    """Counts of the named events, and of reconnects."""
    of = lambda name: F.count_if(F.col("name") == name)
    return rows.groupBy(*key).agg(*(of(f"track_{e}").alias(e) for e in EVENTS), of("target_lost").alias("target_lost"), of("capture_reconnected").alias("reconnect_events"))


def session_bounds(rows: DataFrame) -> DataFrame:
    """frames, duration_s (the last footer's, else the last frame's time), the first header's metadata, the last capture summary."""
    when = lambda kind, c: F.when(F.col("type") == kind, c)
    line = F.col("line")
    first = lambda c, kind: F.min_by(F.col(c), when(kind, line))
    last = lambda c, cond: F.max_by(F.col(c), F.when(cond, line))
    is_ = lambda kind: F.col("type") == kind
    return rows.groupBy("session").agg(
        F.count_if(is_("frame")).alias("frames"), F.coalesce(last("duration_s", is_("footer")), last("t", is_("frame")), F.lit(0.0)).alias("duration_s"),
        first("metadata", "header").alias("metadata"), last("data", is_("event") & (F.col("name") == "capture_summary")).alias("capture_summary"),
    )


def session_report(rows: DataFrame, flat: DataFrame) -> DataFrame:
    """One row per session with all reports as columns; tracks and stages as arrays in their order."""
    frames = rows.filter("type = 'frame'")
    stages = stage_report(stage_samples(frames)).groupBy("session").agg(F.sort_array(F.collect_list(F.struct("stage", "ms_avg", "ms_p95", "ms_max"))).alias("timings_ms"))
    item = F.struct((-F.col("frames_present")).alias("order"), "id", "label", "frames_present", "frames_predicted", "prediction_ratio", "confirmed_ratio", "avg_quality", "recoveries")
    tracks = track_report(flat).groupBy("session").agg(F.sort_array(F.collect_list(item)).alias("all"), F.count("*").alias("track_count"), F.max("frames_present").alias("longest_track_frames"))
    tracks = tracks.withColumn("tracks", F.transform("all", lambda t: t.dropFields("order"))).drop("all")
    out = session_bounds(rows)
    for part in (fps_report(frames), stages, event_counts(rows.filter("type = 'event'")), tracks):
        out = out.join(part, "session", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("track_count", "longest_track_frames", *EVENTS, "target_lost", "reconnect_events")}
    return out.withColumns(zero)


def run_summary(videos: DataFrame, tracklets: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts; videos has a column failed. edges: a row each, or counts in a column edges (graph.edge_counts)."""
    one = lambda df, name: df.agg((F.coalesce(F.sum(name), F.lit(0)) if name in df.columns else F.count("*")).alias(name))
    seen = videos.agg(F.count("*").alias("videos_seen"), F.count_if("failed").alias("videos_failed"))
    parts = [one(tracklets, "tracklets"), one(entities.select("entity_id").distinct(), "entities"), one(edges, "edges")]
    for part in parts:
        seen = seen.crossJoin(part)  # one row each
    return seen


def failure_message(videos: DataFrame, shown: int = 3) -> DataFrame:
    """One row, message: if all videos have failed the first failures (by place) in words, else null. videos: place, video, error."""
    first = F.sort_array(F.collect_list(F.struct("place", F.concat_ws(": ", "video", "error").alias("text"))))
    whole = videos.filter("error IS NOT NULL").orderBy("place").limit(shown)
    every = videos.agg(F.bool_and(F.col("error").isNotNull()).alias("all"))
    text = whole.agg(F.concat_ws("; ", F.transform(first, lambda x: x["text"])).alias("text"))
    return every.crossJoin(text).select(F.when(F.col("all"), F.concat(F.lit("all input videos failed: "), F.col("text"))).alias("message"))


def capture_summary(frames: DataFrame) -> DataFrame:
    """Per video: frames, how often its source was opened, and reconnects, from frames with reconnected."""
    again = F.count_if(F.coalesce("reconnected", F.lit(False)))
    return frames.groupBy("video").agg(F.count("*").alias("frames"), (again + 1).alias("open_count"), again.alias("reconnects"))


def confirmed_count(states: DataFrame) -> DataFrame:
    return states.groupBy("video", "frame").agg(F.count_if("confirmed").alias("confirmed"), F.count("*").alias("tracks"))


def clicked(states: DataFrame, clicks: DataFrame) -> DataFrame:
    """Of (video, frame, x, y): the hit track of highest id, or null; a click right of the frame's width (if any) hits none."""
    inside: Column = F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))
    keys = [c for c in clicks.columns]
    on_frame = F.col("x") < F.coalesce(F.col("frame_width"), F.lit(float("inf"))) if "frame_width" in keys else F.lit(True)
    hits = clicks.join(states.select("video", "frame", "track_id", "x1", "y1", "x2", "y2"), ["video", "frame"], "left")
    return hits.groupBy(*keys).agg(F.max(F.when(inside & on_frame, F.col("track_id"))).alias("hit"))
