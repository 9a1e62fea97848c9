"""Queries of the tracker: batch, stream and the mobile profile, against the same fold in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.functions import tracks as T
from trackframe.operators import lifecycle, reports, selection, tracker, tracklets
from trackframe.plans.analyze import observations
from trackframe.plans.registry import DETECTIONS, query, r, rsql
from trackframe.sources import adapters, generators
from trackframe.sources.shared import cut, fresh
from trackframe.streaming import live

BOX = ("x1", "y1", "x2", "y2")
D = "::DOUBLE"

#: The same input as adapters.tracking(), one row a frame, numbered within its video.
SPINE = f"""{DETECTIONS}, looked AS (
  SELECT 'o' || CAST(floor(frame / 300.0::DOUBLE) AS BIGINT) AS video, *, 'class ' || class_id AS label,
    CASE WHEN det_idx % 5 <> 4 THEN [score, x1 / 480, y1 / 210, class_id + 1.0::DOUBLE] END AS look FROM detections
), framed AS (
  SELECT video, frame, coalesce(list({{'det_idx': det_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'score': score, 'class_id': class_id, 'label': label, 'look': look}} ORDER BY det_idx) FILTER (frame % 11 <> 5), []) AS dets
  FROM looked GROUP BY video, frame
), spine AS (
  SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame) AS k, frame % 6 <> 0 AS should_detect, frame % 151 = 0 AS reset,
    CASE WHEN frame % 3 = 1 THEN CAST(frame % 7 - 3 AS DOUBLE) ELSE 0.0{D} END AS dx, CASE WHEN frame % 3 = 1 THEN CAST(frame % 5 - 2 AS DOUBLE) ELSE 0.0{D} END AS dy,
    CASE WHEN frame % 3 = 2 AND frame % 2 = 0 THEN [1.0{D}, 0.01{D}, CAST(frame % 4 AS DOUBLE), -0.01{D}, 1.0{D}, 1.0{D}] END AS affine
  FROM framed
)"""

TRACK = (
    "STRUCT(id BIGINT, class_id INTEGER, label VARCHAR, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, score DOUBLE, last_score DOUBLE, vx DOUBLE, vy DOUBLE, "
    "age INTEGER, hits INTEGER, missed INTEGER, confirmed BOOLEAN, recoveries INTEGER, look DOUBLE[])"
)


def _point(x: str, y: str, row: int) -> str:
    """A row of the affine applied to a point."""
    return f"(affine[{3 * row + 1}] * {x} + affine[{3 * row + 2}] * {y} + affine[{3 * row + 3}])"


def _dot(a: str, b: str) -> str:
    return "(" + " + ".join(f"{a}[{i}] * {b}[{i}]" for i in range(1, 5)) + ")"


def _candidates(c: tracker.TrackerConfig, tracks: str, dets: str, loose: bool) -> str:
    """All open pairs of tracks and detections, as singleton lists in order of preference, after one that matches nothing."""
    min_iou = c.min_iou * (tracker.LOOSE_IOU if loose else 1.0)
    reach = c.max_center_ratio * (tracker.LOOSE_CENTER if loose else 1.0)
    gap = lambda a, b: f"((d.{a} + d.{b}) * 0.5{D} - (t.p{a} + t.p{b}) * 0.5{D})"
    gx, gy = gap("x1", "x2"), gap("y1", "y2")
    side = lambda lo, hi: f"greatest(0.0{D}, least(t.p{hi}, d.{hi}) - greatest(t.p{lo}, d.{lo}))"
    area = lambda v, p: f"(greatest(0.0{D}, {v}.{p}x2 - {v}.{p}x1) * greatest(0.0{D}, {v}.{p}y2 - {v}.{p}y1))"
    shared = f"({side('x1', 'x2')} * {side('y1', 'y2')})"
    iou = f"({shared} / greatest({area('t', 'p')} + {area('d', '')} - {shared}, 1e-6{D}))"
    norm = lambda v: f"sqrt({_dot(v, v)})"
    like = f"CASE WHEN t.look IS NOT NULL AND d.look IS NOT NULL THEN least(1.0{D}, greatest(0.0{D}, {_dot('t.look', 'd.look')} / ({norm('t.look')} * {norm('d.look')}))) * {c.appearance_weight}{D} END"
    far = f"sqrt({gx} * {gx} + {gy} * {gy}) / t.diagonal"
    pair = f"{{'tid': t.id, 'didx': d.det_idx, 'iou': {iou}, 'far': {far}, 'conf': d.score, 'look': {like if c.appearance_weight else 'NULL' + D}}}"
    each = f"flatten(list_transform({tracks}, lambda t: list_transform(list_filter({dets}, lambda d: d.class_id = t.class_id), lambda d: {pair})))"
    open_ = f"list_filter({each}, lambda p: p.iou >= {min_iou}{D} OR p.far <= {reach}{D})"
    value = f"p.iou * {c.iou_weight}{D} + greatest(0.0{D}, 1.0{D} - p.far / {reach}{D}) + p.conf * {c.score_weight}{D}" + (f" + coalesce(p.look, 0.0{D})" if c.appearance_weight else "")
    sign = "" if c.confirms else "-"  # the mobile sort keeps insertion order
    scored = f"list_transform({open_}, lambda p: {{'value': {value}, 't': {sign}p.tid, 'd': {sign}p.didx, 'tid': p.tid, 'didx': p.didx}})"
    return f"list_concat([[{{'value': 9e9{D}, 't': 0::BIGINT, 'd': 0, 'tid': -1::BIGINT, 'didx': -1}}]], list_transform(list_reverse_sort({scored}), lambda x: [x]))"


def _greedy(pairs: str) -> str:
    taken = "len(list_filter(acc, lambda q: q.tid = x[1].tid OR q.didx = x[1].didx)) > 0"
    return f"list_reduce({pairs}, lambda acc, x: CASE WHEN {taken} THEN acc ELSE list_concat(acc, x) END)"


def tracker_sql(c: tracker.TrackerConfig, motion: bool = True) -> str:
    """CTEs that end in states: the fold of the tracker, a recursion over the frames of all videos side by side."""
    if not motion:
        box = {v: f"t.{v} + 0.0{D}" for v in BOX}
        carried = {"x": f"w.t.cx + 0.0{D}", "y": f"w.t.cy + 0.0{D}"}
    else:
        corners = [(x, y) for x in ("t.x1", "t.x2") for y in ("t.y1", "t.y2")]
        hull = lambda f, row: f"{f}({', '.join(_point(x, y, row) for x, y in corners)})"
        box = {v: f"CASE WHEN affine IS NULL THEN t.{v} + {'dx' if v[0] == 'x' else 'dy'} ELSE {hull('least' if v[1] == '1' else 'greatest', 0 if v[0] == 'x' else 1)} END" for v in BOX}
        carried = {a: f"CASE WHEN affine IS NULL THEN w.t.c{a} + d{a} ELSE {_point('w.t.cx', 'w.t.cy', k)} END" for k, a in enumerate("xy")}
    damping = f"greatest(0.25{D}, 1.0{D} - 0.08{D} * t.missed)"
    fields = "id class_id label x1 y1 x2 y2 score last_score vx vy age hits missed confirmed recoveries look".split()
    own = ", ".join(f"'{f}': t.{f}" for f in fields)
    predicted = ", ".join(f"'p{v}': ({box[v]}) + t.v{v[0]} * {damping}" for v in BOX)
    diagonal = f"greatest(sqrt(greatest(0.0{D}, t.x2 - t.x1) * greatest(0.0{D}, t.x2 - t.x1) + greatest(0.0{D}, t.y2 - t.y1) * greatest(0.0{D}, t.y2 - t.y1)), 24.0{D})"
    extended = f"list_transform(old, lambda t: {{{own}, {predicted}, 'diagonal': {diagonal}, 'cx': (t.x1 + t.x2) * 0.5{D}, 'cy': (t.y1 + t.y2) * 0.5{D}}})"
    keep = c.velocity_keep
    moving = {a: f"w.t.v{a} * {keep}{D} + ((w.d.{a}1 + w.d.{a}2) * 0.5{D} - ({carried[a]})) * (1 - {keep}{D})" for a in "xy"}
    mix = f"list_transform([1, 2, 3, 4], lambda i: w.t.look[i] * (1 - 0.2{D}) + w.d.look[i] * 0.2{D})"
    unit = lambda v: f"list_transform({v}, lambda e: e / sqrt({_dot(v, v)}))"
    matched = {
        "id": "w.t.id", "class_id": "w.t.class_id", "label": "w.d.label", **{v: f"w.d.{v}" for v in BOX}, "score": "w.d.score", "last_score": "w.d.score", "vx": moving["x"], "vy": moving["y"],
        "age": "w.t.age + 1", "hits": "w.t.hits + 1", "missed": "0", "confirmed": f"w.t.confirmed OR w.t.hits + 1 >= {c.min_hits}", "recoveries": "w.t.recoveries + CAST(w.t.missed > 0 AS INTEGER)",
        "look": f"CASE WHEN w.d.look IS NULL THEN w.t.look WHEN w.t.look IS NULL THEN w.d.look ELSE {unit(mix)} END",
    }
    coasted = {f: f"w.t.{f}" for f in fields} | {v: f"w.t.p{v}" for v in BOX} | {"age": "w.t.age + 1"}
    unseen = coasted | {"missed": "w.t.missed + 1"}
    struct = lambda values: "{" + ", ".join(f"'{k}': {v}" for k, v in values.items()) + "}"
    new = {
        "id": "next_id + i - 1", "class_id": "d.class_id", "label": "d.label", **{v: f"d.{v}" for v in BOX}, "score": "d.score", "last_score": "d.score", "vx": f"0.0{D}", "vy": f"0.0{D}", "age": "1", "hits": "1",
        "missed": "0", "confirmed": str(c.min_hits <= 1).lower(), "recoveries": "0", "look": "d.look",
    }
    gone = f"t.missed > {c.max_missed}" + (f" OR (NOT t.confirmed AND t.missed > {min(2, c.max_missed)})" if c.confirms else "")
    none = f"CAST([] AS {TRACK}[])"
    second = _greedy(_candidates(c, "list_filter(ext, lambda t: NOT list_contains(list_transform(m1, lambda q: q.tid), t.id))", "list_filter(seen, lambda d: NOT list_contains(list_transform(m1, lambda q: q.didx), d.det_idx))", True))
    return f"""{SPINE}, run AS (
  SELECT DISTINCT video, 0::BIGINT AS k, 0::BIGINT AS frame, 0 AS epoch, 1::BIGINT AS next_id, {none} AS tracks FROM spine
  UNION ALL
  SELECT video, k, frame, epoch, next_id + len(born), list_filter(CAST(list_concat(live, born) AS {TRACK}[]), lambda t: NOT ({gone}))
  FROM (SELECT *, CASE WHEN should_detect THEN CAST(list_transform(list_filter(high, lambda d: NOT list_contains(list_transform(m, lambda q: q.didx), d.det_idx)), lambda d, i: {struct(new)}) AS {TRACK}[]) ELSE {none} END AS born
  FROM (SELECT *, CAST(list_transform(paired, lambda w: CASE WHEN NOT should_detect THEN {struct(coasted)} WHEN w.d IS NULL THEN {struct(unseen)} ELSE {struct(matched)} END) AS {TRACK}[]) AS live
  FROM (SELECT *, list_transform(ext, lambda t: {{'t': t, 'd': list_filter(seen, lambda d: list_contains(list_transform(list_filter(m, lambda q: q.tid = t.id), lambda q: q.didx), d.det_idx))[1]}}) AS paired
  FROM (SELECT *, {f"list_concat(m1, {second})" if c.two_stage else "m1"} AS m
  FROM (SELECT *, {_greedy(_candidates(c, "ext", "high", False))} AS m1
  FROM (SELECT *, list_filter(seen, lambda d: d.score >= {c.high_conf}{D}) AS high
  FROM (SELECT *, {extended} AS ext, list_filter(dets, lambda d: d.score >= {c.low_conf}{D}) AS seen
  FROM (SELECT s.* EXCLUDE (k), s.k, r.epoch + CAST(s.reset AS INTEGER) AS epoch, CASE WHEN s.reset THEN 1 ELSE r.next_id END AS next_id, CASE WHEN s.reset THEN {none} ELSE r.tracks END AS old
    FROM run r JOIN spine s ON s.video = r.video AND s.k = r.k + 1))))))))
), states AS (
  SELECT video, epoch, frame, t.id AS track_id, t.* EXCLUDE (id) FROM (SELECT video, epoch, frame, unnest(tracks) AS t FROM run WHERE k > 0)
)"""


FULL = tracker_sql(tracker.TrackerConfig())
SHOWN = f"""SELECT video, epoch, frame, CAST(track_id AS INTEGER) AS track_id, class_id, label, {", ".join(f"{rsql(v, 3)} AS {v}" for v in BOX)}, {rsql("score", 4)} AS score, {rsql("vx", 4)} AS vx, {rsql("vy", 4)} AS vy,
  age, hits, missed, confirmed, recoveries, {rsql("coalesce(look[1], -1)", 4)} AS look FROM states"""


def _shown(states: DataFrame) -> DataFrame:
    numbers = [r(c, 3).alias(c) for c in BOX] + [r(c, 4).alias(c) for c in ("score", "vx", "vy")]
    look = r(F.coalesce(F.get("appearance", F.lit(0)), F.lit(-1.0)), 4).alias("look")
    return states.select("video", "epoch", "frame", "track_id", "class_id", "label", *numbers, "age", "hits", "missed", "confirmed", "recoveries", look)


def _tracked(spark: SparkSession, d: str) -> DataFrame:
    return tracker.run_tracking(*adapters.tracking(spark, d))


@query(f"WITH RECURSIVE {FULL} {SHOWN}")
def track_states(spark: SparkSession, d: str) -> DataFrame:
    """The tracker over all detections: appearance, skipped frames, resets, shifts and affine motion."""
    return _shown(_tracked(spark, d))


@query(f"WITH RECURSIVE {tracker_sql(tracker.LITE, motion=False)} {SHOWN}")
def lite_track_states(spark: SparkSession, d: str) -> DataFrame:
    frames, found, _ = adapters.tracking(spark, d)
    return _shown(tracker.run_tracking(frames, found, None, tracker.LITE))


@query(f"WITH RECURSIVE {tracker_sql(tracker.TrackerConfig(), motion=False)} {SHOWN}")
def stabilized_track_states(spark: SparkSession, d: str) -> DataFrame:
    """On stabilized frames motion isn't used."""
    return _shown(tracker.run_tracking(*adapters.tracking(spark, d), stabilized=True))


@query(f"WITH RECURSIVE {FULL} {SHOWN}")
def stream_track_states(spark: SparkSession, d: str) -> DataFrame:
    """The same states from a stream: the spine in files, one a micro-batch, state by video."""
    where = fresh(spark, "stream")
    spine = tracker.spine(*adapters.tracking(spark, d))
    first = spine.groupBy("video").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY frame)").alias("half"))
    parts = spine.join(first, "video")
    parts.filter("frame <= half").drop("half").coalesce(1).write.parquet(f"{where}/in")
    parts.filter("frame > half").drop("half").coalesce(1).write.mode("append").parquet(f"{where}/in")
    read = spark.readStream.schema(spine.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    stream = live.track_stream(read).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint")
    stream.trigger(availableNow=True).start().awaitTermination()
    return _shown(spark.read.parquet(f"{where}/out"))


@query(f"""WITH RECURSIVE {FULL}, l AS (SELECT *, lag(confirmed) OVER w AS was_confirmed, lag(missed) OVER w AS was_missed, lag(frame) OVER w AS was, lead(frame) OVER w AS nxt, max(frame) OVER (PARTITION BY video) AS last_frame
  FROM states WINDOW w AS (PARTITION BY video, epoch, track_id ORDER BY frame)), e AS (
SELECT *, 'track_created' AS name, frame AS happened FROM l WHERE was IS NULL UNION ALL SELECT *, 'track_confirmed', frame FROM l WHERE was IS NOT NULL AND NOT was_confirmed AND confirmed
UNION ALL SELECT *, 'track_recovered', frame FROM l WHERE was_missed > 0 AND missed = 0 UNION ALL SELECT *, 'track_ended', frame + 1 FROM l WHERE nxt IS NULL AND frame < last_frame)
SELECT video, epoch, CAST(track_id AS INTEGER) AS track_id, happened AS frame, name, label, recoveries FROM e""")
def track_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.events(_tracked(spark, d)).select("video", "epoch", "track_id", "frame", "name", "label", "recoveries")


#: Confirmed, observed states on frames with a detector pass, that have an appearance; an epoch counts as a video.
OBSERVED = f"""o AS (
  SELECT s.* EXCLUDE (video), video || '/' || epoch AS video, coalesce(nullif(last_score, 0), score) AS seen,
    greatest(0.0{D}, least(1.0{D}, least(1.0{D}, hits / 8.0{D}) * 0.35{D} + greatest(0.0{D}, least(1.0{D}, coalesce(nullif(last_score, 0), score))) * 0.65{D})) / (1.0{D} + missed * 0.35{D}) * CASE WHEN confirmed THEN 1.0{D} ELSE 0.72{D} END AS quality
  FROM states s WHERE confirmed AND missed = 0 AND look IS NOT NULL AND frame % 6 <> 0
)"""
LIKE = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, " + _dot("k", "x[1]") + " / (sqrt(" + _dot("k", "k") + ") * sqrt(" + _dot("x[1]", "x[1]") + "))))"


def _sum(i: int) -> str:
    return f"list_sum(list_transform(all_, lambda v: v[{i}]))"


@query(f"""WITH RECURSIVE {FULL}, {OBSERVED}, g AS (
  SELECT video, track_id, arg_min(class_id, frame) AS class_id, arg_min(label, frame) AS label, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS observations, avg(seen) AS mean_score, avg(quality) AS mean_quality,
    (list(frame ORDER BY seen * 0.65{D} + quality * 0.35{D} DESC, frame))[1] AS best_frame, list(look ORDER BY frame) AS all_ FROM o GROUP BY ALL HAVING count(*) >= 2
), n AS (SELECT *, [{", ".join(_sum(i) for i in range(1, 5))}] AS total, list_reduce(list_transform(all_, lambda v: [v]), lambda acc, x: CASE WHEN len(acc) >= 6 OR len(list_filter(acc, lambda k: {LIKE} >= 0.985{D})) > 0 THEN acc ELSE list_concat(acc, x) END) AS gallery FROM g)
SELECT video, CAST(track_id AS INTEGER) AS local_track_id, class_id, label, first_frame, last_frame, observations, {rsql("mean_score", 4)} AS mean_score, {rsql("mean_quality", 4)} AS mean_quality, best_frame, 30.0{D} AS fps,
  {rsql(f"total[1] / sqrt({_dot('total', 'total')})", 4)} AS d1, {rsql(f"total[3] / sqrt({_dot('total', 'total')})", 4)} AS d3, CAST(len(gallery) AS INTEGER) AS kept, {rsql("gallery[-1][2]", 4)} AS last_kept FROM n""")
def tracklet_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Tracks to tracklets: descriptor, gallery, best frame, at least two observations. Each epoch counts as a video."""
    frames, found, motion = adapters.tracking(spark, d)
    states = cut(tracker.run_tracking(frames, found, motion), "states")
    named = lambda df: df.withColumn("video", F.concat("video", F.lit("/"), F.col("epoch").cast("string")))
    seen = frames.join(states.select("video", "frame", "epoch").distinct(), ["video", "frame"])
    rows = tracklets.summarize(observations(named(states), named(seen)), named(seen).groupBy("video").agg(F.max("fps").alias("fps")), 2)
    return rows.select(
        "video", "local_track_id", "class_id", "label", "first_frame", "last_frame", "observations", r("mean_score", 4).alias("mean_score"), r("mean_quality", 4).alias("mean_quality"), "best_frame", "fps",
        r(F.get("descriptor", F.lit(0)), 4).alias("d1"), r(F.get("descriptor", F.lit(2)), 4).alias("d3"), F.size("gallery").alias("kept"), r(F.get(F.element_at("gallery", -1), F.lit(1)), 4).alias("last_kept"),
    )


CLICKS = "(VALUES (0, 60.0::DOUBLE, 60.0::DOUBLE), (1, 250.0::DOUBLE, 90.0::DOUBLE)) c(seq, x, y)"


@query(f"""WITH RECURSIVE {tracker_sql(tracker.LITE, motion=False)}, hits AS (
  SELECT s.video, s.k, list(h.hit ORDER BY h.seq) AS clicks FROM spine s JOIN (
    SELECT f.video, f.frame, c.seq, coalesce(max(CASE WHEN c.x BETWEEN t.x1 AND t.x2 AND c.y BETWEEN t.y1 AND t.y2 THEN t.track_id END), -1) AS hit
    FROM (SELECT video, frame FROM spine WHERE frame % 9 = 4) f CROSS JOIN {CLICKS} LEFT JOIN states t ON t.video = f.video AND t.frame = f.frame GROUP BY f.video, f.frame, c.seq) h
  ON h.video = s.video AND h.frame = s.frame GROUP BY s.video, s.k
), living AS (SELECT video, frame, list(track_id) AS alive FROM states GROUP BY ALL),
steps AS (SELECT s.video, s.k, s.frame, coalesce(h.clicks, []) AS clicks, coalesce(l.alive, []) AS alive FROM spine s LEFT JOIN hits h ON h.video = s.video AND h.k = s.k LEFT JOIN living l ON l.video = s.video AND l.frame = s.frame),
lock AS (
  SELECT DISTINCT video, 0::BIGINT AS k, 0::BIGINT AS frame, -1::BIGINT AS held, CAST(NULL AS VARCHAR) AS event FROM spine
  UNION ALL
  SELECT video, k, frame, list_reduce(list_concat([kept], clicks), lambda a, h: CASE WHEN h = a THEN -1 ELSE h END), CASE WHEN len(clicks) > 0 THEN 'target_lock' WHEN lost THEN 'target_lost' END
  FROM (SELECT *, CASE WHEN lost THEN -1 ELSE held END AS kept FROM (SELECT l.held, s.*, l.held >= 0 AND NOT list_contains(s.alive, l.held) AS lost FROM lock l JOIN steps s ON s.video = l.video AND s.k = l.k + 1))
) SELECT video, frame, CAST(held AS INTEGER) AS selected_id, coalesce(event, '') AS event FROM lock WHERE k > 0""")
def target_lock(spark: SparkSession, d: str) -> DataFrame:
    """Two clicks on every ninth frame select, let go of, or miss tracks of the mobile profile."""
    frames, found, _ = adapters.tracking(spark, d)
    states = tracker.run_tracking(frames, found, None, tracker.LITE)
    points = F.array(*(F.struct(F.lit(i).cast("bigint").alias("seq"), F.lit(x).alias("x"), F.lit(y).alias("y")) for i, x, y in ((0, 60.0, 60.0), (1, 250.0, 90.0))))
    clicks = frames.filter("frame % 9 = 4").select("video", "frame", F.inline(points))
    found = selection.selected_tracks(states, frames, clicks)
    return found.select("video", "frame", F.coalesce("selected_id", F.lit(-1)).alias("selected_id"), F.coalesce("event", F.lit("")).alias("event"))


@query(f"""WITH RECURSIVE {DETECTIONS}, chosen AS (
  SELECT 'o' || CAST(floor(frame / 300.0{D}) AS BIGINT) AS video, frame, row_number() OVER (PARTITION BY floor(frame / 300.0{D}) ORDER BY frame) AS k, class_id AS track_id, x1, y1, x2, y2, frame % 4 = 0 AS fresh,
    [1.0{D}, 0.02{D}, CAST(frame % 5 AS DOUBLE), -0.02{D}, 1.0{D}, 2.0{D}] AS affine, frame % 7 AS inliers, 0.40{D} + (frame % 3) * 0.1{D} AS ratio FROM detections WHERE det_idx = 0
), fold AS (
  SELECT *, false AS refined FROM chosen WHERE k = 1
  UNION ALL
  SELECT c.video, c.frame, c.k, c.track_id, {", ".join(f"CASE WHEN use THEN {f}({', '.join(f'c.affine[{3 * row + 1}] * {x} + c.affine[{3 * row + 2}] * {y} + c.affine[{3 * row + 3}]' for x in ('f.x1', 'f.x2') for y in ('f.y1', 'f.y2'))}) ELSE c.{v} END" for v, f, row in (("x1", "least", 0), ("y1", "least", 1), ("x2", "greatest", 0), ("y2", "greatest", 1)))},
    c.fresh, c.affine, c.inliers, c.ratio, use FROM (SELECT c0.*, c0.inliers >= 6 AND c0.ratio >= 0.45{D} AND NOT c0.fresh AS open FROM chosen c0) c JOIN fold f ON f.video = c.video AND c.k = f.k + 1, LATERAL (SELECT c.open AND c.track_id = f.track_id AS use)
) SELECT video, frame, track_id, {", ".join(f"{rsql(v, 3)} AS {v}" for v in BOX)}, refined FROM fold""")
def refined_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Each order's first line as the selected track: estimates that pass the gate move its box between fresh frames."""
    frame = F.col("frame")
    rows = adapters.detections(spark, d).filter("det_idx = 0").withColumn("video", F.concat(F.lit("o"), F.floor(frame / 300).cast("string")))
    selected = rows.select("video", "frame", F.col("class_id").alias("track_id"), *BOX, (frame % 4 == 0).alias("fresh"))
    affine = F.array(F.lit(1.0), F.lit(0.02), (frame % 5).cast("double"), F.lit(-0.02), F.lit(1.0), F.lit(2.0))
    estimates = rows.select("video", "frame", affine.alias("affine"), (frame % 7).alias("inliers"), (F.lit(0.40) + (frame % 3) * 0.1).alias("ratio"))
    return selection.refined_boxes(selected, estimates).select("video", "frame", "track_id", *(r(v, 3).alias(v) for v in BOX), "refined")


@query(f"""SELECT f AS frame, {rsql("sin(f * 0.02" + D + ") * 2.0" + D)} AS dx, {rsql("cos(f * 0.018" + D + ")")} AS dy, true AS valid FROM range(3000) t(f)""")
def synthetic_motion(spark: SparkSession, d: str) -> DataFrame:
    return generators.synthetic_motion(spark).select("frame", r("dx").alias("dx"), r("dy").alias("dy"), "valid")


@query(f"""WITH t AS (SELECT f AS frame, f / 30.0{D} AS t FROM range(600) x(f)), b AS (
  SELECT frame, 0 AS det_idx, 'car' AS label, 2 AS class_id, 0.93{D} AS score, 220 + sin(t * 0.9{D}) * 120 AS cx, 240 + cos(t * 0.6{D}) * 50 AS cy, 170 AS w, 90 AS h FROM t
  UNION ALL SELECT frame, 1, 'person', 0, 0.88{D}, 650 + sin(t * 0.5{D} + 1.2{D}) * 160, 380 + cos(t * 0.8{D}) * 110, 75, 170 FROM t WHERE frame % 120 NOT BETWEEN 78 AND 85
  UNION ALL SELECT frame, 2, 'airplane', 4, 0.84{D}, 510 + sin(t * 0.32{D}) * 300, 115 + cos(t * 0.4{D}) * 38, 210, 70 FROM t)
SELECT frame, det_idx, label, class_id, score, {rsql(f"cx - w / 2.0{D}", 4)} AS x1, {rsql(f"cy + h / 2.0{D}", 4)} AS y2 FROM b""")
def demo_detections(spark: SparkSession, d: str) -> DataFrame:
    return generators.demo_detections(spark).select("frame", "det_idx", "label", "class_id", "score", r("x1", 4).alias("x1"), r("y2", 4).alias("y2"))


@query(f"""WITH {DETECTIONS}, f AS (SELECT DISTINCT frame FROM detections) SELECT CAST(floor(frame / 300.0{D}) AS BIGINT) AS v, max(frame) AS frame FROM f GROUP BY 1""")
def latest_frames(spark: SparkSession, d: str) -> DataFrame:
    """The newest frame of each video of a micro-batch."""
    frames, *_ = adapters.tracking(spark, d)
    return live.latest_frames(frames).select(F.substring("video", 2, 20).cast("bigint").alias("v"), "frame")


@query(f"""WITH {DETECTIONS}, b AS (SELECT *, (x1 + x2) * 0.5{D} + 3 AS cx, (y1 + y2) * 0.5{D} - 4 AS cy, CAST(frame % 200 AS DOUBLE) + 100 AS view_w, CAST(frame % 150 AS DOUBLE) + 100 AS view_h FROM detections),
w AS (SELECT *, view_w / greatest(1, view_h) > 480.0{D} / 270.0{D} AS wide FROM b),
f AS (SELECT *, CASE WHEN wide THEN view_h * (480.0{D} / 270.0{D}) ELSE view_w END AS draw_w, CASE WHEN wide THEN view_h ELSE view_w / (480.0{D} / 270.0{D}) END AS draw_h FROM w),
l AS (SELECT *, CASE WHEN wide THEN (view_w - draw_w) / 2 ELSE 0 END AS left_, CASE WHEN wide THEN 0 ELSE (view_h - draw_h) / 2 END AS top_ FROM f)
SELECT frame, det_idx, {rsql("cx", 4)} AS shifted_x, {rsql("left_ + cx / 480.0" + D + " * (left_ + draw_w - left_)", 4)} AS shown_x, {rsql("top_ + cy / 270.0" + D + " * (top_ + draw_h - top_)", 4)} AS shown_y,
  cx BETWEEN left_ AND left_ + draw_w AND cy BETWEEN top_ AND top_ + draw_h AS inside, {rsql("sqrt(x1 * x1 + y1 * y1)", 4)} AS speed FROM l""")
def display_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Shifted boxes, the fit of a source into a view, points mapped into it, and speed."""
    box = G.shift(G.Box.of(), F.lit(3.0), F.lit(-4.0))
    cx, cy = G.center(box)
    shown = G.fit_center((F.col("frame") % 200).cast("double") + 100, (F.col("frame") % 150).cast("double") + 100, F.lit(480.0), F.lit(270.0))
    x, y = G.map_point(cx, cy, F.lit(480.0), F.lit(270.0), shown)
    return adapters.detections(spark, d).select("frame", "det_idx", r(cx, 4).alias("shifted_x"), r(x, 4).alias("shown_x"), r(y, 4).alias("shown_y"), G.contains(shown, cx, cy).alias("inside"), r(T.speed(F.col("x1"), F.col("y1")), 4).alias("speed"))


@query(f"""WITH {DETECTIONS}, s AS (SELECT frame, det_idx, (x1 + x2) * 0.5{D} * 2 AS cx, (y1 + y2) * 0.5{D} * 2 AS cy, (x2 - x1) * 2 AS w, (y2 - y1) * 2 AS h FROM detections),
a AS (SELECT *, (cx - 480.0{D}) / 480.0{D} * 35.0{D} AS yaw, -((cy - 270.0{D}) / 270.0{D}) * 20.0{D} AS pitch, w / 960.0{D} * 70.0{D} AS aw, h / 540.0{D} * 40.0{D} AS ah FROM s)
SELECT frame, det_idx, printf('YAW      %+6.2f deg EST', yaw) AS yaw, printf('PITCH    %+6.2f deg EST', pitch) AS pitch, printf('ANG SIZE %5.2fx%5.2f deg', aw, ah) AS size FROM a""")
def calibrated_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The overlay's lines for a camera that was calibrated at twice the size."""
    box = G.Box.of()
    lines = T.calibrated_lines(*G.center(box), G.width(box), G.height(box), *(F.lit(v) for v in (480.0, 270.0, 960.0, 540.0, 70.0, 40.0)))
    return adapters.detections(spark, d).select("frame", "det_idx", lines.alias("l")).select("frame", "det_idx", *(F.col("l")[i].alias(c) for i, c in enumerate(("yaw", "pitch", "size"))))




SINGLE = "::FLOAT"


def _extent(lo: str, hi: str) -> str:
    return f"greatest(0.0{SINGLE}, {hi} - {lo})"


def _area(v: str) -> str:
    return f"({_extent(f'{v}.x1', f'{v}.x2')} * {_extent(f'{v}.y1', f'{v}.y2')})"


SHARED = f"({_extent('greatest(a.x1, b.x1)', 'least(a.x2, b.x2)')} * {_extent('greatest(a.y1, b.y1)', 'least(a.y2, b.y2)')})"


@query(f"""WITH {DETECTIONS}, f AS (SELECT frame, det_idx, {", ".join(f"CAST({v} / 3 AS FLOAT) AS {v}" for v in BOX)} FROM detections)
SELECT a.frame, a.det_idx, {rsql(f"CAST({SHARED} / greatest({_area('a')} + {_area('b')} - {SHARED}, 1e-6{SINGLE}) AS DOUBLE)", 5)} AS iou FROM f a JOIN f b ON b.frame = a.frame AND b.det_idx = a.det_idx + 1""")
def single_precision_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of neighbouring detections, in single precision."""
    rows = adapters.detections(spark, d).select("frame", "det_idx", *((F.col(v) / 3).cast("float").alias(v) for v in BOX))
    after = rows.select("frame", (F.col("det_idx") - 1).alias("det_idx"), *(F.col(v).alias(f"n_{v}") for v in BOX))
    return rows.join(after, ["frame", "det_idx"]).select("frame", "det_idx", r(G.iou32(G.Box.of(), G.Box.of("n_")).cast("double"), 5).alias("iou"))


@query(f"""WITH k AS (SELECT 'u' || user_id AS video, event_id AS frame, ts, ['e', 'm', 'z', 'r', 's', 'u'][1 + event_id % 6] AS key, CASE WHEN event_id % 4 > 0 THEN CAST(event_id % 50 AS INTEGER) END AS selected_id FROM events),
t AS (SELECT *, count(*) OVER (PARTITION BY video, key ORDER BY frame) AS times, printf('T%03d-', selected_id) || strftime(ts, '%Y%m%d-%H%M%S') AS stem FROM k), on_ AS (SELECT *, CASE WHEN times % 2 = 1 THEN 'true' ELSE 'false' END AS flag FROM t)
SELECT video, frame, 'enhance' AS name, '{{"enabled":' || flag || '}}' AS data FROM on_ WHERE key = 'e' UNION ALL SELECT video, frame, 'stabilize', '{{"enabled":' || flag || '}}' FROM on_ WHERE key = 'z'
UNION ALL SELECT video, frame, 'view_mode', '{{"mode":"' || ['normal', 'clarity', 'lowlight', 'edges', 'pseudo-thermal'][1 + times % 5] || '"}}' FROM t WHERE key = 'm' UNION ALL SELECT video, frame, 'tracker_reset', '{{}}' FROM t WHERE key = 'r'
UNION ALL SELECT video, frame, 'snapshot', '{{"track_id":' || selected_id || ',"path":"' || stem || '.png"}}' FROM t WHERE key IN ('s', 'u') AND selected_id IS NOT NULL
UNION ALL SELECT video, frame, 'ai_upscale', '{{"track_id":' || selected_id || ',"path":"' || stem || '-x4.png"}}' FROM t WHERE key = 'u' AND selected_id IS NOT NULL""")
def control_events(spark: SparkSession, d: str) -> DataFrame:
    """An event is a key: what an operator turns on and off, resets and saves, as session events."""
    e, n = adapters.table(spark, d, "events"), F.col("event_id")
    key = F.element_at(F.array(*(F.lit(x) for x in "emzrsu")), (n % 6 + 1).cast("int"))
    keys = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video"), n.alias("frame"), F.lit(0).alias("seq"), "ts", key.alias("key"), F.when(n % 4 > 0, (n % 50).cast("int")).alias("selected_id"))
    return selection.control_events(keys, upscaler=True).drop("seq")


@query("SELECT 'u' || user_id AS video, count(*) AS frames, count(*) FILTER (event_id % 13 = 7) + 1 AS open_count, count(*) FILTER (event_id % 13 = 7) AS reconnects FROM events GROUP BY 1")
def capture_summary(spark: SparkSession, d: str) -> DataFrame:
    e = adapters.table(spark, d, "events")
    return reports.capture_summary(e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video"), (F.col("event_id") % 13 == 7).alias("reconnected")))


@query("""WITH f AS (SELECT 'a' AS run, r_regionkey AS place, r_name AS video, 'no frames' AS error FROM region UNION ALL SELECT 'b', r_regionkey, r_name, CASE WHEN r_regionkey > 0 THEN 'no frames' END FROM region)
SELECT run, CASE WHEN bool_and(error IS NOT NULL) THEN 'all input videos failed: ' || string_agg(video || ': ' || error, '; ' ORDER BY place) FILTER (place < 3) ELSE '' END AS message FROM f GROUP BY run""")
def failure_messages(spark: SparkSession, d: str) -> DataFrame:
    """If all videos fail, the first three failures make the message."""
    rows = adapters.table(spark, d, "region").select(F.col("r_regionkey").alias("place"), F.col("r_name").alias("video"))
    runs = {"a": F.lit("no frames"), "b": F.when(F.col("place") > 0, "no frames")}
    found = [reports.failure_message(rows.withColumn("error", e)).select(F.lit(k).alias("run"), F.coalesce("message", F.lit("")).alias("message")) for k, e in runs.items()]
    return found[0].unionByName(found[1])


@query("SELECT n_nationkey AS id, ['NORMAL', 'thermal', 'Edges', '', 'pseudo-thermal'][1 + n_nationkey % 5] AS mode, n_nationkey % 5 IN (0, 2, 4) AS accepted FROM nation")
def checked_modes(spark: SparkSession, d: str) -> DataFrame:
    names = ("NORMAL", "thermal", "Edges", "", "pseudo-thermal")
    known = {}
    for m in names:
        try:
            known[m] = bool(selection.check_mode(m))
        except ValueError:
            known[m] = False
    n = F.col("n_nationkey")
    mode = F.element_at(F.array(*(F.lit(m) for m in names)), (n % 5 + 1).cast("int"))
    good = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return adapters.table(spark, d, "nation").select(n.alias("id"), mode.alias("mode")).withColumn("accepted", good[F.col("mode")])
