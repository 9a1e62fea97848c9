"""Decoding, tracklets, graph, sessions, sources and functions against worked cases."""

import json
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.functions import tracks as T
from trackframe.functions.numbers import cosine, nearest_rank, rounded, unit
from trackframe.operators import decode, graph, lifecycle, reports, tracklets
from trackframe.operators.pixels import appearance
from trackframe.schemas import RAW_PREDICTIONS, REVIEWS, TRACKLETS
from trackframe.sources import config, files, sessions, sinks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_geometry(spark):
    box = G.Box(*(F.lit(float(v)) for v in (0, 0, 10, 20)))
    hull = G.transform(box, F.array(*(F.lit(float(v)) for v in (0, -1, 0, 1, 0, 0))))
    assert list(one(spark, *hull)) == [-20.0, 0.0, 0.0, 10.0]
    assert one(spark, G.iou(box, box))[0] == 1.0
    fit = G.fit_center(F.lit(200), F.lit(100), F.lit(100), F.lit(100))
    assert list(one(spark, *fit, *G.map_point(F.lit(50.0), F.lit(0.0), F.lit(100), F.lit(100), fit))) == [50.0, 0.0, 150.0, 100.0, 100.0, 0.0]
    lb = G.letterbox(F.lit(1280), F.lit(720), F.lit(640), F.lit(640))
    assert one(spark, lb["scale"], lb["new_h"], lb["pad_y"])[:] == (0.5, 360, 140)
    assert list(one(spark, *G.crop_bounds(box, 0.1, F.lit(100), F.lit(100)))) == [0, 0, 11, 22]
    assert one(spark, *G.crop_bounds(G.Box(*(F.lit(float(v)) for v in (200, 0, 210, 10))), 0.1, F.lit(100), F.lit(100)))[0] is None


def test_numbers(spark):
    assert list(one(spark, rounded(F.lit(0.125), 2), rounded(F.lit(-2.5), 0), nearest_rank(F.array(*(F.lit(float(v)) for v in (1, 2, 3, 4, 10)))))) == [0.13, -3.0, 10.0]
    assert one(spark, nearest_rank(F.array().cast("array<double>")))[0] == 0.0
    for n in (1, 2, 7, 20, 31, 240):
        values = [float(v) for v in range(n)]
        assert one(spark, nearest_rank(F.array(*map(F.lit, values))))[0] == values[min(n - 1, round((n - 1) * 0.95))]
    a, zero = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, cosine(a, a), cosine(a, zero), cosine(a, F.array(F.lit(1.0))), unit(a), unit(zero))[:] == (1.0, None, None, [0.6, 0.8], None)


def test_track_functions(spark):
    q = lambda *v: T.quality(*map(F.lit, v))
    got = one(spark, q(8, 0.9, 0.1, 0, True), q(8, 0.0, 0.9, 0, True), q(4, 0.8, 0.8, 1, False))
    assert got[0] == pytest.approx(0.35 + 0.65 * 0.9) and got[1] == got[0]
    assert got[2] == pytest.approx((0.175 + 0.52) / 1.35 * 0.72)
    life = lambda c, m: T.lifecycle(F.lit(c), F.lit(m))
    assert one(spark, life(False, 0), life(True, 1), life(True, 0))[:] == ("TENTATIVE", "PREDICTED", "TRACKED")
    assert one(spark, T.label_of(F.lit(0)), T.label_of(F.lit(79)), T.label_of(F.lit(80)), T.label_of(F.lit(-1)))[:] == ("person", "toothbrush", "class_80", "class_-1")
    assert one(spark, T.entity_prefix(F.lit("hot dog!")), T.entity_prefix(F.lit("?")), T.entity_prefix(F.lit("Person")))[:] == ("HOT_DOG", "OBJECT", "PERSON_APPEARANCE")
    w, h, fov = F.lit(1000), F.lit(500), F.lit(60.0)
    yaw, pitch = T.angular_offset(F.lit(1000.0), F.lit(0.0), w, h, fov, F.lit(30.0))
    assert one(spark, yaw, pitch)[:] == (30.0, 15.0)
    assert one(spark, T.hfov_of(F.lit(100.0), F.lit(200.0), F.lit(1.0), F.lit(1.0)), T.hfov_of(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(1.0)))[:] == (pytest.approx(90.0), None)
    cadence = [r[0] for r in spark.range(1, 7).select(T.should_detect(F.col("id"), profile="speed")).collect()]
    assert cadence == [True, False, False, True, False, False]


def raw(spark, rows, **over):
    size = {"input_w": 640, "input_h": 640, "frame_w": 640, "frame_h": 640, "scale": 1.0, "pad_x": 0.0, "pad_y": 0.0} | over
    return spark.createDataFrame([("v", 1, i, [float(x) for x in r], *size.values()) for i, r in enumerate(rows)], RAW_PREDICTIONS)


def test_suppression_and_normalised_boxes(spark):
    rows = [[100, 100, 50, 50, 0.9, 0.1, 0, 0], [102, 100, 50, 50, 0.8, 0.1, 0, 0], [300, 300, 40, 40, 0.1, 0.7, 0, 0]]
    out = decode.decode(raw(spark, rows), 0.25, 0.5, ["a", "b", "c", "d"]).orderBy("det_idx").collect()
    assert [(r.label, round(r.score, 3)) for r in out] == [("a", 0.9), ("b", 0.7)]
    out = decode.decode(raw(spark, [[0.5, 0.5, 0.5, 0.5, 0.9, 0, 0, 0]]), 0.25, 0.5, ["a", "b", "c", "d"]).first()
    assert (out.x1, out.y1, out.x2, out.y2) == (160, 160, 480, 480)


def test_end_to_end_layout(spark):
    seven = [[0, 10, 10, 60, 60, 0.9, 2], [0, 10, 10, 60, 60, 0.8, 2], [0, 700, 10, 800, 60, 0.8, 1]]
    frame = raw(spark, seven)
    assert decode.looks_end_to_end(frame, 80).first().end2end
    assert not decode.looks_end_to_end(frame, 2).first().end2end
    out = decode.decode(frame, 0.25, 0.5).collect()  # the last one has no area within the frame
    assert [(r.label, r.x1, r.x2) for r in out] == [("car", 10, 60)]
    assert not decode.looks_end_to_end(raw(spark, [[1, 1, 2, 2, 5, 1]]), 80).first().end2end
    lite = decode.decode(raw(spark, [[100, 100, 50, 50, 0.9, 0.1], [100, 100, 50, 50, 0.9, 0.1]]), 0.25, 0.5, ["a", "b"], lite=True).collect()
    assert len(lite) == 1


def tracklet(video, number, descriptor, kind=2, label="car", gallery=None):
    return (video, number, kind, label, 10, 40, 8, 0.9, 0.85, 24, 30.0, descriptor, None, gallery)


def graph_of(spark, rows, reviews=()):
    t = spark.createDataFrame(rows, TRACKLETS)
    w = spark.createDataFrame(list(reviews), REVIEWS) if reviews else None
    edges = graph.ordered(graph.edges(t, w)).collect()
    groups = {}
    for r in graph.entities(t, w).orderBy("entity_id", "position").collect():
        groups.setdefault(r.entity_id, []).append(r.member)
    return edges, groups


def test_graph_cases(spark):
    near, far = [1.0, 0.05], [0.05, 1.0]
    edges, groups = graph_of(spark, [tracklet("a", 1, [1.0, 0.0]), tracklet("b", 1, near), tracklet("b", 2, far), tracklet("c", 1, [1.0, 0.0], kind=0, label="person")])
    assert [(e.left, e.right, e.strength) for e in edges] == [("a#T1", "b#T1", "strong")]
    assert groups == {"CAR_001": ["a#T1", "b#T1"], "CAR_002": ["b#T2"], "PERSON_APPEARANCE_001": ["c#T1"]}
    edges, groups = graph_of(spark, [tracklet("a", 1, [1.0, 0.0]), tracklet("a", 2, [1.0, 0.0])])
    assert not edges and len(groups) == 2
    review = [1.0, 0.45]
    edges, groups = graph_of(spark, [tracklet("a", 1, [1.0, 0.0]), tracklet("b", 1, review)])
    assert [e.strength for e in edges] == ["review"] and len(groups) == 2


def test_complete_link_refuses_chains(spark):
    at = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    _, groups = graph_of(spark, [tracklet("a", 1, at(0)), tracklet("b", 1, at(18)), tracklet("c", 1, at(36))])
    assert sorted(map(len, groups.values())) == [1, 2]


def test_reviews(spark):
    rows = [tracklet("a", 1, [1.0, 0.0]), tracklet("b", 1, [1.0, 0.0])]
    edges, groups = graph_of(spark, rows, [("a#T1", "b#T1", "different")])
    assert edges[0].strength == "manual" and len(groups) == 2
    far = [tracklet("a", 1, [1.0, 0.0]), tracklet("b", 1, [0.0, 1.0]), tracklet("b", 2, [0.0, 1.0])]
    edges, groups = graph_of(spark, far, [("b#T1", "a#T1", "same"), ("b#T1", "b#T2", "same")])
    assert {e.strength for e in edges} == {"manual"} and sorted(map(len, groups.values())) == [1, 2]
    _, groups = graph_of(spark, rows, [("a#T1", "b#T1", "unsure")])
    assert len(groups) == 1
    with pytest.raises(ValueError):
        graph.edges(spark.createDataFrame(rows, TRACKLETS), candidate=0.9, strong=0.8)


def test_gallery_beats_the_mean(spark):
    front, side = [1.0, 0.0], [0.0, 1.0]
    rows = [tracklet("a", 1, [1.0, 1.0], gallery=[front, side]), tracklet("b", 1, front, gallery=[front])]
    edges, _ = graph_of(spark, rows)
    assert edges[0].similarity == pytest.approx(0.7 * 1.0 + 0.3 * math.sqrt(0.5), abs=1e-6)


def test_graph_document_and_page(spark):
    t = spark.createDataFrame([tracklet("<a>", 1, [1.0, 0.0]), tracklet("b", 1, [1.0, 0.0])], TRACKLETS)
    doc = graph.document(t)
    assert doc["entities"][0]["members"][0]["end_s"] == 1.333 and len(doc["edges"]) == 1
    page = sinks.graph_html(doc)
    assert "&lt;a&gt;" in page and "<a>#" not in page and "exportReview" in page
    ends = graph.with_endpoints(graph.edges(t), t).first()
    assert ends.left_video == "<a>" and ends.right_last_frame == 40


def test_tracklets(spark):
    rows = [Row(video="v", track_id=1, frame=f, class_id=2, label=l, score=s, quality=0.5, descriptor=d) for f, l, s, d in (
        (1, "car", 0.9, None), (2, "bus", 0.5, [1.0, 0.0]), (3, "bus", 0.8, [1.0, 0.01]), (4, "bus", 0.8, [0.0, 1.0]), (5, "bus", 0.99, [1.0]))]
    t = tracklets.summarize(spark.createDataFrame(rows, "video string, track_id int, frame bigint, class_id int, label string, score double, quality double, descriptor array<double>")).first()
    assert (t.label, t.first_frame, t.last_frame, t.observations, t.best_frame, len(t.gallery)) == ("car", 1, 4, 3, 3, 2)
    assert t.mean_score == pytest.approx(0.7) and math.hypot(*t.descriptor) == pytest.approx(1.0)


LOG = [
    {"type": "header", "version": 1, "started_unix": 1.0, "metadata": {"source": "x"}},
    {"type": "frame", "frame": 1, "t": 0.1, "fps": 20.0, "timings_ms": {"detect": 10.0}, "tracks": [{"id": 1, "label": "car", "bbox": [0, 0, 1, 1], "center": [0.5, 0.5], "missed": 0, "confirmed": True, "quality": 0.9}]},
    {"type": "event", "t": 0.1, "name": "track_created", "data": {"track_id": 1}},
    {"type": "frame", "frame": 2, "t": 0.2, "fps": 30.0, "timings_ms": {"detect": 20.0}, "tracks": [{"id": 1, "label": "car", "bbox": [0, 0, 1, 1], "center": [0.5, 0.5], "missed": 1, "confirmed": True, "quality": 0.7, "recoveries": 1}]},
    {"type": "footer", "duration_s": 1.5},
]


def test_session_round(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n\n".join(json.dumps(x) for x in LOG) + "\n")
    rows = sessions.read_sessions(spark, str(tmp_path / "s.jsonl")).cache()
    flat = sessions.flat_tracks(rows)
    report = reports.session_report(rows, flat).first()
    assert (report.frames, report.duration_s, report.fps_avg, report.fps_p95, report.created, report.track_count) == (2, 1.5, 25.0, 30.0, 1, 1)
    assert report.timings_ms[0].ms_avg == 15.0
    track = report.tracks[0]
    assert (track.prediction_ratio, track.avg_quality, track.recoveries, track.frames_present) == (0.5, 0.8, 1, 2)
    assert sinks.write_flat_csv(flat, str(tmp_path / "out")) == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == list(sessions.FLAT)
    spine = spark.createDataFrame([(r[0], f) for r in rows.select("session").distinct().collect() for f in (1, 2, 3)], "session string, frame bigint")
    assert [(r.frame, r.id) for r in sessions.overlay_rows(spine, rows).orderBy("frame").collect()] == [(1, 1), (2, 1), (3, None)]


def test_reviews_file(spark, tmp_path):
    items = [{"left": "b", "right": "a", "decision": "SAME"}, {"left": "a", "right": "b", "decision": "different"}, {"left": "a", "decision": "same"}, {"left": "x", "right": "y", "decision": "maybe"}]
    (tmp_path / "r.json").write_text(json.dumps({"version": 1, "decisions": items}))
    got = sessions.read_reviews(spark, str(tmp_path / "r.json"))
    assert [tuple(r) for r in got.collect()] == [("a", "b", "different")]
    assert sinks.review_document(got)["decisions"] == [{"left": "a", "right": "b", "decision": "different"}]


def test_lifecycle_and_selection(spark):
    rows = [("v", 0, 1, f, "car", f > 1, m, 0, 0.0, 0.0, 10.0, 10.0) for f, m in ((1, 0), (2, 0), (3, 1), (4, 0))] + [("v", 0, 2, 6, "car", False, 0, 0, 5.0, 5.0, 20.0, 20.0)]
    s = spark.createDataFrame(rows, "video string, epoch int, track_id int, frame bigint, label string, confirmed boolean, missed int, recoveries int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.track_id, r.frame, r.name) for r in lifecycle.events(s).collect()}
    assert got == {(1, 1, "track_created"), (1, 2, "track_confirmed"), (1, 4, "track_recovered"), (1, 5, "track_ended"), (2, 6, "track_created")}
    wanted = spark.createDataFrame([("v", 4, 1), ("v", 5, 1), ("v", 6, None)], "video string, frame bigint, selected_id int")
    assert [r.frame for r in lifecycle.target_lost(s, wanted).collect()] == [5]
    assert [len(r.history) for r in lifecycle.trajectory(s, 2).filter("track_id = 1").orderBy("frame").collect()] == [1, 2, 2, 2]


def test_rolling_and_ema(spark):
    rows = spark.createDataFrame([("s", "detect", i, float(v)) for i, v in enumerate((1, 2, 3, 4, 10))], "session string, stage string, seq bigint, ms double")
    last = reports.rolling_stages(rows, 4).orderBy(F.desc("seq")).first()
    assert (last.latest, last.mean, last.p95) == (10.0, 4.75, 10.0)
    smooth = [r.ema for r in lifecycle.ema(rows, ("session",), "seq", "ms", 0.88).orderBy("seq").collect()]
    assert smooth[0] == 1.0 and smooth[1] == pytest.approx(0.88 + 0.24)
    move = spark.createDataFrame([("v", 1, 1.0, 0.0, 0.0), ("v", 2, 1.0, 0.0, 0.0)], "video string, frame bigint, dx double, dy double, da double")
    assert [r.corr_dx for r in lifecycle.stabilizer(move).orderBy("frame").collect()] == pytest.approx([0.18 - 1, 0.82 * 0.18 + 0.36 - 2])


def test_files(spark, tmp_path):
    for name in ("B.MP4", "a.webm", "a_trackframe.mp4", "analyzed.mov", "x.txt", "sub/c.avi"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"abc")
    names = lambda **k: [r.video for r in files.discover_videos(spark, str(tmp_path), **k).collect()]
    assert names() == ["a.webm", "B.MP4"]
    assert names(recursive=True, include_derived=True) == ["a.webm", "a_trackframe.mp4", "analyzed.mov", "B.MP4", "sub/c.avi"]
    with pytest.raises(FileNotFoundError):
        files.discover_videos(spark, str(tmp_path / "none"))
    sha = files.sha256_files(spark, str(tmp_path / "x.txt")).first().sha256
    assert sha.startswith("ba7816bf")
    assert one(spark, files.sha256_matches(F.lit(sha), F.lit(f" SHA256:{sha.upper()}")))[0]


def test_config(tmp_path):
    assert config.check_config({"profile": "speed", "conf": 1, "cpu": True})["conf"] == 1
    for bad in ({"nope": 1}, {"conf": True}, {"cpu": 1}, {"profile": "x"}, {"detect_every": -1}, []):
        with pytest.raises(ValueError):
            config.check_config(bad)
    assert all(config.check_config(p) for p in config.PRESETS.values())
    assert config.parse_source("0") == 0 and config.parse_source("a.mp4") == "a.mp4"
    cal = config.Calibration(1000, 500, 60.0)
    cal.save(str(tmp_path / "c.json"))
    assert config.Calibration.load(str(tmp_path / "c.json")) == cal
    with pytest.raises(ValueError):
        config.Calibration(0, 1, 60.0)


def test_appearance():
    import numpy as np

    image = np.zeros((40, 80, 3), np.uint8)
    image[:, :40, 2], image[:, 40:, 0] = 255, 255
    red, blue = appearance(image, (0, 0, 40, 40)), appearance(image, (40, 0, 80, 40))
    assert len(red) == 48 and np.dot(red, blue) < 0.01 and np.dot(red, red) == pytest.approx(1)
    assert appearance(image, (0, 0, 2, 2)) is None


def test_graph_descriptor():
    import numpy as np

    from trackframe.operators.pixels import graph_descriptor

    rng = np.random.default_rng(0)
    image = rng.integers(0, 255, (120, 160, 3)).astype(np.uint8)
    plain = np.full((120, 160, 3), 90, np.uint8)
    a, b, c = graph_descriptor(image, (10, 10, 110, 110)), graph_descriptor(np.clip(image.astype(int) + 1, 0, 255).astype(np.uint8), (10, 10, 110, 110)), graph_descriptor(plain, (10, 10, 110, 110))
    assert len(a) == 152 and np.dot(a, a) == pytest.approx(1) and np.dot(a, b) > 0.99 and np.dot(a, c) < 0.9
    assert graph_descriptor(image, (0, 0, 5, 5)) is None


def test_target_lock(spark):
    from trackframe.operators.selection import refined_boxes, selected_tracks

    box = "x1 double, y1 double, x2 double, y2 double"
    states = spark.createDataFrame([("v", f, t, 0.0, 0.0, 10.0, 10.0) for f, t in ((1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1))], f"video string, frame bigint, track_id int, {box}")
    frames = spark.createDataFrame([("v", f) for f in range(1, 6)], "video string, frame bigint")
    clicks = spark.createDataFrame([("v", 1, 1, 5.0, 5.0), ("v", 4, 1, 5.0, 5.0), ("v", 4, 2, 5.0, 5.0)], "video string, frame bigint, seq bigint, x double, y double")
    got = [tuple(r)[1:] for r in selected_tracks(states, frames, clicks).orderBy("frame").collect()]
    assert got == [(1, 2, "target_lock"), (2, 2, None), (3, None, "target_lost"), (4, None, "target_lock"), (5, None, None)]
    chosen = spark.createDataFrame([("v", f, t, 0.0, 0.0, 10.0, 10.0, f == 1) for f, t in ((1, 1), (2, 1), (3, 1), (4, 1), (5, 2))], f"video string, frame bigint, track_id int, {box}, fresh boolean")
    moves = spark.createDataFrame([("v", f, [1.0, 0.0, 5.0, 0.0, 1.0, 0.0], 20, 0.4 if f == 4 else 0.9) for f in range(1, 6)], "video string, frame bigint, affine array<double>, inliers int, ratio double")
    assert [(r.x1, r.refined) for r in refined_boxes(chosen, moves).orderBy("frame").collect()] == [(0.0, False), (5.0, True), (10.0, True), (0.0, False), (0.0, False)]


class Fake:
    """A detector that sees one box in every image; tensors lie on their side."""

    def __call__(self, image):
        import numpy as np

        rows = np.zeros((20, 7), np.float32)
        rows[3] = [320.25, 320, 100, 80, 0.1, 0.9, 0.2]
        return rows.T[None]


def test_frames_to_graph(spark, tmp_path):
    import numpy as np

    from trackframe.operators.detect import oriented, predict
    from trackframe.operators.tracker import TrackerConfig
    from trackframe.plans.analyze import analyze
    from trackframe.sources.frames import Capture, FrameSource

    for v in ("a", "b"):
        (tmp_path / v).mkdir()
        for n in range(6):
            (tmp_path / v / f"{n:03d}.rgb").write_bytes(np.full((48, 64, 3), 40 * n, np.uint8).tobytes())
    spark.dataSource.register(FrameSource)
    frames = spark.read.format("frames").option("path", str(tmp_path)).option("max_frames", 5).load().cache()
    assert frames.count() == 10
    found = decode.decode(predict(frames, Fake), 0.25, 0.5, ["a", "b", "c"]).withColumn("appearance", F.array(F.lit(1.0), F.lit(0.0)))
    result = analyze(frames, found, config=TrackerConfig(min_hits=1))
    assert [(r.video, r.observations, r.label) for r in result.tracklets.orderBy("video").collect()] == [("a", 5, "b"), ("b", 5, "b")]
    assert result.edges.first().strength == "strong" and result.entities.count() == 2
    summary = reports.run_summary(frames.select("video", F.lit(False).alias("failed")).distinct(), result.tracklets, result.entities, result.edges).first()
    assert (summary.videos_seen, summary.tracklets, summary.entities, summary.edges) == (2, 2, 1, 1)
    with pytest.raises(ValueError):
        oriented(np.zeros((3, 3)))
    with pytest.raises(ValueError):
        analyze(frames, found, min_observations=0)
    feed = iter([b"1", None, b"2", None, None, b"3"])
    camera = Capture(lambda: next(feed, None), camera=True, attempts=2)
    assert list(camera.frames()) == [(b"1", False), (b"2", True)] and camera.stats() == {"open_count": 3, "read_failures": 3, "reconnects": 2}
