"""The tracker's cases, and its laws on random inputs."""

import numpy as np
import pytest

from trackframe.operators.tracker import LITE, N, TrackerConfig, Tracks, moved, overlap, run_tracking
from trackframe.schemas import DETECTIONS, FRAMES, MOTION
from trackframe.sources import generators


def found(*boxes, score=0.9, kind=0, looks=None):
    boxes = np.array(boxes, float).reshape(-1, 4)
    n = len(boxes)
    return {"boxes": boxes, "scores": np.full(n, score), "classes": np.full(n, float(kind)), "labels": [f"c{kind}"] * n, "looks": looks or [None] * n}


def square(x, y, size=100):
    return (x, y, x + size, y + size)


def ids(t):
    return t.column("track_id").astype(int).tolist()


def test_iou():
    a, b = np.array([square(0, 0)], float), np.array([square(50, 0), square(0, 0), square(500, 500)], float)
    assert overlap(a, b)[0] == pytest.approx([1 / 3, 1, 0])


def test_id_is_stable_and_confirmed():
    t = Tracks(TrackerConfig())
    for i in range(10):
        t.step(found(square(7 * i, 0)))
    assert ids(t) == [1] and t.column("confirmed")[0] == 1 and t.column("hits")[0] == 10


def test_dropout_recovers():
    t = Tracks(TrackerConfig(min_hits=1))
    for boxes in ([square(0, 0)], [], [], [square(35, 0)]):
        t.step(found(*boxes))
    assert ids(t) == [1] and t.column("recoveries")[0] == 1 and t.column("missed")[0] == 0


def test_classes_do_not_match():
    t = Tracks(TrackerConfig(min_hits=1))
    t.step(found(square(0, 0)))
    t.step(found(square(0, 0), kind=1))
    assert ids(t) == [1, 2]


def test_low_scores_extend_but_do_not_spawn():
    t = Tracks(TrackerConfig(min_hits=1))
    t.step(found(square(0, 0), score=0.2))
    assert ids(t) == []
    t.step(found(square(0, 0)))
    t.step(found(square(5, 0), score=0.2))
    assert ids(t) == [1] and t.column("hits")[0] == 2


def test_camera_motion_leaves_no_velocity():
    t = Tracks(TrackerConfig(min_hits=1))
    t.step(found(square(0, 0)))
    t.step(found(square(20, 0)), motion=(20.0, 0.0))
    assert abs(t.column("vx")[0]) < 1e-9
    t.step(found(square(45, -8)), affine=[1, 0, 25, 0, 1, -8])
    assert abs(t.column("vx")[0]) < 1e-9 and abs(t.column("vy")[0]) < 1e-9


def test_rotation_hull():
    assert moved(np.array([[0, 0, 10, 20]], float), (0, 0), [0, -1, 0, 1, 0, 0])[0].tolist() == [-20, 0, 0, 10]


def test_tentative_expires_early_and_confirmed_late():
    t = Tracks(TrackerConfig())
    t.step(found(square(0, 0)))
    for _ in range(3):
        t.step(found())
    assert ids(t) == []
    t = Tracks(TrackerConfig(min_hits=1))
    t.step(found(square(0, 0)))
    for _ in range(14):
        t.step(found())
    assert ids(t) == [1]
    t.step(found())
    assert ids(t) == []


def test_skipped_frames_predict_without_a_miss():
    t = Tracks(TrackerConfig(min_hits=1))
    t.step(found(square(100, 0)))
    t.step(found(), motion=(5.0, 0.0), detect=False)
    assert t.column("missed")[0] == 0 and t.column("age")[0] == 2
    assert (t.column("x1")[0] + t.column("x2")[0]) / 2 == 155.0


def test_appearance_decides_swapped_boxes():
    one, two = [1.0] + [0.0] * 7, [0.0] * 7 + [1.0]
    t = Tracks(TrackerConfig(min_hits=1))
    t.step(found(square(0, 0), square(30, 0), looks=[one, two]))
    t.step(found(square(0, 0), square(30, 0), looks=[two, one]))
    first = t.looks[ids(t).index(1)]
    assert first[0] > 0.9


def test_crossing_keeps_ids():
    t = Tracks(TrackerConfig(min_hits=1))
    for i in range(12):
        t.step(found(square(20 * i, 0, 40), square(400 - 20 * i, 60, 40)))
    assert ids(t) == [1, 2] and t.column("x1").tolist() == [220, 180]


def test_bad_thresholds():
    with pytest.raises(ValueError):
        TrackerConfig(low_conf=0.5, high_conf=0.4)


def test_state_survives_json():
    t = Tracks(TrackerConfig(min_hits=1))
    t.step(found(square(0, 0), square(300, 0), looks=[[1.0, 0.0], None]))
    u = Tracks.from_json(t.to_json(), t.config)
    for x in (t, u):
        x.step(found(square(10, 0)))
    assert np.array_equal(t.table, u.table) and t.looks == u.looks


def test_lite_spawns_everything():
    t = Tracks(LITE)
    t.step(found(square(0, 0), square(500, 0), score=0.05))
    assert ids(t) == [1, 2]
    for _ in range(11):
        t.step(found())
    assert ids(t) == []


def test_laws_on_random_frames():
    rng = np.random.default_rng(7)
    for config in (TrackerConfig(), LITE):
        t, last = Tracks(config), 0
        for _ in range(120):
            n = int(rng.integers(0, 9))
            corner = rng.uniform(0, 400, (n, 2))
            f = found(*np.concatenate([corner, corner + rng.uniform(20, 90, (n, 2))], axis=1))
            f["scores"], f["classes"] = rng.uniform(0, 1, n), rng.integers(0, 2, n).astype(float)
            before = len(ids(t))
            t.step(f, (float(rng.normal()), 0.0), None, bool(rng.random() < 0.8))
            assert ids(t) == sorted(set(ids(t)))
            assert (t.column("missed") <= config.max_missed).all()
            assert len(ids(t)) <= before + n
            assert max(ids(t), default=0) >= 0 and t.next_id > last - 1
            last = t.next_id


def test_batch_frames_without_detections_coast_and_resets_begin_anew(spark):
    frames = spark.createDataFrame([("v", i, 30.0, 640, 480, True, i == 4) for i in range(1, 7)], FRAMES)
    det = spark.createDataFrame([("v", i, 0, 10.0 * i, 0.0, 10.0 * i + 50, 50.0, 0.9, 0, "person", None) for i in (1, 2, 5, 6)], DETECTIONS)
    motion = spark.createDataFrame([("v", 2, 99.0, 0.0, None, False)], MOTION)
    rows = run_tracking(frames, det, motion, TrackerConfig(min_hits=1)).orderBy("frame").collect()
    assert [(r.epoch, r.frame, r.track_id, r.missed) for r in rows] == [(0, 1, 1, 0), (0, 2, 1, 0), (0, 3, 1, 1), (1, 5, 1, 0), (1, 6, 1, 0)]
    assert run_tracking(frames, det, None, TrackerConfig(min_hits=1), labels="car").count() == 0
    assert run_tracking(frames.limit(0), det.limit(0)).count() == 0


def test_synthetic_load(spark):
    states = run_tracking(generators.synthetic_frames(spark, 90), generators.synthetic_detections(spark, 90), generators.synthetic_motion(spark, 90), TrackerConfig(min_hits=1))
    assert states.select("track_id").distinct().count() <= 34
    assert generators.synthetic_detections(spark).count() == 95_762
    assert generators.demo_detections(spark, 120).count() == 3 * 120 - 8
    assert N["track_id"] == 0
