"""The multi-object tracker: an ordered fold over the frames of a video.

One step takes a frame's detections and camera motion to the next set of tracks. A tracker's tracks are columns of one
numpy table, so a step is a few array operations however many tracks there are; association takes the whole table of
track-detection scores at once. Videos are independent: a batch is one group per video, a stream one state per video.

Ids go to new tracks in order of det_idx, and equal scores go to the higher track
id, then the higher det_idx. Resets start a new epoch, whose ids begin at 1 again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.functions.tracks import in_classes
from trackframe.schemas import TRACK_STATES


@dataclass(frozen=True)
class TrackerConfig:
    """The defaults are the full profile; LITE is the mobile one."""

    max_missed: int = 14
    min_iou: float = 0.10
    max_center_ratio: float = 1.9
    high_conf: float = 0.45
    low_conf: float = 0.12
    min_hits: int = 3
    iou_weight: float = 2.4
    score_weight: float = 0.15
    appearance_weight: float = 0.55
    velocity_keep: float = 0.62
    two_stage: bool = True
    confirms: bool = True

    def __post_init__(self) -> None:
        if not 0.0 <= self.low_conf <= self.high_conf <= 1.0:
            raise ValueError("low_conf and high_conf must be ordered within 0 and 1")


LITE = TrackerConfig(max_missed=10, min_iou=0.12, max_center_ratio=1.8, high_conf=0.0, low_conf=0.0, min_hits=1, iou_weight=2.2, score_weight=0.0, appearance_weight=0.0, velocity_keep=0.6, two_stage=False, confirms=False)

LOOSE_IOU, LOOSE_CENTER, APPEARANCE_BLEND, SHORTEST_DIAGONAL = 0.65, 1.25, 0.2, 24.0
NUMBERS = ("track_id", "class_id", "x1", "y1", "x2", "y2", "score", "last_score", "vx", "vy", "age", "hits", "missed", "confirmed", "recoveries")
N = {name: i for i, name in enumerate(NUMBERS)}
BOX = slice(N["x1"], N["y2"] + 1)


def middle(boxes: np.ndarray) -> np.ndarray:
    return (boxes[:, :2] + boxes[:, 2:]) * 0.5


def moved(boxes: np.ndarray, motion: tuple[float, float], affine: list[float] | None) -> np.ndarray:
    """Boxes after the camera's motion: the hull of the transformed corners, or a shift."""
    if affine is None:
        return boxes + np.tile(np.asarray(motion, float), 2)
    m = np.asarray(affine, float).reshape(2, 3)
    xs, ys = boxes[:, [0, 0, 2, 2]], boxes[:, [1, 3, 1, 3]]
    u, v = (r[0] * xs + r[1] * ys + r[2] for r in m)
    return np.stack([u.min(1), v.min(1), u.max(1), v.max(1)], axis=1)


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of all pairs."""
    side = lambda lo, hi: np.maximum(0.0, np.minimum(a[:, None, hi], b[None, :, hi]) - np.maximum(a[:, None, lo], b[None, :, lo]))
    area = lambda x: np.maximum(0.0, x[:, 2] - x[:, 0]) * np.maximum(0.0, x[:, 3] - x[:, 1])
    shared = side(0, 2) * side(1, 3)
    return shared / np.maximum(area(a)[:, None] + area(b)[None, :] - shared, 1e-6)


def length(x: np.ndarray) -> float:
    return float(np.sqrt(np.add.reduce(x * x)))


def alike(a: list[float] | None, b: list[float] | None) -> float | None:
    """Cosine within 0 and 1; None where there is none."""
    if a is None or b is None or len(a) != len(b) or not len(a):
        return None
    x, y = np.asarray(a, float), np.asarray(b, float)
    nx, ny = length(x), length(y)
    return min(1.0, max(0.0, float(np.add.reduce(x * y)) / (nx * ny))) if nx > 1e-12 and ny > 1e-12 else None


def blended(old: list[float] | None, new: list[float] | None) -> list[float] | None:
    if new is None or old is None or len(old) != len(new):
        return old if new is None else new
    x = np.asarray(old, float) * (1 - APPEARANCE_BLEND) + np.asarray(new, float) * APPEARANCE_BLEND
    size = length(x)
    return (x / size).tolist() if size > 1e-12 else new


class Tracks:
    """The tracks of one video: a table of numbers, and labels and appearances beside it."""

    def __init__(self, config: TrackerConfig) -> None:
        self.config, self.epoch, self.last_frame = config, 0, -(1 << 62)
        self.clear()

    def clear(self) -> None:
        self.next_id = 1
        self.table = np.zeros((0, len(NUMBERS)))
        self.labels: list[str] = []
        self.looks: list[list[float] | None] = []

    def column(self, name: str) -> np.ndarray:
        return self.table[:, N[name]]

    def to_json(self) -> str:
        return json.dumps({"epoch": self.epoch, "last_frame": self.last_frame, "next_id": self.next_id, "table": self.table.tolist(), "labels": self.labels, "looks": self.looks})

    @classmethod
    def from_json(cls, text: str, config: TrackerConfig) -> Tracks:
        out, data = cls(config), json.loads(text)
        for k in ("epoch", "last_frame", "next_id", "labels", "looks"):
            setattr(out, k, data[k])
        out.table = np.array(data["table"], float).reshape(-1, len(NUMBERS))
        return out

    def predicted(self, motion: tuple[float, float], affine: list[float] | None) -> np.ndarray:
        damping = np.maximum(0.25, 1.0 - 0.08 * self.column("missed"))
        drift = np.stack([self.column("vx") * damping, self.column("vy") * damping], axis=1)
        return moved(self.table[:, BOX], motion, affine) + np.tile(drift, 2)

    def _pairs(self, rows: np.ndarray, dets: np.ndarray, boxes: np.ndarray, found: dict, loose: bool) -> list[tuple[int, int]]:
        """One-to-one matches of some tracks and detections, best score first."""
        c = self.config
        if not len(rows) or not len(dets):
            return []
        min_iou, reach = c.min_iou * (LOOSE_IOU if loose else 1.0), c.max_center_ratio * (LOOSE_CENTER if loose else 1.0)
        now = self.table[rows][:, BOX]
        size = np.maximum(0, now[:, 2:] - now[:, :2])
        diagonal = np.maximum(np.sqrt(size[:, 0] * size[:, 0] + size[:, 1] * size[:, 1]), SHORTEST_DIAGONAL)
        gap = middle(found["boxes"][dets])[None, :, :] - middle(boxes[rows])[:, None, :]
        far = np.sqrt(gap[..., 0] * gap[..., 0] + gap[..., 1] * gap[..., 1]) / diagonal[:, None]
        iou = overlap(boxes[rows], found["boxes"][dets])
        score = iou * c.iou_weight + np.maximum(0.0, 1.0 - far / reach) + found["scores"][dets][None, :] * c.score_weight
        open_ = (self.column("class_id")[rows][:, None] == found["classes"][dets][None, :]) & ((iou >= min_iou) | (far <= reach))
        i, j = np.nonzero(open_)
        value = score[i, j]
        if c.appearance_weight:
            for k, (a, b) in enumerate(zip(i, j, strict=True)):
                if (s := alike(self.looks[rows[a]], found["looks"][dets[b]])) is not None:
                    value[k] += s * c.appearance_weight
        order = np.lexsort((-dets[j], -self.column("track_id")[rows[i]], -value))
        if not c.confirms:
            order = np.lexsort((dets[j], self.column("track_id")[rows[i]], -value))  # the mobile sort keeps insertion order
        used_rows, used_dets, out = set(), set(), []
        for k in order:
            a, b = int(rows[i[k]]), int(dets[j[k]])
            if a not in used_rows and b not in used_dets:
                used_rows.add(a)
                used_dets.add(b)
                out.append((a, b))
        return out

    def _match(self, pairs: list[tuple[int, int]], found: dict, motion: tuple[float, float], affine: list[float] | None) -> None:
        if not pairs:
            return
        r, d = np.array(pairs).T
        t, keep = self.table, self.config.velocity_keep
        old, new = middle(t[r][:, BOX]), middle(found["boxes"][d])
        carried = middle(moved(np.tile(old, 2), motion, affine))  # a point is a box without extent
        t[r, N["vx"]] = t[r, N["vx"]] * keep + (new - carried)[:, 0] * (1 - keep)
        t[r, N["vy"]] = t[r, N["vy"]] * keep + (new - carried)[:, 1] * (1 - keep)
        t[r, N["recoveries"]] += t[r, N["missed"]] > 0
        t[r, BOX] = found["boxes"][d]
        t[r, N["score"]] = t[r, N["last_score"]] = found["scores"][d]
        t[r, N["age"]] += 1
        t[r, N["hits"]] += 1
        t[r, N["missed"]] = 0
        t[r, N["confirmed"]] = (t[r, N["confirmed"]] > 0) | (t[r, N["hits"]] >= self.config.min_hits)
        for a, b in pairs:
            self.labels[a] = found["labels"][b]
            self.looks[a] = blended(self.looks[a], found["looks"][b])

    def step(self, found: dict, motion: tuple[float, float] = (0.0, 0.0), affine: list[float] | None = None, detect: bool = True) -> None:
        """One frame. found: boxes (n, 4), scores, classes, labels, looks, in order of det_idx."""
        c = self.config
        boxes = self.predicted(motion, affine)
        if not detect:
            self.table[:, BOX] = boxes
            self.table[:, N["age"]] += 1
            return
        seen = np.flatnonzero(found["scores"] >= c.low_conf)
        found = {k: v[seen] if isinstance(v, np.ndarray) else [v[i] for i in seen] for k, v in found.items()}
        every, high = np.arange(len(self.table)), found["scores"] >= c.high_conf
        pairs = self._pairs(every, np.flatnonzero(high), boxes, found, False)
        taken = np.zeros(len(high), bool)
        taken[[d for _, d in pairs]] = True
        if c.two_stage:
            free = np.setdiff1d(every, [r for r, _ in pairs])
            more = self._pairs(free, np.flatnonzero(~taken), boxes, found, True)
            taken[[d for _, d in more]] = True
            pairs += more
        self._match(pairs, found, motion, affine)
        lost = np.setdiff1d(every, [r for r, _ in pairs]).astype(int)
        self.table[lost, BOX] = boxes[lost]
        self.table[lost, N["age"]] += 1
        self.table[lost, N["missed"]] += 1
        self._spawn(np.flatnonzero(high & ~taken), found)
        missed = self.column("missed")
        gone = missed > c.max_missed
        if c.confirms:
            gone |= (self.column("confirmed") == 0) & (missed > min(2, c.max_missed))
        stay = np.flatnonzero(~gone)
        self.table = self.table[stay]
        self.labels, self.looks = [self.labels[i] for i in stay], [self.looks[i] for i in stay]

    def _spawn(self, dets: np.ndarray, found: dict) -> None:
        new = np.zeros((len(dets), len(NUMBERS)))
        new[:, N["track_id"]] = self.next_id + np.arange(len(dets))
        new[:, N["class_id"]], new[:, BOX] = found["classes"][dets], found["boxes"][dets]
        new[:, N["score"]] = new[:, N["last_score"]] = found["scores"][dets]
        new[:, N["age"]] = new[:, N["hits"]] = 1
        new[:, N["confirmed"]] = self.config.min_hits <= 1
        self.next_id += len(dets)
        self.table = np.concatenate([self.table, new])
        self.labels += [found["labels"][i] for i in dets]
        self.looks += [found["looks"][i] for i in dets]

    def advance(self, row: dict) -> tuple | None:
        """One row of the spine (see spine()) to a row of pages(); None for a frame that isn't after the last one."""
        if row["frame"] <= self.last_frame:
            return None
        self.last_frame = int(row["frame"])
        if row["reset"]:
            self.clear()
            self.epoch += 1
        dets = row["dets"] if row["dets"] is not None else []
        found = {
            "boxes": np.array([(d["x1"], d["y1"], d["x2"], d["y2"]) for d in dets], float).reshape(-1, 4),
            "scores": np.array([d["score"] for d in dets], float),
            "classes": np.array([d["class_id"] for d in dets], float),
            "labels": [d["label"] for d in dets],
            "looks": [None if d["appearance"] is None else [float(x) for x in d["appearance"]] for d in dets],
        }
        affine = None if row["affine"] is None else [float(x) for x in row["affine"]]
        self.step(found, (float(row["dx"]), float(row["dy"])), affine, bool(row["should_detect"]))
        return row["video"], self.epoch, self.last_frame, self.table.copy(), list(self.labels), list(self.looks)  # later steps change the table


def page_of(rows: list[tuple]) -> pd.DataFrame:
    """TRACK_STATES of what advance() gave, in one go: building a frame per step would cost more than the step."""
    rows = [r for r in rows if len(r[3])]
    if not rows:
        return pd.DataFrame(columns=COLUMNS)
    sizes = [len(r[3]) for r in rows]
    out = pd.DataFrame(np.concatenate([r[3] for r in rows]), columns=list(NUMBERS))
    for c in ("track_id", "class_id", "age", "hits", "missed", "recoveries"):
        out[c] = out[c].astype("int32")
    out["confirmed"] = out["confirmed"] > 0
    for k, c in enumerate(("video", "epoch", "frame")):
        out[c] = np.repeat(np.array([r[k] for r in rows], object if c == "video" else None), sizes)
    out["label"] = [x for r in rows for x in r[4]]
    out["appearance"] = [x for r in rows for x in r[5]]
    return out[COLUMNS]


COLUMNS = [f.split()[0] for f in TRACK_STATES.split(", ")]


def spine(frames: DataFrame, detections: DataFrame, motion: DataFrame | None = None, labels: str = "", stabilized: bool = False) -> DataFrame:
    """One row per frame, with its detections as an array in order of det_idx, its motion and its flags.

    Frames without detections stay: their tracks coast. Motion that isn't valid counts as none, and so does all motion of
    frames that are stabilized already.
    """
    item = F.struct("det_idx", "x1", "y1", "x2", "y2", "score", "class_id", "label", "appearance")
    grouped = detections.filter(in_classes(F.col("label"), labels)).groupBy("video", "frame").agg(F.sort_array(F.collect_list(item)).alias("dets"))
    out = frames.select("video", "frame", F.coalesce("should_detect", F.lit(True)).alias("should_detect"), F.coalesce("reset", F.lit(False)).alias("reset"))
    out = out.join(grouped, ["video", "frame"], "left")
    if motion is None or stabilized:
        return out.select("*", F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(None).cast("array<double>").alias("affine"))
    used = motion.filter("valid").select("video", "frame", "dx", "dy", "affine")
    return out.join(used, ["video", "frame"], "left").withColumns({"dx": F.coalesce("dx", F.lit(0.0)), "dy": F.coalesce("dy", F.lit(0.0))})


def run_tracking(frames: DataFrame, detections: DataFrame, motion: DataFrame | None = None, config: TrackerConfig = TrackerConfig(), labels: str = "", stabilized: bool = False) -> DataFrame:  # noqa: B008
    """TRACK_STATES: one row per frame and track that lives after it. Parallel by video; a video is one task."""

    def whole(page: pd.DataFrame) -> pd.DataFrame:
        tracks = Tracks(config)
        return page_of([r for row in page.sort_values("frame").to_dict("records") if (r := tracks.advance(row)) is not None])

    return spine(frames, detections, motion, labels, stabilized).groupBy("video").applyInPandas(whole, TRACK_STATES)


__all__ = ["LITE", "TrackerConfig", "Tracks", "run_tracking", "spine"]
