"""What is derived from one track, detection or calibration row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackframe.functions.numbers import clamp01

#: The 80 detector classes in order of their ids.
LABELS = (
    "person, bicycle, car, motorcycle, airplane, bus, train, truck, boat, traffic light, fire hydrant, stop sign, "
    "parking meter, bench, bird, cat, dog, horse, sheep, cow, elephant, bear, zebra, giraffe, backpack, umbrella, handbag, "
    "tie, suitcase, frisbee, skis, snowboard, sports ball, kite, baseball bat, baseball glove, skateboard, surfboard, "
    "tennis racket, bottle, wine glass, cup, fork, knife, spoon, bowl, banana, apple, sandwich, orange, broccoli, carrot, "
    "hot dog, pizza, donut, cake, chair, couch, potted plant, bed, dining table, toilet, tv, laptop, mouse, remote, "
    "keyboard, cell phone, microwave, oven, toaster, sink, refrigerator, book, clock, vase, scissors, teddy bear, "
    "hair drier, toothbrush"
).split(", ")

#: Labels whose links mean similar visible appearance only, never identity.
PERSON_LABELS = ("person",)


def label_of(class_id: Column, labels: list[str] | None = None) -> Column:
    names = F.array(*(F.lit(x) for x in (labels or LABELS)))
    known = F.when((class_id >= 0) & (class_id < len(labels or LABELS)), F.get(names, class_id.cast("int")))
    return F.coalesce(known, F.concat(F.lit("class_"), class_id.cast("string")))


def in_classes(label: Column, wanted: str) -> Column:
    """A comma-separated list, blanks and case aside; an empty list lets everything through."""
    names = sorted({w.strip().lower() for w in wanted.split(",") if w.strip()})
    return F.lower(label).isin(names) if names else F.lit(True)


def should_detect(frame: Column, every: int = 0, profile: str = "balanced") -> Column:
    """Whether a frame (from 1) gets a detector pass; a given cadence wins over the profile's."""
    step = every if every > 0 else {"quality": 1, "balanced": 2, "speed": 3}[profile]
    return (frame - 1) % step == 0


def quality(hits: Column, last_score: Column, score: Column, missed: Column, confirmed: Column) -> Column:
    """0.35 for hits up to 8, 0.65 for the last detection's score (the current score if that is 0 or null), damped by
    misses, and lower while unconfirmed."""
    stable = F.least(F.lit(1.0), hits / F.lit(8.0)) * 0.35
    seen = clamp01(F.coalesce(F.nullif(last_score, F.lit(0.0)), score)) * 0.65
    return clamp01(stable + seen) / (1.0 + missed * 0.35) * F.when(confirmed, 1.0).otherwise(0.72)


def lifecycle(confirmed: Column, missed: Column) -> Column:
    return F.when(~confirmed, "TENTATIVE").when(missed > 0, "PREDICTED").otherwise("TRACKED")


def speed(vx: Column, vy: Column) -> Column:
    return F.hypot(vx, vy)


def entity_prefix(label: Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(F.upper(label), r"[^\p{L}\p{N}]", "_"), F.lit("_"))
    named = F.when(cleaned == "", "OBJECT").otherwise(cleaned)
    return F.when(F.lower(label).isin(*PERSON_LABELS), F.concat(named, F.lit("_APPEARANCE"))).otherwise(named)


def relation(label: Column) -> Column:
    return F.when(F.lower(label).isin(*PERSON_LABELS), "same_appearance_candidate").otherwise("same_object_candidate")


def entity_semantics(label: Column) -> Column:
    return F.when(F.lower(label).isin(*PERSON_LABELS), "appearance_group_not_identity").otherwise("tentative_same_object_group")


def tracklet_key(video: Column, track_id: Column) -> Column:
    return F.concat(video, F.lit("#T"), track_id.cast("string"))


def safe_stem(stem: Column) -> Column:
    return F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_")


def preview_name(stem: Column, track_id: Column) -> Column:
    return F.format_string("%s_T%03d.jpg", safe_stem(stem), track_id)


def snapshot_name(track_id: Column, ts: Column) -> Column:
    return F.format_string("T%03d-%s.png", track_id, F.date_format(ts, "yyyyMMdd-HHmmss"))


def motion_valid(inliers: Column, ratio: Column, tx: Column, ty: Column, scale: Column, rotation_rad: Column, w: Column, h: Column) -> Column:
    """The gate of a global motion estimate."""
    return (inliers >= 6) & (ratio >= 0.35) & (F.abs(tx) <= w * 0.75) & (F.abs(ty) <= h * 0.75) & scale.between(0.78, 1.28) & (F.abs(rotation_rad) <= F.radians(F.lit(35.0)))


def refine_valid(inliers: Column, ratio: Column, scale: Column, rotation_rad: Column) -> Column:
    """The gate of a lock refinement."""
    return (inliers >= 6) & (ratio >= 0.45) & scale.between(0.85, 1.18) & (F.abs(rotation_rad) <= F.radians(F.lit(20.0)))


def hfov_of(object_px: Column, frame_px: Column, distance: Column, size: Column) -> Column:
    """Horizontal field of view in degrees from an object of known size and distance; null unless all are above 0."""
    focal = object_px * distance / F.nullif(size, F.lit(0.0))
    return F.when((object_px > 0) & (frame_px > 0) & (distance > 0) & (size > 0), F.degrees(2 * F.atan(frame_px / (2 * focal))))


def vfov_of(hfov_deg: Column, w: Column, h: Column) -> Column:
    return F.degrees(2 * F.atan(F.tan(F.radians(hfov_deg) / 2) * (h / w)))


def angular_offset(x: Column, y: Column, w: Column, h: Column, hfov: Column, vfov: Column) -> tuple[Column, Column]:
    """Yaw and pitch in degrees (EST), pitch upwards."""
    return (x - w / 2) / (w / 2) * (hfov / 2), -((y - h / 2) / (h / 2)) * (vfov / 2)


def angular_size(box_w: Column, box_h: Column, w: Column, h: Column, hfov: Column, vfov: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0.0), box_w) / w * hfov, F.greatest(F.lit(0.0), box_h) / h * vfov


def calibrated_lines(cx: Column, cy: Column, box_w: Column, box_h: Column, frame_w: Column, frame_h: Column, cal_w: Column, cal_h: Column, hfov: Column, vfov: Column) -> Column:
    """The three overlay lines of a calibrated camera; sizes are first brought to the calibration's resolution."""
    sx, sy = cal_w / F.greatest(frame_w, F.lit(1)), cal_h / F.greatest(frame_h, F.lit(1))
    yaw, pitch = angular_offset(cx * sx, cy * sy, cal_w, cal_h, hfov, vfov)
    aw, ah = angular_size(box_w * sx, box_h * sy, cal_w, cal_h, hfov, vfov)
    # Of values that lie exactly between two the even one is shown; those are odd multiples of 1/8.
    shown = lambda v: F.when(F.pmod(v * 8, F.lit(2.0)) == 1, F.bround(v, 2)).otherwise(v)
    return F.array(
        F.format_string("YAW      %+6.2f deg EST", shown(yaw)), F.format_string("PITCH    %+6.2f deg EST", shown(pitch)), F.format_string("ANG SIZE %5.2fx%5.2f deg", shown(aw), shown(ah))
    )
