"""Schemas of the tables that the operators exchange."""

from __future__ import annotations

DETECTIONS = "video string, frame bigint, det_idx int, x1 double, y1 double, x2 double, y2 double, score double, class_id int, label string, appearance array<double>"
FRAMES = "video string, frame bigint, fps double, width int, height int, should_detect boolean, reset boolean"
MOTION = "video string, frame bigint, dx double, dy double, affine array<double>, valid boolean"
RAW_PREDICTIONS = "video string, frame bigint, row_idx int, values array<float>, input_w int, input_h int, frame_w int, frame_h int, scale double, pad_x double, pad_y double"
TRACK_STATES = (
    "video string, epoch int, frame bigint, track_id int, class_id int, label string, x1 double, y1 double, x2 double, y2 double, "
    "score double, last_score double, vx double, vy double, age int, hits int, missed int, confirmed boolean, recoveries int, appearance array<double>"
)
TRACKLETS = (
    "video string, local_track_id int, class_id int, label string, first_frame bigint, last_frame bigint, observations bigint, mean_score double, "
    "mean_quality double, best_frame bigint, fps double, descriptor array<double>, preview_path string, gallery array<array<double>>"
)
REVIEWS = "lo string, hi string, decision string"
TRACK = (
    "struct<id:int,class_id:int,label:string,score:double,bbox:array<double>,center:array<double>,velocity_px_frame:array<double>,"
    "age:int,hits:int,missed:int,confirmed:boolean,lifecycle:string,quality:double,recoveries:int>"
)
SESSION = (
    "type string, version int, started_unix double, metadata variant, frame bigint, t double, fps double, selected_id int, camera_motion array<double>, "
    "selected_refine struct<valid:boolean,inliers:int,inlier_ratio:double>, timings_ms map<string,double>, "
    f"tracks array<{TRACK}>, name string, data variant, duration_s double"
)
