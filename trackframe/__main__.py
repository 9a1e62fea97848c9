"""python -m trackframe COMMAND: the analyses from the command line, on tables and session logs."""

from __future__ import annotations

import argparse
import json
import sys
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.functions import tracks as T
from trackframe.operators import graph, reports
from trackframe.operators.decode import suppress
from trackframe.operators.selection import check_mode
from trackframe.operators.tracker import LITE, TrackerConfig, run_tracking
from trackframe.plans.analyze import analyze
from trackframe.sources import config, files, generators, sessions, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trackframe", allow_abbrev=False)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str, **flags: object) -> None:
        c = sub.add_parser(name, allow_abbrev=False)
        for a in args:
            c.add_argument(a)
        for k, default in flags.items():
            c.add_argument(f"--{k.replace('_', '-')}", default=default, **({"action": "store_true"} if default is False else {"type": type(default)}))

    command("videos", "folder", recursive=False, include_derived=False)
    command("hash", "folder")
    command("report", "session", json="")
    command("csv", "session", "out")
    command("overlay", "session", "frames", "out")
    command(
        "track", "frames", "detections", "out", motion="", tracker="full", profile="quality", detect_every=0, classes="", conf=0.0, iou=0.0, stabilize=False, no_cmc=False, no_appearance=False, max_frames=0,
        session_log="", calibration="", view="normal", config="", preset="",
    )
    command(
        "analyze", "frames", "detections", "out", motion="", review="", classes="", conf=0.0, iou=0.0, detect_every=1, min_observations=3, candidate_threshold=graph.CANDIDATE, strong_threshold=graph.STRONG,
        max_frames_per_video=0, no_html=False,
    )
    command("fov", object_px=0.0, frame_px=0.0, distance=0.0, size=0.0, save="", width=0, height=0)
    command("check-config", "path")
    command("benchmark", frames=3000, targets=32, least_fps=30.0)
    return p


def table(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if path else None


def with_defaults(a: argparse.Namespace, given: list[str]) -> argparse.Namespace:
    """A preset's and then a configuration file's values where the command line names none."""
    values = config.PRESETS[a.preset] if a.preset else {}
    values = config.check_config(values) | (config.load_config(a.config) if a.config else {})
    for key, value in values.items():
        if hasattr(a, key) and f"--{key.replace('_', '-')}" not in given:
            setattr(a, key, value)
    return a


def chosen(found: DataFrame, a: argparse.Namespace) -> DataFrame:
    """Detections of at least conf, with boxes suppressed that overlap by iou, if these are above 0."""
    if a.conf > 0:
        found = found.filter(F.col("score") >= a.conf)
    if a.iou > 0:
        found = found.join(suppress(found, a.iou).select("video", "frame", "class_id", "det_idx"), ["video", "frame", "class_id", "det_idx"], "left_semi")
    return found


def cadenced(frames: DataFrame, every: int, profile: str, most: int) -> DataFrame:
    """Frames up to a number, with a detector pass on every so many (by profile, if 0)."""
    frames = frames.filter(F.col("frame") <= most) if most else frames
    return frames.withColumn("should_detect", F.coalesce("should_detect", F.lit(True)) & T.should_detect(F.col("frame"), every, profile))


def track(spark: SparkSession, a: argparse.Namespace) -> None:
    check_mode(a.view)
    frames = cadenced(table(spark, a.frames), a.detect_every, a.profile, a.max_frames)
    found = chosen(table(spark, a.detections), a)
    if a.no_appearance:
        found = found.withColumn("appearance", F.lit(None).cast("array<double>"))
    motion = None if a.no_cmc else table(spark, a.motion)
    settings = LITE if a.tracker == "lite" else TrackerConfig()
    run_tracking(frames, found, motion, settings, a.classes, a.stabilize).write.parquet(a.out)
    if a.session_log:
        rows = sessions.frame_rows(spark.read.parquet(a.out)).withColumnRenamed("video", "session").withColumn("ordinal", F.col("frame"))
        known = frames.select(F.col("video").alias("session"), "frame", "fps")
        rows = rows.join(known, ["session", "frame"]).withColumn("t", F.when(F.col("fps") > 0, F.col("frame") / F.col("fps")).otherwise(0.0))
        details = {"detections": a.detections, "profile": a.profile, "view": a.view} | ({"calibration": json.dumps(asdict(config.Calibration.load(a.calibration)))} if a.calibration else {})
        videos = frames.select(F.col("video").alias("session")).distinct()
        header = videos.select("session", F.lit("header").alias("type"), F.lit(1).alias("version"), F.struct(*(F.lit(v).alias(k) for k, v in details.items())).alias("metadata"))
        footer = rows.groupBy("session").agg(F.max("t").alias("duration_s")).select("session", F.lit("footer").alias("type"), "duration_s")
        sinks.write_session(header, rows, footer, a.session_log)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = sys.argv[1:] if argv is None else argv
    a = parser().parse_args(given)
    if a.command == "check-config":
        print(json.dumps(config.load_config(a.path), indent=2))
        return 0
    spark = spark or SparkSession.builder.appName("trackframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command in ("videos", "hash"):
        found = files.discover_videos(spark, a.folder, a.recursive, a.include_derived) if a.command == "videos" else files.sha256_files(spark, a.folder)
        for r in found.toLocalIterator():
            print("\t".join(map(str, r)))
    elif a.command in ("report", "csv", "overlay"):
        rows = sessions.read_sessions(spark, a.session)
        if a.command == "report":
            for r in sinks.report_json(reports.session_report(rows, sessions.flat_tracks(rows)).drop("metadata", "capture_summary")).collect():
                print(r.report)
                if a.json:
                    with open(a.json, "w", encoding="utf-8") as f:
                        f.write(r.report)
        elif a.command == "csv":
            print(sinks.write_flat_csv(sessions.flat_tracks(rows), a.out))
        else:
            sessions.overlay_rows(spark.read.parquet(a.frames), rows).write.parquet(a.out)
    elif a.command == "track":
        track(spark, with_defaults(a, given))
    elif a.command == "analyze":
        reviews = sessions.read_reviews(spark, a.review) if a.review else None
        frames, limits = cadenced(table(spark, a.frames), a.detect_every, "quality", 0), (a.candidate_threshold, a.strong_threshold)
        found = analyze(frames, chosen(table(spark, a.detections), a), table(spark, a.motion), reviews, None, TrackerConfig(), a.classes, a.min_observations, *limits, a.max_frames_per_video)
        found.tracklets.write.parquet(f"{a.out}/tracklets")
        tracklets = spark.read.parquet(f"{a.out}/tracklets")
        document = graph.document(tracklets, reviews, *limits)
        sinks.write_graph(document, f"{a.out}/graph.json", {"frames": a.frames, "detections": a.detections})
        if not a.no_html:
            with open(f"{a.out}/graph.html", "w", encoding="utf-8") as f:
                f.write(sinks.graph_html(document))
        print(json.dumps({"tracklets": len(document["tracklets"]), "entities": len(document["entities"]), "edges": len(document["edges"])}))
    elif a.command == "fov":
        hfov = spark.range(1).select(T.hfov_of(*(F.lit(v) for v in (a.object_px, a.frame_px, a.distance, a.size)))).first()[0]
        if hfov is None:
            raise SystemExit("all of object-px, frame-px, distance and size are above 0")
        print(f"{hfov:.3f}")
        if a.save:
            config.Calibration(a.width, a.height, hfov).save(a.save)
    else:
        start = time.perf_counter()
        states = run_tracking(generators.synthetic_frames(spark, a.frames), generators.synthetic_detections(spark, a.frames, a.targets), generators.synthetic_motion(spark, a.frames), TrackerConfig(min_hits=1))
        states.write.format("noop").mode("overwrite").save()
        fps = a.frames / (time.perf_counter() - start)
        print(f"{fps:.1f} frames/s")
        return int(fps < a.least_fps)
    return 0


if __name__ == "__main__":
    sys.exit(main())
