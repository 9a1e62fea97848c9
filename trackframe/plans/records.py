"""Queries of what is written and read: session logs, reports, reviews, files, configuration, pixels."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackframe.functions.numbers import rounded
from trackframe.operators import graph, pixels, reports
from trackframe.operators.tracker import TrackerConfig
from trackframe.plans.analyze import analyze
from trackframe.plans.registry import ITEMS, REVIEWED, query, r, rsql
from trackframe.plans.tracking import FULL
from trackframe.sources import adapters, config, files, sessions, sinks
from trackframe.sources.shared import fresh, put

D = "::DOUBLE"
NAMES = ("track_created", "track_confirmed", "track_recovered", "track_ended", "target_lost", "capture_reconnected")


def _logged(spark: SparkSession, d: str) -> DataFrame:
    """Writes a log for each user and reads all back: an event is a frame row with a track, every ninth one also an event row;
    there is a header, and for even users a footer."""
    e = adapters.table(spark, d, "events")
    session, n, v = F.col("user_id").alias("session"), F.col("event_id"), F.col("value")
    users = e.select(session).distinct()
    even = F.when(n % 2 == 0, F.array(v, -v))
    track = F.struct(
        (n % 5).cast("int").alias("id"), (n % 3).cast("int").alias("class_id"), F.col("event_type").alias("label"), (v / 200).alias("score"), F.array(v, v * 0.5, v + 20, v * 0.5 + 40).alias("bbox"),
        F.array(v + 10, v * 0.5 + 20).alias("center"), even.alias("velocity_px_frame"), (n % 50).cast("int").alias("age"), (n % 9).cast("int").alias("hits"), (n % 4).cast("int").alias("missed"),
        (n % 3 > 0).alias("confirmed"), F.lit("TRACKED").alias("lifecycle"), (v / 100).alias("quality"), (n % 7).cast("int").alias("recoveries"),
    )
    timings = F.create_map(F.lit("detect"), v, F.lit("track"), v / 2)
    none = {c: F.lit(None).cast("string") for c in ("name",)}
    frames = e.select(session, (2 * n).alias("ordinal"), F.lit("frame").alias("type"), n.alias("frame"), (v / 10).alias("t"), v.alias("fps"), F.when(n % 6 == 0, (n % 5).cast("int")).alias("selected_id"), timings.alias("timings_ms"), F.array(track).alias("tracks"), *(c.alias(k) for k, c in none.items()))
    name = F.element_at(F.array(*(F.lit(x) for x in NAMES)), (n % 6 + 1).cast("int"))
    happened = e.filter("event_id % 9 = 0").select(session, (2 * n + 1).alias("ordinal"), F.lit("event").alias("type"), name.alias("name"))
    header = users.select("session", F.lit("header").alias("type"), F.lit(1).alias("version"), F.struct(F.concat(F.lit("cam"), F.col("session").cast("string")).alias("source")).alias("metadata"))
    footer = users.filter("session % 2 = 0").select("session", F.lit("footer").alias("type"), (F.col("session") * 1.5).alias("duration_s"))
    where = fresh(spark, "sessions")
    sinks.write_session(header, frames.unionByName(happened, allowMissingColumns=True), footer, where)
    rows = sessions.read_sessions(spark, where)
    return rows.withColumn("session", F.regexp_extract("session", r"session=(\d+)", 1).cast("bigint"))


#: What a log's tracks hold, from the events table.
TRACKS = f"""tr AS (SELECT user_id AS session, event_id AS frame, value AS v, event_id % 5 AS id, event_type AS label, event_id % 4 AS missed, event_id % 3 > 0 AS confirmed, event_id % 7 AS recoveries FROM events)"""


@query(f"""WITH {TRACKS} SELECT frame, {rsql("v / 10", 6)} AS t, v AS fps, CAST(CASE WHEN frame % 6 = 0 THEN id ELSE -1 END AS INTEGER) AS selected_id, CAST(id AS INTEGER) AS track_id, label, CAST(frame % 3 AS INTEGER) AS class_id, {rsql("v / 200")} AS score, v AS x1, {rsql("v * 0.5" + D)} AS y1,
  {rsql("v + 20")} AS x2, {rsql("v + 10")} AS cx, CASE WHEN frame % 2 = 0 THEN v ELSE 0.0{D} END AS vx, CASE WHEN frame % 2 = 0 THEN -v ELSE 0.0{D} END AS vy, CAST(frame % 50 AS INTEGER) AS age, CAST(frame % 9 AS INTEGER) AS hits, CAST(missed AS INTEGER) AS missed, confirmed,
  'TRACKED' AS lifecycle, {rsql("v / 100")} AS quality, CAST(recoveries AS INTEGER) AS recoveries, (SELECT count(*) FROM tr) AS written FROM tr""")
def session_csv(spark: SparkSession, d: str) -> DataFrame:
    """Logs to the flat export and back, with the number of rows that the writer reports."""
    where = fresh(spark, "flat")
    n = sinks.write_flat_csv(sessions.flat_tracks(_logged(spark, d)), where)
    kinds = {"frame": "bigint", "label": "string", "lifecycle": "string", "confirmed": "boolean"} | {c: "int" for c in ("selected_id", "track_id", "class_id", "age", "hits", "missed", "recoveries")}
    back = spark.read.option("header", True).schema(", ".join(f"{c} {kinds.get(c, 'double')}" for c in sessions.FLAT)).csv(where)
    exact = ("frame", "fps", "track_id", "label", "class_id", "x1", "vx", "vy", "age", "hits", "missed", "confirmed", "lifecycle", "recoveries")
    return back.select(*exact, F.coalesce("selected_id", F.lit(-1)).alias("selected_id"), *(r(c).alias(c) for c in ("t", "score", "y1", "x2", "cx", "quality")), F.lit(n).cast("bigint").alias("written"))


def _p95(x: str, where: str = "") -> str:
    held = f"list({x}){where}"
    return f"list_sort({held})[1 + CAST(least(len({held}) - 1, round_even((len({held}) - 1) * 0.95{D}, 0)) AS BIGINT)]"


@query(f"""WITH {TRACKS}, f AS (
  SELECT session, count(*) AS frames, CASE WHEN session % 2 = 0 THEN session * 1.5{D} ELSE arg_max(v, frame) / 10 END AS duration_s, coalesce(avg(v) FILTER (v > 0), 0) AS fps_avg, coalesce({_p95("v", " FILTER (v > 0)")}, 0) AS fps_p95,
    coalesce(min(v) FILTER (v > 0), 0) AS fps_min, avg(v) AS detect_avg, {_p95("v")} AS detect_p95, max(v) / 2 AS track_max, {", ".join(f"count(*) FILTER (frame % 9 = 0 AND frame % 6 = {i}) AS n{i}" for i in range(6))} FROM tr GROUP BY session
), t AS (SELECT session, id, count(*) AS n, count(*) FILTER (missed > 0) / count(*) AS predicted FROM tr GROUP BY ALL),
b AS (SELECT session, count(*) AS track_count, max(n) AS longest, arg_max(id, n * 10 - id) AS first_id, arg_max(predicted, n * 10 - id) AS first_predicted FROM t GROUP BY session)
SELECT f.session, frames, {rsql("duration_s", 4)} AS duration_s, 'cam' || f.session AS source, {rsql("fps_avg", 3)} AS fps_avg, {rsql("fps_p95", 3)} AS fps_p95, {rsql("fps_min", 3)} AS fps_min, 2::BIGINT AS stages, {rsql("detect_avg", 3)} AS detect_avg, {rsql("detect_p95", 3)} AS detect_p95,
  {rsql("track_max", 3)} AS track_max, n0 AS created, n3 AS ended, n4 AS target_lost, n5 AS reconnect_events, track_count, longest AS longest_track_frames, CAST(first_id AS BIGINT) AS first_id, {rsql("first_predicted", 4)} AS first_predicted FROM f JOIN b ON b.session = f.session""")
def session_reports(spark: SparkSession, d: str) -> DataFrame:
    """The report of every log, written as JSON and read from it."""
    rows = _logged(spark, d)
    report = reports.session_report(rows, sessions.flat_tracks(rows)).drop("metadata", "capture_summary")
    sources = rows.filter("type = 'header'").select("session", F.variant_get("metadata", "$.source", "string").alias("source"))
    text = sinks.report_json(report)
    at = lambda path, kind: F.get_json_object("report", f"$.{path}").cast(kind)
    whole = {c: at(c, "bigint") for c in ("frames", "created", "ended", "target_lost", "reconnect_events", "track_count", "longest_track_frames")}
    parts = {c: at(c, "double") for c in ("fps_avg", "fps_p95", "fps_min")} | {"duration_s": rounded(at("duration_s", "double"), 4)}
    first = {"first_id": at("tracks[0].id", "bigint"), "first_predicted": at("tracks[0].prediction_ratio", "double")}
    stages = {"detect_avg": at("timings_ms[0].ms_avg", "double"), "detect_p95": at("timings_ms[0].ms_p95", "double"), "track_max": at("timings_ms[1].ms_max", "double")}
    count = F.size(F.from_json(F.get_json_object("report", "$.timings_ms"), "array<struct<stage:string>>")).cast("bigint").alias("stages")
    return text.join(sources, "session").select("session", "source", count, *(v.alias(k) for k, v in (whole | parts | first | stages).items()))


@query("""SELECT user_id AS session, event_id % 40 AS frame, arg_max(value, event_id) AS fps, max(event_id) AS line_event FROM events GROUP BY ALL""")
def session_frames(spark: SparkSession, d: str) -> DataFrame:
    """Of a frame that a log has twice, the last line counts."""
    rows = _logged(spark, d).withColumn("original", F.col("frame")).withColumn("frame", F.col("frame") % 40)
    return sessions.frames(rows).select("session", "frame", "fps", F.col("original").alias("line_event"))


@query(f"""WITH {ITEMS}, {REVIEWED} SELECT lo, hi, CASE decision WHEN 'different' THEN 'same' ELSE decision END AS decision FROM reviews""")
def review_files(spark: SparkSession, d: str) -> DataFrame:
    """Reviews written and read; later entries of a pair, either way round and in any case, count; invalid ones don't."""
    document = sinks.review_document(adapters.reviews(spark, d))
    turned = [{"left": x["right"], "right": x["left"], "decision": "SAME"} for x in document["decisions"] if x["decision"] == "different"]
    invalid = [{"left": "a", "right": "b", "decision": "maybe"}, {"left": "a", "decision": "same"}, {"left": None, "right": "b", "decision": "same"}, {"left": "a", "right": "b"}]
    document["decisions"] += turned + invalid
    where = f"{fresh(spark, 'reviews')}.json"
    put(spark, where, json.dumps(document, indent=1))
    return sessions.read_reviews(spark, where)


SUFFIX = "CASE n_nationkey % 4 WHEN 0 THEN '.MP4' WHEN 1 THEN '.webm' WHEN 2 THEN '.txt' ELSE '.Mkv' END"


def _files(spark: SparkSession, d: str) -> str:
    """A folder with a small file for each nation, in folders by region; every fifth one is the output of an earlier run."""
    where = fresh(spark, "videos")
    for x in adapters.table(spark, d, "nation").collect():
        suffix = (".MP4", ".webm", ".txt", ".Mkv")[x.n_nationkey % 4]
        put(spark, f"{where}/R{x.n_regionkey}/{x.n_name}{'_TrackFrame' if x.n_nationkey % 5 == 0 else ''}{suffix}", x.n_name)
    return where


@query(f"""WITH f AS (SELECT 'R' || n_regionkey || '/' || n_name || {SUFFIX} AS video, length(n_name) AS length FROM nation WHERE n_nationkey % 4 <> 2 AND n_nationkey % 5 <> 0)
SELECT video, length, row_number() OVER (ORDER BY lower(video)) AS place FROM f""")
def discovered_videos(spark: SparkSession, d: str) -> DataFrame:
    """Video files below a folder, in order, outputs of earlier runs left out."""
    found = files.discover_videos(spark, _files(spark, d), recursive=True).collect()  # a folder's listing, as the command prints it
    return spark.createDataFrame([(x.video, x.length, k) for k, x in enumerate(found, 1)], "video string, length long, place long")


@query(f"""SELECT 'R' || n_regionkey || '/' || n_name || CASE WHEN n_nationkey % 5 = 0 THEN '_TrackFrame' ELSE '' END || {SUFFIX} AS file, sha256(n_name) AS sha256, n_nationkey % 3 <> 1 AS verified FROM nation""")
def file_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of files, checked against expected ones: with a prefix, in capitals, or wrong."""
    hashed = files.sha256_files(spark, f"{_files(spark, d)}/*").withColumn("file", F.regexp_extract("path", "(R[^/]*/[^/]*)$", 1))
    number = F.regexp_extract("file", r"NATION_(\d+)", 1).cast("int")
    expected = F.when(number % 3 == 0, F.concat(F.lit(" SHA256:"), F.upper("sha256"))).when(number % 3 == 1, F.reverse("sha256")).otherwise(F.col("sha256"))
    return hashed.select("file", "sha256", files.sha256_matches(F.col("sha256"), expected).alias("verified"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name, sha256(r_name) AS sha256, 640 AS input_size, r_regionkey % 2 = 0 AS verified FROM region")
def model_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Manifests saved, loaded and verified beside their models; every other one is another model's."""
    out = []
    with tempfile.TemporaryDirectory() as folder:
        for x in adapters.table(spark, d, "region").collect():
            model, path = Path(folder, f"{x.r_regionkey}.onnx"), str(Path(folder, f"{x.r_regionkey}.json"))
            model.write_text(x.r_name)
            digest = files.hashlib.sha256(x.r_name.encode()).hexdigest()
            config.Manifest(x.r_name, f"sha256:{digest.upper()}" if x.r_regionkey % 2 == 0 else digest[::-1]).save(path)
            read = config.Manifest.load(path)
            out.append((x.r_regionkey, read.name, digest, read.input_size, read.verify(str(model))))
    return spark.createDataFrame(out, "id long, name string, sha256 string, input_size int, verified boolean")


def _each(rows: DataFrame, schema: str, f: Callable[..., tuple]) -> DataFrame:
    """f of each row's values, as rows of the schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            yield pd.DataFrame([f(*x) for x in page.itertuples(index=False)], columns=names)

    return rows.mapInPandas(run, schema)


def _accepted(check: Callable[[], object]) -> bool:
    try:
        check()
    except ValueError:
        return False
    return True


CANDIDATES: tuple[Callable[[int], object], ...] = (
    lambda p: {"camera_width": p}, lambda p: {"camera_width": "x"}, lambda p: {"cpu": 1}, lambda p: {"cpu": True}, lambda p: {"profile": "fast"}, lambda p: {"detect_every": p % 3 - 1}, lambda p: {"nope": 1},
    lambda p: {"camera_fps": 29.5, "view": "edges"}, lambda p: {"max_frames": True}, lambda p: [p], lambda p: {"camera_fps": p, "conf": 0.2}, lambda p: {"reconnect_attempts": 0, "reconnect_delay_ms": -p},
)


@query("SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN true WHEN 3 THEN true WHEN 5 THEN p_partkey % 3 >= 1 WHEN 7 THEN true WHEN 10 THEN true ELSE false END AS accepted FROM part")
def checked_configs(spark: SparkSession, d: str) -> DataFrame:
    """Configurations with unknown keys, wrong types, wrong words and negative numbers are refused."""
    ids = adapters.table(spark, d, "part").select("p_partkey")
    return _each(ids, "id long, accepted boolean", lambda p: (p, _accepted(lambda: config.check_config(json.loads(json.dumps(CANDIDATES[p % 12](p)))))))


@query("""SELECT * FROM (VALUES ('amd-balanced', 13::BIGINT, 1920, 1080, 4, 250, 'balanced', 2, false), ('amd-quality', 13::BIGINT, 1920, 1080, 4, 250, 'quality', 1, false), ('cpu-safe', 14::BIGINT, 1280, 720, 3, 350, 'speed', 3, true))
  t(preset, keys, width, height, attempts, delay_ms, profile, detect_every, cpu)""")
def presets(spark: SparkSession, d: str) -> DataFrame:
    rows = [(k, len(p), p["camera_width"], p["camera_height"], p["reconnect_attempts"], p["reconnect_delay_ms"], p["profile"], p["detect_every"], p.get("cpu", False)) for k, p in config.PRESETS.items() if config.check_config(p)]
    return spark.createDataFrame(rows, "preset string, keys long, width int, height int, attempts int, delay_ms int, profile string, detect_every int, cpu boolean")


@query(f"""WITH c AS (SELECT p_partkey AS id, p_partkey % 50 * 20 AS w, p_partkey % 31 * 30 AS h, CAST(p_partkey % 200 AS DOUBLE) AS hfov FROM part),
v AS (SELECT *, CASE WHEN w > 0 AND h > 0 AND hfov >= 1 AND hfov < 179 THEN degrees(2 * atan(tan(radians(hfov) / 2) * h / w)) END AS vfov FROM c)
SELECT id, CASE WHEN vfov >= 1 AND vfov < 179 THEN {rsql("vfov", 5)} ELSE -1.0{D} END AS vfov FROM v""")
def calibrations(spark: SparkSession, d: str) -> DataFrame:
    """Calibrations with a derived vertical field of view, saved and loaded; -1 for those that are refused."""

    def one(p: int, w: int, h: int, hfov: float) -> tuple[int, float]:
        try:
            with tempfile.NamedTemporaryFile(suffix=".json") as f:
                config.Calibration(w, h, hfov).save(f.name)
                return p, config.Calibration.load(f.name).vfov_deg
        except ValueError:
            return p, -1.0

    p = F.col("p_partkey")
    rows = adapters.table(spark, d, "part").select(p, p % 50 * 20, p % 31 * 30, (p % 200).cast("double"))
    return _each(rows, "id long, vfov double", one).select("id", F.when(F.col("vfov") < 0, F.col("vfov")).otherwise(r("vfov", 5)).alias("vfov"))


@query("WITH s AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN 'clip' || p_partkey ELSE '-' || p_partkey END AS text FROM part) SELECT id, CASE WHEN regexp_full_match(text, '[0-9]+') THEN 'camera' ELSE 'file' END AS kind, text AS source FROM s")
def source_names(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_partkey")
    text = F.when(p % 3 == 0, p.cast("string")).when(p % 3 == 1, F.concat(F.lit("clip"), p.cast("string"))).otherwise(F.concat(F.lit("-"), p.cast("string")))
    rows = adapters.table(spark, d, "part").select(p, text)
    return _each(rows, "id long, kind string, source string", lambda i, t: (i, "camera" if isinstance(config.parse_source(t), int) else "file", str(config.parse_source(t))))


@query(f"""WITH a AS (SELECT p_partkey AS id, (p_partkey % 14) / 10.0{D} - 0.1{D} AS low, (p_partkey % 11) / 10.0{D} AS high FROM part) SELECT id, 0.0{D} <= low AND low <= high AND high <= 1.0{D} AS tracker, 0.0{D} <= low AND low <= high AND high <= 1.0{D} AS graph FROM a""")
def checked_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds of the tracker and of the graph that aren't ordered within 0 and 1 are refused."""
    p = F.col("p_partkey")
    rows = adapters.table(spark, d, "part").select(p, ((p % 14) / F.lit(10.0) - 0.1).alias("low"), ((p % 11) / F.lit(10.0)).alias("high"))
    return _each(rows, "id long, tracker boolean, graph boolean", lambda i, low, high: (i, _accepted(lambda: TrackerConfig(low_conf=low, high_conf=high)), _accepted(lambda: graph.check_thresholds(low, high))))


@query(f"WITH RECURSIVE {FULL} SELECT video, count(*) AS states, max(frame) AS last_frame FROM states WHERE frame <= 9000 GROUP BY video")
def bounded_analysis(spark: SparkSession, d: str) -> DataFrame:
    """The folder analysis of frames up to a number, which is the feature."""
    states = analyze(*adapters.tracking(spark, d), max_frames=9000).states
    return states.groupBy("video").agg(F.count("*").alias("states"), F.max("frame").alias("last_frame"))


@query(f"""WITH {TRACKS} SELECT frame, 1 AS schema, 'frame.png' AS image, 'abc' AS image_sha256, 'cam' AS source, 'clarity' AS view_mode, CAST(id AS INTEGER) AS id, label, {rsql("v / 200")} AS score, {rsql("v * 0.5" + D, 3)} AS y1, {rsql("v / 100", 4)} AS quality, 1280 AS width FROM tr""")
def snapshot_sidecars(spark: SparkSession, d: str) -> DataFrame:
    """The JSON beside a snapshot, field by field."""
    n, v = F.col("event_id"), F.col("value")
    track = F.struct((n % 5).cast("int").alias("id"), F.col("event_type").alias("label"), F.lit(1).alias("class_id"), (v / 200).alias("score"), F.array(v, v * 0.5).alias("bbox"), F.array(v).alias("center"), F.lit("TRACKED").alias("lifecycle"), (v / 100).alias("quality"), F.lit(0).alias("recoveries"))
    calibration = F.struct(F.lit("c").alias("name"), F.lit(1280).alias("width"))
    rows = adapters.table(spark, d, "events").select(n, track.alias("track"))
    fixed = (F.lit(x) for x in ("frame.png", "abc", "def", "cam"))
    text = sinks.snapshot_sidecar(*fixed, n, F.lit("clarity"), F.lit("MEASURED"), F.col("track"), calibration=calibration)
    at = lambda path, kind: F.get_json_object("j", f"$.{path}").cast(kind)
    return rows.select(text.alias("j")).select(
        at("frame", "bigint").alias("frame"), at("schema", "int").alias("schema"), *(at(c, "string").alias(c) for c in ("image", "image_sha256", "source", "view_mode")), at("track.id", "int").alias("id"), at("track.label", "string").alias("label"),
        at("track.score", "double").alias("score"), at("track.bbox[1]", "double").alias("y1"), at("track.quality", "double").alias("quality"), at("calibration.width", "int").alias("width"),
    )


@query(f"SELECT i AS level, CAST(floor(pow(i / 255.0{D}, 0.58{D}) * 255) AS INTEGER) AS shown FROM range(256) t(i)")
def low_light_table(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, int(v)) for k, v in enumerate(pixels.low_light())], "level long, shown int")


#: Hue (0 to 179) and saturation (0 to 255) of a colour, and its brightness, rounded half up.
COLOUR = """c AS (SELECT p_partkey AS id, p_partkey * 37 % 256 AS b, p_partkey * 91 % 256 AS g, p_partkey * 53 % 256 AS r FROM part), m AS (SELECT *, greatest(b, g, r) AS high, least(b, g, r) AS low FROM c),
h AS (SELECT *, CASE WHEN high = low THEN 0.0::DOUBLE WHEN high = r THEN CAST(g - b AS DOUBLE) / (high - low) WHEN high = g THEN 2 + CAST(b - r AS DOUBLE) / (high - low) ELSE 4 + CAST(r - g AS DOUBLE) / (high - low) END * 30 AS turn FROM m),
hs AS (SELECT *, floor((turn - 180 * floor(turn / 180)) + 0.5::DOUBLE) % 180 AS hue, floor(CASE WHEN high > 0 THEN CAST(high - low AS DOUBLE) / high * 255 ELSE 0 END + 0.5::DOUBLE) AS saturation, floor(b * 0.114::DOUBLE + g * 0.587::DOUBLE + r * 0.299::DOUBLE + 0.5::DOUBLE) AS gray FROM h)"""


#: Descriptors that a task keeps.
KEPT = 4096


def _painted(spark: SparkSession, d: str, f: Callable[[np.ndarray, tuple], list[float]]) -> DataFrame:
    """Images whose left half is of a part's colour and whose right half is black: places and value of the left half's descriptor.

    A task describes an image once, however many parts have its colour; of more than KEPT colours it begins anew.
    """
    known: dict[tuple[int, ...], tuple[list[int], float]] = {}

    def described(colour: tuple[int, ...]) -> tuple[list[int], float]:
        image = np.zeros((24, 48, 3), np.uint8)
        image[:, :24] = colour
        found = np.array(f(image, (0, 0, 24, 24)))
        some = np.flatnonzero(found > 1e-6)
        return some.tolist(), float(found[some].max())

    def one(p: int) -> tuple[int, list[int], float]:
        colour = (p * 37 % 256, p * 91 % 256, p * 53 % 256)
        if colour not in known:
            if len(known) >= KEPT:
                known.clear()
            known[colour] = described(colour)
        return p, *known[colour]

    return _each(adapters.table(spark, d, "part").select("p_partkey"), "id long, places array<long>, value double", one)


@query(f"WITH {COLOUR} SELECT id, CAST(floor(hue / 15) * 4 + floor(saturation / 64) AS BIGINT) AS place, 1.0{D} AS value FROM hs")
def appearance_bins(spark: SparkSession, d: str) -> DataFrame:
    """The tracker's descriptor of a uniform region: one bin of hue and saturation."""
    return _painted(spark, d, pixels.appearance).select("id", F.col("places")[0].alias("place"), r("value").alias("value"))


@query(f"""WITH {COLOUR} SELECT id, CAST(floor(hue / 22.5{D}) * 4 + floor(saturation / 64) AS BIGINT) AS first_place, CAST(96 + floor(hue / 22.5{D}) * 4 + floor(saturation / 64) AS BIGINT) AS last_quarter, CAST(128 + floor(gray / 16) AS BIGINT) AS gray_place, 5 AS places,
  {rsql("1 / sqrt(5.0" + D + ")")} AS value FROM hs""")
def graph_descriptor_bins(spark: SparkSession, d: str) -> DataFrame:
    """The graph's descriptor of a uniform region: a bin of each quarter, one of brightness, no edges."""
    places = F.col("places")
    return _painted(spark, d, pixels.graph_descriptor).select("id", places[0].alias("first_place"), places[3].alias("last_quarter"), places[4].alias("gray_place"), F.size(places).alias("places"), r("value").alias("value"))


@query("WITH e AS (SELECT event_id, event_type FROM events) SELECT event_type AS label, count(*) AS n, min(event_id) AS first_seen FROM e GROUP BY 1")
def distinct_labels(spark: SparkSession, d: str) -> DataFrame:
    """Distinct labels, with how often and when first."""
    e = adapters.table(spark, d, "events")
    first = Window.partitionBy("event_type")
    rows = e.select(F.col("event_type").alias("label"), F.count("*").over(first).alias("n"), F.min("event_id").over(first).alias("first_seen"))
    return rows.distinct()
