"""Session logs: JSON lines of kind header, frame, event and footer; and review files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackframe.functions import tracks as T
from trackframe.functions.numbers import rounded
from trackframe.schemas import SESSION

#: The columns of the flat export, in order.
FLAT = (
    "frame",
    "t",
    "fps",
    "selected_id",
    "track_id",
    "label",
    "class_id",
    "score",
    "x1",
    "y1",
    "x2",
    "y2",
    "cx",
    "cy",
    "vx",
    "vy",
    "age",
    "hits",
    "missed",
    "confirmed",
    "lifecycle",
    "quality",
    "recoveries",
)


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all sessions, with the file (session) and the number of the line: which header is first is a matter of lines.

    Files are split as any text is; lines are numbered by where their split begins and their order in it. Blank lines don't count.
    """
    lines = spark.read.text(path).filter(F.btrim("value") != "")
    placed = lines.select(F.col("_metadata.file_path").alias("session"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    line = F.row_number().over(Window.partitionBy("session").orderBy("block", "place")) - 1
    return placed.select("session", line.alias("line"), F.from_json("value", SESSION).alias("r")).select("session", "line", "r.*")


def frames(rows: DataFrame) -> DataFrame:
    """Frame rows; of a frame that occurs twice in a session, the last line counts."""
    latest = Window.partitionBy("session", "frame").orderBy(F.desc("line"))
    return rows.filter("type = 'frame'").withColumn("n", F.row_number().over(latest)).filter("n = 1").drop("n")


def flat_tracks(rows: DataFrame) -> DataFrame:
    """One row per frame row and track, in the order of FLAT, with defaults for what is missing."""
    exploded = rows.filter("type = 'frame'").select("session", "line", "frame", "t", "fps", "selected_id", F.posexplode("tracks").alias("place", "tr"))
    or_ = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c.split(".")[-1])
    at = lambda c, i, name: F.get(F.col(f"tr.{c}"), F.lit(i)).alias(name)
    velocity = lambda i, name: F.coalesce(F.get("tr.velocity_px_frame", F.lit(i)), F.lit(0.0)).alias(name)
    return exploded.select(
        "session", "line", "place", "frame", or_("t", 0.0), or_("fps", 0.0), "selected_id", F.col("tr.id").alias("track_id"), or_("tr.label", ""), or_("tr.class_id", -1), or_("tr.score", 0.0),
        *(at("bbox", i, n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), at("center", 0, "cx"), at("center", 1, "cy"), velocity(0, "vx"), velocity(1, "vy"),
        or_("tr.age", 0), or_("tr.hits", 0), or_("tr.missed", 0), or_("tr.confirmed", False), or_("tr.lifecycle", ""), or_("tr.quality", 0.0), or_("tr.recoveries", 0),
    )


def overlay_rows(spine: DataFrame, rows: DataFrame) -> DataFrame:
    """Video frames (session, frame) with the session's tracks where it has some; frames without stay, with null."""
    joined = spine.join(frames(rows).select("session", "frame", "t", "fps", "tracks"), ["session", "frame"], "left")
    return joined.select("session", "frame", "t", "fps", F.explode_outer("tracks").alias("track")).select("session", "frame", "t", "fps", "track.*")


def frame_rows(states: DataFrame) -> DataFrame:
    """Track states as frame rows of a session log: one per video and frame, tracks in order of id."""
    r = lambda c, d: rounded(F.col(c), d)
    cx, cy = (F.col("x1") + F.col("x2")) * 0.5, (F.col("y1") + F.col("y2")) * 0.5
    track = F.struct(
        F.col("track_id").alias("id"), "class_id", "label", r("score", 6).alias("score"), F.array(*(r(c, 3) for c in ("x1", "y1", "x2", "y2"))).alias("bbox"), F.array(rounded(cx, 3), rounded(cy, 3)).alias("center"),
        F.array(r("vx", 3), r("vy", 3)).alias("velocity_px_frame"), "age", "hits", "missed", "confirmed", T.lifecycle(F.col("confirmed"), F.col("missed")).alias("lifecycle"),
        rounded(T.quality(F.col("hits"), F.col("last_score"), F.col("score"), F.col("missed"), F.col("confirmed")), 4).alias("quality"), "recoveries",
    )
    return states.groupBy("video", "frame").agg(F.sort_array(F.collect_list(track)).alias("tracks")).select(F.lit("frame").alias("type"), "video", "frame", "tracks")


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """lo, hi, decision of review files; items that aren't valid are left out, the last of a pair counts."""
    schema = "version int, decisions array<struct<left:string,right:string,decision:string>>"
    items = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("decisions").alias("place", "d"))
    decision = F.lower("d.decision")
    valid = items.filter(F.col("d.left").isNotNull() & F.col("d.right").isNotNull() & decision.isin("same", "different", "unsure"))
    pair = valid.select("place", F.least("d.left", "d.right").alias("lo"), F.greatest("d.left", "d.right").alias("hi"), decision.alias("decision"))
    return pair.groupBy("lo", "hi").agg(F.max_by("decision", "place").alias("decision"))
