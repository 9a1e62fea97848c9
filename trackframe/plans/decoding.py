"""Queries of the decoder, in its three layouts, and of the orientation of model outputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.functions import tracks as T
from trackframe.operators import decode, detect
from trackframe.plans.registry import DETECTIONS, iou_sql, query, r, rsql
from trackframe.sources import adapters

D = "::DOUBLE"
BOX = ("x1", "y1", "x2", "y2")
SIZES = {"input_w": 640, "input_h": 640, "frame_w": 1280, "frame_h": 720}


def _kept(order: str) -> str:
    """CTEs from scored (frame, det_idx, class_id, score, box) to kept rows with their rank in class."""
    return f"""grouped AS (
  SELECT frame, class_id, list([{{'score': score, 'det_idx': det_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY {order}) AS dets FROM scored GROUP BY frame, class_id
), folded AS (
  SELECT frame, class_id, list_reduce(dets, lambda acc, d: CASE WHEN len(list_filter(acc, lambda k: {iou_sql("k", "d[1]")} >= 0.45{D})) > 0 THEN acc ELSE list_concat(acc, d) END) AS list_ FROM grouped
), kept AS (SELECT frame, class_id, list_[rank] AS k, rank FROM (SELECT *, unnest(range(1, len(list_) + 1)) AS rank FROM folded))"""


def _placed(p: str = "") -> str:
    place = lambda v: f"greatest(0.0{D}, least(({p}{v} - {0 if v[0] == 'x' else 140}.0{D}) / 0.5{D}, {1279 if v[0] == 'x' else 719}.0{D})) AS {v}"
    return ", ".join(place(v) for v in BOX)


SHOWN = f"{rsql('score', 4)} AS score, {', '.join(f'{rsql(v, 2)} AS {v}' for v in BOX)}"
LABEL = "CASE class_id " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(T.LABELS[:3])) + " END AS label"
CENTRES = f"""raw AS (
  SELECT frame, det_idx, CAST(CAST((x1 + x2) * 0.5{D} AS FLOAT) AS DOUBLE) AS a, CAST(CAST((y1 + y2) * 0.5{D} AS FLOAT) AS DOUBLE) AS b, CAST(CAST(x2 - x1 AS FLOAT) AS DOUBLE) AS c, CAST(CAST(y2 - y1 AS FLOAT) AS DOUBLE) AS d,
    {", ".join(f"CAST(CAST(CASE WHEN class_id = {k} THEN score ELSE score * 0.3{D} END AS FLOAT) AS DOUBLE) AS s{k}" for k in range(3))} FROM detections
), best AS (SELECT *, greatest(s0, s1, s2) AS score, CASE greatest(s0, s1, s2) WHEN s0 THEN 0 WHEN s1 THEN 1 ELSE 2 END AS class_id, a - c / 2 AS x1, b - d / 2 AS y1, a + c / 2 AS x2, b + d / 2 AS y2 FROM raw)"""


def _centres(spark: SparkSession, d: str) -> DataFrame:
    """Raw model rows (centre, size, three class scores) made from line items."""
    det, box = adapters.detections(spark, d), G.Box.of()
    scores = [F.when(F.col("class_id") == k, F.col("score")).otherwise(F.col("score") * 0.3) for k in range(3)]
    return _raw(det, F.array(*(v.cast("float") for v in (*G.center(box), G.width(box), G.height(box), *scores))))


def _raw(det: DataFrame, values: Column) -> DataFrame:
    sizes = [F.lit(v).alias(k) for k, v in SIZES.items()]
    return det.select("video", "frame", F.col("det_idx").alias("row_idx"), values.alias("values"), *sizes, F.lit(0.5).alias("scale"), F.lit(0.0).alias("pad_x"), F.lit(140.0).alias("pad_y"))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("frame", "det_idx", "class_id", "label", r("score", 4).alias("score"), *(r(c, 2).alias(c) for c in BOX))


#: Frames whose rows pass for corners, score and class: their boxes have no area then, and all go.
CORNERS = f"SELECT frame FROM raw GROUP BY frame HAVING bool_and(abs(a - round(a)) < 1e-3{D} AND abs(s2 - round(s2)) < 1e-3{D} AND s1 BETWEEN -1e-4{D} AND 1.0001{D})"


@query(f"""WITH {DETECTIONS}, {CENTRES}, scored AS (SELECT * FROM best WHERE score >= 0.25{D} AND frame NOT IN ({CORNERS})), {_kept("score DESC, det_idx DESC")},
placed AS (SELECT frame, class_id, rank, k.score AS score, {_placed("k.")} FROM kept)
SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY class_id, rank) - 1 AS INTEGER) AS det_idx, class_id, {LABEL}, {SHOWN} FROM placed""")
def raw_decode(spark: SparkSession, d: str) -> DataFrame:
    return _shown(decode.decode(_centres(spark, d), 0.25, 0.45))


@query(f"""WITH {DETECTIONS}, {CENTRES}, scored AS (SELECT frame, det_idx, class_id, score, {_placed()} FROM best WHERE score >= 0.25{D}), {_kept("score DESC, det_idx")},
flat AS (SELECT frame, class_id, k.* FROM kept)
SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY score DESC, det_idx) - 1 AS INTEGER) AS det_idx, class_id, {LABEL}, {SHOWN} FROM flat""")
def lite_decode(spark: SparkSession, d: str) -> DataFrame:
    """The mobile rules: clipped before suppression, ties to the earlier row."""
    return _shown(decode.decode(_centres(spark, d), 0.25, 0.45, lite=True))


@query(f"""WITH {DETECTIONS}, raw AS (
  SELECT frame, det_idx, class_id, CAST(CAST(score AS FLOAT) AS DOUBLE) AS score, {", ".join(f"CAST(CAST(({'x1' if v == 'x2' else v} + CASE WHEN '{v}' = 'x2' AND det_idx % 4 < 3 THEN x2 - x1 ELSE 0 END) / CASE WHEN frame % 5 = 0 THEN 640.0{D} ELSE 1.0{D} END AS FLOAT) AS DOUBLE) AS {v}" for v in BOX)} FROM detections
), sure AS (SELECT *, max(greatest(abs(x1), abs(y1), abs(x2), abs(y2))) OVER (PARTITION BY frame) <= 2.5{D} AS share FROM raw WHERE score >= 0.25{D}),
scored AS (SELECT frame, det_idx, class_id, score, {", ".join(f"{v} * CASE WHEN share THEN 640.0{D} ELSE 1.0{D} END AS {v}" for v in BOX)} FROM sure), {_kept("score DESC, det_idx DESC")},
placed AS (SELECT frame, class_id, rank, k.score AS score, {_placed("k.")} FROM kept), real_ AS (SELECT * FROM placed WHERE x2 > x1 AND y2 > y1)
SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY class_id, rank) - 1 AS INTEGER) AS det_idx, class_id, {LABEL}, {SHOWN} FROM real_""")
def end2end_decode(spark: SparkSession, d: str) -> DataFrame:
    """Rows of corners, score and class, behind a batch column or not, in pixels or shares; every fourth box has no area."""
    det = adapters.detections(spark, d)
    right = F.when(F.col("det_idx") % 4 < 3, F.col("x2")).otherwise(F.col("x1"))
    unit = F.when(F.col("frame") % 5 == 0, F.lit(640.0)).otherwise(1.0)
    six = F.array(*((v / unit).cast("float") for v in (F.col("x1"), F.col("y1"), right, F.col("y2"))), F.col("score").cast("float"), F.col("class_id").cast("float"))
    values = F.when(F.col("frame") % 3 == 0, F.concat(F.array(F.lit(0.0).cast("float")), six)).otherwise(six)
    return _shown(decode.decode(_raw(det, values), 0.25, 0.45, T.LABELS[:3]))


@query("""WITH s AS (SELECT p_partkey AS id, 3 + p_partkey % 10 AS rows_, 3 + p_partkey % 13 AS columns_ FROM part), t AS (SELECT id, CASE WHEN rows_ < columns_ THEN columns_ ELSE rows_ END AS rows_, CASE WHEN rows_ < columns_ THEN rows_ ELSE columns_ END AS columns_ FROM s)
SELECT id, CASE WHEN columns_ < 6 THEN -1 ELSE rows_ END AS predictions, CASE WHEN columns_ < 6 THEN -1 ELSE columns_ END AS features FROM t""")
def oriented_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Shapes of model outputs, turned so that predictions are rows; -1 where that gives too few features."""

    def turn(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            out = []
            for i, a, b in page.itertuples(index=False):
                try:
                    out.append((i, *detect.oriented(np.zeros((1, a, b))).shape))
                except ValueError:
                    out.append((i, -1, -1))
            yield pd.DataFrame(out, columns=["id", "predictions", "features"])

    shapes = adapters.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (3 + F.col("p_partkey") % 10).alias("a"), (3 + F.col("p_partkey") % 13).alias("b"))
    return shapes.mapInPandas(turn, "id bigint, predictions bigint, features bigint")
