"""Model output to detections: layout test, confidence filter, coordinates and class-wise suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions import geometry as G
from trackframe.functions.tracks import LABELS, label_of

KEPT = "array<struct<score:double,tie:int,det_idx:int,x1:double,y1:double,x2:double,y2:double>>"


def suppress(detections: DataFrame, threshold: float, keys: tuple[str, ...] = ("video", "frame"), stable: bool = False) -> DataFrame:
    """Class-wise greedy suppression: in order of score, a box goes if a kept one of its class overlaps it by threshold.

    Ties go to the higher det_idx, or with stable to the lower. Returns keys, class_id, det_idx, score, box and rank (the place
    among the kept of its class). A group is one class of one frame, so it is bounded by the model's output.
    """
    tie = -F.col("det_idx") if stable else F.col("det_idx")
    item = F.struct(F.col("score").cast("double").alias("score"), tie.alias("tie"), "det_idx", *(F.col(c).cast("double").alias(c) for c in G.Box._fields))
    box = lambda s: G.Box(s["x1"], s["y1"], s["x2"], s["y2"])

    def step(kept: Column, d: Column) -> Column:
        return F.when(F.exists(kept, lambda k: G.iou(box(k), box(d)) >= threshold), kept).otherwise(F.concat(kept, F.array(d)))

    groups = detections.groupBy(*keys, "class_id").agg(F.sort_array(F.collect_list(item), asc=False).alias("dets"))
    kept = groups.select(*keys, "class_id", F.posexplode(F.aggregate("dets", F.array().cast(KEPT), step)).alias("rank", "d"))
    return kept.select(*keys, "class_id", "d.det_idx", "d.score", *(f"d.{c}" for c in G.Box._fields), (F.col("rank") + 1).alias("rank"))


def looks_end_to_end(raw: DataFrame, label_count: int, keys: tuple[str, ...] = ("video", "frame")) -> DataFrame:
    """Per tensor: end2end, whether its rows are x1, y1, x2, y2, score, class, after a batch column of whole numbers or not."""
    size = F.size("values")
    value = lambda i: F.when(size == 7, F.get("values", F.lit(i + 1))).when(size == 6, F.get("values", F.lit(i))).cast("double")
    whole = lambda x: F.max(F.abs(x - F.rint(x))) < 1e-3
    finite = lambda x: F.coalesce(F.bool_and(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    first = F.get("values", F.lit(0)).cast("double")
    batch = (F.max(size) == 6) | ((F.max(size) == 7) & finite(first) & whole(first))
    scores = finite(value(4)) & (F.min(value(4)) >= -1e-4) & (F.max(value(4)) <= 1.0001)
    test = (F.min(size) == F.max(size)) & batch & scores & finite(value(5)) & whole(value(5)) & F.lit(label_count > 2)
    return raw.groupBy(*keys).agg(F.coalesce(test, F.lit(False)).alias("end2end"))


def decode(raw: DataFrame, confidence: float, threshold: float, labels: list[str] | None = None, lite: bool = False) -> DataFrame:
    """RAW_PREDICTIONS to detections. det_idx numbers a frame's detections by class, then score.

    Of end-to-end rows the boxes are corners, and boxes without area go; of the others they are centre and size, with one
    score per class. Boxes of at most 2.5 throughout a frame are taken as shares of the input size. lite: the mobile rules,
    which clip before suppression, look at the first 32 rows only for shares, and break ties the other way.
    """
    labels = labels or LABELS
    keys = ("video", "frame")
    rows = raw.join(looks_end_to_end(raw, len(labels)), list(keys)) if not lite else raw.withColumn("end2end", F.lit(False))
    v = F.when(F.col("end2end") & (F.size("values") == 7), F.slice("values", 2, 6)).otherwise(F.col("values"))
    rows = rows.withColumn("v", F.transform(v, lambda x: x.cast("double")))
    scores = F.slice("v", F.lit(5), F.greatest(F.lit(0), F.size("v") - 4))
    rows = rows.withColumns({
        "score": F.when(F.col("end2end"), F.get("v", F.lit(4))).otherwise(F.array_max(scores)),
        "class_id": F.when(F.col("end2end"), F.rint(F.get("v", F.lit(5))).cast("int")).otherwise((F.array_position(scores, F.array_max(scores)) - 1).cast("int")),
    })
    frame = Window.partitionBy(*keys)
    a, b, c, d = (F.get("v", F.lit(i)) for i in range(4))
    if lite:
        rows = rows.withColumn("share", ~F.coalesce(F.max(((a > 2.5) | (c > 2.5)) & (F.col("row_idx") < 32)).over(frame), F.lit(False)))
        rows = rows.filter(F.col("score") >= confidence)
    else:
        rows = rows.filter(F.col("score") >= confidence)
        most = F.when(F.col("end2end"), F.greatest(*(F.abs(x) for x in (a, b, c, d)))).otherwise(F.greatest(a, b, c, d))
        rows = rows.withColumn("share", F.max(F.when(~F.isnan(most), most)).over(frame) <= 2.5)
    sx, sy = (F.when(F.col("share"), F.col(n).cast("double")).otherwise(1.0) for n in ("input_w", "input_h"))
    if lite:
        sy = sx
    corners, middle = G.Box(a * sx, b * sy, c * sx, d * sy), G.from_center(a * sx, b * sy, c * sx, d * sy)
    boxes = G.Box(*(F.when(F.col("end2end"), x).otherwise(y) for x, y in zip(corners, middle, strict=True)))
    place = lambda box: G.clip(G.unletterbox(box, F.col("scale"), F.col("pad_x"), F.col("pad_y")), F.col("frame_w"), F.col("frame_h"))
    sizes = rows.groupBy(*keys).agg(*(F.first(n).alias(n) for n in ("end2end", "frame_w", "frame_h", "scale", "pad_x", "pad_y")))
    boxed = rows.select(*keys, F.col("row_idx").alias("det_idx"), "score", "class_id", *(place(boxes) if lite else boxes).columns())
    kept = suppress(boxed, threshold, keys, stable=lite).join(sizes, list(keys))
    out = kept if lite else kept.select(*(c for c in kept.columns if c not in G.Box._fields), *place(G.Box.of()).columns())
    out = out.filter(~F.col("end2end") | ((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))) if not lite else out
    order = Window.partitionBy(*keys).orderBy(*((F.desc("score"), "det_idx") if lite else ("class_id", "rank")))
    number = (F.row_number().over(order) - 1).cast("int").alias("det_idx")
    return out.select(*keys, number, *G.Box._fields, "score", "class_id", label_of(F.col("class_id"), labels).alias("label"))
