"""Boxes, points and transforms as Column expressions. Boxes are four columns x1, y1, x2, y2 in pixels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        """The box in the columns {prefix}x1 to {prefix}y2; a prefix that ends in a dot names a struct."""
        return cls(*(F.col(f"{prefix}{c}") for c in cls._fields))

    def columns(self, prefix: str = "") -> list[Column]:
        return [v.alias(f"{prefix}{c}") for v, c in zip(self, self._fields, strict=True)]


def width(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.x2 - b.x1)


def height(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.y2 - b.y1)


def center(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) * 0.5, (b.y1 + b.y2) * 0.5


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; extents below 0 count as 0, and the union is at least 1e-6."""
    shared = F.greatest(F.lit(0.0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(F.lit(0.0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))
    return shared / F.greatest(width(a) * height(a) + width(b) * height(b) - shared, F.lit(1e-6))


def iou32(a: Box, b: Box) -> Column:
    """iou() in single precision throughout, as the mobile profile has it."""
    single = lambda v: F.lit(v).cast("float") if isinstance(v, float) else v.cast("float")
    a, b = (Box(*(single(v) for v in box)) for box in (a, b))
    extent = lambda lo, hi: F.greatest(single(0.0), hi - lo)
    shared = extent(F.greatest(a.x1, b.x1), F.least(a.x2, b.x2)) * extent(F.greatest(a.y1, b.y1), F.least(a.y2, b.y2))
    area = lambda x: extent(x.x1, x.x2) * extent(x.y1, x.y2)
    return (shared / F.greatest(area(a) + area(b) - shared, single(1e-6))).cast("float")


def shift(b: Box, dx: Column, dy: Column) -> Box:
    return Box(b.x1 + dx, b.y1 + dy, b.x2 + dx, b.y2 + dy)


def transform_point(x: Column, y: Column, affine: Column) -> tuple[Column, Column]:
    """affine is an array a, b, tx, c, d, ty."""
    a, b, tx, c, d, ty = (affine[i] for i in range(6))
    return a * x + b * y + tx, c * x + d * y + ty


def transform(box: Box, affine: Column) -> Box:
    """The upright hull of the four transformed corners."""
    corners = [transform_point(x, y, affine) for x in (box.x1, box.x2) for y in (box.y1, box.y2)]
    xs, ys = zip(*corners, strict=True)
    return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def from_center(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def clip(b: Box, frame_w: Column, frame_h: Column) -> Box:
    within = lambda v, n: F.greatest(F.lit(0.0), F.least(v, n - 1.0))
    return Box(within(b.x1, frame_w), within(b.y1, frame_h), within(b.x2, frame_w), within(b.y2, frame_h))


def unletterbox(b: Box, scale: Column, pad_x: Column, pad_y: Column) -> Box:
    return Box((b.x1 - pad_x) / scale, (b.y1 - pad_y) / scale, (b.x2 - pad_x) / scale, (b.y2 - pad_y) / scale)


def letterbox(frame_w: Column, frame_h: Column, input_w: Column, input_h: Column) -> dict[str, Column]:
    """Scale, resized size and the left and top padding that a letterboxed model input has."""
    scale = F.least(input_w / frame_w, input_h / frame_h)
    new_w, new_h = F.bround(frame_w * scale).cast("int"), F.bround(frame_h * scale).cast("int")
    pad = lambda full, new: F.bround((full - new) / 2.0 - 0.1).cast("int")
    return {"scale": scale, "new_w": new_w, "new_h": new_h, "pad_x": pad(input_w, new_w), "pad_y": pad(input_h, new_h)}


def contains(b: Box, x: Column, y: Column) -> Column:
    """Whether a point lies in the closed box."""
    return x.between(b.x1, b.x2) & y.between(b.y1, b.y2)


def crop_bounds(b: Box, margin: float, frame_w: Column, frame_h: Column) -> Box:
    """Whole-pixel bounds (cut off, not rounded) of the box with a margin, within the frame; null where nothing is left."""
    mx, my = (b.x2 - b.x1) * margin, (b.y2 - b.y1) * margin
    x1, y1 = (F.greatest(F.lit(0.0), v).cast("int") for v in (b.x1 - mx, b.y1 - my))
    x2, y2 = (F.least(n.cast("double"), v).cast("int") for n, v in ((frame_w, b.x2 + mx), (frame_h, b.y2 + my)))
    some = (x2 > x1) & (y2 > y1)
    return Box(*(F.when(some, v) for v in (x1, y1, x2, y2)))


def fit_center(view_w: Column, view_h: Column, source_w: Column, source_h: Column) -> Box:
    """The rectangle in which a source is shown, centred, in a view."""
    ratio, view = source_w / source_h, view_w / F.greatest(F.lit(1), view_h)
    wide = view > ratio
    draw_w, draw_h = F.when(wide, view_h * ratio).otherwise(view_w), F.when(wide, view_h.cast("double")).otherwise(view_w / ratio)
    left, top = F.when(wide, (view_w - draw_w) / 2).otherwise(0.0), F.when(wide, 0.0).otherwise((view_h - draw_h) / 2)
    return Box(left, top, left + draw_w, top + draw_h)


def map_point(x: Column, y: Column, source_w: Column, source_h: Column, shown: Box) -> tuple[Column, Column]:
    """A source point in the rectangle of fit_center."""
    return shown.x1 + x / source_w * (shown.x2 - shown.x1), shown.y1 + y / source_h * (shown.y2 - shown.y1)
