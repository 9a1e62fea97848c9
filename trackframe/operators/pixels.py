"""Appearance descriptors of image regions, in numpy: an optional layer under pandas UDFs."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HUES, SATURATIONS, MARGIN, SMALLEST = 12, 4, 0.12, 4


def hue_saturation(bgr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hue 0 to 180 and saturation 0 to 255 of 8-bit blue-green-red pixels."""
    b, g, r = (bgr[..., i].astype(float) for i in range(3))
    high, low = bgr.max(axis=-1).astype(float), bgr.min(axis=-1).astype(float)
    spread = np.where(high > low, high - low, 1.0)
    sector = np.select([high == r, high == g], [(g - b) / spread, 2 + (b - r) / spread], 4 + (r - g) / spread)
    hue = np.where(high > low, sector * 30 % 180, 0.0)
    return np.floor(hue + 0.5) % 180, np.floor(np.where(high > 0, (high - low) / np.where(high > 0, high, 1) * 255, 0) + 0.5)


def appearance(image: np.ndarray, box: tuple[float, float, float, float]) -> list[float] | None:
    """Hue-saturation histogram of the box's middle, at length 1; None for boxes under 4 pixels."""
    h, w = image.shape[:2]
    x1, y1 = (max(0, min(n - 1, round(v))) for v, n in ((box[0], w), (box[1], h)))
    x2, y2 = (max(a + 1, min(n, round(v))) for a, v, n in ((x1, box[2], w), (y1, box[3], h)))
    crop = image[y1:y2, x1:x2]
    if min(crop.shape[:2]) < SMALLEST:
        return None
    my, mx = (int(n * MARGIN) for n in crop.shape[:2])
    if min(crop.shape[0] - 2 * my, crop.shape[1] - 2 * mx) >= SMALLEST:
        crop = crop[my : crop.shape[0] - my, mx : crop.shape[1] - mx]
    hue, saturation = hue_saturation(crop)
    table, *_ = np.histogram2d(hue.ravel(), saturation.ravel(), bins=(HUES, SATURATIONS), range=((0, 180), (0, 256)))
    return (table / np.linalg.norm(table)).ravel().tolist()


CELLS, GRAYS, DIRECTIONS, SIDE, GRAPH_MARGIN, GRAPH_SMALLEST = 2, 16, 8, 96, 0.08, 8


@functools.lru_cache(maxsize=256)
def _area_weights(n: int, side: int) -> np.ndarray:
    edge = np.arange(side + 1) * n / side
    low, high = np.maximum(edge[:-1, None], np.arange(n)[None, :]), np.minimum(edge[1:, None], np.arange(1, n + 1)[None, :])
    w = np.maximum(0, high - low)
    return w / w.sum(axis=1, keepdims=True)


def area_resize(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Each pixel of the result is the mean of the area that it covers, by weights along rows and columns."""
    h, w = image.shape[:2]
    rows = (_area_weights(h, side) @ image.reshape(h, -1).astype(float)).reshape(side, w, -1)
    return np.matmul(_area_weights(w, side), rows)


def at_unit(x: np.ndarray) -> np.ndarray:
    return x / max(float(np.linalg.norm(x)), 1e-12)


def graph_descriptor(image: np.ndarray, box: tuple[float, float, float, float]) -> list[float] | None:
    """The descriptor of similarity graphs: colour by quarters, brightness, and directions of edges; 152 numbers at length 1.

    It is generic: no face, identity or biometric model is behind it. None for boxes under 8 pixels.
    """
    h, w = image.shape[:2]
    x1, y1 = (max(0, min(n - 1, round(v))) for v, n in ((box[0], w), (box[1], h)))
    x2, y2 = (max(a + 1, min(n, round(v))) for a, v, n in ((x1, box[2], w), (y1, box[3], h)))
    crop = image[y1:y2, x1:x2]
    if min(crop.shape[:2]) < GRAPH_SMALLEST:
        return None
    my, mx = (max(1, int(n * GRAPH_MARGIN)) for n in crop.shape[:2])
    if min(crop.shape[0] - 2 * my, crop.shape[1] - 2 * mx) >= GRAPH_SMALLEST:
        crop = crop[my : crop.shape[0] - my, mx : crop.shape[1] - mx]
    small = np.floor(area_resize(crop) + 0.5).astype(np.uint8)
    hue, saturation = hue_saturation(small)
    half = SIDE // CELLS
    # Bins of 22.5 degrees of hue by 64 of saturation, and of 16 of brightness; counts of whole numbers, so their order is free.
    bins = (hue // 22.5 * 4 + saturation // 64).astype(np.int64)
    quarters = [np.bincount(bins[r : r + half, c : c + half].ravel(), minlength=32).astype(float) for r in (0, half) for c in (0, half)]
    gray = np.floor(small @ np.array([0.114, 0.587, 0.299]) + 0.5)
    padded = np.pad(gray, 1, mode="reflect")
    smooth = lambda a, axis: a.take(range(SIDE), axis) + 2 * a.take(range(1, SIDE + 1), axis) + a.take(range(2, SIDE + 2), axis)
    slope = lambda a, axis: a.take(range(2, SIDE + 2), axis) - a.take(range(SIDE), axis)
    gx, gy = slope(smooth(padded, 0), 1), slope(smooth(padded, 1), 0)
    direction = np.floor(np.degrees(np.arctan2(gy, gx)) % 360 / 45).astype(int) % DIRECTIONS
    edges = np.bincount(direction.ravel(), weights=np.hypot(gx, gy).ravel(), minlength=DIRECTIONS)
    parts = [*(at_unit(q) for q in quarters), at_unit(np.bincount((gray // (256 // GRAYS)).astype(np.int64).ravel(), minlength=GRAYS).astype(float)), at_unit(edges)]
    whole = np.concatenate(parts)
    return at_unit(whole).tolist() if np.linalg.norm(whole) > 1e-12 else None


def _appearance(pixels: pd.Series, width: pd.Series, height: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    images = (np.frombuffer(p, np.uint8).reshape(h, w, 3) for p, w, h in zip(pixels, width, height, strict=True))
    return pd.Series([appearance(i, b) for i, b in zip(images, zip(x1, y1, x2, y2, strict=True), strict=True)])


def appearance_column(pixels: str = "pixels", width: str = "width", height: str = "height") -> Column:
    """Of rows with raw pixels (height x width x 3 bytes) and a box x1 to y2."""
    return F.pandas_udf(_appearance, "array<double>")(pixels, width, height, "x1", "y1", "x2", "y2")


def low_light(gamma: float = 0.58) -> np.ndarray:
    """The look-up table of the low-light view."""
    return np.clip((np.arange(256) / 255) ** gamma * 255, 0, 255).astype(np.uint8)
