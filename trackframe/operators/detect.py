"""The seam for models: any callable that takes an image to a tensor becomes a source of raw predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from trackframe.schemas import RAW_PREDICTIONS

WIDEST, FEWEST = 512, 6


def oriented(tensor: np.ndarray) -> np.ndarray:
    """Rows of predictions: a tensor with fewer rows than columns, and at most WIDEST rows, lies on its side."""
    tensor = np.squeeze(np.asarray(tensor))
    if tensor.ndim != 2:
        raise ValueError(f"model output of shape {tensor.shape} isn't a table")
    if tensor.shape[0] < tensor.shape[1] and tensor.shape[0] <= WIDEST:
        tensor = tensor.T
    if tensor.shape[1] < FEWEST:
        raise ValueError(f"{tensor.shape[1]} features are too few")
    return tensor


def predict(frames: DataFrame, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], input_w: int = 640, input_h: int = 640, confidence: float = 0.0) -> DataFrame:
    """RAW_PREDICTIONS of frames (video, frame, width, height, pixels) that need a detector pass.

    make_model runs once a task and gives a callable from a letterboxed image (input_h, input_w, 3) to the model's tensor.
    Images are letterboxed by the nearest pixel. Rows whose scores are all below confidence aren't sent on.
    """

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for page in pages:
            rows = []
            for f in page.itertuples():
                scale = min(input_w / f.width, input_h / f.height)
                w, h = round(f.width * scale), round(f.height * scale)
                left, top = round((input_w - w) / 2 - 0.1), round((input_h - h) / 2 - 0.1)
                image = np.frombuffer(f.pixels, np.uint8).reshape(f.height, f.width, 3)
                box = np.full((input_h, input_w, 3), 114, np.uint8)
                box[top : top + h, left : left + w] = image[(np.arange(h) / scale).astype(int)[:, None], (np.arange(w) / scale).astype(int)[None, :]]
                for i, v in enumerate(oriented(model(box))):
                    if v[4:].max() >= confidence:
                        rows.append((f.video, f.frame, i, v.astype(np.float32).tolist(), input_w, input_h, f.width, f.height, scale, float(left), float(top)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RAW_PREDICTIONS.split(", ")])

    return frames.filter("should_detect").select("video", "frame", "width", "height", "pixels").mapInPandas(run, RAW_PREDICTIONS)
