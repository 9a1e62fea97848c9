"""Descriptors of images that repeat."""

import numpy as np

from trackframe.operators import pixels
from trackframe.plans import records


def test_an_image_is_described_once_a_task(spark, tmp_path, monkeypatch):
    """2000 parts of 256 colours: all are returned, each colour is described once by each task."""
    calls = spark.sparkContext.accumulator(0)
    spark.range(2000).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")

    def counted(image, box):
        calls.add(1)
        return pixels.graph_descriptor(image, box)

    assert len(records._painted(spark, str(tmp_path), counted).collect()) == 2000
    assert calls.value == 256


def test_descriptor_bins_are_those_of_histograms():
    rng = np.random.default_rng(4)
    for size in (9, 40, 130):
        image = rng.integers(0, 256, (size, size + 5, 3)).astype(np.uint8)
        my, mx = max(1, int(size * 0.08)), max(1, int((size + 5) * 0.08))
        crop = image[my : size - my, mx : size + 5 - mx] if size - 2 * my >= 8 else image
        small = np.floor(pixels.area_resize(crop) + 0.5).astype(np.uint8)
        hue, saturation = pixels.hue_saturation(small)
        first, *_ = np.histogram2d(hue[:48, :48].ravel(), saturation[:48, :48].ravel(), bins=(8, 4), range=((0, 180), (0, 256)))
        got = np.array(pixels.graph_descriptor(image, (0, 0, size + 5, size)))[:32]
        assert np.allclose(got / np.linalg.norm(got), first.ravel() / np.linalg.norm(first))
