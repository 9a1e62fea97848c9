"""Pairs of the similarity graph, block by block, against the same similarity as Column expressions over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.test_operators import TRACKLETS, REVIEWS, tracklet
from trackframe.functions.numbers import cosine, gallery_similarity, tracklet_similarity
from trackframe.operators import graph, pairwise


def odd_rows():
    rng = random.Random(3)
    one = lambda n=4: [rng.uniform(-0.2, 1.0) for _ in range(n)]
    odd = [[], [0.0] * 4, [1e-200] * 4, [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0], [1e200, 1.0, 0.0, 0.0], [1.0, 2.0], [None, 1.0, 0.0, 0.0]]
    rows = []
    for k in range(70):
        gallery = None if k % 3 == 0 else [] if k % 7 == 0 else [rng.choice(odd) if rng.random() < 0.15 else one() for _ in range(rng.randint(1, 5))]
        rows.append(tracklet(rng.choice(["A", "a", "b", "c"]), k, odd[k % 8] if k % 5 == 0 else one(), kind=k % 2, gallery=gallery))
    return rows


def by_columns(tracklets, reviews, least):
    """All pairs, by joins and Column expressions."""
    rows = graph.items(tracklets)
    l, r = (rows.select(*(F.col(c).alias(f"{s}_{c}") for c in ("key", "video", "class_id", "place", "descriptor", "gallery"))) for s in "lr")
    none = F.array().cast("array<array<double>>")
    both = l.join(r, (F.col("l_class_id") == F.col("r_class_id")) & (F.col("l_place") < F.col("r_place")))
    known = reviews.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"), "decision")
    both = both.withColumns({"lo": F.least("l_key", "r_key"), "hi": F.greatest("l_key", "r_key")}).join(known, ["lo", "hi"], "left")
    both = both.filter((F.col("l_video") != F.col("r_video")) | F.col("decision").eqNullSafe("same"))
    seen = gallery_similarity(F.coalesce("l_gallery", none), F.coalesce("r_gallery", none))
    scored = both.withColumn("similarity", tracklet_similarity(cosine(F.col("l_descriptor"), F.col("r_descriptor")), seen))
    return scored.filter(F.col("decision").isNotNull() | (F.col("similarity") >= least)).select("l_key", "r_key", "similarity", "decision")


def told(df):
    return sorted(tuple(map(str, r)) for r in df.select("l_key", "r_key", "similarity", "decision").collect())


@pytest.mark.parametrize("block", [3, 4096])
@pytest.mark.parametrize("least", [0.0, 0.8])
def test_pairs_are_those_of_columns(spark, monkeypatch, block, least):
    monkeypatch.setattr(graph, "BLOCK", block)
    t = spark.createDataFrame(odd_rows(), TRACKLETS)
    keys = [r.key for r in graph.items(t).select("key").collect()]
    reviews = [(a, b, d) for k, (a, b) in enumerate(zip(keys, keys[4:])) for d in [("same", "different", "unsure")[k % 3]] if k % 4 == 0]
    w = spark.createDataFrame(reviews, REVIEWS)
    assert told(graph.pairs(t, w, least)) == told(by_columns(t, w, least))


def test_reviews_meet_tracklets_not_pairs(spark):
    """What is joined lies below the comparison of pairs, so no pair is shuffled for its review."""
    t = spark.createDataFrame(odd_rows(), TRACKLETS)
    w = spark.createDataFrame([("a#T1", "b#T2", "same")], REVIEWS)
    plan = graph.edges(t, w)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("FlatMapGroupsInArrow")[0]


def test_few_exact_comparisons(spark, monkeypatch):
    """Of pairs with galleries only those whose bound reaches the threshold are compared vector by vector."""
    import pyarrow as pa

    n, seen = 60, []
    at = lambda k: [math.cos(k), math.sin(k)]
    rows = pa.table({
        "key": [f"v{k}#T{k}" for k in range(n)], "video": [f"v{k}" for k in range(n)], "p0": ["c"] * n, "p1": [f"v{k:03}" for k in range(n)], "p2": list(range(n)),
        "descriptor": [at(k) for k in range(n)], "gallery": [[at(k), at(k + 0.1)] for k in range(n)], "first": [True] * n,
    })
    whole = pairwise.Galleries.similarity
    monkeypatch.setattr(pairwise.Galleries, "similarity", lambda self, a, b: seen.append(len(a)) or whole(self, a, b))
    left, *_ = pairwise.similar(rows, pa.table({"lo": pa.array([], pa.string()), "hi": pa.array([], pa.string()), "decision": pa.array([], pa.string())}), True, 0.95)
    assert len(left) <= sum(seen) < n * (n - 1) / 2 / 4


@pytest.mark.parametrize("few", [0, 200_000])
def test_many_links_are_folded_by_links(spark, monkeypatch, few):
    """400 alike tracklets of 400 videos are one entity, those unlike all are their own; a reviewed difference parts."""
    monkeypatch.setattr(graph, "FEW", few)
    rows = [tracklet(f"v{k:03}", k, [1.0, 0.001 * (k % 5)]) for k in range(400)] + [tracklet("w", k, [0.0, -1.0]) for k in range(20)]
    w = spark.createDataFrame([("v000#T0", "v399#T399", "different")], REVIEWS)
    found = graph.entities(spark.createDataFrame(rows, TRACKLETS), w).groupBy("entity_id").count().orderBy("entity_id").collect()
    assert [r["count"] for r in found] == [399, 1] + [1] * 20
