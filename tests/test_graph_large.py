"""The graph where it is large: packed links, counts, parts of the page, and values that only need to be right when rounded."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_graph_pairs import odd_rows
from tests.test_operators import REVIEWS, TRACKLETS, tracklet
from trackframe.operators import graph, pairwise
from trackframe.sources import sinks


def some_reviews(spark, t):
    keys = [r.key for r in graph.items(t).select("key").collect()]
    return spark.createDataFrame([(a, b, ("same", "different", "unsure")[k % 3]) for k, (a, b) in enumerate(zip(keys, keys[4:])) if k % 4 == 0], REVIEWS)


def odd_tracklets(spark):
    return spark.createDataFrame([*odd_rows(), tracklet("<q'&\">", 900, [1.0, 0.0, 0.0, 0.0]), tracklet("z", 901, [1.0, 0.0, 0.0, 0.0])], TRACKLETS)


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.collect())


def test_links_are_packed(spark, monkeypatch):
    """60 alike tracklets have 1,770 links, but a row each for themselves and their links in a block, and a forest."""
    t = spark.createDataFrame([tracklet(f"v{k}", k, [1.0, 0.0]) for k in range(60)], TRACKLETS)
    found = graph.links(t, None, 0.94).cache()
    n = {r.kind: r["count"] for r in found.groupBy("kind").count().collect()}
    assert n == {graph.JOIN: 59, graph.MEMBER: 60, graph.MORE: 59}
    assert found.agg(F.sum(F.length("others") / 4), F.sum(F.length("passes") / 8)).first()[:] == (1770, 1770)


@pytest.mark.parametrize("known", [0, 1_000_000])
def test_components_give_the_same_entities(spark, monkeypatch, known):
    """in blocks, by forests, on the driver or in rounds, with links handed on in many parts."""
    t = odd_tracklets(spark)
    w = some_reviews(spark, t)
    whole = rows_of(graph.entities(t, w, 0.8))
    for name, value in (("FEW", 0), ("KNOWN", known), ("BLOCK", 9), ("HELD", 3)):
        monkeypatch.setattr(graph, name, value)
    assert rows_of(graph.entities(t, w, 0.8)) == whole


def test_only_some_columns_are_made(spark):
    """what isn't asked for doesn't leave the comparison."""
    t = odd_tracklets(spark)
    w = some_reviews(spark, t)
    for reviews in (None, w):
        some = graph.edges(t, reviews, 0.5, 0.9, ("left", "right", "similarity"))
        assert rows_of(some) == rows_of(graph.edges(t, reviews, 0.5, 0.9).select("left", "right", "similarity"))
    assert graph.pairs(t, None, 0.5, ("l_key", "similarity")).columns == ["l_key", "similarity"]


@pytest.mark.parametrize("gallery", [False, True])
def test_rounded_values_need_few_exact_ones(monkeypatch, gallery):
    """with digits the rounded values and the comparisons are those of exact values, of which few are made."""
    rng, n = random.Random(5), 90
    at = lambda: [rng.gauss(0, 1) for _ in range(6)]
    rows = pa.table({
        "key": [f"k{k}" for k in range(n)], "video": [f"v{k % 7}" for k in range(n)], "p0": ["c"] * n, "p1": [f"v{k % 7}" for k in range(n)], "p2": list(range(n)),
        "descriptor": [at() for _ in range(n)], "gallery": pa.array([[at() for _ in range(k % 4)] if gallery else [] for k in range(n)], pa.list_(pa.list_(pa.float64()))), "first": [True] * n,
    })
    none = pa.table({c: pa.array([], pa.string()) for c in ("lo", "hi", "decision")})
    left, right, exact, _ = pairwise.similar(rows, none, True, 0.1)
    seen, whole = [], pairwise.Vectors.cosine
    monkeypatch.setattr(pairwise.Vectors, "cosine", lambda self, a, other, b: seen.append(len(a)) or whole(self, a, other, b))
    l, r, about, _ = (np.concatenate(x) if k < 3 else x for k, x in enumerate(zip(*pairwise.chunks(rows, none, True, 0.1, 6, (0.5,)), strict=True)))
    digits = lambda v: np.floor(v * 1e6 + 0.5)
    assert (l == left).all() and (r == right).all() and (digits(about) == digits(exact)).all() and ((about >= 0.5) == (exact >= 0.5)).all()
    assert sum(seen) < len(l) / 4


def test_edges_are_counted_where_they_are_found(spark, monkeypatch):
    """the counts are those of the edges, and one row a task."""
    monkeypatch.setattr(graph, "BLOCK", 30)
    t = odd_tracklets(spark)
    w = some_reviews(spark, t)
    every = graph.edges(t, w, 0.5, 0.9).collect()
    counts = graph.edge_counts(t, w, 0.5).collect()
    assert (sum(r.edges for r in counts), sum(r.manual for r in counts)) == (len(every), sum(r.strength == "manual" for r in every))
    assert len(counts) < 20


def test_page_in_parts_has_the_cards_of_the_document(spark, monkeypatch):
    """made in parts, the cards are those of the page that the driver makes of the whole document."""
    monkeypatch.setattr(graph, "CARDS", 7)
    t = odd_tracklets(spark)
    w = some_reviews(spark, t)
    page = sinks.graph_html(graph.document(t, w, 0.0, 0.9))
    edges = graph.edge_pages(t, w, 0.0, 0.9).collect()
    cards = lambda text, kind: sorted(re.findall(rf"<section class={kind}.*?</section>", text))
    assert cards("".join(r.cards for r in edges), "edge") == cards(page, "edge")
    assert sum(r.edges for r in edges) == len(cards(page, "edge")) > 100
    marked = graph.edge_pages(t, w, 0.0, 0.9, "<section class=edge ").agg(F.sum("found"), F.sum("manual")).first()
    assert marked[:] == (len(cards(page, "edge")), page.count("(manual, "))
    entities = sinks.entity_cards(graph.entities(t, w, 0.9), graph.items(t)).collect()
    assert cards("".join(r.card for r in entities), "entity") == cards(page, "entity")


def test_lean_links_carry_no_similarities(spark):
    """what descriptors alone tell isn't written with the links, which take a byte each where there are many."""
    t = spark.createDataFrame([tracklet(f"v{k}", k, [1.0, 0.0]) for k in range(60)], TRACKLETS)
    found = graph.links(t, None, 0.94, lean=True).filter(F.col("kind") == graph.MORE)
    assert found.agg(F.count("*"), F.sum(F.length("others")), F.count("passes")).first()[:] == (59, 1770, 0)
    seen = t.withColumn("gallery", F.array("descriptor"))
    assert graph.links(seen, None, 0.94, lean=True).agg(F.sum(F.length("passes") / 8)).first()[0] == 1770


def test_steps_hold_places():
    """lists of ascending places as bytes and back, with gaps about 255."""
    lists = [[0], [254, 255, 256, 511], [255], [3, 258, 768, 8191], list(range(300))]
    made, size = graph.steps(np.concatenate(lists), np.array([len(x) for x in lists]))
    ends = np.cumsum(size)
    assert [graph.places(made[e - n : e].tobytes()).tolist() for e, n in zip(ends, size, strict=True)] == lists


@pytest.mark.parametrize("block", [7, 8192])
def test_entities_are_those_of_explicit_links(spark, monkeypatch, block):
    """the similarities that the fold makes again choose as those of pairs() do, also among copies, galleries and reviews."""
    rng = random.Random(7)
    vectors = [[rng.gauss(0.3, 1) for _ in range(5)] for _ in range(25)]
    rows = [tracklet(f"v{k % 6}", k, rng.choice(vectors) if k % 2 else [rng.gauss(0.3, 1) for _ in range(5)], kind=k % 2, gallery=[rng.choice(vectors)] if k % 9 == 0 else None) for k in range(120)]
    t = spark.createDataFrame(rows, TRACKLETS)
    w = some_reviews(spark, t)
    passes = {}
    for r in graph.pairs(t, w, 0.4).collect():
        if r.decision != "unsure" or r.similarity is not None and r.similarity >= 0.4:
            passes[r.l_key, r.r_key] = {"same": 1.0, "different": -1.0}.get(r.decision, r.similarity)
    groups = []
    for r in graph.items(t).orderBy("class_id", "place").collect():
        whole = [(-min(s), g) for g, members in enumerate(groups) for s in [[passes.get((m, r.key), -1.0) for m in members]] if min(s) >= 0]
        groups[min(whole)[1]].append(r.key) if whole else groups.append([r.key])
    for name, value in (("FEW", 0), ("BLOCK", block)):
        monkeypatch.setattr(graph, name, value)
    found = {}
    for r in graph.entities(t, w, 0.4).orderBy("entity_id", "position").collect():
        found.setdefault(r.entity_id, []).append(r.member)
    assert sorted(found.values()) == sorted(groups) and max(map(len, groups)) > 2


def test_blocks_are_dealt_in_rounds(spark, monkeypatch):
    """the rounds deal each pair of blocks that is dealt at once without them, and a tracklet twice at most."""
    monkeypatch.setattr(graph, "BLOCK", 7)
    t = spark.createDataFrame([tracklet(f"v{k}", k, [1.0, float(k)], kind=k % 2) for k in range(90)], TRACKLETS)
    w = some_reviews(spark, t)
    dealt = lambda apart: rows_of(graph._dealt(t, w, apart)[0].select("class_id", "i", "j", "first", "key", "lo", "hi"))
    rounds = [dealt(apart) for apart in range(4)]
    assert sorted(sum(rounds, [])) == dealt(None) and all(rounds)
    assert max(sum(r[4] != "None" for r in x) for x in rounds) <= 2 * 90 < sum(r[4] != "None" for r in dealt(None))
