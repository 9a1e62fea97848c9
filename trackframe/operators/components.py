"""Connected components of a graph of links, by alternating large and small stars.

Both stars are a minimum per node and a join back. A hub with very many links is summed before it is shuffled, and its
links are joined with its minimum by broadcast: nodes with over 1/HUBS of all links are at most HUBS. After each round the
links are written to the shared folder. Rounds end when the links no longer change; then every link goes from a node to
the smallest node of its component. Links with a null end are left out, repeated ones count once, and an empty table of
links gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.sources.shared import cut, discard

HUBS, LEAST_HUB = 1000, 1000


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """rows (a, b), total of them, with m, the smallest b of their a."""
    per = rows.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hubs = per.filter(F.col("n") > max(LEAST_HUB, total // HUBS)).select("a", "m").collect()  # at most HUBS
    if not hubs:
        return rows.join(per.select("a", "m"), "a")
    known = F.broadcast(rows.sparkSession.createDataFrame(hubs, "a long, m long"))
    others = rows.join(known.select("a"), "a", "left_anti")
    rest = others.join(others.groupBy("a").agg(F.min("b").alias("m")), "a")
    return rest.unionByName(rows.join(known, "a"))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    m = F.least("m", "a")
    return _with_least(both, 2 * total).filter("b > a").select(F.col("b").alias("a"), m.alias("b")).filter("a != b").distinct()


def _small_star(links: DataFrame, total: int) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    found = _with_least(down, total)
    # Each neighbour goes to the minimum, and so does the node itself: its row is the one whose neighbour is the minimum.
    to = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
    return found.select(to.alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a long, b long) a table: node, component (its smallest node) for every node that isn't the smallest itself."""
    links, before = cut(links.filter("a != b").distinct(), "links"), None
    while True:
        sign = tuple(links.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 24))).first())
        if sign == before or sign[0] == 0:
            out = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out.cut_path = links.cut_path
            return out
        before = sign
        large = cut(_large_star(links, sign[0]), "large", drop=[links])
        links = cut(_small_star(large, large.count()), "links")
        discard(large)
