"""Where queries register, with their SQL; and what several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.functions.numbers import rounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its name, with its SQL where there is one."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r(c: str | Column, digits: int = 6) -> Column:
    return rounded(F.col(c) if isinstance(c, str) else c, digits)


def rsql(x: str, digits: int = 6) -> str:
    p = f"CAST({10**digits} AS DOUBLE)"
    return f"(CASE WHEN ({x}) < 0 THEN -floor(-({x}) * {p} + 0.5) / {p} ELSE floor(({x}) * {p} + 0.5) / {p} END + 0.0::DOUBLE)"


def iou_sql(a: str, b: str) -> str:
    side = lambda lo, hi: f"greatest(0.0::DOUBLE, least({a}.{hi}, {b}.{hi}) - greatest({a}.{lo}, {b}.{lo}))"
    area = lambda x: f"(greatest(0.0::DOUBLE, {x}.x2 - {x}.x1) * greatest(0.0::DOUBLE, {x}.y2 - {x}.y1))"
    shared = f"({side('x1', 'x2')} * {side('y1', 'y2')})"
    return f"({shared} / greatest({area(a)} + {area(b)} - {shared}, 1e-6::DOUBLE))"


DETECTIONS = """boxed AS (
  SELECT l_orderkey AS frame, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, CAST(l_partkey % 3 AS INTEGER) AS class_id,
    0.05::DOUBLE + CAST(l_partkey % 77 AS DOUBLE) / 80::DOUBLE AS score, CAST(l_suppkey % 12 AS DOUBLE) * 40 AS x1, CAST(l_partkey % 7 AS DOUBLE) * 30 AS y1
  FROM lineitem
), detections AS (
  SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY score, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS det_idx,
    x1, y1, x1 + 40 + l_quantity AS x2, y1 + 30 + l_quantity * 0.5::DOUBLE AS y2, score, class_id
  FROM boxed
)"""


NMS = f"""grouped AS (
  SELECT frame, class_id, list([{{'score': score, 'det_idx': det_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] ORDER BY score DESC, det_idx DESC) AS dets
  FROM detections WHERE score >= 0.25::DOUBLE GROUP BY frame, class_id
), kept AS (
  SELECT frame, class_id, len(dets) AS n, list_reduce(dets, lambda acc, d: CASE WHEN len(list_filter(acc, lambda k: {iou_sql("k", "d[1]")} >= 0.45::DOUBLE)) > 0 THEN acc ELSE list_concat(acc, d) END) AS kept FROM grouped
)"""


STATES = """one AS (
  SELECT user_id AS track_id, CAST(floor(event_id / 50) AS BIGINT) AS frame, max(event_id) AS event_id, arg_max(event_type, event_id) AS label, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2
), states AS (
  SELECT track_id, frame, label, row_number() OVER w > 2 AS confirmed, CAST(event_id % 4 AS INTEGER) AS missed, CAST(row_number() OVER w AS INTEGER) AS hits, value AS x1, value * 0.5::DOUBLE AS y1, value + 20 AS x2, value * 0.5::DOUBLE + 40 AS y2
  FROM one WINDOW w AS (PARTITION BY track_id ORDER BY frame)
)"""


COSINE = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)))))"
ITEMS = "items AS (SELECT vec_id, 'v' || (vec_id % 5) AS video, label AS class_id, 'class ' || label AS label, CAST(embedding AS DOUBLE[]) AS v, 'v' || (vec_id % 5) || '#T' || vec_id AS key FROM embeddings)"
REVIEWED = """turns AS (SELECT key, lead(key) OVER w AS other, row_number() OVER w AS n FROM items WINDOW w AS (PARTITION BY class_id ORDER BY vec_id)),
reviews AS (SELECT least(key, other) AS lo, greatest(key, other) AS hi, CASE CAST(floor(n / 20) AS BIGINT) % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'different' ELSE 'unsure' END AS decision FROM turns WHERE n % 20 = 1 AND other IS NOT NULL)"""
PAIRS = f"""pairs AS (SELECT a.key AS l, b.key AS r, a.label, {COSINE} AS sim, w.decision FROM items a JOIN items b ON a.class_id = b.class_id AND (a.video, a.vec_id) < (b.video, b.vec_id)
  LEFT JOIN reviews w ON w.lo = least(a.key, b.key) AND w.hi = greatest(a.key, b.key) WHERE a.video <> b.video OR w.decision = 'same')"""
EDGE_COLUMNS = f"l AS \"left\", r AS \"right\", label, {rsql('sim')} AS similarity, CASE WHEN decision IN ('same', 'different') THEN 'manual' WHEN sim >= 0.30::DOUBLE THEN 'strong' ELSE 'review' END AS strength"
