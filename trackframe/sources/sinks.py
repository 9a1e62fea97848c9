"""Writers: session logs, flat CSV, reports, the graph document and its HTML page, snapshot sidecars."""

from __future__ import annotations

import html
import json
import math
import re
from collections.abc import Callable
from functools import reduce
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trackframe.functions.numbers import rounded
from trackframe.sources.sessions import FLAT


def write_session(header: DataFrame, body: DataFrame, footer: DataFrame, path: str) -> None:
    """Rows as JSON lines, by kind and then by the column ordinal, in one file per session that reads from top to bottom.

    With a column session there is a folder session=... for each, and sessions are written side by side; a session's file is
    one task's. Without it all rows are one session.
    """
    many = "session" in header.columns
    parts = []
    for kind, d in enumerate((header, body, footer)):
        value = F.to_json(F.struct(*(c for c in d.columns if c not in ("ordinal", "session"))))
        ordinal = F.col("ordinal").cast("long") if "ordinal" in d.columns else F.lit(0).cast("long")
        parts.append(d.select(*(["session"] if many else []), F.lit(kind).alias("kind"), F.coalesce(ordinal, F.lit(0)).alias("ordinal"), value.alias("value")))
    lines = parts[0].unionByName(parts[1]).unionByName(parts[2])
    if many:
        dealt = lines.repartition("session").sortWithinPartitions("session", "kind", "ordinal")
        dealt.select("session", "value").write.partitionBy("session").text(path)
    else:
        lines.coalesce(1).sortWithinPartitions("kind", "ordinal").select("value").write.text(path)


def write_flat_csv(flat: DataFrame, path: str) -> int:
    """The flat columns in their fixed order, with a header; returns the number of rows that were written."""
    seen = Observation()
    ordered = flat.orderBy("session", "line", "place").select(*FLAT)
    ordered.observe(seen, F.count("*").alias("n")).write.option("header", True).csv(path)
    return seen.get["n"]


def report_json(report: DataFrame) -> DataFrame:
    """session and its report as JSON, one row each."""
    return report.select("session", F.to_json(F.struct(*(c for c in report.columns if c != "session"))).alias("report"))


def write_graph(document: dict, path: str, run: dict | None = None) -> None:
    """The graph document, with what is known of the run (inputs, configuration, counts)."""
    document = document | ({"run": run} if run else {})
    Path(path).write_text(json.dumps(document, indent=2, ensure_ascii=False), encoding="utf-8")


def review_document(reviews: DataFrame) -> dict:
    """Reviews in the form that read_reviews takes."""
    return {"version": 1, "decisions": [{"left": r.lo, "right": r.hi, "decision": r.decision} for r in reviews.orderBy("lo", "hi").collect()]}


#: The cards of the graph's page, and the places that are filled in.
ENTITY, MEMBER = "<section class=entity><h3>{0}</h3><p>{1}</p><ul>{2}</ul></section>", "<li>{0} track {1}</li>"
EDGE = "<section class=edge data-left='{0}' data-right='{1}'><b>{0}</b> and <b>{1}</b>: {2} ({3}, {4}) <select>" + "".join(f"<option>{d}</option>" for d in ("", "same", "different", "unsure")) + "</select></section>"


def _filled(template: str, values: list, literal: Callable) -> list:
    """The template's pieces in order, literal ones and values."""
    return [values[int(x)] if k % 2 else literal(x) for k, x in enumerate(re.split(r"\{(\d)\}", template)) if x]


def edge_cards(left: pa.Array, right: pa.Array, similarity: np.ndarray, strength: pa.Array, relation: pa.Array) -> pa.Array:
    """The cards of many edges, whose keys are escaped already; a similarity has at most 6 digits, or is nan where there is none."""
    text = pc.cast(pa.array(similarity), pa.string())
    own = ~((similarity >= 1e-4) & (similarity < 1.0))  # of these Arrow's text isn't Python's
    if own.any():
        text = pc.replace_with_mask(text, pa.array(own), pa.array(["None" if math.isnan(x) else repr(x) for x in similarity[own].tolist()], pa.string()))
    return pc.binary_join_element_wise(*_filled(EDGE, [left, right, text, strength, relation], lambda x: pa.scalar(x)), "")


def entity_cards(entities: DataFrame, tracklets: DataFrame) -> DataFrame:
    """entity_id and its card; tracklets: key, video, local_track_id."""
    escaped = lambda c: reduce(lambda x, y: F.replace(x, F.lit(y[0]), F.lit(y[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")), c)
    fill = lambda template, *values: F.concat(*_filled(template, values, F.lit))
    one = tracklets.select(F.col("key").alias("member"), "video", "local_track_id").dropDuplicates(["member"])
    item = F.struct("position", fill(MEMBER, escaped(F.col("video")), F.col("local_track_id").cast("string")).alias("text"))
    grouped = entities.join(one, "member").groupBy("entity_id").agg(F.max("semantics").alias("semantics"), F.sort_array(F.collect_list(item)).alias("items"))
    return grouped.select("entity_id", fill(ENTITY, escaped(F.col("entity_id")), escaped(F.col("semantics")), F.array_join("items.text", "")).alias("card"))


def graph_html(document: dict) -> str:
    """A page with a card for each entity and edge, and controls that export reviews; all text is escaped."""
    e = lambda x: html.escape(str(x), quote=True)
    entities = "".join(ENTITY.format(e(g["entity_id"]), e(g["semantics"]), "".join(MEMBER.format(e(m["video"]), e(m["local_track_id"])) for m in g["members"])) for g in document["entities"])
    edges = "".join(EDGE.format(*(e(x[c]) for c in ("left", "right", "similarity", "strength", "relation"))) for x in document["edges"])
    script = "function exportReview(){const d=[...document.querySelectorAll('.edge')].map(x=>({left:x.dataset.left,right:x.dataset.right,decision:x.querySelector('select').value})).filter(x=>x.decision);const a=document.createElement('a');a.href=URL.createObjectURL(new Blob([JSON.stringify({version:1,decisions:d})]));a.download='review.json';a.click()}"
    return f"<!doctype html><meta charset=utf-8><title>Similarity graph</title><p>Links between people mean similar visible appearance in this batch only, not identity.</p><button onclick=exportReview()>Export review</button><h2>Entities</h2>{entities}<h2>Edges</h2>{edges}<script>{script}</script>"


def snapshot_sidecar(image: Column, image_sha256: Column, model_sha256: Column, source: Column, frame: Column, view: Column, classification: Column, track: Column, **more: Column) -> Column:
    """The JSON beside a snapshot; track is a struct id, label, class_id, score, bbox, center, lifecycle, quality, recoveries.

    more: calibration (name, width, height, hfov_deg, vfov_deg) and derived_from (image, image_sha256) as structs, where there are any.
    """
    shown = F.struct(
        track["id"].alias("id"), track["label"].alias("label"), track["class_id"].alias("class_id"), rounded(track["score"], 6).alias("score"), F.transform(track["bbox"], lambda v: rounded(v, 3)).alias("bbox"),
        F.transform(track["center"], lambda v: rounded(v, 3)).alias("center"), track["lifecycle"].alias("lifecycle"), rounded(track["quality"], 4).alias("quality"), track["recoveries"].alias("recoveries"),
    )
    return F.to_json(F.struct(F.lit(1).alias("schema"), classification.alias("classification"), image.alias("image"), image_sha256.alias("image_sha256"), model_sha256.alias("model_sha256"), source.alias("source"), frame.alias("frame"), view.alias("view_mode"), shown.alias("track"), *(v.alias(k) for k, v in more.items())))
