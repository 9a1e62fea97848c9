"""The similarity graph of tracklets: reviewable edges, and entities that only strong complete links form.

Links between people mean similar visible appearance in this batch only, never identity.
"""

from __future__ import annotations

import html
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from trackframe.functions import tracks as T
from trackframe.functions.numbers import rounded
from trackframe.operators.components import components
from trackframe.operators.pairwise import Grown, chunks, ordinary
from trackframe.operators.tracklets import public
from trackframe.sources import sinks
from trackframe.sources.shared import cut

DECISIONS = ("same", "different", "unsure")
CANDIDATE, STRONG = 0.86, 0.94


def check_thresholds(candidate: float, strong: float) -> None:
    if not 0.0 <= candidate <= strong <= 1.0:
        raise ValueError("candidate and strong must be ordered within 0 and 1")


def items(tracklets: DataFrame) -> DataFrame:
    """Tracklets with a descriptor, their key, and the place in the graph's order as a struct."""
    place = F.struct(F.lower("label").alias("label"), F.lower("video").alias("video"), "local_track_id")
    return tracklets.filter("descriptor IS NOT NULL").withColumns({"key": T.tracklet_key(F.col("video"), F.col("local_track_id")), "place": place})


#: Tracklets of a class that are compared with as many others in one task.
BLOCK = 8192


def _narrow(c: str, kind: str) -> tuple[Column, Column]:
    """The numbers of an array as floats if they are floats (half the bytes to move), else as they are; one of both is null."""
    floats = F.col(c).cast(kind.replace("double", "float"))
    lossless = floats.cast(kind).eqNullSafe(F.col(c))
    return F.when(lossless, floats), F.when(~lossless, F.col(c))


def _dealt(tracklets: DataFrame, reviews: DataFrame | None, apart: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Tracklets and reviews once for each pair of blocks (class_id, i, j) that they belong to; types by column.

    apart: only the pairs of blocks so far apart, the last one being the first one's neighbour; a tracklet belongs to two at most.
    """
    rows = items(tracklets).filter("class_id IS NOT NULL").select(
        "class_id", "key", "video", "label", F.col("place.local_track_id").alias("p2"),
        F.col("descriptor").cast("array<double>").alias("descriptor"), F.coalesce("gallery", F.array()).cast("array<array<double>>").alias("gallery"),
    )
    kinds = dict(rows.dtypes)
    for c, kind in (("descriptor", "array<double>"), ("gallery", "array<array<double>>")):
        floats, doubles = _narrow(c, kind)
        rows = rows.withColumns({f"{c}_floats": floats, c: doubles})
    # Counted with those that have no descriptor, so that no descriptor is read. At most 1/BLOCK of the rows.
    large = tracklets.groupBy("class_id").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).filter("blocks > 1 AND class_id IS NOT NULL")

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(large), "class_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
        return rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))

    rows = placed(rows)
    ahead = F.least(F.pmod(F.col("with") - F.col("block"), F.col("blocks")), F.pmod(F.col("block") - F.col("with"), F.col("blocks")))
    dealt = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).filter("true" if apart is None else ahead == apart)
    dealt = dealt.withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with"), "first": F.col("block") <= F.col("with")}).drop("blocks", "block", "with", "key")
    if reviews is not None:
        ends = placed(tracklets.filter("class_id IS NOT NULL").select("class_id", T.tracklet_key(F.col("video"), F.col("local_track_id")).alias("key"))).select("class_id", "key", "blocks", "block").distinct()
        known = reviews.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi"), "decision")
        known = known.join(ends.select(F.col("key").alias("lo"), "class_id", "blocks", "block"), "lo").join(ends.select(F.col("key").alias("hi"), "class_id", F.col("block").alias("with")), ["hi", "class_id"])
        known = known.filter("true" if apart is None else ahead == apart)
        dealt = dealt.unionByName(known.select("class_id", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "lo", "hi", "decision"), allowMissingColumns=True)
    else:
        dealt = dealt.withColumns({c: F.lit(None).cast("string") for c in ("lo", "hi", "decision")})
    # The groups are few and large: with more partitions than groups few of them share a task.
    spark = tracklets.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    dealt = dealt.repartition(parts, "class_id", "i", "j")  # what follows from other columns is made again where they arrive
    return dealt.withColumns({"key": T.tracklet_key(F.col("video"), F.col("p2")), "p0": F.lower("label"), "p1": F.lower("video")}), kinds


def _group(batches: Iterable[pa.RecordBatch]) -> tuple[pa.Table, pa.Table, int, int]:
    """What was dealt to one task: tracklets, reviews, and the numbers of the two blocks."""
    table = pa.Table.from_batches(batches).combine_chunks()
    told = table.column("first").is_null()
    mine = table.filter(pc.invert(told)).combine_chunks()
    for c, kind in (("descriptor", pa.list_(pa.float64())), ("gallery", pa.list_(pa.list_(pa.float64())))):
        floats, doubles = (pa.chunked_array(mine.column(x).chunks, mine.column(x).type).cast(kind) for x in (f"{c}_floats", c))
        at = pc.if_else(pc.is_valid(floats), pa.array(range(len(mine)), pa.int64()), pa.array(range(len(mine), 2 * len(mine)), pa.int64()))
        whole = floats if not floats.null_count else pa.chunked_array(floats.chunks + doubles.chunks, kind).combine_chunks().take(at)
        mine = mine.set_column(mine.schema.get_field_index(c), c, whole)
    return mine, table.filter(told), table.column("i")[0].as_py(), table.column("j")[0].as_py()


def pairs(tracklets: DataFrame, reviews: DataFrame | None = None, least: float = 0.0, only: Sequence[str] | None = None, digits: int | None = None, near: tuple[float, ...] = ()) -> DataFrame:
    """Each pair of one class once, in the graph's order, that is reviewed or has a similarity of least or more.

    class_id, l_key, r_key, l_label, p0 to p2 (the right one's place), similarity (null if there is none) and decision. Pairs
    within a video count only if a review says same. A class is dealt to blocks by hash, and each pair of blocks is one
    task's: it compares all pairs in numpy, see operators.pairwise. So a tracklet moves once for each block of its class, and
    no pair moves that isn't part of the result. Reviews are joined with the keys of both ends, never with pairs.

    only: the columns that are made at all. digits: similarities are right when rounded to so many digits and when compared
    with least and near, which takes far less than exact ones.
    """
    dealt, kind = _dealt(tracklets, reviews)
    source = {"class_id": ("class_id", 0), "l_key": ("key", 0), "r_key": ("key", 1), "l_label": ("label", 0), "p0": ("p0", 1), "p1": ("p1", 1), "p2": ("p2", 1)}
    names = list(only or (*source, "similarity", "decision"))
    kinds = {"class_id": kind["class_id"], "p2": kind["p2"], "similarity": "double"}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, told, i, j = _group(batches)
        if not len(mine):
            return
        ends = {c: mine.column(source[c][0]).combine_chunks() for c in names if c in source}
        for left, right, values, decisions in chunks(mine, told, i == j, least, digits, near):
            if len(left):
                at = (pa.array(left), pa.array(right))
                made = {c: v.take(at[source[c][1]]) for c, v in ends.items()}
                made |= {"similarity": pa.array(values, from_pandas=True), "decision": pa.array(decisions, pa.string()) if decisions else pa.nulls(len(left), pa.string())}
                yield pa.RecordBatch.from_arrays([made[c] for c in names], names)

    return dealt.groupBy("class_id", "i", "j").applyInArrow(compare, schema)


#: The columns of edges, and what of pairs each needs.
EDGES = {"left": "l_key", "right": "r_key", "label": "l_label", "similarity": "similarity", "strength": "similarity decision", "relation": "l_label", "review_decision": "decision"}


def edges(tracklets: DataFrame, reviews: DataFrame | None = None, candidate: float = CANDIDATE, strong: float = STRONG, only: Sequence[str] = tuple(EDGES)) -> DataFrame:
    """left, right, label, similarity (6 digits), strength, relation, review_decision, or only some; in no order, see ordered()."""
    check_thresholds(candidate, strong)
    needs = dict.fromkeys(c for name in only for c in EDGES[name].split() if c != "decision" or reviews is not None)
    shown = pairs(tracklets, reviews, candidate, list(needs), 6, (strong,))
    decision = F.col("decision") if reviews is not None else F.lit(None).cast("string")
    strength = F.when(decision.isin("same", "different"), "manual").when(F.col("similarity") >= strong, "strong").otherwise("review")
    made = {"left": F.col("l_key"), "right": F.col("r_key"), "label": F.col("l_label"), "similarity": rounded(F.col("similarity"), 6), "strength": strength, "relation": T.relation(F.col("l_label")), "review_decision": decision}
    return shown.select(*(made[c].alias(c) for c in only))


def edge_counts(tracklets: DataFrame, reviews: DataFrame | None = None, candidate: float = CANDIDATE) -> DataFrame:
    """How many edges() there are, as a column edges whose sum it is, and how many of them a review decides (manual).

    The same comparison of all pairs; each task counts what it finds, and no edge leaves it.
    """
    dealt, _ = _dealt(tracklets, reviews)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, told, i, j = _group(batches)
        every = manual = 0
        for left, _, _, decisions in chunks(mine, told, i == j, candidate, 0, ()) if len(mine) else ():
            every += len(left)
            manual += sum(d in ("same", "different") for d in decisions or ())
        yield pa.RecordBatch.from_arrays([pa.array([every], pa.int64()), pa.array([manual], pa.int64())], ["edges", "manual"])

    return dealt.groupBy("class_id", "i", "j").applyInArrow(count, "edges long, manual long")


#: Cards of edges in one part of the page.
CARDS = 20_000


def edge_pages(tracklets: DataFrame, reviews: DataFrame | None = None, candidate: float = CANDIDATE, strong: float = STRONG, mark: str | None = None) -> DataFrame:
    """The cards of all edges() as the graph's page has them, in parts and in no order: edges and manual (counts of edges and of
    those that a review decides) and cards (text). Cards are made where pairs are compared, so no edge is gathered or shuffled.

    With a mark the text stays where it is made, and found tells how often it holds the mark.
    """
    check_thresholds(candidate, strong)
    dealt, _ = _dealt(tracklets, reviews)

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, told, i, j = _group(batches)
        if not len(mine):
            return
        keys = pa.array([html.escape(str(k), quote=True) for k in mine.column("key").to_pylist()], pa.string())
        relation = pa.array(["same_appearance_candidate" if label is not None and label.lower() in T.PERSON_LABELS else "same_object_candidate" for label in mine.column("label").to_pylist()])
        for left, right, values, decisions in chunks(mine, told, i == j, candidate, 6, (strong,)):
            for at in range(0, len(left), CARDS):
                l, r, v = (x[at : at + CARDS] for x in (left, right, values))
                manual = np.array([d in ("same", "different") for d in decisions[at : at + CARDS]]) if decisions else np.zeros(len(l), bool)
                strength = pc.if_else(pa.array(manual), "manual", pc.if_else(pa.array(v >= strong), "strong", "review"))
                cards = sinks.edge_cards(keys.take(pa.array(l)), keys.take(pa.array(r)), np.floor(v * 1e6 + 0.5) / 1e6, strength, relation.take(pa.array(l)))
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(cards)], pa.int32()), cards), "")
                yield pa.RecordBatch.from_arrays([pa.array([len(l)], pa.int64()), pa.array([int(manual.sum())], pa.int64()), text if mark is None else pc.count_substring(text, mark).cast(pa.int64())], ["edges", "manual", last])

    last = "cards" if mark is None else "found"
    return dealt.groupBy("class_id", "i", "j").applyInArrow(render, f"edges long, manual long, {last} {'string' if mark is None else 'long'}")


def ordered(found: DataFrame) -> DataFrame:
    """Reviewed edges first, then by rounded similarity, missing ones last, then by keys."""
    manual = F.when(F.col("review_decision").isin("same", "different"), 0).otherwise(1)
    return found.orderBy(manual, F.desc_nulls_last("similarity"), "left", "right")


def with_endpoints(found: DataFrame, tracklets: DataFrame) -> DataFrame:
    """Edges with the first and last frame and the label of both ends; ends that aren't known stay null."""
    ends = tracklets.select(T.tracklet_key(F.col("video"), F.col("local_track_id")).alias("key"), "video", "first_frame", "last_frame")
    for side in ("left", "right"):
        found = found.join(ends.select(F.col("key").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ends.columns[1:])), side, "left")
    return found


#: Tracklets and links up to which a class is folded whole; beyond, the fold goes by connected components of links.
FEW = 200_000
#: Joins of nodes up to which the driver finds the components and they are broadcast (16 bytes each); links that a task
#: holds before it hands them on.
KNOWN, HELD = 1_000_000, 1 << 21


def _roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root with the sets of a[k] and b[k] joined; a set's root is one of its members, which is its own."""
    while True:
        l, r = root[a], root[b]
        apart = l != r
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        root[np.maximum(l, r)[apart]] = np.minimum(l, r)[apart]
        while (deeper := root[root] != root).any():
            root[deeper] = root[root[deeper]]


def _components(joins: DataFrame) -> DataFrame:
    """components() of at most KNOWN joins (a, b), found on the driver."""
    found = joins.toArrow()
    nodes, at = np.unique(np.concatenate([found.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    root = _roots(np.arange(len(nodes)), *np.split(at, 2))
    return F.broadcast(joins.sparkSession.createDataFrame(pa.table({"node": nodes, "component": nodes[root]}), "node long, component long"))


#: A row is a pair of linked nodes (own, star), a tracklet, more links of one, or its descriptor.
JOIN, MEMBER, MORE, VECTOR = 0, 1, 2, 3


def steps(places: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places, list after list, as bytes: 255 for so many places without one, then the rest to the next. And bytes by list."""
    step = np.diff(places, prepend=0)
    first = np.cumsum(size) - size
    step[first] = places[first]
    ends = np.cumsum(step // 255 + 1)
    out = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = step % 255
    return out, np.add.reduceat(step // 255 + 1, first) if len(first) else size


def places(steps: bytes) -> np.ndarray:
    """The places of one list of steps()."""
    found = np.frombuffer(steps, np.uint8)
    return np.cumsum(found, dtype=np.int64)[found != 255]


def _node(key: str = "key") -> Column:
    """The number by which the components of links know a tracklet."""
    return F.xxhash64("class_id", key)


def links(tracklets: DataFrame, reviews: DataFrame | None, strong: float, lean: bool = False, apart: int | None = None) -> DataFrame:
    """The tracklets and, packed with the later end, the links that entities() folds: strong or reviewed pairs.

    A tracklet is known in its class by a number, its block << 32 | its key's place in it: own. others: int32 places of keys
    in block, passes: a double for each (-1: reviewed as different). Besides the links a task gives its own forest, rows that
    link as few nodes as hold the same components together (without those reviewed as different); own and star are _node()
    there.

    lean: links that aren't reviewed, between ordinary() tracklets, have null passes, which the descriptors tell, and their
    others are steps(), one or two bytes a link where there are many. apart: only what blocks so far apart give, see _dealt().
    """
    dealt, kind = _dealt(tracklets, reviews, apart)
    dealt = dealt.withColumn("node", _node())
    fields = {"class_id": kind["class_id"], "p0": "string", "p1": "string", "p2": kind["p2"], "key": "string", "label": "string", "kind": "int", "own": "long", "block": "long", "others": "binary", "passes": "binary", "star": "long"}
    schema = ", ".join(f"{c} {t}" for c, t in fields.items())
    shape = to_arrow_schema(StructType.fromDDL(schema))

    def packed(values: np.ndarray, size: np.ndarray) -> pa.Array:
        ends = np.concatenate([[0], np.cumsum(size * values.itemsize)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])

    def rows_of(made: dict, n: int) -> Iterator[pa.RecordBatch]:
        if n:
            yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(n, f.type) for f in shape], schema=shape)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, told, i, j = _group(batches)
        if not len(mine):
            return
        n, first = len(mine), mine.column("first").to_numpy()
        code = np.empty(n, np.int64)
        keys = mine.column("key").to_pylist()
        for side in (True, False):
            rows = np.flatnonzero(first == side).tolist()
            place = {k: p for p, k in enumerate(sorted({keys[x] for x in rows if keys[x] is not None}))}
            code[rows] = [place.get(keys[x], len(place)) for x in rows]
        block = np.where(first, i, j)
        own, node = block << 32 | code, mine.column("node").to_numpy()
        column = {c: mine.column(c).combine_chunks() for c in ("class_id", "p0", "p1", "p2", "key", "label")}
        take = lambda at, names: {c: column[c].take(pa.array(at)) for c in names}
        every = np.arange(n)
        if i == j:
            yield from rows_of(take(every, column) | {"kind": pa.array(np.full(n, MEMBER)), "own": pa.array(own)}, n)

        def hand(l: np.ndarray, r: np.ndarray, passes: np.ndarray, told: bool) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((code[l], r))
            l, passes = l[order], passes[order]
            at, size = np.unique(r, return_counts=True)
            ends, a = np.cumsum(size), 0
            while a < len(at):  # about 1 MB a batch
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + 80_000)))
                part = slice(ends[a] - size[a], ends[b - 1])
                links = {"others": packed(code[l[part]].astype(np.int32), size[a:b]), "passes": packed(passes[part], size[a:b])} if told else {"others": packed(*steps(code[l[part]], size[a:b]))}
                links |= {"kind": pa.array(np.full(b - a, MORE)), "own": pa.array(own[at[a:b]]), "block": pa.array(np.full(b - a, i) if i == j else i + j - block[at[a:b]])}
                yield from rows_of(take(at[a:b], ("class_id", "p0", "p1", "p2", "key")) | links, b - a)
                a = b

        def hand_all() -> Iterator[pa.RecordBatch]:
            l, r, passes, told = (np.concatenate([x[k] for x in held]) for k in range(4))
            for some in (True, False):
                if (told == some).any():
                    yield from hand(l[told == some], r[told == some], passes[told == some], some)

        plain = ordinary(mine) if lean else np.zeros(n, bool)
        held, many, root = [], 0, every.copy()
        for l, r, passes, decisions in chunks(mine, told, i == j, strong):
            if decisions:
                said = np.array(decisions, dtype=object)
                passes = np.where(said == "different", -1.0, np.where(said == "same", 1.0, np.where(passes >= strong, passes, np.nan)))
                l, r, passes = (x[~np.isnan(passes)] for x in (l, r, passes))
            joins = passes >= 0
            root = _roots(root, l[joins], r[joins])
            held.append((l, r, passes, np.ones(len(l), bool) if decisions is not None else ~(plain[l] & plain[r])))
            many += len(l)
            if many >= HELD:
                yield from hand_all()
                held, many = [], 0
        if many:
            yield from hand_all()
        at = np.flatnonzero(root != every)
        yield from rows_of(take(at, ["class_id"]) | {"kind": pa.array(np.full(len(at), JOIN)), "own": pa.array(node[at]), "star": pa.array(node[root[at]])}, len(at))

    found = dealt.groupBy("class_id", "i", "j").applyInArrow(compare, schema)
    if apart:
        return found
    single = items(tracklets).filter("class_id IS NULL").select("class_id", F.col("place.label").alias("p0"), F.col("place.video").alias("p1"), F.col("place.local_track_id").alias("p2"), "key", "label", F.lit(MEMBER).alias("kind"), F.xxhash64("key").alias("own"))
    return found.unionByName(single, allowMissingColumns=True)


def entities(tracklets: DataFrame, reviews: DataFrame | None = None, strong: float = STRONG) -> DataFrame:
    """entity_id, label, semantics, member (key), position in the entity.

    Complete linkage in the graph's order: a tracklet joins the entity whose least similar member is nearest to it, if all
    members are strong matches or reviewed as same, none is reviewed as different, and none is of the same video unless
    reviewed as same. Only strong or reviewed pairs reach the fold, packed by tracklet. All members of an entity are linked to
    each other, so where there are many, tracklets are parted by connected components first (found from the tasks' forests)
    and each component is one task's. It reads the component in the graph's order, holds its tracklets with their descriptors
    and the links of one of them, and looks only at entities that a link leads to: the work grows with the links, not with
    the square of the tracklets. A similarity that descriptors alone tell doesn't move with its link: the fold makes it again,
    to the last bit, where a tracklet could join more than one entity.
    """
    largest = tracklets.filter("class_id IS NOT NULL").groupBy("class_id").count().agg(F.max("count")).first()[0] or 0
    blocks = -(-largest // BLOCK)
    # Where there are many blocks, pairs of them that are as far apart are dealt at once: on disk are two copies of the tracklets at most.
    used = [cut(links(tracklets, reviews, strong, True, apart), "entity-rows") for apart in (range(blocks // 2 + 1) if blocks > 2 else [None])]
    rows = reduce(DataFrame.unionByName, used)
    bare = (F.col("kind") == MORE) & F.col("passes").isNull()
    many = F.when(F.col("kind") == MEMBER, 1).when(bare, F.length("others")).when(F.col("kind") == MORE, F.length("others") / 4)
    size, joined, untold = rows.agg(F.coalesce(F.sum(many), F.lit(0)), F.count_if(F.col("kind") == JOIN), F.count_if(bare)).first()
    parts = rows.filter(F.col("kind") != JOIN).withColumn("node", _node())
    floats, doubles = _narrow("descriptor", "array<double>")
    place = {f"p{k}": F.col(f"place.{c}") for k, c in enumerate(("label", "video", "local_track_id"))}
    vectors = items(tracklets).filter("class_id IS NOT NULL" if untold else "false").withColumns({"descriptor": F.col("descriptor").cast("array<double>"), **place})
    vectors = vectors.select("class_id", *place, "key", F.lit(VECTOR).alias("kind"), _node().alias("node"), floats.alias("floats"), doubles.alias("doubles"))
    if size <= FEW:
        parts, vectors = (x.withColumn("component", F.lit(0).cast("long")) for x in (parts, vectors))
    else:
        joins = rows.filter(F.col("kind") == JOIN).select(F.col("own").alias("a"), F.col("star").alias("b"))
        if joined <= KNOWN:
            linked = known = _components(joins)
        else:
            used.append(known := components(joins))
            linked = known.unionByName(known.select(F.col("component").alias("node"), "component").distinct())
        parts = parts.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        vectors = vectors.join(linked, "node")  # others have no links

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now = None, None
        heads, sizes, homes, near = [], [], {}, {}
        waiting, placed, plain, vector = [], [], [], None
        # For links without passes, where there are descriptors: a number in the component by block and place of a key, and by
        # that number the entity and the place of the descriptor.
        seats: dict[int, np.ndarray] = {}
        home, row, seated, vectors = np.empty(0, np.int64), np.empty(0, np.int64), 0, Grown()

        def put(values: np.ndarray, k: int, value: int) -> np.ndarray:
            if k >= len(values):
                values = np.concatenate([values, np.full(max(k + 1 - len(values), len(values)), -1)])
            values[k] = value
            return values

        def settle() -> Iterator[tuple]:
            """The tracklet whose links have all been read (all of them, if a key is repeated) finds its entity."""
            nonlocal home, row, seated, vector
            mine = -1 if vector is None else vectors.add(vector)
            others = np.concatenate([seats[b][at] for b, at in plain]) if plain else np.empty(0, np.int64)
            theirs = home[others].tolist()
            for key, label, own in waiting:
                met: dict[int, list[float]] = {}
                for other, passes in near.items():
                    for g in homes.get(other, ()) if passes >= 0 else ():
                        met.setdefault(g, []).append(passes)
                found = Counter(theirs)
                found.update({g: len(s) for g, s in met.items()})
                whole = [g for g, n in found.items() if n == sizes[g]]
                if len(whole) > 1:  # only then similarities matter
                    least = {g: min(met.get(g, (2.0,))) for g in whole}
                    if asked := [k for k, g in enumerate(theirs) if g in least]:
                        for k, s in zip(asked, vectors.cosines(mine, row[others[asked]], len(vector)).tolist(), strict=True):
                            least[theirs[k]] = min(least[theirs[k]], s)
                    whole = [min((-s, g) for g, s in least.items())[1]]
                mate = whole[0] if whole else len(heads)
                if not whole:
                    heads.append((key, label))
                    sizes.append(0)
                placed.append((own, mate))
                yield (key, label, *heads[mate], sizes[mate])
                sizes[mate] += 1
            for own, mate in placed:
                homes.setdefault(own, []).append(mate)
                if mine >= 0:
                    seats[own >> 32] = put(seats.get(own >> 32, np.empty(0, np.int64)), own & 0xFFFFFFFF, seated)
                    home, row, seated = put(home, seated, mate), put(row, seated, mine), seated + 1
            vector = None
            for held in (waiting, placed, plain, near):
                held.clear()

        for b in batches:
            out = []
            numbers = {c: (pc.fill_null(b.column(c).values, 0.0).to_numpy(zero_copy_only=False).astype(np.float64), b.column(c).offsets.to_numpy()) for c in ("floats", "doubles")}
            short = b.column("floats").is_valid().to_pylist()
            for k, (class_id, component, p0, p1, p2, key, label, kind, own, block, others, links) in enumerate(zip(*(c.to_pylist() for c in b.columns[:12]), strict=True)):
                if (class_id, component, p0, p1, p2, key) != now:
                    out += settle()
                    now = (class_id, component, p0, p1, p2, key)
                    if now[:2] != part:
                        part = now[:2]
                        for held in (heads, sizes, homes, seats):
                            held.clear()
                        home, row, seated, vectors = np.empty(0, np.int64), np.empty(0, np.int64), 0, Grown()
                if kind == MEMBER:
                    waiting.append((key, label, own))
                elif kind == VECTOR:
                    values, ends = numbers["floats" if short[k] else "doubles"]
                    vector = values[ends[k] : ends[k + 1]]
                elif links is None:
                    plain.append((block, places(others)))
                else:
                    for other, passes in zip((np.frombuffer(others, np.int32).astype(np.int64) + (block << 32)).tolist(), np.frombuffer(links).tolist(), strict=True):
                        before = near.get(other, passes)
                        near[other] = min(before, passes) if min(before, passes) < 0 else max(before, passes)
            yield table(out)
        yield table(list(settle()))

    names = ("member", "member_label", "head", "label", "position")
    table = lambda out: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string() if k < 4 else pa.int32()) for k in range(5)], names)
    order = ["class_id", "component", "p0", "p1", "p2", "key"]
    every = parts.unionByName(vectors, allowMissingColumns=True).repartition("class_id", "component").sortWithinPartitions(*order, "kind")
    dealt = every.select(*order, "label", "kind", "own", "block", "others", "passes", "floats", "doubles")
    folded = dealt.mapInArrow(fold, "member string, member_label string, head string, label string, position int")
    folded = cut(folded, "entities", drop=used)
    heads = folded.filter("position = 0").join(items(tracklets).select(F.col("key").alias("head"), "place"), "head")
    number = F.row_number().over(Window.partitionBy("prefix").orderBy("place"))
    named = heads.withColumn("prefix", T.entity_prefix(F.col("label"))).select("head", F.format_string("%s_%03d", "prefix", number).alias("entity_id"))
    return folded.join(named, "head").select("entity_id", "label", T.entity_semantics(F.col("label")).alias("semantics"), "member", "position")


def document(tracklets: DataFrame, reviews: DataFrame | None = None, candidate: float = CANDIDATE, strong: float = STRONG) -> dict:
    """The graph as one document, gathered on the driver: for reports of a reviewable size; see edge_pages() for others."""
    found = [r.asDict(True) for r in ordered(edges(tracklets, reviews, candidate, strong)).collect()]
    seen = {r["key"]: r.asDict(True) for r in public(items(tracklets).orderBy("place").drop("place", "key")).collect()}
    groups: dict[str, dict] = {}
    for r in entities(tracklets, reviews, strong).orderBy("entity_id", "position").collect():
        groups.setdefault(r.entity_id, {"entity_id": r.entity_id, "label": r.label, "semantics": r.semantics, "members": []})["members"].append(seen[r.member])
    return {"schema_version": 1, "thresholds": {"candidate": candidate, "strong": strong}, "tracklets": list(seen.values()), "entities": list(groups.values()), "edges": found, "review_decisions_applied": reviews.count() if reviews is not None else 0}
