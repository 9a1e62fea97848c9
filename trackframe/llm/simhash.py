"""Operator 10, SimHash near-dedup: vantage-point trees over fingerprints.

Fingerprints are per document, then grouped: a fingerprint is handled once however many documents have it. A rule (Rule)
says how many bits a fingerprint has and how many may differ, and cuts the bits into pieces. One family of vantage-point
trees for each piece is searched with the small radius that the rule gives, where triangle bounds prune well; every pair
found is verified on all bits.

* CONTRACT: 64 bits, 3-word shingles, at most 3 differing bits. They differ in at most one bit of the upper or of the
  lower half, so two pieces of 32 bits and radius 1 miss no pair.
* NEAR_COPIES: 256 bits, 5-word shingles, for texts that share 0.8 of their shingles (Jaccard). Those differ in 15 % of the
  bits, 39 with a deviation of 6; at most 56 link. 16 pieces of 16 bits, radius 1: exact up to 31 differing bits; at a
  similarity of 0.8 some piece differs in at most one bit with probability 0.994. Links are candidates only: keep_one()
  compares the shingle sets themselves.

The upper levels of the trees are built from a bounded sample (SAMPLE_A_LEAF fingerprints a leaf, at most LEAVES leaves);
their leaves are the shards. A fingerprint lives in one shard of each family, and goes as a query to every shard whose
boundary its radius overlaps. A shard of over FULL times its intended size (a clump that its piece doesn't part, or more
fingerprints than LEAVES shards hold) is searched as pairs of blocks, each a task of its own. Within a shard the tree goes
on to leaves of LEAF fingerprints, which are compared outright; larger sets that are equal on the piece are searched by the
distance on all bits, pairs left out only where other links join them. A shard gives back a spanning forest of the links
that it finds, not all pairs, so a group of a thousand neighbours gives a thousand rows; connectivity, and so the
components, are the same.

Null and empty texts have fingerprint zero, linked like any other. Repeated rows are rows with equal fingerprints. Null
ids take part; a component's id is its smallest id that isn't null. Other columns are ignored; an empty table gives an
empty result. Texts are taken whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.llm.common import LOWER, binary, cut, mix
from trackframe.operators.components import components

SEED, LEAF, SAMPLE_A_LEAF, LEAVES, FULL = 42, 64, 16, 32768, 8


@dataclass(frozen=True)
class Rule:
    """words 64-bit words a fingerprint; at most most differing bits; pieces a word, searched with radius."""

    shingle: int
    words: int
    most: int
    pieces: int
    radius: int
    shard: int

    def families(self) -> list[tuple[int, np.uint64]]:
        """Word number and mask of each piece."""
        width = 64 // self.pieces
        return [(w, np.uint64(((1 << width) - 1) << (width * k))) for w in range(self.words) for k in range(self.pieces)]


CONTRACT = Rule(shingle=3, words=1, most=3, pieces=2, radius=1, shard=8192)
NEAR_COPIES = Rule(shingle=5, words=4, most=56, pieces=4, radius=1, shard=32768)


def shingle_hashes(text: bytes, n: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each n-word shingle of a text, repeats included; of the whole sequence if that is shorter; none for no words."""
    tokens = text.translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= n:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-n] + 1)).tolist()
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends[n - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """Bits that are set in over half of the hashes; the first word is of the hashes themselves, further ones of mixes of them."""
    total = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        for w in range(words):
            bits = part if w == 0 else mix(part + np.uint64(w))
            total[w] += np.unpackbits(bits.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, rule: Rule = CONTRACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fp (binary, the words in little-endian order), same (128-bit hash of the set of shingles)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = binary(b.column(1))
            raw, at = memoryview(data), offsets.tolist()
            fps, sets = [], []
            for s, e in zip(at[:-1], at[1:], strict=True):
                hashes = shingle_hashes(bytes(raw[s:e]), rule.shingle)
                fps.append(fingerprint(hashes, rule.words).tobytes())
                sets.append(xxhash.xxh3_128_digest(np.unique(hashes).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "fp", "same"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp binary, same binary")


def matrix(column: pa.Array, words: int) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def _split(points: np.ndarray, mask: np.uint64) -> tuple[np.uint64, int] | None:
    """A vantage point and a distance that part the points; None if all are equal under the mask."""
    for v in points[:: max(1, len(points) // 8)][:8]:
        d = np.bitwise_count((points ^ v) & mask)
        low, high = int(d.min()), int(d.max())
        if low < high:
            return v, min(int(np.median(d)), high - 1)
    far = points[np.argmax(np.bitwise_count((points ^ points[0]) & mask))]
    return (far, 0) if (far ^ points[0]) & mask else None


def grow(points: np.ndarray, mask: np.uint64, leaves: int) -> list:
    """The upper tree: nested [vantage, distance, inside, outside], leaves numbered from 0."""
    numbers = iter(range(1 << 30))

    def node(p: np.ndarray, want: int) -> object:
        parted = _split(p, mask) if want > 1 and len(p) > 1 else None
        if parted is None:
            return next(numbers)
        inside = np.bitwise_count((p ^ parted[0]) & mask) <= parted[1]
        return [int(parted[0]), parted[1], node(p[inside], want // 2), node(p[~inside], want - want // 2)]

    return node(points, leaves)


def route(tree: object, fps: np.ndarray, mask: np.uint64, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf that is reached: its number, the rows that go there, and whether each lives there."""
    stack = [(tree, np.arange(len(fps)), np.ones(len(fps), bool))]
    while stack:
        node, rows, home = stack.pop()
        if not len(rows):
            continue
        if not isinstance(node, list):
            yield node, rows, home
            continue
        d = np.bitwise_count((fps[rows] ^ np.uint64(node[0])) & mask).astype(np.int16)
        to, out = d <= node[1] + radius, d > node[1] - radius
        stack.append((node[2], rows[to], home[to] & (d[to] <= node[1])))
        stack.append((node[3], rows[out], home[out] & (d[out] > node[1])))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest of its component, for the same components as the links a-b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if np.array_equal(new, label):
            moved = np.flatnonzero(label != np.arange(n))
            return moved, label[moved]
        label = new


def _apart(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[i] ^ fps[j]).sum(axis=-1, dtype=np.int64)


def _reached(fps: np.ndarray, ball: np.ndarray, shell: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A link from the ball to each row of the shell that any row of the ball is linked to; the ball is one component."""
    at = 0
    while at < len(ball) and len(shell):
        part = ball[at : at + max(1, (1 << 19) // len(shell))]
        at += len(part)
        near = np.bitwise_count(fps[part][:, None, :] ^ fps[shell][None, :, :]).sum(axis=-1, dtype=np.int64) <= most
        hit = near.any(axis=0)
        yield part[near.argmax(axis=0)[hit]], shell[hit]
        shell = shell[~hit]


def _clump(fps: np.ndarray, p: np.ndarray, q: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join p with q (which holds p) where no piece parts p: by the distance on all bits and the full radius.

    A pivot whose ball holds much of p is linked to the ball. What else is linked to a row of the ball is at most twice
    the radius from the pivot, and one link joins it. Else the pivot parts p as a vantage point.
    """
    stack = [(p, q)]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) <= LEAF:
            step = max(1, (1 << 19) // len(p))
            for at in range(0, len(q), step):
                part = q[at : at + step]
                i, j = np.nonzero(np.bitwise_count(fps[p][:, None, :] ^ fps[part][None, :, :]).sum(axis=-1, dtype=np.int64) <= most)
                yield p[i], part[j]
            continue
        dp, dq = _apart(fps, p[:1], p), _apart(fps, p[:1], q)
        inside = dp <= most
        if 4 * int(inside.sum()) >= len(p):
            ball = q[dq <= most]
            yield np.full(len(ball), p[0]), ball
            yield from _reached(fps, p[inside], q[(dq > most) & (dq <= 2 * most)], most)
            stack.append((p[~inside], q[~np.isin(q, p[inside], assume_unique=True)]))
            continue
        mu = min(int(np.median(dp)), int(dp.max()) - 1)
        stack.append((p[dp <= mu], q[dq <= mu + most]))
        stack.append((p[dp > mu], q[dq > mu - most]))


def search(fps: np.ndarray, homes: int, piece: tuple[int, np.uint64], rule: Rule) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (row, row) at most rule.most apart that join the first homes rows with all rows, as far as the piece's radius
    finds them. Pairs that other links join already may be left out."""
    word, mask = piece
    x = np.ascontiguousarray(fps[:, word])
    stack = [(np.arange(homes), np.arange(len(fps)))]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        parted = _split(x[p], mask) if len(p) > LEAF else None
        if parted is not None:
            v, mu = parted
            dp = np.bitwise_count((x[p] ^ v) & mask)
            dq = np.bitwise_count((x[q] ^ v) & mask).astype(np.int16)
            stack.append((p[dp <= mu], q[dq <= mu + rule.radius]))
            stack.append((p[dp > mu], q[dq > mu - rule.radius]))
            continue
        if len(p) > LEAF:
            yield from _clump(fps, p, q[np.bitwise_count((x[q] ^ x[p[0]]) & mask) <= rule.radius], rule.most)
            continue
        step = max(1, (1 << 19) // len(p))
        for at in range(0, len(q), step):
            part = q[at : at + step]
            i, j = np.nonzero(np.bitwise_count((x[p][:, None] ^ x[part][None, :]) & mask) <= rule.radius)
            i, j = p[i], part[j]
            near = np.flatnonzero(_apart(fps, i, j) <= rule.most)
            yield i[near], j[near]


def _links_of_shard(table: pa.Table, rule: Rule) -> pa.Table:
    home = table.column("home").to_numpy(zero_copy_only=False)
    order = np.argsort(~home, kind="stable")  # those that live here come first; all are queries
    fps, key = matrix(table.column("fp"), rule.words)[order], table.column("key").to_numpy()[order]
    kept: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
    size = 0
    for i, j in search(fps, int(home.sum()), rule.families()[table.column("family")[0].as_py()], rule):
        other = i != j
        kept.append(np.stack([i[other], j[other]]))
        size += int(other.sum())
        if size > 1 << 20:
            kept, size = [np.stack(forest(len(fps), *np.concatenate(kept, axis=1)))], 0
    a, b = forest(len(fps), *np.concatenate(kept, axis=1))
    return pa.table({"a": key[a], "b": key[b]})


def links(distinct: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """Links (a, b) between the keys of distinct fingerprints (key long, fp binary) that the rule joins."""
    count = distinct.count()
    leaves = 1
    while leaves < LEAVES and leaves * rule.shard < count:
        leaves *= 2
    families = rule.families()
    chosen = distinct.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_A_LEAF * leaves).select("fp").collect()
    sample = matrix(pa.array([bytes(r[0]) for r in chosen], pa.binary()), rule.words)
    trees = [grow(np.ascontiguousarray(sample[:, w]), mask, leaves) if leaves > 1 else 0 for w, mask in families]

    def routed(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        fps = matrix(b.column(1), rule.words)
        for k, (w, mask) in enumerate(families):
            for leaf, rows, home in route(trees[k], np.ascontiguousarray(fps[:, w]), mask, rule.radius):
                yield k, leaf, rows, home

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for k, leaf, rows, _ in routed(b):
                held[k, leaf] += len(rows)
        columns = [pa.array([x[0] for x in held], pa.int32()), pa.array([x[1] for x in held], pa.int32()), pa.array(list(held.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["family", "leaf", "n"])

    most = FULL * rule.shard
    sizes = distinct.select("key", "fp").mapInArrow(tally, "family int, leaf int, n long").groupBy("family", "leaf").agg(F.sum("n").alias("n"))
    blocks = {(r.family, r.leaf): -(-r.n // most) for r in sizes.filter(F.col("n") > most).collect()}  # one in `most` rows at most

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = b.column(0).to_numpy().view(np.uint64)
            for k, leaf, rows, home in routed(b):
                n = blocks.get((k, leaf), 1)
                mine = (part[rows] % np.uint64(n)).astype(np.int64)
                for i in range(n):  # block i of those that live here, with block j of all
                    for j in range(n):
                        lives, asks = home & (mine == i), mine == j
                        some = np.flatnonzero(lives | asks)
                        if len(some):
                            at = pa.array(rows[some])
                            fixed = [pa.array(np.full(len(some), x, np.int32)) for x in (k, leaf, i * n + j)]
                            yield pa.RecordBatch.from_arrays([*fixed, b.column(0).take(at), b.column(1).take(at), pa.array(lives[some])], ["family", "leaf", "pair", "key", "fp", "home"])

    dealt = distinct.select("key", "fp").mapInArrow(deal, "family int, leaf int, pair int, key long, fp binary, home boolean")
    return dealt.groupBy("family", "leaf", "pair").applyInArrow(lambda t: _links_of_shard(t, rule), "a long, b long")


def grouped(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Tables: of each row doc_id, fp, same and the fingerprint's key; of each key the least id and the component's root."""
    prints = cut(fingerprints(docs, rule, id_col, text_col).withColumn("key", F.xxhash64("fp")), "fingerprints")
    groups = cut(prints.groupBy("key", "fp").agg(F.min("doc_id").alias("least")), "groups")
    label = components(links(groups, rule))
    rooted = groups.join(label, groups.key == label.node, "left").select("key", "least", F.coalesce("component", "key").alias("root"))
    return prints, cut(rooted, "rooted", drop=[groups, label])


def near_duplicates(docs: DataFrame, rule: Rule = CONTRACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fp (binary), component_id (smallest doc_id that links lead to)."""
    prints, rooted = grouped(docs, rule, id_col, text_col)
    # Tables, so that both sides of a join are dealt out for it alone and a large component can be split.
    least = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    final = cut(rooted.join(least, "root").select("key", "component_id"), "final", drop=[least, rooted])
    return prints.join(final, "key").select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    high_first = F.concat(*(F.substring("fp", k, 1) for k in range(8, 0, -1)))
    return found.select("doc_id", F.lower(F.hex(high_first)).alias("fingerprint"), "component_id")


#: The first documents of a component that are compared with all others at once (twice as many each round), and bytes of
#: shingle hashes in one task.
LEADERS, TASK_BYTES = 32, 8 << 20


def _shingle_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, same, hashes (the sorted distinct shingle hashes as bytes)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = binary(b.column(1))
            raw, at = memoryview(data), offsets.tolist()
            for fro in range(0, len(b), 256):
                to = min(fro + 256, len(b))
                sets = [np.unique(shingle_hashes(bytes(raw[at[i] : at[i + 1]]), rule.shingle)).tobytes() for i in range(fro, to)]
                names = [xxhash.xxh3_128_digest(x) for x in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(fro, to - fro), pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "same", "hashes"])

    return docs.mapInArrow(run, "doc_id long, same binary, hashes binary")


def similarities(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of each left set with each right one; sets are sorted arrays of distinct numbers."""
    owner = np.repeat(np.arange(len(right)), [len(x) for x in right])
    every = np.concatenate(right) if right else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    out = np.zeros((len(left), len(right)))
    size = np.array([len(x) for x in right])
    for i, x in enumerate(left):
        lo, hi = np.searchsorted(every, x), np.searchsorted(every, x, side="right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(right))
        out[i] = shared / np.maximum(len(x) + size - shared, 1)
    return out


def _led(least: float):
    """Of some components (members; their first documents as leads) which member stays (1), goes (2) or is still open (0)."""

    def run(members: pa.Table, leads: pa.Table) -> pa.Table:
        sets = lambda t: [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
        roots, names, mine = members.column("root").to_numpy(), members.column("same").to_pylist(), sets(members)
        lead_root, lead_id = leads.column("root").to_numpy(), leads.column("doc_id").to_numpy()
        lead_name, theirs = leads.column("same").to_pylist(), sets(leads)
        state = np.zeros(len(roots), np.int32)
        for root in np.unique(lead_root):
            at = sorted(np.flatnonzero(lead_root == root).tolist(), key=lambda i: (lead_id[i], lead_name[i]))
            alike = similarities([theirs[i] for i in at], [theirs[i] for i in at])
            stays: list[int] = []
            for k in range(len(at)):
                if not any(alike[k, j] >= least for j in stays):
                    stays.append(k)
            first, kept = {lead_name[i] for i in at}, {lead_name[at[k]] for k in stays}
            m = np.flatnonzero(roots == root)
            near = (similarities([mine[i] for i in m], [theirs[at[k]] for k in stays]) >= least).any(axis=1)
            state[m] = [1 if names[i] in kept else 2 if names[i] in first or n else 0 for i, n in zip(m, near, strict=True)]
        return pa.table({"root": members.column("root"), "same": members.column("same"), "state": pa.array(state)})

    return run


def _first_of_their_kind(open_: DataFrame, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """root and same of those of open_ (root, doc_id, same, hashes) that no earlier one that stays is similar to; and its tables.

    In order of doc_id: a set of shingles stays unless one that stays before it in its component is similar. A round compares
    all sets of a component with its first ones; what is still open goes on to a round with twice as many. Small components
    share tasks, large ones are dealt to several.
    """
    leaders, tables = LEADERS, []
    open_ = cut(open_, "open")
    stay = open_.limit(0).select("root", "same")
    while True:
        sizes = cut(open_.groupBy("root").agg(F.sum(F.octet_length("hashes") + 64).alias("bytes")), "sizes")
        whole = sizes.agg(F.sum("bytes")).first()[0]
        if not whole:
            return stay, [*tables, open_, sizes]
        shares, large = max(1, -(-int(whole) // TASK_BYTES)), F.col("bytes") > TASK_BYTES
        task = F.when(large, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(shares)))
        parts = F.when(large, F.ceil(F.col("bytes") / TASK_BYTES)).otherwise(1).cast("int")
        tasks = sizes.select("root", task.alias("task"), parts.alias("parts"))
        first = F.row_number().over(Window.partitionBy("root").orderBy("doc_id", "same"))
        leads = open_.select("root", "doc_id", "same").withColumn("n", first).filter(F.col("n") <= leaders).select("root", "same")
        leads = cut(open_.join(leads, ["root", "same"]), "leads")
        members = open_.join(tasks, "root").withColumn("part", F.pmod(F.xxhash64("same"), F.col("parts")).cast("int"))
        asked = leads.join(tasks, "root").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys, columns = ("task", "parts", "part"), ("task", "parts", "part", "root", "doc_id", "same", "hashes")
        renamed = [df.select(*columns).toDF(*columns) for df in (members, asked)]  # both read the same tables
        judged = renamed[0].groupBy(*keys).cogroup(renamed[1].groupBy(*keys))
        state = cut(judged.applyInArrow(_led(least), "root long, same binary, state int"), "state", drop=[leads, sizes])
        tables.append(state)
        stay = stay.unionByName(state.filter("state = 1").select("root", "same")) if len(tables) > 1 else state.filter("state = 1").select("root", "same")
        open_ = cut(open_.join(state.filter("state = 0").select("root", "same"), ["root", "same"]), "open", drop=[open_])
        leaders *= 2


def keep_one(docs: DataFrame, rule: Rule = NEAR_COPIES, least: float = 0.8) -> DataFrame:
    """The rows of docs without near copies: of texts whose sets of shingles have a similarity of least or more.

    Fingerprints give the components of candidates; in each, in order of doc_id, a document goes if it is similar to one
    that stays. So each that goes has a similar one that stays, and of those that stay no two candidates are similar.
    Rows that repeat an id go together, if all of them do. Rows without id stay.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints, rooted = grouped(slim, rule, "doc_id", "text")
    members = prints.join(rooted.select("key", "root"), "key").filter("doc_id IS NOT NULL").select("doc_id", "root", "same")
    members = cut(members, "members", drop=[prints, rooted])
    kinds = cut(members.groupBy("root", "same").agg(F.min("doc_id").alias("stays")), "kinds")  # one of each set of shingles
    several = cut(kinds.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root"), "several")
    rivals = cut(kinds.join(several, "root").select("root", "same", F.col("stays").alias("doc_id")), "rivals")
    texts = slim.join(rivals.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = _shingle_sets(texts, rule).join(rivals, ["doc_id", "same"]).select("root", "doc_id", "same", "hashes").dropDuplicates(["root", "same"])
    stay, tables = _first_of_their_kind(sets, least)
    alone = kinds.join(several, "root", "left_anti").select("root", "same")
    kept = cut(kinds.join(alone.unionByName(stay), ["root", "same"]), "kept", drop=[several, rivals, *tables])
    found = members.join(kept, ["root", "same"], "left").groupBy("doc_id").agg(F.bool_or(F.col("stays").eqNullSafe(F.col("doc_id"))).alias("stays"))
    gone = cut(found.filter("NOT stays").select("doc_id"), "near-copies", drop=[members, kinds, kept])
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
