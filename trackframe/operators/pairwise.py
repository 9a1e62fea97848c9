"""Similar pairs among two blocks of tracklets, in numpy: a bound for all pairs by matrix products, exact values for the rest.

The values are those of trackframe.functions.numbers (cosine, gallery_similarity, tracklet_similarity): sums go element by
element in the same order. A pair is left out only if its bound lies below the threshold by more than SLACK, which is far
above what matrix products round away; vectors with very large or no finite numbers have the bound 1. Where only rounded
values are asked for, the product stands for the value if nothing within SLACK of it rounds or compares otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Room for rounding in a bound; magnitude from which matrix products aren't trusted; numbers that are held at once.
SLACK, LARGE, AT_ONCE = 1e-9, 1e150, 1 << 18


class Vectors:
    """The vectors of a list column by their lengths. Without a use are null and zero vectors, empty ones and those with nulls."""

    def __init__(self, lists: pa.Array) -> None:
        self.length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(lists)
        values = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
        if flat.null_count:
            holes = np.repeat(np.arange(len(lists)), self.length)[pc.is_null(flat).to_numpy(zero_copy_only=False)]
        else:
            holes = np.zeros(0, np.int64)
        first = np.cumsum(self.length) - self.length
        self.length[holes] = 0
        self.place, self.norm, self.odd = np.zeros(len(lists), np.int64), np.zeros(len(lists)), np.zeros(len(lists), bool)
        self.columns: dict[int, np.ndarray] = {}
        for d in np.unique(self.length[self.length > 0]).tolist():
            rows = np.flatnonzero(self.length == d)
            columns = values[first[rows] + np.arange(d)[:, None]]
            squares = np.zeros(len(rows))
            with np.errstate(all="ignore"):
                for x in columns:
                    squares += x * x
                self.odd[rows] = ~(np.abs(columns).max(axis=0) < LARGE)
            self.place[rows], self.norm[rows], self.columns[d] = np.arange(len(rows)), np.sqrt(squares), columns
        self.length[self.norm <= 1e-12] = 0
        self.units: dict[int, np.ndarray] = {}

    def _unit(self, d: int, rows: np.ndarray) -> np.ndarray:
        """The vectors of length d of some rows, one after the other, at length 1."""
        if d not in self.units:
            held = np.flatnonzero(self.length == d)
            self.units[d] = np.zeros(self.columns[d].shape[::-1])
            with np.errstate(all="ignore"):
                self.units[d][self.place[held]] = (self.columns[d][:, self.place[held]] / self.norm[held]).T
        return self.units[d][self.place[rows]]

    def bound(self, some: np.ndarray, other: Vectors, theirs: np.ndarray) -> np.ndarray:
        """For each pair of the rows some and the other's rows theirs about its cosine, 1 where that isn't sure, -inf without one."""
        out = None
        for d in self.columns.keys() & other.columns.keys():
            a, b = np.flatnonzero(self.length[some] == d), np.flatnonzero(other.length[theirs] == d)
            if len(a) and len(b):
                with np.errstate(all="ignore"):
                    found = self._unit(d, some[a]) @ other._unit(d, theirs[b]).T
                    np.clip(found, 0.0, 1.0, out=found)
                found[self.odd[some[a]]] = 1.0
                found[:, other.odd[theirs[b]]] = 1.0
                if len(a) == len(some) and len(b) == len(theirs):
                    return found
                out = np.full((len(some), len(theirs)), -np.inf) if out is None else out
                out[np.ix_(a, b)] = found
        return np.full((len(some), len(theirs)), -np.inf) if out is None else out

    def cosine(self, some: np.ndarray, other: Vectors, theirs: np.ndarray) -> np.ndarray:
        """Of the pairs (some[k], theirs[k]): the cosine within 0 and 1, nan without one."""
        out = np.full(len(some), np.nan)
        for d in self.columns.keys() & other.columns.keys():
            fit = np.flatnonzero((self.length[some] == d) & (other.length[theirs] == d))
            for at in range(0, len(fit), 1 << 12):
                part = fit[at : at + (1 << 12)]
                l, r = some[part], theirs[part]
                inner = np.zeros(len(part))
                with np.errstate(all="ignore"):
                    for x, y in zip(self.columns[d], other.columns[d], strict=True):
                        inner += x[self.place[l]] * y[other.place[r]]
                    value = inner / (self.norm[l] * other.norm[r])
                out[part] = np.where(np.isnan(value), 1.0, np.clip(value, 0.0, 1.0) + 0.0)  # no negative zero
        return out


class Galleries:
    """The vectors of all galleries of a column one after the other, and where each row's begin."""

    def __init__(self, lists: pa.Array) -> None:
        self.size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.vectors = Vectors(pc.list_flatten(lists))

    def _every(self, rows: np.ndarray) -> np.ndarray:
        many = self.size[rows]
        return np.arange(many.sum()) + np.repeat(self.first[rows] - np.cumsum(many) + many, many)

    def cosines(self, some: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """About the cosine of every vector of the galleries of some rows with every one of theirs, see Vectors.bound."""
        return self.vectors.bound(self._every(some), self.vectors, self._every(theirs))

    def bound(self, each: np.ndarray, some: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """From their cosines at least the similarity of each pair of rows, all of which have galleries; -inf without one."""
        for rows, axis in ((some, 0), (theirs, 1)):
            size = self.size[rows]
            if (size == size[0]).all():  # far quicker than reduceat
                each = np.moveaxis(each, axis, 0)
                best = each[:: size[0]].copy()
                for k in range(1, size[0]):
                    np.maximum(best, each[k :: size[0]], out=best)
                each = np.moveaxis(best, 0, axis)
            else:
                each = np.maximum.reduceat(each, np.cumsum(size) - size, axis=axis)
        return each

    def odd(self) -> np.ndarray:
        """The rows whose galleries hold a vector with very large or no finite numbers."""
        total = np.concatenate([[0], np.cumsum(self.vectors.odd)])
        return total[self.first + self.size] > total[self.first]

    def similarity(self, some: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Of the pairs (some[k], theirs[k]): the mean of the best min(3, sizes, cosines) cosines, nan without one."""
        return self._means(some, theirs, lambda a, x, b, y: self.vectors.cosine(self.first[a] + x, self.vectors, self.first[b] + y))

    def about(self, some: np.ndarray, theirs: np.ndarray, each: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """The similarity of the same pairs from the cosines() of rows and columns, among which they are."""
        at = [np.zeros(len(self.size), np.int64) for _ in range(2)]
        for place, those in zip(at, (rows, columns), strict=True):
            place[those] = np.cumsum(self.size[those]) - self.size[those]

        def look(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> np.ndarray:
            found = each[at[0][a] + x, at[1][b] + y]
            return np.where(np.isneginf(found), np.nan, found)

        return self._means(some, theirs, look)

    def _means(self, some: np.ndarray, theirs: np.ndarray, look: Callable[..., np.ndarray]) -> np.ndarray:
        """look: gives the cosines of row a's vectors number x with row b's vectors number y."""
        many, out = self.size[some] * self.size[theirs], np.full(len(some), np.nan)
        at = 0
        while at < len(some):
            most = np.maximum.accumulate(many[at : at + AT_ONCE])
            to = at + max(1, int(np.searchsorted(most * np.arange(1, len(most) + 1), AT_ONCE, side="right")))
            a, b, n = some[at:to], theirs[at:to], many[at:to]
            if n.max():
                pair, k = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                wide = self.size[b][pair]
                table = np.full((len(n), n.max()), np.nan)
                table[pair, k] = look(a[pair], k // wide, b[pair], k % wide)
                scored = (~np.isnan(table)).sum(axis=1)
                best = -np.sort(-table, axis=1)  # nan last
                count = np.minimum(np.minimum(3, scored), np.minimum(self.size[a], self.size[b]))
                total = np.zeros(len(n))
                for c in range(min(3, best.shape[1])):
                    total += np.where(c < count, best[:, c], 0.0)
                out[at:to] = np.where(count > 0, total / np.maximum(count, 1), np.nan)
            at = to
        return out


class Grown:
    """Ordinary vectors that come one after the other, by their lengths. Their cosines are those of Vectors, to the last bit."""

    def __init__(self) -> None:
        self.rows: dict[int, np.ndarray] = {}
        self.norms: dict[int, np.ndarray] = {}
        self.many: dict[int, int] = {}

    def add(self, vector: np.ndarray) -> int:
        """The vector's number among those of its length."""
        d = len(vector)
        k = self.many[d] = self.many.get(d, -1) + 1
        if d not in self.rows:
            self.rows[d], self.norms[d] = np.empty((16, d)), np.empty(16)
        elif k == len(self.norms[d]):
            self.rows[d], self.norms[d] = (np.concatenate([x, np.empty_like(x)]) for x in (self.rows[d], self.norms[d]))
        self.rows[d][k] = vector
        with np.errstate(all="ignore"):
            self.norms[d][k] = np.sqrt(np.cumsum(vector * vector)[-1]) if d else 0.0
        return k

    def cosines(self, k: int, others: np.ndarray, d: int) -> np.ndarray:
        """Of the vector number k with others of its length d."""
        inner = np.cumsum(self.rows[d][others] * self.rows[d][k], axis=1)[:, -1]  # element by element, as Vectors adds
        return np.clip(inner / (self.norms[d][others] * self.norms[d][k]), 0.0, 1.0) + 0.0


def ordinary(rows: pa.Table) -> np.ndarray:
    """The rows whose similarity to each other, where they have one, is the cosine of two vectors that Grown can hold, and whose
    key is no other row's. rows: key, descriptor, gallery."""
    lists, keys = _whole(rows, "descriptor"), _codes(_whole(rows, "key"))
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(lists)
    with np.errstate(all="ignore"):
        wrong = ~(np.abs(pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False)) < LARGE)
    out = (keys >= 0) & (np.bincount(keys + 1)[keys + 1] == 1)
    out &= pc.fill_null(pc.list_value_length(_whole(rows, "gallery")), 0).to_numpy(zero_copy_only=False) == 0
    out[np.repeat(np.arange(len(lists)), length)[wrong]] = False
    return out


def _codes(column: pa.Array) -> np.ndarray:
    """A number for each distinct value, -1 for null."""
    return pc.fill_null(pc.dictionary_encode(column).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _ranks(table: pa.Table, by: tuple[str, ...]) -> np.ndarray:
    """Each row's place in the order of some columns, nulls first, the same for equals."""
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in by], null_placement="at_start").to_numpy()
    new = np.zeros(len(order), bool)
    for c in by:
        codes = _codes(table.column(c).combine_chunks())[order]
        new[1:] |= codes[1:] != codes[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _whole(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _settled(value: np.ndarray, digits: int, near: tuple[float, ...]) -> np.ndarray:
    """Whether all numbers within SLACK of a value round to the same and compare the same with the thresholds near."""
    power = float(10**digits)
    with np.errstate(invalid="ignore"):
        place = value * power + 0.5
        place -= np.floor(place)
        sure = (place > SLACK * power) & (place < 1.0 - SLACK * power)
        for t in near:
            sure &= np.abs(value - t) > SLACK
    return sure


def chunks(rows: pa.Table, reviews: pa.Table, inner: bool, least: float, digits: int | None = None, near: tuple[float, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list | None]]:
    """What similar() returns, in parts: first the reviewed pairs with their decisions, then the others, with None for those.

    digits: the values need only be right when rounded to so many digits and when compared with least and the thresholds near.
    """
    rank, video = _ranks(rows, ("p0", "p1", "p2")), _codes(_whole(rows, "video"))
    vectors, galleries = Vectors(_whole(rows, "descriptor")), Galleries(_whole(rows, "gallery"))
    first = _whole(rows, "first").to_numpy(zero_copy_only=False)
    order = np.argsort(rank, kind="stable")
    mine = order if inner else order[first[order]]
    theirs = mine if inner else order[~first[order]]

    def joined(value: np.ndarray, both: np.ndarray, seen: np.ndarray) -> np.ndarray:
        base = value[both]
        mixed = np.clip(seen * 0.7 + base * 0.3, 0.0, 1.0)
        value[both] = np.where(np.isnan(seen), base, np.where(np.isnan(base), seen, mixed))
        return value

    def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.flatnonzero(shows[a] & shows[b])
        return joined(vectors.cosine(a, vectors, b), both, galleries.similarity(a[both], b[both]))

    shows, odd = galleries.size > 0, vectors.odd | galleries.odd()
    at: dict[str, list[int]] = {}
    if len(reviews):
        for k, key in enumerate(rows.column("key").to_pylist()):
            at.setdefault(key, []).append(k)
    told = [(x, y, d) for lo, hi, d in zip(*(reviews.column(c).to_pylist() for c in ("lo", "hi", "decision")), strict=True) for x in at.get(lo, ()) for y in at.get(hi, ()) if rank[x] < rank[y] or (rank[y] < rank[x] and lo != hi)]
    l = np.array([x if rank[x] < rank[y] else y for x, y, _ in told], np.int64)
    r = np.array([y if rank[x] < rank[y] else x for x, y, _ in told], np.int64)
    decided = np.array([d is not None for *_, d in told], bool)
    apart = (video[l] >= 0) & (video[r] >= 0) & (video[l] != video[r])
    value = exact(l, r)
    shown = (apart | np.array([d == "same" for *_, d in told], bool)) & (decided | (value >= least))
    yield l[shown], r[shown], value[shown], [told[k][2] for k in np.flatnonzero(shown)]
    known = np.unique(l * len(rows) + r)

    wide = max(1, len(theirs), int(galleries.size[mine].max(initial=0) * galleries.size[theirs].sum()))
    step = max(1, AT_ONCE // wide)
    for k in range(0, len(mine), step):
        part, others = mine[k : k + step], theirs[k:] if inner else theirs  # of a block the later ones, in the graph's order
        about = bound = vectors.bound(part, vectors, others)
        some, those = np.flatnonzero(shows[part]), np.flatnonzero(shows[others])
        if mixed := len(some) > 0 and len(those) > 0:
            place, bound = np.ix_(some, those), about.copy()
            each = galleries.cosines(part[some], others[those])
            seen, base = galleries.bound(each, part[some], others[those]), about[place]
            with np.errstate(invalid="ignore"):
                bound[place] = np.where(np.isneginf(seen), base, np.where(np.isneginf(base), seen, seen * 0.7 + base * 0.3))
        open_ = np.flatnonzero(bound.ravel() >= max(least - SLACK, -1.0))
        x, y = np.divmod(open_, len(others))
        x, y = part[x], others[y]
        keep = (video[x] != video[y]) & (rank[x] < rank[y] if inner else rank[x] != rank[y])
        if (video < 0).any():
            keep &= (video[x] >= 0) & (video[y] >= 0)
        x, y, open_ = x[keep], y[keep], open_[keep]
        l, r = (x, y) if inner else (np.where(rank[x] < rank[y], x, y), np.where(rank[x] < rank[y], y, x))
        if len(known):
            new = ~np.isin(l * len(rows) + r, known)
            l, r, x, y, open_ = l[new], r[new], x[new], y[new], open_[new]
        if digits is None:
            value = exact(l, r)
        else:
            value = about.ravel()[open_]
            if mixed:
                value[np.isneginf(value)] = np.nan
                both = np.flatnonzero(shows[x] & shows[y])
                value = joined(value, both, galleries.about(x[both], y[both], each, part[some], others[those]))
            open_ = np.flatnonzero(odd[l] | odd[r] | ~_settled(value, digits, (least, *near)))
            value[open_] = exact(l[open_], r[open_])
        ok = value >= least
        yield l[ok], r[ok], value[ok], None


def similar(rows: pa.Table, reviews: pa.Table, inner: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Left row, right row, similarity (nan without one) and decision of each pair that is reviewed or reaches least.

    rows: key, video, p0 to p2 (the place in the graph's order), descriptor, gallery, and first, which tells the two blocks
    apart; inner: all rows are one block, each of its pairs counts once. reviews: lo, hi (keys) and decision.
    """
    left, right, values, decisions = zip(*chunks(rows, reviews, inner, least), strict=True)
    return np.concatenate(left), np.concatenate(right), np.concatenate(values), [d for v, told in zip(values, decisions, strict=True) for d in (told or [None] * len(v))]
